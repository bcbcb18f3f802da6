"""Secret scan over a trigram index.

From each rule's pattern a Boolean query is derived: alternatives, each a set of trigrams that a match
must contain. The index holds posting lists (trigram, document) of every trigram that some rule asks for.
Queries intersect postings inside an alternative and unite alternatives; the documents they leave are
verified with the pattern. A rule with an alternative that has no mandatory trigram scans all documents.
Trigrams are compared in lower case, which can only add candidates. Only DataFrame functions run here.
"""

from __future__ import annotations

import re._constants as kinds
import re._parser as parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from lamina.durable import materialise

MOST_ALTERNATIVES = 64  # beyond it a part of a pattern counts as unknown, which widens the query


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # understood alike by both pattern languages in use
    group: int = 0  # the group that must have ``least`` characters
    least: int = 1
    any_case: bool = False


# The base kinds, in their order. A run's least length is part of its pattern.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)

_BREAK = None  # stands between two literal runs whose distance is unknown


def _runs(items) -> list[tuple]:
    """Alternatives of a parsed pattern, each a sequence of characters and breaks."""
    found: list[tuple] = [()]
    for name, value in items:
        if name is kinds.LITERAL:
            own = [(chr(value),)]
        elif name is kinds.IN and all(n is kinds.LITERAL for n, _ in value):
            own = [(chr(v),) for _, v in value]
        elif name is kinds.BRANCH:
            own = [r for part in value[1] for r in _runs(part)]
        elif name is kinds.SUBPATTERN:
            own = _runs(value[3])
        elif name is kinds.MAX_REPEAT and value[:2] == (0, 1) and all(n is kinds.LITERAL for n, _ in value[2]):
            own = [(), *_runs(value[2])]
        elif name is kinds.MAX_REPEAT and value[0] >= 1:
            own = [(*r, _BREAK) if value[1] > 1 else r for r in _runs(value[2])]
        else:
            own = [(_BREAK,)]
        joined = [a + b for a, b in product(found, own)]
        found = joined if len(joined) <= MOST_ALTERNATIVES else [a + (_BREAK,) for a in found]
    return found


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of mandatory trigrams in lower case; None if some match needs none."""
    alternatives = set()
    for run in _runs(parser.parse(pattern)):
        own, text = set(), ""
        for c in (*run, _BREAK):
            if c is not _BREAK:
                text += c.lower()
                continue
            own |= {text[k:k + 3] for k in range(len(text) - 2)}
            text = ""
        if not own:
            return None
        alternatives.add(frozenset(own))
    return sorted((a for a in alternatives if not any(b < a for b in alternatives)), key=sorted)


def _spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end) of a rule's matches, in code points, leftmost and apart from each other."""
    pattern = F.lit(("(?i)" if rule.any_case else "") + rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    sized = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length)
    gaps = F.transform(F.split(text, pattern, -1), F.length)  # what lies before each match
    matches = F.zip_with(F.arrays_zip(gaps.alias("gap"), F.transform(whole, F.length).alias("long")), sized, lambda m, own: F.struct(m["gap"].alias("gap"), m["long"].alias("long"), own.alias("own")))
    matches = F.filter(matches, lambda m: m["long"].isNotNull())
    none = F.array().cast("array<struct<start:int,end:int>>")

    def add(so_far: Column, m: Column) -> Column:
        start = so_far["at"] + m["gap"]
        found = F.array(F.struct(start.alias("start"), (start + m["long"]).alias("end")))
        return F.struct((start + m["long"]).alias("at"), F.when(m["own"] >= rule.least, F.concat(so_far["found"], found)).otherwise(so_far["found"]).alias("found"))

    return F.aggregate(matches, F.struct(F.lit(0).alias("at"), none.alias("found")), add, lambda all_: all_["found"])


def _named(spans: Column, rank: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def candidates(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``(id, kinds)``: documents that the trigram queries leave for each rule, from ``texts`` (id, low)."""
    spark = texts.sparkSession
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    wanted = sorted({t for q in queries.values() for a in q or () for t in a})
    asked = [(k, f"{kind} {n}", wanted.index(t), len(a)) for k, kind in enumerate(queries) for n, a in enumerate(queries[kind] or ()) for t in a]
    table = spark.createDataFrame(asked, "rule int, alternative string, trigram int, needed int")
    there = F.array(*[F.col("low").contains(t) for t in wanted]) if wanted else F.array().cast("array<boolean>")
    postings = materialise(texts.select("id", there.alias("there")).select("id", F.explode(F.array_compact(F.transform("there", lambda has, k: F.when(has, k)))).alias("trigram")).distinct())
    # the table of queries has as many rows as the rules have trigrams
    met = postings.join(F.broadcast(table), "trigram").groupBy("id", "rule", "alternative", "needed").agg(F.count(F.lit(1)).alias("met")).where("met = needed")
    return met.groupBy("id").agg(F.collect_set("rule").alias("kinds"))


def scan_secrets(docs: DataFrame, base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``found``, an array of (start, rank, end, kind) in that order.

    ``rank`` is a rule's place in ``base + more``. A null text counts as empty. Rows that share an id, or
    have none, share their candidate rules, and each is verified by its own text. Other columns are not
    used.
    """
    rules = (*base, *more)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text"))
    found = candidates(source.select("id", F.lower("text").alias("low")), rules)
    seen = source.join(found.withColumnRenamed("id", "of"), F.col("id").eqNullSafe(F.col("of")), "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    columns = []
    for rank, rule in enumerate(rules):
        due = F.lit(True) if trigram_query(rule.pattern) is None else F.coalesce(F.array_contains("kinds", rank), F.lit(False))
        hit = F.col("text").rlike(("(?i)" if rule.any_case else "") + rule.pattern)  # one pass where nothing is found
        spans = F.when(due & hit, _spans(F.col("text"), rule)).otherwise(none)
        columns.append(_named(spans, rank, rule.kind))
    return seen.select(F.col("id").alias(id_col), F.array_sort(F.concat(*columns)).alias("found"))


def span_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
