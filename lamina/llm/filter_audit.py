"""Filter interaction audit over failing-id relations.

Every filter has one stored table with the rows that fail it. The survivors of a prefix of filters depend
on the set of filters in it, not on their order, so the audit holds the survivors of all sets: a chain of
left-anti joins, one for each filter, in which every row is present with and without that filter and the
failing ids are taken away from the former. Rows that fail nothing survive every set; a left-semi join
with all failing ids keeps them out of the chain. Every join is on the row key, so the chain needs one
exchange of the rows and one of each id table.

All orders are then read off the counts by set: what a step removes is the difference of two of them.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

from lamina.durable import materialise, materialise_counted

SPACES = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HOT = 1000  # a text that more than one in HOT rows have is looked up by broadcast: fewer than HOT texts
COUNTS = ("kept", "good", "toxic")


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text that is not null."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    chars = F.length(text)
    upper = chars - F.length(F.translate(text, _UPPER, ""))
    return {
        "A": F.size(words) < 200, "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words), "C": 100 * upper > 3 * chars,
        "D": text.rlike(r"[#$%&*|]")}


def repeats_of_smaller(rows: DataFrame) -> DataFrame:
    """``row`` of each of ``rows`` (row, id, digest) whose digest some row with a smaller id has."""
    groups, count = materialise_counted(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("first")).where("members > 1"))
    total = rows.count() if count["rows"] else 0
    hot = groups.where(F.col("members") * HOT > total)  # fewer than HOT rows
    cold = groups.where(F.col("members") * HOT <= total)
    by_hot = rows.join(F.broadcast(hot.select("digest", "first")), "digest")
    others = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    return by_hot.unionByName(others.join(cold.select("digest", "first"), "digest")).where("id > first").select("row")


def survivors_by_set(rows: DataFrame, fails: Mapping[str, DataFrame]) -> DataFrame:
    """``(part, set, kept, good, toxic)`` for each part of ``rows`` and each of the 2^n sets of filters, zeros included.

    ``rows`` is (row, part, good, toxic) with a unique ``row``; each table of ``fails`` has the column ``row``. Bit k
    of ``set`` stands for the filter at place k.
    """
    sums = [F.count(F.lit(1)).alias("kept"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")]
    failing = reduce(DataFrame.unionByName, [ids.select("row") for ids in fails.values()])
    state = rows.join(failing, "row", "left_semi").withColumn("set", F.lit(0))
    for k, ids in enumerate(fails.values()):
        both = state.withColumn("added", F.explode(F.array(F.lit(False), F.lit(True))))
        gone = ids.select(F.col("row").alias("_gone"))
        state = both.join(gone, (F.col("row") == F.col("_gone")) & F.col("added"), "left_anti")
        state = state.withColumn("set", F.col("set") + F.when(F.col("added"), 1 << k).otherwise(0)).drop("added")
    touched = state.groupBy("part", "set").agg(*sums)
    clean = rows.join(failing, "row", "left_anti").groupBy("part").agg(*[s.alias(f"clean_{name}") for s, name in zip(sums, COUNTS)])
    sets = rows.select("part").distinct().withColumn("set", F.explode(F.sequence(F.lit(0), F.lit((1 << len(fails)) - 1))))
    full = sets.join(touched, ["part", "set"], "left").join(clean, "part", "left")
    return full.select("part", "set", *[(F.coalesce(n, F.lit(0)) + F.coalesce(f"clean_{n}", F.lit(0))).alias(n) for n in COUNTS])


def audit_orders(by_set: DataFrame, filters: str) -> DataFrame:
    """One row for each part, order of ``filters`` and step, from the counts by set."""
    n = len(filters)
    everything = (1 << n) - 1
    listed = F.array_sort(F.collect_list(F.struct("set", *COUNTS)))  # 2^n entries of a part
    parts = by_set.groupBy("part").agg(listed.alias("sets"))
    at = lambda mask, name: F.element_at(F.col("sets"), F.lit(mask) + 1 if isinstance(mask, int) else mask + 1)[name]
    kept = lambda mask: at(mask, "kept")
    fails, alone, shares = [], [], []
    for k in range(n):
        others = [s for s in range(everything + 1) if not s >> k & 1]
        fails.append(kept(0) - kept(1 << k))
        alone.append(kept(everything ^ 1 << k) - kept(everything))
        weight = lambda s: math.factorial(s.bit_count()) * math.factorial(n - 1 - s.bit_count())
        shares.append(sum(((kept(s) - kept(s | 1 << k)) * weight(s) for s in others), F.lit(0)))
    parts = parts.select("part", "sets", F.array(*fails).alias("fails"), F.array(*alone).alias("alone"), F.array(*shares).alias("shares"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    place = lambda step: F.instr(F.lit(filters), F.substring("filter_order", step, F.lit(1)))
    before = F.expr(f"aggregate(slice(split(filter_order, ''), 1, step - 1), 0, (s, f) -> s | shiftleft(1, instr('{filters}', f) - 1))")
    steps = steps.withColumn("before", before).withColumn("own", place(F.col("step"))).withColumn("after", F.expr("before | shiftleft(1, own - 1)"))
    own = lambda name: F.element_at(name, F.col("own"))
    lost = lambda name: at(F.col("before"), name) - at(F.col("after"), name)
    return steps.select(
        "part", "filter_order", "step", at(F.col("after"), "kept").alias("kept"), lost("kept").alias("removed"), (own("fails") - lost("kept")).alias("redundant"),
        own("alone").alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), own("shares").alias("shapley"))


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the filters A to E and step, with ``kept``, ``removed``, ``redundant``, ``unique_fails``,
    ``good_lost``, ``toxic_lost`` and ``shapley``; zeros included.

    A: under 200 words; B: under half of the words distinct; C: over 3 % of the characters are A-Z; D: holds one of
    ``#$%&*|``; E: another row of the table has the identical text and a smaller id. Null texts count as empty, a null
    part as the empty string. Every row counts, repeated ones too: rows of the same id never make each other fail E,
    nor does a null id, which fails it never. A document is good or toxic when any row of ``labels`` with its id
    (not null) says 1; nulls in labels say nothing. An empty table has no parts and gives no rows; very long
    texts are judged whole. Other columns, whatever their names, are not used.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rules = text_failures(text)
    compact = materialise(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), *[condition.alias(name) for name, condition in rules.items()]))
    fails = {name: materialise(compact.where(F.col(name)).select("row")) for name in rules}
    fails["E"] = materialise(repeats_of_smaller(compact.select("row", "id", "digest")))
    says = lambda name: F.coalesce(F.max(F.col(name) == 1), F.lit(False)).alias("good" if name == "quality" else name)
    told = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("id")).agg(says("quality"), says("toxic"))
    rows = compact.select("row", "id", "part").join(told, "id", "left")
    rows = materialise(rows.select("row", "part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")))
    return audit_orders(survivors_by_set(rows, fails), "".join(fails))
