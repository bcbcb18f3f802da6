"""Filter interaction audit against a direct simulation of every order."""

import random
import re
from itertools import permutations

from lamina.llm import filter_audit
from lamina.llm.filter_audit import audit_filters

SCHEMA = "doc_id bigint, text string, lang string, row string, part int, kept boolean, id string"
LABELS = "doc_id bigint, quality int, toxic int, good int"


def failures(rows):
    smallest = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            smallest[text or ""] = min(smallest.get(text or "", doc_id), doc_id)
    for doc_id, text, _ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        yield "".join(name for name, fails in (
            ("A", len(words) < 200), ("B", 100 * len(set(words)) < 50 * len(words)), ("C", 100 * len(re.findall("[A-Z]", t)) > 3 * len(t)),
            ("D", bool(re.search(r"[#$%&*|]", t))), ("E", doc_id is not None and doc_id > smallest[t])) if fails)


def simulate(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    held = [(lang or "", doc_id in good, doc_id in toxic, fails) for (doc_id, _, lang), fails in zip(rows, failures(rows))]
    result, shapley = {}, {}
    for part in {h[0] for h in held}:
        own = [h for h in held if h[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for step, name in enumerate(order, 1):
                before = [h for h in own if not set(h[3]) & set(order[:step - 1])]
                gone = [h for h in before if name in h[3]]
                result[part, order, step] = (
                    len(before) - len(gone), len(gone), sum(name in h[3] for h in own) - len(gone), sum(h[3] == name for h in own), sum(h[1] for h in gone), sum(h[2] for h in gone))
                shapley[part, name] = shapley.get((part, name), 0) + len(gone)
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in result.items()}


def compare(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x", 1, True, "y") for r in rows], SCHEMA).repartition(4)
    told = spark.createDataFrame([(*x, 7) for x in labels], LABELS)
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in audit_filters(docs, told).collect()}
    assert got == simulate(rows, labels)


def test_against_simulation(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HOT", 10)  # some texts are hot here
    r = random.Random(11)
    many = [f"word{k}" for k in range(300)]
    texts = [" ".join(many[:k]) + end for k in (0, 1, 199, 200, 260) for end in ("", " Aa BB", "#", " é 😀")]
    texts += [" ".join(["a", "b"] * 120), "A " * 150 + " ".join(many), " ".join(many[:210]) + "\x0b\x1f", "", None, "z" * 200_000, "w " * 60_000]
    rows = [(r.choice([k, k // 2, None]), r.choice(texts), r.choice(["en", "de", None, ""])) for k in range(150)] + [(5, None, "fr"), (6, "", "fr"), (6, "", "fr")] + [(900 + k, "same", "en") for k in range(60)]
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 1, None])) for k in range(0, 160, 2)] + [(4, 1, 0), (None, 1, 1), (10_000, 1, 1)]
    compare(spark, rows, labels)


def test_rows_that_fail_nothing_and_no_labels(spark):
    text = " ".join(f"w{k}" for k in range(250))
    compare(spark, [(1, text, "en"), (2, text + " x", "en"), (None, text + " x", None)], [])


def test_empty_tables(spark):
    assert audit_filters(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)).collect() == []
