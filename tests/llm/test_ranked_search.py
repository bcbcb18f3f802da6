"""Ball-tree search against the score of every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lamina.llm import ranked_search
from lamina.llm.ranked_search import rank_documents

DOCS = "doc_id bigint, text string, item_id bigint, rank string, score int"
ITEMS = "item_id bigint, text string, doc_id int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    counts = [Counter(terms(t)) for _, t in docs]
    n = sum(bool(c) for c in counts)
    total = sum(sum(c.values()) for c in counts)
    df = Counter(t for c in counts for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for (doc_id, _), c in zip(docs, counts):
            m = 10 + (90 * sum(c.values()) * n) // total if total else 10
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, rank, None if null else doc_id, -score) for rank, (score, null, doc_id) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def search(spark, docs, items, parts=3, k=10):
    d = spark.createDataFrame([(*x, 1, "r", 2) for x in docs], DOCS).repartition(parts)
    i = spark.createDataFrame([(*x, 3) for x in items], ITEMS)
    return sorted((tuple(r) for r in rank_documents(d, i, k).select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("sizes", [{}, {"TREE": 40, "LEAF": 3, "BLOCK_TERMS": 40, "BLOCK_ITEMS": 4}])
def test_against_all_scores(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(ranked_search, name, value)
    r = random.Random(13)
    words = [f"w{int(r.paretovariate(0.7)) % 200}" for _ in range(4000)] + ["É", "é", "STRASSE", "naïve", "x-y", "a_b", "10", " ", "日本 語"]
    text = lambda most: r.choice([" ", "-", "\n", "."]).join(r.choice(words) for _ in range(r.randrange(most)))
    docs = [(r.choice([k, k, k // 2, None]), r.choice([text(60), text(60), text(300), "same old words w1 w2 w3", None, ""])) for k in range(250)] + [(7777, "w5 " * 30_000), (1, "only"), (2, "only"), (0, "only")]
    items = [(k, text(25)) for k in range(12)] + [(50, "same OLD w3"), (50, "only"), (51, None), (52, "..."), (None, "naïve w9"), (53, "absent entirely")]
    assert search(spark, docs, items) == brute(docs, items)


def test_few_documents_and_empty_tables(spark):
    assert search(spark, [(3, "a b"), (4, "b")], [(1, "b"), (2, "c")], 1) == brute([(3, "a b"), (4, "b")], [(1, "b"), (2, "c")])
    assert search(spark, [], [(1, "b")]) == []
    assert search(spark, [(1, "b")], []) == []


def test_bounds_hold_for_every_node():
    r = np.random.default_rng(3)
    width, rows = 40, 400
    dense = r.integers(0, 900_000, (rows, width)) * (r.random((rows, width)) < 0.15)
    dense[:, 0] += 1
    starts = np.concatenate([[0], np.cumsum((dense > 0).sum(1))])
    terms_, values = np.nonzero(dense)[1], dense[dense > 0]
    own = [np.sort(r.choice(width, 6, replace=False)) for _ in range(9)]
    items = ranked_search.Items(list(range(9)), list(range(9)), np.arange(0, 60, 6), np.concatenate(own), [b""] * width)
    weights = r.integers(0, 20_000, width)
    tree = ranked_search.Tree(starts, terms_, values, items, weights)
    scores = np.stack([dense[:, q] @ weights[q] for q in own], 1)

    def reach(node):
        return np.concatenate([reach(c) for c in tree.children[node]]) if tree.children[node] else tree.rows[node]

    for node in range(len(tree.bounds)):
        assert (scores[reach(node)].max(0) <= tree.bounds[node]).all()
    best = tree.best(4, 10, [], np.arange(rows), values)
    assert sorted(best, reverse=True) == sorted(((int(s), -k) for k, s in enumerate(scores[:, 4]) if s > 0), reverse=True)[:10]
