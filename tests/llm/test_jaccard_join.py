"""The n-gram Jaccard join against brute force."""

import random

import numpy as np
import pytest

from lamina.llm import jaccard_join
from lamina.llm.components import connected_components
from lamina.llm.jaccard_join import ngram_jaccard_join, overlaps


def sets_of(text, size=5):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[k:k + size]) for k in range(max(1, len(words) - size + 1)))


def brute(rows):
    sets = [sets_of(t) for _, t in rows]
    n = len(rows)
    parent = list(range(n))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    links = [0] * n
    for a in range(n):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(n) if root(m) == root(k) and rows[m][0] is not None]
        out.append((i, len(sets[k]), min(ids, default=None), links[k]))
    return out


def corpus(seed, families=12, copies=14, words=60):
    r = random.Random(seed)
    word = lambda: "w%d" % r.randrange(400)
    passage = [word() for _ in range(30)]
    texts = []
    for _ in range(families):
        base = [word() for _ in range(words + r.randrange(60))]
        for _ in range(copies):
            own = list(base)
            for _ in range(r.randrange(6)):
                own[r.randrange(len(own))] = word()
            if r.random() < 0.4:
                own = passage + own
            texts.append(" ".join(own))
    texts += [" ".join(passage)] * 3 + ["a b", "A  b", "a b c", "", None, " \n\t", "x" * 40_000]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    return rows + [rows[0], (None, texts[0]), (None, "lone text of a row without any id")]


def key(row):
    return tuple((v is None, v or 0) for v in row)


@pytest.mark.parametrize("group,block", [(64, 1024), (3, 7), (2, 2)])
def test_brute_force(spark, monkeypatch, group, block):
    monkeypatch.setattr(jaccard_join, "GROUP", group)
    monkeypatch.setattr(jaccard_join, "ROW_BLOCK", block)
    monkeypatch.setattr(jaccard_join, "COLUMN_BLOCK", 500)
    rows = corpus(7 + group)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = ngram_jaccard_join(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows), key=key)


def test_empty_table_and_clashing_columns(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert ngram_jaccard_join(none).collect() == []
    extra = spark.createDataFrame([(1, "a b c d e f", 5, 6, "x")], "doc_id bigint, text string, n bigint, class bigint, component_id string")
    assert [tuple(r) for r in ngram_jaccard_join(extra).collect()] == [(1, 2, 1, 0)]


def test_overlaps():
    r = np.random.default_rng(1)
    rows = [np.unique(r.integers(0, 90, 60)).astype(np.uint64) for _ in range(70)]
    cols = [np.unique(r.integers(0, 120, 60)).astype(np.uint64) for _ in range(50)]
    pack = lambda sets: (np.array([len(s) for s in sets]), np.concatenate(sets))
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in cols] for a in rows]
    assert overlaps(pack(rows), pack(cols)).astype(int).tolist() == want


def test_components_of_a_long_chain(spark):
    order = list(range(400))
    random.Random(3).shuffle(order)
    edges = [(order[k], order[k + 1]) for k in range(399)] + [(900, 901), (950, 950), (901, 901), (None, 4)]
    df = spark.createDataFrame(edges, "x bigint, y bigint").repartition(5)
    got = dict(map(tuple, connected_components(df).collect()))
    assert got == {**dict.fromkeys(range(400), 0), 900: 900, 901: 900, 950: 950}


def test_sets_are_stored_tightly():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 48, n, dtype=np.uint64)) for n in (0, 1, 42, 43, 44, 330, 20_000)]
    sets += [np.arange(100, dtype=np.uint64), np.arange((1 << 48) - 300, 1 << 48, dtype=np.uint64)]
    stored = [jaccard_join._stored(s) for s in sets]
    sizes = np.array([len(s) for s in sets], np.int64)
    assert (jaccard_join._restored(stored, sizes) == np.concatenate(sets)).all()
    assert all(len(d) <= 6 * n for d, n in zip(stored, sizes)) and len(stored[5]) < 6 * 330 * 0.88
    for entries in (np.array([3, 65_535]), np.array([3, 65_536])):
        assert (jaccard_join._wide(jaccard_join._narrow(entries), 2) == entries).all()


def test_shared_passages_do_not_join_panels(spark, monkeypatch):
    """Passages that many documents share, more than the list holds, don't put unrelated documents into one panel."""
    r = random.Random(4)
    passages = [" ".join(f"p{k}.{n}" for n in range(20)) for k in range(60)]
    texts = [" ".join([f"{k}.{n}" for n in range(90)] + r.sample(passages, 3)) for k in range(600)]
    texts += [f"{t} end" for t in texts[:40]]
    rows = list(enumerate(texts))
    once, seen = jaccard_join.materialise, []

    def watched(df):
        seen.append(once(df))
        return seen[-1]

    monkeypatch.setattr(jaccard_join, "materialise", watched)
    monkeypatch.setattr(jaccard_join, "COMMON", 50)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = [tuple(x) for x in ngram_jaccard_join(df).collect()]
    assert sorted(got) == sorted(brute(rows))
    inside = next(t for t in seen if {"panel", "n"} <= set(t.columns))
    assert inside.groupBy("panel").count().agg({"count": "max"}).first()[0] == 2
