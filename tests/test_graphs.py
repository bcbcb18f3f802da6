"""Hierarchies, shortest paths, elimination trees and matrices against small brute force."""

import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.checks import StrictModeError
from lamina.operators import graph, hierarchy, krylov, lowrank, numbering, sparse
from tests.conftest import rows

CHIP = """Top Frame, Top Core, Frame Pad1, Frame Pad2, Core Row1, Core Row2, Core Row3, Row1 AND, Row1 INV,
Row2 OR, Row2 INV, Row2 INV, Row3 AND, Row3 INV"""


@pytest.fixture(scope="module")
def chip(spark):
    data = [(*pair.split(), k) for k, pair in enumerate(CHIP.replace("\n", " ").split(","))]
    return spark.createDataFrame(data, "ParentName string, ChildName string, ord int")


def test_chip_numbering(spark, chip):
    pairs = hierarchy.edges(chip, "ParentName", "ChildName")
    assert pairs.count() == 13
    numbers = hierarchy.topological_numbers(pairs)
    want = ["AND", "INV", "OR", "Pad1", "Pad2", "Frame", "Row1", "Row2", "Row3", "Core", "Top"]
    assert rows(numbers, "number", "name") == list(enumerate(want, 1))
    assert hierarchy.ordering_violations(pairs, numbers).isEmpty()


def test_chip_children(spark, chip):
    numbers, numbered, table = hierarchy.analyse_hierarchy(chip, ["ord"], "ParentName", "ChildName")
    assert numbered.count() == 14 and set(numbered.columns) >= {"CellNumber", "RefCellNumber"}
    children = {r["CellName"]: list(r["ChildrenNum"]) for r in table.collect()}
    assert children == {"Top": [6, 10], "Frame": [4, 5], "Core": [7, 8, 9], "Row1": [1, 2], "Row2": [3, 2], "Row3": [1, 2],
                        "AND": [], "INV": [], "OR": [], "Pad1": [], "Pad2": []}
    assert rows(hierarchy.top_cells(chip, table, "CellName", "ChildName")) == [("Top",)]


def test_cycle_is_an_error(spark):
    for loop in ([("A", "B"), ("B", "A")], [("T", "A"), ("A", "B"), ("B", "C"), ("C", "A"), ("C", "leaf")]):
        with pytest.raises(StrictModeError, match="cycle"):
            hierarchy.topological_levels(spark.createDataFrame(loop, "parent string, child string"))


def test_random_dag_property(spark):
    rng = random.Random(5)
    pairs = list({(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(240)) if a > b})
    df = spark.createDataFrame([(f"n{a:02}", f"n{b:02}") for a, b in pairs], "parent string, child string")
    numbers = dict(rows(hierarchy.topological_numbers(df), "name", "number"))
    assert sorted(numbers.values()) == list(range(1, len(numbers) + 1))
    assert all(numbers[f"n{b:02}"] < numbers[f"n{a:02}"] for a, b in pairs)


def test_array_of_first_seen(spark):
    from lamina.operators.grouping import as_array, first_seen_distinct

    df = spark.createDataFrame([("a", v, v) for v in range(5)], "k string, v int, ord int")
    seen = first_seen_distinct(df, ["k"], "v", ["ord"], "first")
    assert as_array(seen, ["k"], "v", "first", "vs").first()["vs"] == [0, 1, 2, 3, 4]


def dijkstra(edges, source):
    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    dist, heap = {source: 0.0}, [(0.0, source)]
    while heap:
        d, u = heapq.heappop(heap)
        if d > dist[u]:
            continue
        for v, w in near[u]:
            if d + w < dist.get(v, float("inf")):
                dist[v] = d + w
                heapq.heappush(heap, (d + w, v))
    return dist


def test_shortest_distances(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(40), rng.randrange(40), float(rng.randrange(1, 30))) for _ in range(90)] + [(100, 101, 1.0)]
    graph_df = graph.undirected(spark.createDataFrame(edges, "a int, b int, w double"), "a", "b", "w")
    want = dijkstra(edges, 0)
    assert dict(rows(graph.shortest_distances(graph_df, 0))) == want
    nodes = {v for e in edges for v in e[:2]}
    far = graph.all_distances(graph_df, 0)
    assert graph.unreachable_count(far).first()[0] == len(nodes) - len(want) >= 2
    near = {(b, w) for a, b, w in rows(graph_df, "src", "dst", "w") if a == 3}
    assert set(rows(graph.neighbours_of(graph_df, 3), "dst", "w")) == near
    with pytest.raises(StrictModeError):
        graph.shortest_distances(graph_df, 777)


def test_long_rounds_are_not_broadcast(spark, monkeypatch):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300), float(rng.randrange(1, 30))) for _ in range(900)]
    graph_df = graph.undirected(spark.createDataFrame(edges, "a int, b int, w double"), "a", "b", "w")
    plans, write = [], graph.materialise_counted

    def kept(df, **rows):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, **rows)

    monkeypatch.setattr(graph, "materialise_counted", kept)
    monkeypatch.setattr(graph, "BROADCAST_NODES", 20, raising=False)
    assert dict(rows(graph.shortest_distances(graph_df, 0))) == dijkstra(edges, 0)
    assert "BroadcastHashJoin" in plans[0] and any("BroadcastHashJoin" not in p for p in plans)


def etree(n, entries):
    """Parents by filling the matrix column by column."""
    m = np.zeros((n + 1, n + 1), bool)
    for i, j in entries:
        m[i, j] = m[j, i] = True
    parent = {}
    for j in range(1, n + 1):
        below = [i for i in range(j + 1, n + 1) if m[i, j]]
        for a in below:
            m[a, below] = m[below, a] = True
        parent[j] = below[0] if below else 0
    return parent


@pytest.mark.parametrize("seed", [0, 1, 2, 3])
def test_elimination_tree(spark, seed):
    rng = random.Random(seed)
    n = 14
    entries = [(k, k) for k in range(1, n + 1)] + [(rng.randrange(1, n + 1), rng.randrange(1, n + 1)) for _ in range(14)]
    got = dict(rows(graph.elimination_tree(spark.createDataFrame(entries, "i bigint, j bigint"))))
    assert got == etree(n, entries)
    dense = [(i, j) for i in (1, 2, 3) for j in (1, 2, 3)]
    assert rows(graph.elimination_tree(spark.createDataFrame(dense, "i bigint, j bigint"))) == [(1, 2), (2, 3), (3, 0)]


def dense(df, n):
    m = np.zeros((n, n))
    for i, j, v in rows(df, "i", "j", "v"):
        m[i - 1, j - 1] += v
    return m


def index(spark, n, name="i"):
    return spark.range(1, n + 1).withColumnRenamed("id", name)


def test_operators_match_dense_ones(spark):
    def band(n, d):
        return sum(v * np.eye(n, k=k) for k, v in d.items())

    d = sparse.FOURTH_ORDER
    assert np.array_equal(dense(sparse.banded(index(spark, 6), 6), 6), band(6, d))
    b, eye = band(4, d), np.eye(4)
    kron2 = np.kron(b, eye) + np.kron(eye, b)
    assert np.array_equal(dense(sparse.grid_operator(index(spark, 16, "cell"), (4, 4)), 16), kron2)
    small = sparse.banded(index(spark, 4), 4)
    both = sparse.add(sparse.kron_with_identity(small, 4), sparse.kron_with_identity(small, 4, True, 4))
    assert np.array_equal(dense(both, 16), kron2)
    r, e3 = band(3, sparse.RESISTIVE), np.eye(3)
    kron3 = np.kron(np.kron(r, e3), e3) + np.kron(np.kron(e3, r), e3) + np.kron(np.kron(e3, e3), r)
    got = dense(sparse.grid_operator(index(spark, 27, "cell"), (3, 3, 3), sparse.RESISTIVE), 27)
    assert np.array_equal(got, kron3)


def test_residual_and_solve(spark):
    rng = np.random.default_rng(1)
    n = 8
    low = np.tril(rng.uniform(0.5, 1, (n, n)))
    perm = rng.permutation(n)
    p = np.eye(n)[perm]
    a = p.T @ low @ low.T @ p
    frame = lambda m: spark.createDataFrame([(i + 1, j + 1, float(v)) for (i, j), v in np.ndenumerate(m) if v], "i bigint, j bigint, v double")
    vec = lambda v: spark.createDataFrame([(i + 1, float(x)) for i, x in enumerate(v)], "i bigint, x double")
    x = rng.uniform(size=n)
    order = spark.createDataFrame([(k + 1, int(q) + 1) for k, q in enumerate(perm)], "k bigint, p bigint")
    assert sparse.factor_residual(frame(a), frame(low), vec(x), order).first()[0] < 1e-12
    assert sparse.factor_residual(frame(a), frame(low * 1.1), vec(x), order).first()[0] == pytest.approx(0.21, abs=1e-9)
    y = [v for _, v in rows(sparse.multiply(frame(a), vec(x)))]
    assert np.allclose(y, a @ x)
    spd = a + n * np.eye(n)
    solved = [v for _, v in rows(sparse.solve_spd(frame(spd), vec(spd @ x)))]
    assert np.allclose(solved, x, atol=1e-7)
    with pytest.raises(StrictModeError, match="positive definite"):
        sparse.solve_spd(frame(-spd), vec(x))


@pytest.mark.parametrize("columns", [512, 4])
def test_gram(spark, monkeypatch, columns):
    monkeypatch.setattr(lowrank, "COLUMNS", columns)
    rng = np.random.default_rng(4)
    m = rng.normal(size=(50, 6))
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(m)], "id bigint, e array<double>").repartition(3)
    g = m.T @ m + 0.01 * np.eye(6)
    gram = lowrank.gram(df, "e", 0.01)
    assert np.allclose(dense(gram, 6), g)


def test_effective_rank(spark):
    from lamina.operators.grouping import effective_rank

    w = np.array([5.0, 3.0, 1.0, 0.5])
    p = w / w.sum()
    df = spark.createDataFrame([(float(v),) for v in w], "s double")
    assert effective_rank(df, "s").first()[0] == pytest.approx(np.exp(-(p * np.log(p)).sum()))
    assert effective_rank(df.withColumn("s", F.lit(2.0)), "s").first()[0] == pytest.approx(4.0)


def test_negative_weights_are_refused(spark):
    edges = spark.createDataFrame([("a", "b", -1.0), ("b", "a", -1.0)], "src string, dst string, w double")
    with pytest.raises(StrictModeError, match="negative"):
        graph.shortest_distances(edges, "a")


def pattern_parents(entries):
    """Elimination tree by components of growing column sets."""
    below, root, parent = {}, {}, {}
    for i, j in entries:
        below.setdefault(max(i, j), set()).add(min(i, j))
        root |= {i: i, j: j}
    for i in sorted(root):
        for j in below.get(i, ()):
            while root[j] != j:
                j = root[j]
            if j != i:
                parent[j] = root[j] = i
    return sorted((i, parent.get(i, 0)) for i in root)


def test_elimination_tree_by_halving(spark):
    r = random.Random(3)
    shapes = {
        "tree": [(i, r.randrange(1, i)) for i in range(2, 90)], "loop": [(i, i + 1) for i in range(1, 90)] + [(90, 1)],
        "random": [(r.randrange(1, 90), r.randrange(1, 90)) for _ in range(130)]}
    shift, entries = 0, []
    for own in shapes.values():
        entries += [(i + shift, j + shift) for i, j in own] + [(i + shift, j + shift) for i, j in own[:5]]
        shift += 90
    df = spark.createDataFrame(entries + [(900, 900)], "i bigint, j bigint")
    assert rows(graph.elimination_tree(df, 60)) == pattern_parents([*entries, (900, 900)])


def test_arrow_pattern_takes_few_rounds(spark, monkeypatch):
    rounds, once = [], graph.previous_in_order
    monkeypatch.setattr(graph, "previous_in_order", lambda *a: rounds.append(1) or once(*a))
    arrow = spark.range(2, 4097).selectExpr("id AS i", "1L AS j")
    tree = dict(rows_of(graph.elimination_tree(arrow, 3000)))
    assert tree == {k: k + 1 for k in range(1, 4096)} | {4096: 0} and len(rounds) < 20
    assert graph.elimination_tree(spark.createDataFrame([], "i bigint, j bigint")).collect() == []


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_previous_in_order(spark):
    r = random.Random(4)
    data = sorted({(r.choice([1, 1, 1, 2, 5, None]), r.randrange(900)) for _ in range(1500)}, key=lambda p: (p[0] is not None, p))
    got = numbering.previous_in_order(spark.createDataFrame(data, "k bigint, v bigint").repartition(5), ["k"], "v")
    want = [(k, v, data[n - 1][1] if n and data[n - 1][0] == k else None) for n, (k, v) in enumerate(data)]
    assert sorted(rows_of(got), key=str) == sorted(want, key=str)


# ---- general systems ------------------------------------------------------------------------

def dense_of(entries, n):
    a = np.zeros((n, n))
    for i, j, v in entries:
        a[i - 1, j - 1] += v
    return a


@pytest.mark.parametrize("kind", ["dominant", "convection", "zero diagonal"])
def test_general_solve(spark, kind):
    r, n = random.Random(len(kind)), 60
    if kind == "dominant":
        entries = [(i, r.randrange(1, n + 1), r.uniform(-1, 1)) for i in range(1, n + 1) for _ in range(4)] + [(i, i, 6.0) for i in range(1, n + 1)]
    elif kind == "convection":
        entries = [(i, i + k, v) for i in range(1, n + 1) for k, v in ((0, 2.0), (-1, -1.9), (1, -0.1)) if 1 <= i + k <= n]
    else:
        entries = [(i, i + k, v) for i in range(1, n + 1) for k, v in ((0, 0.0 if i % 7 == 3 else 3.0), (-1, 1.0), (1, -1.5)) if 1 <= i + k <= n]
    x = [r.uniform(-5, 5) for _ in range(n)]
    b = dense_of(entries, n) @ x
    got = krylov.solve(spark.createDataFrame(entries, "i bigint, j bigint, v double"), spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(b)], "i bigint, x double"), block_rows=25)
    assert [v for _, v in sorted(rows_of(got))] == pytest.approx(x, abs=1e-6)


def test_singular_system_is_refused(spark):
    matrix = spark.createDataFrame([(1, 1, 1.0), (1, 2, 1.0), (2, 1, 1.0), (2, 2, 1.0)], "i bigint, j bigint, v double")
    with pytest.raises(StrictModeError):
        krylov.solve(matrix, spark.createDataFrame([(1, 1.0), (2, 2.0)], "i bigint, x double"), patience=5)


def test_incomplete_factor_of_a_band_is_its_factor():
    n = 9
    entries = [(i, i + k, 4.0 if not k else -1.0 - i % 2) for i in range(n) for k in (-1, 0, 1) if 0 <= i + k < n]
    i, j, v = (np.array(x) for x in zip(*entries))
    starts = np.searchsorted(i, np.arange(n + 1))
    values, pivots = krylov.incomplete_factor(starts, j, v)
    b = np.arange(1.0, n + 1)
    z = krylov.triangular(starts, j, values, None, krylov.levels(starts, j, True), b)
    z = krylov.triangular(starts, j, values, pivots, krylov.levels(starts, j, False), z)
    assert z == pytest.approx(np.linalg.solve(dense_of([(a + 1, c + 1, d) for a, c, d in entries], n), b))


def test_components_of_a_long_band_take_few_rounds(spark, monkeypatch):
    from lamina.operators import components

    rounds, once = [], components.materialise_counted
    monkeypatch.setattr(components, "materialise_counted", lambda *a: rounds.append(1) or once(*a))
    band = spark.range(1, 1201).selectExpr("id AS u", "explode(array(id + 1, id + 5)) AS v")
    apart = spark.range(2000, 2300).selectExpr("id AS u", "id + 1000 AS v")
    got = dict(rows_of(components.component_roots(band.unionByName(apart), 100)))
    assert got == {k: 1205 if k < 2000 else max(k, k % 1000 + 3000) if k < 3000 else k for k in [*range(1, 1206), *range(2000, 2300), *range(3000, 3300)]}
    assert len(rounds) < 12
    assert rows_of(components.component_roots(band.where("u > v"))) == []
