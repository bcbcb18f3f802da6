"""Weighted graphs as edge tables ``(src, dst, w)``; undirected edges appear in both directions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lamina.checks import StrictModeError, require_none
from lamina.durable import materialise, materialise_counted
from lamina.operators.components import component_roots
from lamina.operators.numbering import previous_in_order

BLOCK_EDGES = 1 << 20  # edges of a block that one task solves
BROADCAST_NODES = 1 << 16  # a round's nodes go to every executor, through the driver, when there are at most so many


def undirected(df: DataFrame, src: str, dst: str, w: str) -> DataFrame:
    """Both directions of every edge, parallel edges reduced to the lightest."""
    ahead = df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.col(w).alias("w"))
    back = ahead.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return ahead.unionByName(back).groupBy("src", "dst").agg(F.min("w").alias("w"))


def neighbours_of(edges: DataFrame, node: object) -> DataFrame:
    """Neighbours of a node with the edge weights."""
    return edges.where(F.col("src") == F.lit(node)).select("src", "dst", "w")


def shortest_distances(edges: DataFrame, source: object) -> DataFrame:
    """Distance from ``source`` to every node it reaches, for weights of zero or more.

    Each round relaxes only the edges leaving nodes whose distance fell in the round before, and
    keeps the smallest candidate per node; it ends when nothing falls. Only a short round is broadcast, as
    all rounds together would else send many times the nodes through the driver.
    """
    edges = materialise(edges)
    require_none(edges.where("w < 0"), "negative weight")  # with one the rounds might never end
    node = edges.select(F.col("src").alias("node")).where(F.col("node") == F.lit(source)).limit(1)
    best = materialise(node.withColumn("dist", F.lit(0.0)))
    if best.isEmpty():
        raise StrictModeError(f"{source} is not a node")
    frontier, fell = best, {"rows": 1}
    while True:
        short = fell["rows"] <= BROADCAST_NODES
        steps = frontier.hint("broadcast" if short else "merge").join(edges, frontier["node"] == edges["src"])
        offers = steps.groupBy(F.col("dst").alias("node")).agg(F.min(F.col("dist") + F.col("w")).alias("offer"))
        better = offers.join(best.hint("merge"), "node", "left").where("dist IS NULL OR offer < dist")
        frontier, fell = materialise_counted(better.select("node", F.col("offer").alias("dist")))
        if not fell["rows"]:
            return best
        best = materialise(best.unionByName(frontier).groupBy("node").agg(F.min("dist").alias("dist")))


def all_distances(edges: DataFrame, source: object) -> DataFrame:
    """Every node with its distance from ``source``, infinite when out of reach."""
    edges = materialise(edges)
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    found = shortest_distances(edges, source)
    return nodes.join(found.hint("merge"), "node", "left").withColumn("dist", F.coalesce("dist", F.lit(float("inf"))))


def unreachable_count(distances: DataFrame) -> DataFrame:
    return distances.agg(F.count_if(F.col("dist") == F.lit(float("inf"))).alias("unreachable"))


def _solve_block(table: pa.Table) -> pa.Table:
    """Parents within one block: edges in the order of their upper ends, components kept by union and find."""
    lower, upper = table.column("u").to_numpy(), table.column("v").to_numpy()
    order = np.lexsort((lower, upper))
    names, place = np.unique(np.concatenate([lower[order], upper[order]]), return_inverse=True)
    low, up = place[:len(order)].tolist(), place[len(order):].tolist()
    root, parent = list(range(len(names))), [-1] * len(names)
    for a, b in zip(low, up):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        if a != b:
            root[a] = parent[a] = b
    some = np.flatnonzero(np.array(parent) >= 0)
    return pa.table({"node": names[some], "parent": names[np.array(parent, np.int64)[some]]})


def elimination_tree(entries: DataFrame, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """Parent of each column in the elimination tree of a symmetric pattern ``(i, j)``; 0 for roots.

    The parent of j is the smallest i > j that j reaches through columns below i. Only the components of
    the columns up to each i matter, so a range of columns is halved: the components of its lower half,
    seen from the upper one, are single columns, named by their largest. Such a column's parent is its first
    neighbour in the upper half, and its neighbours there, which elimination would make a clique, are as
    well held together by a path in ascending order. So edges never become more, and both halves go on
    on their own. There are as many rounds as it takes halvings to bring a range down to ``block_edges``
    edges; such a block is solved by one task. A column with very many entries is ordered over many tasks.
    """
    columns = entries.select(F.explode(F.array("i", "j")).alias("node")).distinct()
    below = entries.where("i <> j").select(F.least("i", "j").cast("bigint").alias("u"), F.greatest("i", "j").cast("bigint").alias("v")).distinct()
    span = below.agg(F.min("u"), F.max("v")).first()
    state, count = materialise_counted(below.select(F.lit(span[0]).cast("bigint").alias("lo"), F.lit(span[1]).cast("bigint").alias("hi"), "u", "v"))
    parents: list[DataFrame] = []
    while count["rows"]:
        sizes = state.groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("edges"))
        sized = state.join(sizes, ["lo", "hi"]).withColumn("mid", F.expr("lo + (hi - lo) div 2"))
        sized, count = materialise_counted(sized, large=F.col("edges") > block_edges)
        small = sized.where(F.col("edges") <= block_edges).select("lo", "hi", "u", "v")
        parents.append(materialise(small.groupBy("lo", "hi").applyInArrow(_solve_block, "node bigint, parent bigint")))
        if not count["large"]:
            break
        large = sized.where(F.col("edges") > block_edges).drop("edges")
        lower, upper = large.where("v <= mid"), large.where("u > mid")
        roots = component_roots(lower)
        between = large.where("u <= mid AND v > mid").join(roots, F.col("u") == F.col("node"), "left")
        between = between.select("lo", "hi", "mid", F.coalesce("root", "u").alias("root"), "v").distinct()
        paths = materialise(previous_in_order(between, ["root"], "v", "before"))
        parents.append(paths.where("before IS NULL").select(F.col("root").alias("node"), F.col("v").alias("parent")))
        inside = paths.where("before IS NOT NULL").select("lo", "hi", "mid", F.col("before").alias("u"), "v").unionByName(upper)
        onward = lower.select("lo", F.col("mid").alias("hi"), "u", "v").unionByName(inside.select((F.col("mid") + 1).alias("lo"), "hi", "u", "v"))
        state, count = materialise_counted(onward.distinct())
    found = reduce(DataFrame.unionByName, parents) if parents else columns.select("node", F.col("node").alias("parent")).limit(0)
    return columns.join(found, "node", "left").select("node", F.coalesce("parent", F.lit(0)).cast("bigint").alias("parent"))
