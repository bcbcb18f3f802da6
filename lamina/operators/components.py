"""Connected components of edge tables by random contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lamina.durable import materialise, materialise_counted

BLOCK_EDGES = 1 << 20  # so many edges are left to one task


def _solve(table: pa.Table) -> pa.Table:
    """The largest node of each component, by union and find."""
    names, place = np.unique(np.concatenate([table.column("u").to_numpy(), table.column("v").to_numpy()]), return_inverse=True)
    root = list(range(len(names)))
    for a, b in zip(*place.reshape(2, -1).tolist()):
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        root[min(a, b)] = max(a, b)
    top = np.array(root, np.int64)
    while (top[top] != top).any():
        top = top[top]
    return pa.table({"node": names, "to": names[top]})


def component_roots(edges: DataFrame, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """``(node, root)`` for the ends of ``edges`` (u, v): the largest node of each one's component.

    A round lets every node point at the one of itself and its neighbours with the least hash, follows the pointers
    once more, renames the ends of the edges and drops those inside one component. Hashes differ from round to
    round, so a share of the nodes goes in each, however the nodes are linked: a long band, where pointers to the
    largest neighbour would all move up together, takes as few rounds as a star. One task solves the last ``block_edges``.
    """
    left, count = materialise_counted(edges.select(F.col("u").cast("bigint"), F.col("v").cast("bigint")).where("u <> v").distinct())
    if not count["rows"]:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).limit(0)
    steps: list[DataFrame] = []
    while count["rows"] > block_edges:
        lot = lambda node: F.struct(F.xxhash64(node, F.lit(len(steps))).alias("lot"), F.col(node).alias("node"))
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(lot("v")).alias("m"))
        up = materialise(least.select(F.col("u").alias("node"), F.least("m", lot("u"))["node"].alias("to")))
        step = materialise(up.join(up.select(F.col("node").alias("to"), F.col("to").alias("top")), "to").select("node", F.col("top").alias("to")))
        named = left.join(step.withColumnsRenamed({"node": "u", "to": "pu"}), "u").join(step.withColumnsRenamed({"node": "v", "to": "pv"}), "v")
        ahead, behind = F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")
        left, count = materialise_counted(named.where("pu <> pv").select(ahead, behind).distinct())
        steps.append(step)
    if count["rows"]:
        # bounded: at most block_edges edges
        steps.append(materialise(left.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(_solve, "node bigint, to bigint")))
    labels = steps[0].withColumnRenamed("to", "root")
    for step in steps[1:]:
        later = step.select(F.col("node").alias("root"), F.col("to").alias("later"))
        labels = labels.join(later, "root", "left").select("node", F.coalesce("later", "root").alias("root"))
    if len(steps) == 1 and count["rows"]:
        return labels
    labels = materialise(labels)
    largest = labels.groupBy("root").agg(F.max("node").alias("largest"))
    return labels.join(largest, "root").select("node", F.col("largest").alias("root"))
