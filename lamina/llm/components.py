"""Connected components of an edge table by hooking to the smallest neighbour and contraction.

Each round aggregates the smallest neighbour of every node, follows that pointer once more, renames
the ends of the edges and drops those inside one component. The edges that are left shrink from round
to round and are written to the shared folder, so neither lineage nor data grows with the rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lamina.durable import materialise, materialise_counted


def smallest_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 and edges ``a``-``b``: the smallest node of each one's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch, at most one edge for each node that keeps the batch's components together."""
    for batch in batches:
        ends = np.concatenate([batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)])
        nodes, place = np.unique(ends, return_inverse=True)
        half = len(place) // 2
        label = smallest_labels(place[:half], place[half:], len(nodes))
        kept = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[kept]), pa.array(nodes[label[kept]])], ["a", "b"])


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for the ends of ``edges`` (two bigint columns); component is the smallest node.

    Rows with a null end are left out; loops and repeated edges do no harm.
    """
    a, b = edges.columns
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    nodes = pairs.where("a = b").select(F.col("a").alias("node"))
    left, count = materialise_counted(pairs.where("a <> b").mapInArrow(forest, "a bigint, b bigint"))
    steps = []
    while count["rows"]:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p")))
        step = materialise(up.join(up.select(F.col("a").alias("p"), F.col("p").alias("pp")), "p").select(F.col("a").alias("node"), F.col("pp").alias("p")))
        ends = left.join(step.withColumnsRenamed({"node": "a", "p": "pa"}), "a").join(step.withColumnsRenamed({"node": "b", "p": "pb"}), "b")
        moved = ends.where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct()
        left, count = materialise_counted(moved.mapInArrow(forest, "a bigint, b bigint"))
        steps.append(step)
    if not steps:
        return nodes.distinct().withColumn("component", F.col("node"))
    labels = steps[0].withColumnRenamed("p", "component")
    for step in steps[1:]:
        later = step.select(F.col("node").alias("component"), F.col("p").alias("later"))
        labels = labels.join(later, "component", "left").select("node", F.coalesce("later", "component").alias("component"))
    alone = nodes.distinct().join(steps[0].select("node"), "node", "left_anti").withColumn("component", F.col("node"))
    return labels.unionByName(alone)
