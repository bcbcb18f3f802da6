"""A stored index of boxes: sort-tile-recursive packing written as Parquet, searched by node boxes.

Boxes are ordered by the x of their centres and cut into slices, each slice by y and cut into leaves of equal
size, so a leaf holds neighbours. Both orders come from range partitioning and positions, whatever the
data's skew. Leaves go to files in their order, some to a part; a part is a folder of its own, and a small table
holds the box of every leaf. A search joins its windows with the leaf boxes and reads the parts that are
hit, and of their files the row groups of the leaves.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from lamina.durable import materialise
from lamina.operators.numbering import global_position
from lamina.operators.spatial import BOX, extent, overlap_join

LEAF_ROWS = 4096
PART_LEAVES = 64  # leaves in a part: files of some 10 MB at least
LISTED_PARTS = 1000  # so many parts are named in the scan's filter; more are found by the join alone
MOST_PARTS = 1000  # a larger table has larger parts, not more folders to list and commit


def write_index(boxes: DataFrame, box_id: str, path: str, leaf_rows: int = LEAF_ROWS, part_leaves: int = PART_LEAVES) -> None:
    """Write ``boxes`` (an id and ``xmin, ymin, xmax, ymax``, other columns too) to ``path``, which must not exist.

    Rows with a null in their box meet nothing and are left out.
    """
    whole = F.lit(True)
    for name in BOX:
        whole = whole & F.col(name).isNotNull()
    boxes = materialise(boxes.where(whole))
    leaves = max(1, -(-boxes.count() // leaf_rows))
    slice_rows = leaf_rows * math.ceil(math.sqrt(leaves))
    centre = lambda axis: F.col(f"{axis}min") / 2 + F.col(f"{axis}max") / 2
    across = global_position(boxes.withColumns({"_cx": centre("x"), "_cy": centre("y")}), ["_cx", box_id], "_pos")
    sliced = across.withColumn("_slice", F.expr(f"(_pos - 1) div {slice_rows}")).drop("_pos", "_cx")
    placed = global_position(sliced, ["_slice", "_cy", box_id], "_pos")
    part_leaves = max(part_leaves, -(-leaves // MOST_PARTS))
    leaf = placed.withColumn("leaf", F.expr(f"(_pos - 1) div {leaf_rows}")).withColumn("part", F.expr(f"leaf div {part_leaves}"))
    stored = leaf.drop("_slice", "_cy", "_pos")
    group = str(max(1 << 16, leaf_rows * 64))  # bytes of a row group, about a leaf's
    # positions come in ranges already: a task holds runs of neighbouring leaves
    ordered = stored.sortWithinPartitions("part", "leaf")
    ordered.write.partitionBy("part").option("parquet.block.size", group).option("parquet.page.size", group).parquet(f"{path}/boxes")
    written = boxes.sparkSession.read.parquet(f"{path}/boxes")
    nodes = written.groupBy("part", "leaf").agg(*extent(), F.count(F.lit(1)).alias("boxes"))
    nodes.coalesce(max(1, leaves // 100_000)).write.parquet(f"{path}/nodes")


def _scan(spark: SparkSession, path: str, hits: DataFrame) -> DataFrame:
    """The stored boxes of the parts in ``hits`` (part, leaf)."""
    stored = spark.read.parquet(f"{path}/boxes")
    parts = [r[0] for r in hits.select("part").distinct().limit(LISTED_PARTS + 1).collect()]
    if len(parts) > LISTED_PARTS:
        return stored
    span = hits.agg(F.min("leaf"), F.max("leaf")).first()
    return stored.where(F.col("part").isin(parts) & F.col("leaf").between(*span)) if parts else stored.limit(0)


def search_index(spark: SparkSession, path: str, windows: DataFrame, window_id: str, keep: list[str]) -> DataFrame:
    """Pairs of a stored box (columns ``keep``) and ``window_id`` that meet; touching counts.

    ``windows`` has ``xmin, ymin, xmax, ymax``; one with a null in it meets nothing.
    """
    nodes = spark.read.parquet(f"{path}/nodes")
    whole = windows.select(window_id, *BOX).dropna(subset=list(BOX))
    hits = materialise(overlap_join(nodes, whole, "leaf", window_id).join(nodes.select("leaf", "part"), "leaf"))
    asked = hits.join(whole.select(F.col(window_id), *[F.col(n).alias(f"_{n}") for n in BOX]), window_id)
    found = _scan(spark, path, hits).join(asked, ["part", "leaf"])
    c = F.col
    meets = (c("xmin") <= c("_xmax")) & (c("_xmin") <= c("xmax")) & (c("ymin") <= c("_ymax")) & (c("_ymin") <= c("ymax"))
    return found.where(meets).select(*keep, window_id)
