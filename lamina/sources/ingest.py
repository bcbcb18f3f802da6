"""From decoded layout records to the layout tables.

Decoding the binary stream is left to an exporter; these functions apply the rules by which
decoded shapes, references and labels become rows, and work out the cell boxes.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from lamina.durable import materialise
from lamina.operators.hierarchy import edges, topological_levels
from lamina.operators.polygons import coordinates_text, open_rectangle, ring_box, shape_type
from lamina.operators.spatial import BOX, extent, place_boxes


def geometry_rows(shapes: DataFrame) -> DataFrame:
    """``geometries`` from ``(cell, layer, datatype, ring)``: class and coordinate text.

    A rectangle written with five points, the last repeating the first, keeps four.
    """
    points = open_rectangle(F.col("ring"))
    return shapes.select(
        F.col("cell").alias("CellName"), F.col("layer").cast("bigint").alias("Layer"), F.col("datatype").cast("bigint").alias("DataType"),
        shape_type(F.col("ring")).alias("ShapeType"), coordinates_text(F.transform(points, lambda p: p["x"])).alias("X_JSON"),
        coordinates_text(F.transform(points, lambda p: p["y"])).alias("Y_JSON"))


def instance_rows(references: DataFrame) -> DataFrame:
    """``instances`` from references with optional magnification, rotation (radians) and repetition.

    A repetition counts when both numbers are given; spacing only matters to real arrays.
    """
    c = F.col
    both = c("columns").isNotNull() & c("rows").isNotNull()
    cols, rows = F.when(both, c("columns")).otherwise(1), F.when(both, c("rows")).otherwise(1)
    array = (cols > 1) | (rows > 1)
    spacing = lambda name: F.when(array, F.coalesce(c(name), F.lit(0.0))).otherwise(F.lit(0.0))
    return references.select(
        c("cell").alias("CellName"), c("ref").alias("RefCellName"), c("x").alias("X"), c("y").alias("Y"),
        F.coalesce("magnification", F.lit(1.0)).alias("MAG"), (F.coalesce("rotation", F.lit(0.0)) * F.lit(180.0 / math.pi)).alias("ANGLE"),
        F.coalesce("x_reflection", F.lit(False)).alias("IsXReflect"), array.alias("IsArray"),
        cols.cast("bigint").alias("Columns"), rows.cast("bigint").alias("Rows"), spacing("dx").alias("DX"), spacing("dy").alias("DY"))


def label_rows(labels: DataFrame) -> DataFrame:
    """``textlabels`` from ``(cell, layer, texttype, x, y, text)``."""
    c = F.col
    return labels.select(c("cell").alias("CellName"), c("layer").cast("bigint").alias("Layer"), c("texttype").cast("bigint").alias("TextType"),
                         c("x").alias("X"), c("y").alias("Y"), c("text").alias("Label"))


def cell_boxes(shapes: DataFrame, instances: DataFrame) -> DataFrame:
    """``bbox``: extent of every cell with all it contains, worked out level by level.

    A cell merges its own shapes with the boxes of its references, scaled, turned and repeated.
    Cells without any content have no box. There is one round per level of the hierarchy.
    """
    own = shapes.select(F.col("cell").alias("CellName"), *[v.alias(n) for n, v in ring_box(F.col("ring")).items()])
    own = materialise(own.groupBy("CellName").agg(*extent()))
    levels = materialise(topological_levels(edges(instances, "CellName", "RefCellName")))
    height = levels.agg(F.max("level")).first()[0] or 0
    upper = {n: n.upper() for n in BOX}
    known = own.join(levels.where("level > 0").select(F.col("name").alias("CellName")), "CellName", "left_anti")
    for level in range(1, height + 1):
        cells = levels.where(F.col("level") == level).select(F.col("name").alias("CellName"))
        child = known.select(F.col("CellName").alias("RefCellName"), *[F.col(n).alias(u) for n, u in upper.items()])
        used = instances.join(cells, "CellName", "left_semi").join(child, "RefCellName")
        placed = place_boxes(used.withColumns({u: F.col(u) * F.col("MAG") for u in upper.values()}))
        wide, high = (F.col("Columns") - 1) * F.col("DX"), (F.col("Rows") - 1) * F.col("DY")
        zero = F.lit(0.0)
        repeated = placed.select("CellName", (F.col("xmin") + F.least(wide, zero)).alias("xmin"), (F.col("ymin") + F.least(high, zero)).alias("ymin"),
                                 (F.col("xmax") + F.greatest(wide, zero)).alias("xmax"), (F.col("ymax") + F.greatest(high, zero)).alias("ymax"))
        here = repeated.unionByName(own.join(cells, "CellName", "left_semi")).groupBy("CellName").agg(*extent())
        known = known.unionByName(materialise(here))
    return known.select("CellName", *[F.col(n).alias(u) for n, u in upper.items()])
