"""Queries: layout tables from decoded records."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from lamina.durable import shared_folder
from lamina.plans import standins as s
from lamina.plans.registry import query, table
from lamina.sources import ingest, stream_layout

ELEMENTS_IN_FILE = 500_000  # of a written stream

c = F.col


@query("io1_geometries", """WITH p AS (SELECT p_partkey AS x, p_size AS y, p_size % 4 + 1 AS k FROM part),
t AS (SELECT *, list_aggregate(list_transform(generate_series(0, k - 1), lambda i: (x + 2 * (k - i)) || '.0, ' || (x + 2 * (k - i) - 2) || '.0'), 'string_agg', ', ') AS xs,
  list_aggregate(list_transform(generate_series(0, k - 1), lambda i: (y + i + 1) || '.0, ' || (y + i + 1) || '.0'), 'string_agg', ', ') AS ys FROM p)
SELECT 'P' || x AS "CellName", CAST(y % 5 AS BIGINT) AS "Layer", CAST(0 AS BIGINT) AS "DataType", CASE WHEN k = 1 THEN 'Box' ELSE 'Polygon' END AS "ShapeType",
 '[' || x || '.0, ' || (x + 2 * k) || '.0, ' || xs || CASE WHEN k > 1 THEN ', ' || x || '.0' ELSE '' END || ']' AS "X_JSON",
 '[' || y || '.0, ' || y || '.0, ' || ys || CASE WHEN k > 1 THEN ', ' || y || '.0' ELSE '' END || ']' AS "Y_JSON" FROM t""")
def geometries(spark, folder):
    """Staircases; those of one step are rectangles written with five points."""
    shapes = s.staircases(spark, folder)
    return ingest.geometry_rows(shapes.select(F.concat(F.lit("P"), "polygon").alias("cell"), "layer", F.lit(0).alias("datatype"), "ring"))


def references(spark, folder):
    """References of line items: some without magnification, rotation or repetition."""
    n = c("l_linenumber")
    return table(spark, folder, "lineitem").select(
        F.concat(F.lit("S"), "l_suppkey").alias("cell"), F.concat(F.lit("P"), "l_partkey").alias("ref"), c("l_quantity").alias("x"), n.cast("double").alias("y"),
        F.when(n % 2 == 0, F.lit(2.0)).alias("magnification"), F.when(n % 3 == 0, F.lit(math.pi)).alias("rotation"), (c("l_returnflag") == "R").alias("x_reflection"),
        F.when(n > 2, n - 2).alias("columns"), F.when(n > 3, F.lit(1)).alias("rows"), c("l_discount").alias("dx"), c("l_tax").alias("dy"))


@query("io1_instances", """WITH n AS (SELECT *, l_linenumber AS n, CASE WHEN l_linenumber > 3 THEN l_linenumber - 2 ELSE 1 END AS cols FROM lineitem)
SELECT 'S' || l_suppkey AS "CellName", 'P' || l_partkey AS "RefCellName", l_quantity AS "X", CAST(n AS DOUBLE) AS "Y", CAST(CASE WHEN n % 2 = 0 THEN 2 ELSE 1 END AS DOUBLE) AS "MAG",
 CAST(CASE WHEN n % 3 = 0 THEN 180 ELSE 0 END AS DOUBLE) AS "ANGLE", l_returnflag = 'R' AS "IsXReflect", cols > 1 AS "IsArray", CAST(cols AS BIGINT) AS "Columns", CAST(1 AS BIGINT) AS "Rows",
 CASE WHEN cols > 1 THEN l_discount ELSE 0 END AS "DX", CASE WHEN cols > 1 THEN l_tax ELSE 0 END AS "DY" FROM n""")
def instances(spark, folder):
    return ingest.instance_rows(references(spark, folder))


@query("io1_cell_boxes", """WITH own AS (SELECT 'P' || p_partkey AS cell, CAST(0 AS DOUBLE) AS x0, CAST(0 AS DOUBLE) AS y0, CAST(p_size AS DOUBLE) AS x1, p_size / CAST(2.0 AS DOUBLE) AS y1 FROM part),
t AS (SELECT l_suppkey, l_quantity AS x, l_linenumber AS n, CASE WHEN l_linenumber % 2 = 0 THEN 2 ELSE 1 END AS m, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS mi,
  CASE WHEN l_linenumber % 3 = 0 THEN -1 ELSE 1 END AS co, CASE WHEN l_linenumber > 3 THEN (l_linenumber - 3) * l_discount ELSE 0 END AS wide, x1, y1 FROM lineitem JOIN own ON cell = 'P' || l_partkey),
b AS (SELECT l_suppkey, x + least(0, x1 * m * co) AS x0, x + greatest(0, x1 * m * co) + wide AS x1, n + least(0, y1 * m * mi * co) AS y0, n + greatest(0, y1 * m * mi * co) AS y1 FROM t)
SELECT 'S' || l_suppkey AS "CellName", round(min(x0), 6) AS "XMIN", round(min(y0), 6) AS "YMIN", round(max(x1), 6) AS "XMAX", round(max(y1), 6) AS "YMAX" FROM b GROUP BY 1
UNION ALL SELECT cell, round(x0, 6), round(y0, 6), round(x1, 6), round(y1, 6) FROM own""")
def cell_boxes(spark, folder):
    """Parts hold a rectangle, suppliers hold references to parts."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    w, h, zero = c("p_size"), c("p_size") / 2, F.lit(0)
    shapes = table(spark, folder, "part").select(F.concat(F.lit("P"), "p_partkey").alias("cell"), F.array(point(zero, zero), point(w, zero), point(w, h), point(zero, h)).alias("ring"))
    boxes = ingest.cell_boxes(shapes, instances(spark, folder))
    return boxes.select("CellName", *[F.round(n, 6).alias(n) for n in ("XMIN", "YMIN", "XMAX", "YMAX")])


@query("io1_labels", """SELECT 'S' || l_suppkey AS "CellName", CAST(l_linenumber AS BIGINT) AS "Layer", CAST(l_linenumber % 2 AS BIGINT) AS "TextType", l_quantity AS "X",
 CAST(l_linenumber AS DOUBLE) AS "Y", l_shipdate::DATE::VARCHAR || ' ' || l_returnflag AS "Label" FROM lineitem""")
def labels(spark, folder):
    return ingest.label_rows(label_records(spark, folder))


def label_records(spark, folder):
    return table(spark, folder, "lineitem").select(
        F.concat(F.lit("S"), "l_suppkey").alias("cell"), c("l_linenumber").alias("layer"), (c("l_linenumber") % 2).alias("texttype"), c("l_quantity").alias("x"),
        c("l_linenumber").cast("double").alias("y"), F.concat_ws(" ", F.to_date("l_shipdate").cast("string"), "l_returnflag").alias("text"))


# ---- the same tables by way of binary streams ------------------------------------------------

def stream(spark, folder, kind_of_rows):
    """Tables read back from streams that hold staircases, references and labels, several files of many chunks each.

    Files and chunks follow from the number of elements. Rows are made for one kind only; the streams hold all.
    """
    kind = lambda name: F.lit(name).alias("kind")
    shapes = s.staircases(spark, folder).select(kind("shape"), F.concat(F.lit("P"), "polygon").alias("cell"), c("layer").cast("int").alias("layer"), F.lit(0).alias("datatype"), "ring")
    refs = references(spark, folder).select(kind("ref"), "*")
    texts = label_records(spark, folder).select(kind("label"), "cell", "layer", c("texttype").alias("datatype"), "x", "y", "text")
    every = shapes.unionByName(refs, allowMissingColumns=True).unionByName(texts, allowMissingColumns=True)
    path = f"{shared_folder(spark)}/streams-{uuid.uuid4().hex}"
    many = every.count()
    stream_layout.write_stream(every, path, ["kind", "x", "y"], parts=max(3, many // ELEMENTS_IN_FILE))
    chunk = min(stream_layout.CHUNK, max(256 << 10, many * 2))  # some forty chunks or more, as an element has some 80 bytes
    return stream_layout.layout_tables(stream_layout.read_elements(spark, path, chunk, (kind_of_rows,)))


@query("io1_stream_geometries", """WITH p AS (SELECT p_partkey AS x, p_size AS y, p_size % 4 + 1 AS k FROM part),
t AS (SELECT *, list_aggregate(list_transform(generate_series(0, k - 1), lambda i: (x + 2 * (k - i)) || '.0, ' || (x + 2 * (k - i) - 2) || '.0'), 'string_agg', ', ') AS xs,
  list_aggregate(list_transform(generate_series(0, k - 1), lambda i: (y + i + 1) || '.0, ' || (y + i + 1) || '.0'), 'string_agg', ', ') AS ys FROM p)
SELECT 'P' || x AS "CellName", CAST(y % 5 AS BIGINT) AS "Layer", CAST(0 AS BIGINT) AS "DataType", CASE WHEN k = 1 THEN 'Box' ELSE 'Polygon' END AS "ShapeType",
 '[' || x || '.0, ' || (x + 2 * k) || '.0, ' || xs || ']' AS "X_JSON", '[' || y || '.0, ' || y || '.0, ' || ys || ']' AS "Y_JSON" FROM t""")
def stream_geometries(spark, folder):
    return stream(spark, folder, "shape")["geometries"]


@query("io1_stream_instances", """WITH n AS (SELECT *, l_linenumber AS n, CASE WHEN l_linenumber > 3 THEN l_linenumber - 2 ELSE 1 END AS cols FROM lineitem)
SELECT 'S' || l_suppkey AS "CellName", 'P' || l_partkey AS "RefCellName", l_quantity AS "X", CAST(n AS DOUBLE) AS "Y", CAST(CASE WHEN n % 2 = 0 THEN 2 ELSE 1 END AS DOUBLE) AS "MAG",
 CAST(CASE WHEN n % 3 = 0 THEN 180 ELSE 0 END AS DOUBLE) AS "ANGLE", l_returnflag = 'R' AS "IsXReflect", cols > 1 AS "IsArray", CAST(cols AS BIGINT) AS "Columns", CAST(1 AS BIGINT) AS "Rows",
 round(CASE WHEN cols > 1 THEN l_discount ELSE 0 END, 6) AS "DX", round(CASE WHEN cols > 1 THEN l_tax ELSE 0 END, 6) AS "DY" FROM n""")
def stream_instances(spark, folder):
    return stream(spark, folder, "ref")["instances"].withColumns({n: F.round(n, 6) for n in ("DX", "DY")})


@query("io1_stream_labels", """SELECT 'S' || l_suppkey AS "CellName", CAST(l_linenumber AS BIGINT) AS "Layer", CAST(l_linenumber % 2 AS BIGINT) AS "TextType", l_quantity AS "X",
 CAST(l_linenumber AS DOUBLE) AS "Y", l_shipdate::DATE::VARCHAR || ' ' || l_returnflag AS "Label" FROM lineitem""")
def stream_labels(spark, folder):
    return stream(spark, folder, "label")["textlabels"]
