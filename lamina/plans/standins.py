"""Layout-shaped views of the star-schema test tables, as DataFrames and as SQL.

The test data holds orders, not layouts. Every view is a row-by-row projection, so that work grows
with the tables: line items stand for instances and placements, parts for cells and their boxes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lamina.constants import literal_rows
from lamina.operators.placement import ORIENTATIONS
from lamina.plans.registry import table

# (order key, line number) repeats in the data; these columns together do not.
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
LINE_ORDER_SQL = ", ".join(LINE_ORDER)


def instances(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col
    return table(spark, folder, "lineitem").select(
        F.concat(F.lit("S"), c("l_suppkey")).alias("CellName"), F.concat(F.lit("P"), c("l_partkey")).alias("RefCellName"),
        c("l_quantity").alias("X"), c("l_linenumber").cast("double").alias("Y"), F.lit(1.0).alias("MAG"),
        (F.lit(90.0) * (c("l_linenumber") % 4)).alias("ANGLE"), (c("l_returnflag") == "R").alias("IsXReflect"),
        *LINE_ORDER)


INSTANCES = f"""instances AS (
  SELECT 'S' || l_suppkey AS "CellName", 'P' || l_partkey AS "RefCellName", l_quantity AS "X",
         CAST(l_linenumber AS DOUBLE) AS "Y", CAST(1.0 AS DOUBLE) AS "MAG",
         CAST(90.0 AS DOUBLE) * (l_linenumber % 4) AS "ANGLE", l_returnflag = 'R' AS "IsXReflect", {LINE_ORDER_SQL}
  FROM lineitem)"""


def bbox(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col
    return table(spark, folder, "part").select(
        F.concat(F.lit("P"), c("p_partkey")).alias("CellName"), (F.lit(-0.1) * (c("p_size") % 3)).alias("XMIN"),
        F.lit(-0.2).alias("YMIN"), c("p_size").cast("double").alias("XMAX"), (c("p_size") / F.lit(2.0)).alias("YMAX"))


BBOX = """bbox AS (
  SELECT 'P' || p_partkey AS "CellName", CAST(-0.1 AS DOUBLE) * (p_size % 3) AS "XMIN", CAST(-0.2 AS DOUBLE) AS "YMIN",
         CAST(p_size AS DOUBLE) AS "XMAX", p_size / CAST(2.0 AS DOUBLE) AS "YMAX"
  FROM part)"""

# Placed extent of an instance in SQL: four turned corners, exact for quarter turns.
PLACED = """turned AS (
  SELECT i.*, b."XMIN", b."YMIN", b."XMAX", b."YMAX",
         CAST(CASE "ANGLE" WHEN 0 THEN 1 WHEN 180 THEN -1 ELSE 0 END AS DOUBLE) AS co,
         CAST(CASE "ANGLE" WHEN 90 THEN 1 WHEN 270 THEN -1 ELSE 0 END AS DOUBLE) AS si,
         CAST(CASE WHEN "IsXReflect" THEN -1 ELSE 1 END AS DOUBLE) AS mi
  FROM instances i JOIN bbox b ON i."RefCellName" = b."CellName"),
corners AS (
  SELECT *, "X" + ("XMIN" * co - "YMIN" * mi * si) AS x1, "X" + ("XMAX" * co - "YMIN" * mi * si) AS x2,
         "X" + ("XMIN" * co - "YMAX" * mi * si) AS x3, "X" + ("XMAX" * co - "YMAX" * mi * si) AS x4,
         "Y" + ("XMIN" * si + "YMIN" * mi * co) AS y1, "Y" + ("XMAX" * si + "YMIN" * mi * co) AS y2,
         "Y" + ("XMIN" * si + "YMAX" * mi * co) AS y3, "Y" + ("XMAX" * si + "YMAX" * mi * co) AS y4
  FROM turned),
placed AS (
  SELECT * EXCLUDE ("XMIN", "YMIN", "XMAX", "YMAX"), least(x1, x2, x3, x4) AS xmin, least(y1, y2, y3, y4) AS ymin,
         greatest(x1, x2, x3, x4) AS xmax, greatest(y1, y2, y3, y4) AS ymax FROM corners)"""


def orientation_of(line: Column) -> Column:
    """Orientation by line number; ``line`` 1..7 and 0 cover all eight."""
    return F.element_at(F.array(*map(F.lit, ORIENTATIONS)), (line % 8 + 1).cast("int"))


ORIENTATION = f"CASE l_linenumber % 8 {' '.join(f'WHEN {i} THEN {chr(39)}{o}{chr(39)}' for i, o in enumerate(ORIENTATIONS))} END"

# Offsets of the placement rule in SQL, from box corners in database units.
OFFSET_X = """CASE "Orientation" WHEN 'S' THEN llx + urx WHEN 'FN' THEN llx + urx WHEN 'W' THEN llx + ury WHEN 'FE' THEN llx + ury
  WHEN 'E' THEN llx - lly WHEN 'FW' THEN llx - lly ELSE 0 END"""
OFFSET_Y = """CASE "Orientation" WHEN 'S' THEN lly + ury WHEN 'FS' THEN lly + ury WHEN 'E' THEN lly + urx WHEN 'FE' THEN lly + urx
  WHEN 'W' THEN lly - llx WHEN 'FW' THEN lly - llx ELSE 0 END"""


def components(spark: SparkSession, folder: str) -> DataFrame:
    """Placements on a 100-unit lattice; several share a spot, and many match an instance."""
    c = F.col
    return table(spark, folder, "lineitem").select(
        F.concat_ws("_", F.lit("U"), c("l_orderkey"), c("l_linenumber"), c("l_suppkey")).alias("InstanceName"),
        F.concat(F.lit("P"), c("l_partkey")).alias("CellName"),
        (c("l_quantity") * 1000).cast("int").alias("X"), (c("l_linenumber") * 1000).alias("Y"),
        orientation_of(c("l_linenumber")).alias("Orientation"), *LINE_ORDER)


COMPONENTS = f"""components AS (
  SELECT concat_ws('_', 'U', l_orderkey, l_linenumber, l_suppkey) AS "InstanceName", 'P' || l_partkey AS "CellName",
         CAST(l_quantity * 1000 AS INTEGER) AS "X", l_linenumber * 1000 AS "Y", {ORIENTATION} AS "Orientation", {LINE_ORDER_SQL}
  FROM lineitem),
dbu_box AS (
  SELECT "CellName", CAST(round_even("XMIN" * 1000, 0) AS BIGINT) AS llx, CAST(round_even("YMIN" * 1000, 0) AS BIGINT) AS lly,
         CAST(round_even("XMAX" * 1000, 0) AS BIGINT) AS urx, CAST(round_even("YMAX" * 1000, 0) AS BIGINT) AS ury FROM bbox),
gds AS (
  SELECT c.*, "X" + {OFFSET_X} AS gds_x, "Y" + {OFFSET_Y} AS gds_y
  FROM components c JOIN dbu_box b ON c."CellName" = b."CellName")"""


def hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    """Parent and child names from region to nation to customer to order, with a row order."""
    c = F.col

    def pairs(name: str, parent: tuple[str, str], child: tuple[str, str]) -> DataFrame:
        return table(spark, folder, name).select(
            F.concat(F.lit(parent[0]), c(parent[1])).alias("CellName"), F.concat(F.lit(child[0]), c(child[1])).alias("RefCellName"),
            c(child[1]).cast("bigint").alias("ord"))

    return (
        pairs("nation", ("R", "n_regionkey"), ("N", "n_nationkey"))
        .unionByName(pairs("customer", ("N", "c_nationkey"), ("C", "c_custkey")))
        .unionByName(pairs("orders", ("C", "o_custkey"), ("O", "o_orderkey")))
    )


HIERARCHY = """hierarchy AS (
  SELECT 'R' || n_regionkey AS parent, 'N' || n_nationkey AS child, CAST(n_nationkey AS BIGINT) AS ord FROM nation
  UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey, c_custkey FROM customer
  UNION ALL SELECT 'C' || o_custkey, 'O' || o_orderkey, o_orderkey FROM orders),
nodes AS (SELECT parent AS name FROM hierarchy UNION SELECT child FROM hierarchy),
deep(name, level) AS (
  SELECT name, 0 FROM nodes WHERE name NOT IN (SELECT parent FROM hierarchy)
  UNION
  SELECT h.parent, d.level + 1 FROM deep d JOIN hierarchy h ON h.child = d.name),
levels AS (SELECT name, max(level) AS level FROM deep GROUP BY name),
numbers AS (SELECT name, level, row_number() OVER (ORDER BY level, name) AS number FROM levels)"""


def layer_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes of line items on the layers 1..7, rooted by part."""
    c = F.col
    return table(spark, folder, "lineitem").select(
        c("l_linenumber").cast("bigint").alias("layer"), (c("l_partkey") + 1).alias("root"),
        c("l_orderkey").cast("double").alias("xmin"), c("l_partkey").cast("double").alias("ymin"),
        (c("l_orderkey") + c("l_quantity")).alias("xmax"), (c("l_partkey") + c("l_linenumber") + 0.5).alias("ymax"), *LINE_ORDER)


LAYER_BOXES = f"""layer_boxes AS (
  SELECT CAST(l_linenumber AS BIGINT) AS layer, l_partkey + 1 AS root, CAST(l_orderkey AS DOUBLE) AS xmin, CAST(l_partkey AS DOUBLE) AS ymin,
         l_orderkey + l_quantity AS xmax, l_partkey + l_linenumber + CAST(0.5 AS DOUBLE) AS ymax, {LINE_ORDER_SQL}
  FROM lineitem)"""


def layer_stack(spark: SparkSession, folder: str) -> DataFrame:
    """Layer table with the layers found in the line items; every third one is a via."""
    layer = F.col("l_linenumber").cast("bigint")
    return table(spark, folder, "lineitem").select(layer.alias("layer")).distinct().select(
        "layer", (F.col("layer") * 100).alias("zmin"), (F.col("layer") * 100 + 60 + F.col("layer")).alias("zmax"), (F.col("layer") % 3 == 0).alias("is_via"))


LAYER_STACK = """layer_stack AS (
  SELECT DISTINCT CAST(l_linenumber AS BIGINT) AS layer, CAST(l_linenumber AS BIGINT) * 100 AS zmin,
         CAST(l_linenumber AS BIGINT) * 101 + 60 AS zmax, l_linenumber % 3 = 0 AS is_via
  FROM lineitem)"""


def staircases(spark: SparkSession, folder: str) -> DataFrame:
    """One closed staircase ring per part with 1 to 4 steps of width 2 and height 1, on layer size % 5."""
    steps = F.col("p_size") % 4 + 1
    corner = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    base = F.struct((2.0 * steps).alias("x"), F.lit(0.0).alias("y"))

    def treads(i: Column) -> Column:
        width = 2.0 * (steps - i)
        return F.array(F.struct(width.cast("double").alias("x"), (i + 1).cast("double").alias("y")),
                       F.struct((width - 2.0).cast("double").alias("x"), (i + 1).cast("double").alias("y")))

    rise = F.flatten(F.transform(F.sequence(F.lit(0), steps - 1), treads))
    points = F.concat(F.array(corner, base), rise, F.array(corner))
    moved = F.transform(points, lambda p: F.struct(
        (p["x"] + F.col("p_partkey")).alias("x"), (p["y"] + F.col("p_size")).alias("y")))
    return table(spark, folder, "part").select(
        (F.col("p_size") % 5).cast("bigint").alias("layer"), F.col("p_partkey").alias("polygon"), moved.alias("ring"))


# The rectangles of a staircase follow from its shape: one per step, shorter towards the top.
STAIRCASE_BOXES = """stairs AS (
  SELECT p_size % 5 AS layer, p_partkey AS polygon, p_partkey, p_size, p_size % 4 + 1 AS steps FROM part),
stair_boxes AS (
  SELECT CAST(layer AS BIGINT) AS layer, polygon, k AS step, CAST(p_partkey AS DOUBLE) AS xmin, CAST(p_size + k AS DOUBLE) AS ymin,
         CAST(p_partkey + 2 * (steps - k) AS DOUBLE) AS xmax, CAST(p_size + k + 1 AS DOUBLE) AS ymax
  FROM stairs, generate_series(0, 3) g(k) WHERE k < steps)"""


def mesh_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Mesh text lines: a node per part, and a line, triangle or quadrilateral per order."""
    c = F.col
    parts, orders = table(spark, folder, "part"), table(spark, folder, "orders")
    n, m = parts.count(), orders.count()
    node = c("p_partkey") + 1
    nodes = parts.select(
        (node + 5).alias("line"),
        F.concat_ws(" ", node, c("p_size") % 3 - 1, c("p_size") % 5 - 2, F.lit(0)).alias("value"))
    kind = c("o_orderkey") % 3 + 1
    refs = [(c("o_custkey") + k) % n + 1 for k in range(4)]
    elements = orders.select(
        (c("o_orderkey") + n + 9).alias("line"),
        F.concat_ws(" ", c("o_orderkey") + 1, kind, F.lit("2 0"), c("o_custkey") % 7 + 1, refs[0], refs[1],
                    F.when(kind >= 2, refs[2]), F.when(kind == 3, refs[3])).alias("value"))
    fixed = [(1, "$MeshFormat"), (2, "2.2 0 8"), (3, "$EndMeshFormat"), (4, "$Nodes"), (5, str(n)), (n + 6, "$EndNodes"),
             (n + 7, "$Elements"), (n + 8, str(m)), (n + m + 9, "$EndElements")]
    frame = literal_rows(spark, fixed, "line bigint, value string")
    return frame.unionByName(nodes).unionByName(elements).withColumn("file", F.lit("mesh"))


MESH = """mesh_nodes AS (
  SELECT CAST(p_partkey + 1 AS INTEGER) AS id, CAST(p_size % 3 - 1 AS DOUBLE) AS x, CAST(p_size % 5 - 2 AS DOUBLE) AS y FROM part),
mesh_elements AS (
  SELECT CAST(o_orderkey + 1 AS INTEGER) AS id, CAST(o_orderkey % 3 + 1 AS INTEGER) AS kind, CAST(o_custkey % 7 + 1 AS INTEGER) AS tag2,
         CAST(o_custkey % (SELECT count(*) FROM part) + 1 AS INTEGER) AS n1, CAST((o_custkey + 1) % (SELECT count(*) FROM part) + 1 AS INTEGER) AS n2,
         CAST((o_custkey + 2) % (SELECT count(*) FROM part) + 1 AS INTEGER) AS n3, CAST((o_custkey + 3) % (SELECT count(*) FROM part) + 1 AS INTEGER) AS n4
  FROM orders)"""


def coo(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse matrix of suppliers (rows) by parts (columns), 1-based, summed quantities."""
    return table(spark, folder, "lineitem").groupBy((F.col("l_suppkey") + 1).alias("i"), (F.col("l_partkey") + 1).alias("j")).agg(
        F.sum("l_quantity").alias("v"))


COO = "coo AS (SELECT l_suppkey + 1 AS i, l_partkey + 1 AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"


def supply_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, str]:
    """Undirected supplier-part graph weighted by the smallest quantity, and a source supplier."""
    from lamina.operators.graph import undirected

    lines = table(spark, folder, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("a"), F.concat(F.lit("P"), F.col("l_partkey")).alias("b"), F.col("l_quantity").alias("w"))
    return undirected(lines, "a", "b", "w"), "S0"


SUPPLY_GRAPH = """light AS (
  SELECT 'S' || l_suppkey AS a, 'P' || l_partkey AS b, min(l_quantity) AS w FROM lineitem GROUP BY 1, 2),
supply AS (SELECT a AS src, b AS dst, w FROM light UNION ALL SELECT b, a, w FROM light)"""
