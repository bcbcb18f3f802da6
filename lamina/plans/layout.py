"""Queries: placed boxes, naming, tiles and overlaps, hierarchy, polygons, layer stacks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lamina.durable import shared_folder
from lamina.operators import arrays, hierarchy, lookup, placement, polygons, spatial, spatial_index, stack
from lamina.plans import standins as s
from lamina.plans.registry import query, table
from lamina.sources import tables

c = F.col
BOX = spatial.BOX


def rounded(names):
    return [F.round(n, 6).alias(n) for n in names]


ROUNDED = ", ".join(f"round({n}, 6) AS {n}" for n in BOX)


def placed(spark, folder):
    """Instances with the placed extent of their cell."""
    boxes = {n: n for n in ("XMIN", "YMIN", "XMAX", "YMAX")}
    found = lookup.lookup(s.instances(spark, folder), s.bbox(spark, folder), {"RefCellName": "CellName"}, boxes)
    return spatial.place_boxes(found)


def wide_boxes(spark, folder):
    """Line item boxes spread over the key plane, with a unique id."""
    key = F.concat_ws("/", *s.LINE_ORDER[:4])
    return table(spark, folder, "lineitem").select(
        key.alias("id"), c("l_orderkey").cast("double").alias("xmin"), c("l_partkey").cast("double").alias("ymin"),
        (c("l_orderkey") + c("l_quantity")).alias("xmax"), (c("l_partkey") + c("l_linenumber")).cast("double").alias("ymax"))


WIDE = f"""wide AS (
  SELECT concat_ws('/', {", ".join(s.LINE_ORDER[:4])}) AS id, CAST(l_orderkey AS DOUBLE) AS xmin, CAST(l_partkey AS DOUBLE) AS ymin,
         l_orderkey + l_quantity AS xmax, CAST(l_partkey + l_linenumber AS DOUBLE) AS ymax FROM lineitem)"""


@query("m1_extent_by_parent", f"""WITH {s.INSTANCES}, {s.BBOX}, {s.PLACED}
SELECT "CellName", count(*) AS n, round(min(xmin), 6) AS xmin, round(min(ymin), 6) AS ymin, round(max(xmax), 6) AS xmax, round(max(ymax), 6) AS ymax
FROM placed GROUP BY 1""")
def extent_by_parent(spark, folder):
    """Flagship: box lookup, transform and extent of every parent cell."""
    merged = placed(spark, folder).groupBy("CellName").agg(F.count("*").alias("n"), *spatial.extent())
    return merged.select("CellName", "n", *rounded(BOX))


@query("g1_transform_box", f"""WITH {s.INSTANCES}, {s.BBOX}, {s.PLACED}
SELECT l_orderkey, l_linenumber, l_partkey, {ROUNDED} FROM placed""")
def transform_box(spark, folder):
    return placed(spark, folder).select("l_orderkey", "l_linenumber", "l_partkey", *rounded(BOX))


@query("g2_component_origin", f"""WITH {s.BBOX}, {s.COMPONENTS}
SELECT "InstanceName", "CellName", "Orientation", CAST(gds_x AS BIGINT) AS gds_x, CAST(gds_y AS BIGINT) AS gds_y FROM gds""")
def component_origin(spark, folder):
    out = placement.place_components(s.components(spark, folder), s.bbox(spark, folder))
    return out.select("InstanceName", "CellName", "Orientation", "gds_x", "gds_y")


NAMED = f"""{s.INSTANCES}, {s.BBOX}, {s.COMPONENTS},
firsts AS (SELECT gds_x, gds_y, "CellName" AS cell, arg_min("InstanceName", ({s.LINE_ORDER_SQL})) AS name FROM gds GROUP BY 1, 2, 3),
named AS (SELECT i.*, name AS "InstanceName" FROM instances i LEFT JOIN firsts f
  ON CAST(round_even("X" * 1000, 0) AS BIGINT) = gds_x AND CAST(round_even("Y" * 1000, 0) AS BIGINT) = gds_y AND "RefCellName" = cell)"""


@query("j4_exact_first_match", f"""WITH {NAMED}
SELECT l_orderkey, l_linenumber, "RefCellName", "X", "Y", "InstanceName" FROM named""")
def exact_first_match(spark, folder):
    named = placement.name_instances(s.instances(spark, folder), s.components(spark, folder), s.bbox(spark, folder), s.LINE_ORDER)
    return named.select("l_orderkey", "l_linenumber", "RefCellName", "X", "Y", "InstanceName")


@query("g4_instance_names", f"""WITH {NAMED}
SELECT "CellName", min("InstanceName") AS min_i, max("InstanceName") AS max_i FROM named GROUP BY 1""")
def instance_names(spark, folder):
    named = placement.name_instances(s.instances(spark, folder), s.components(spark, folder), s.bbox(spark, folder), s.LINE_ORDER)
    return placement.name_extrema(named)


@query("j5_tile_index", f"""WITH {WIDE}, xs AS (SELECT id, ymin, ymax, unnest(generate_series(CAST(floor(xmin / 64) AS BIGINT), CAST(floor(xmax / 64) AS BIGINT))) AS tile_x FROM wide),
xy AS (SELECT id, tile_x, unnest(generate_series(CAST(floor(ymin / 64) AS BIGINT), CAST(floor(ymax / 64) AS BIGINT))) AS tile_y FROM xs)
SELECT tile_x, tile_y, count(*) AS boxes, min(id) AS first_id FROM xy GROUP BY 1, 2""")
def tile_index(spark, folder):
    indexed = spatial.tiles(wide_boxes(spark, folder), 64.0)
    return indexed.groupBy("tile_x", "tile_y").agg(F.count("*").alias("boxes"), F.min("id").alias("first_id"))


@query("j5_window_search", f"""WITH {WIDE}, windows AS (SELECT s_suppkey, CAST(s_suppkey * 37 AS DOUBLE) AS x0, CAST(s_suppkey * 11 AS DOUBLE) AS y0 FROM supplier)
SELECT id, s_suppkey FROM wide JOIN windows ON xmin <= x0 + 90 AND x0 <= xmax AND ymin <= y0 + 60 AND y0 <= ymax""")
def window_search(spark, folder):
    windows = table(spark, folder, "supplier").select(
        "s_suppkey", (c("s_suppkey") * 37).cast("double").alias("xmin"), (c("s_suppkey") * 11).cast("double").alias("ymin"),
        (c("s_suppkey") * 37 + 90).cast("double").alias("xmax"), (c("s_suppkey") * 11 + 60).cast("double").alias("ymax"))
    return spatial.overlap_join(wide_boxes(spark, folder), windows, "id", "s_suppkey", tile=64.0)


@query("j5_stored_index", f"""WITH {WIDE}, windows AS (SELECT s_suppkey, CAST(s_suppkey * 37 AS DOUBLE) AS x0, CAST(s_suppkey * 11 AS DOUBLE) AS y0 FROM supplier)
SELECT id, s_suppkey FROM wide JOIN windows ON xmin <= x0 + 90 AND x0 <= xmax AND ymin <= y0 + 60 AND y0 <= ymax""")
def stored_index(spark, folder):
    """The search of ``j5_window_search`` through an index written first."""
    path = f"{shared_folder(spark)}/boxes-{uuid.uuid4().hex}"
    spatial_index.write_index(wide_boxes(spark, folder), "id", path, leaf_rows=512, part_leaves=8)
    windows = table(spark, folder, "supplier").select(
        "s_suppkey", (c("s_suppkey") * 37).cast("double").alias("xmin"), (c("s_suppkey") * 11).cast("double").alias("ymin"),
        (c("s_suppkey") * 37 + 90).cast("double").alias("xmax"), (c("s_suppkey") * 11 + 60).cast("double").alias("ymax"))
    return spatial_index.search_index(spark, path, windows, "s_suppkey", ["id"])


ARRAYS = """a AS (SELECT p_partkey AS id, p_partkey % 500 + 0.25 AS x0, p_size * 3 + 0.5 AS y0, p_partkey % 500 + 2.25 AS x1, p_size * 3 + 1.5 AS y1,
  p_partkey % 9 + 1 AS cols, p_size % 7 + 1 AS rows, CAST((p_partkey % 5 - 2) * 1.7 AS DOUBLE) AS dx, CAST((p_size % 4 - 1) * 2.3 AS DOUBLE) AS dy FROM part),
w AS (SELECT s_suppkey, CAST(s_suppkey * 7 % 500 AS DOUBLE) AS wx0, CAST(s_suppkey * 3 % 150 AS DOUBLE) AS wy0 FROM supplier)"""


def arrays_and_windows(spark, folder):
    parts, suppliers = table(spark, folder, "part"), table(spark, folder, "supplier")
    x, y = (c("p_partkey") % 500).cast("double"), (c("p_size") * 3).cast("double")
    placed = parts.select(
        c("p_partkey").alias("id"), (x + 0.25).alias("xmin"), (y + 0.5).alias("ymin"), (x + 2.25).alias("xmax"), (y + 1.5).alias("ymax"),
        (c("p_partkey") % 9 + 1).cast("bigint").alias("Columns"), (c("p_size") % 7 + 1).cast("bigint").alias("Rows"),
        ((c("p_partkey") % 5 - 2) * F.lit(1.7)).alias("DX"), ((c("p_size") % 4 - 1) * F.lit(2.3)).alias("DY"))
    wx, wy = (c("s_suppkey") * 7 % 500).cast("double"), (c("s_suppkey") * 3 % 150).cast("double")
    return placed, suppliers.select("s_suppkey", wx.alias("xmin"), wy.alias("ymin"), (wx + 12).alias("xmax"), (wy + 8).alias("ymax"))


@query("g13_array_hits", f"""WITH {ARRAYS}, e AS (SELECT *, unnest(generate_series(0, cols - 1)) AS k FROM a), f AS (SELECT *, unnest(generate_series(0, rows - 1)) AS r FROM e)
SELECT id, s_suppkey, CAST(k AS BIGINT) AS "column", CAST(r AS BIGINT) AS "row" FROM f JOIN w
ON x0 + k * dx <= wx0 + 12 AND wx0 <= x1 + k * dx AND y0 + r * dy <= wy0 + 8 AND wy0 <= y1 + r * dy""")
def array_elements(spark, folder):
    """Elements of arrays of several columns and rows that meet a window, from ranges."""
    return arrays.expand_hits(arrays.array_hits(*arrays_and_windows(spark, folder), "id", "s_suppkey"))


COMBS = """combs AS (SELECT p_partkey AS polygon, p_size % 9 + 2 AS teeth, p_size AS y FROM part),
frames AS (SELECT s_suppkey AS polygon, s_nationkey + 8 AS side FROM supplier)"""


def combs_and_frames(spark, folder):
    """Points of combs with 2 to 10 teeth, one for each part, and of square frames with a hole, one for each supplier."""
    teeth, y = c("p_size") % 9 + 2, c("p_size")
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    down = F.flatten(F.transform(F.sequence(teeth - 1, F.lit(0), F.lit(-1)), lambda i: F.array(corner(2 * i + 1, y + 1), corner(2 * i + 1, y + 3), corner(2 * i, y + 3), corner(2 * i, y + 1))))
    ring = F.concat(F.array(corner(F.lit(0), y), corner(2 * teeth - 1, y)), down)
    combs = table(spark, folder, "part").select(F.lit("comb").alias("kind"), c("p_partkey").alias("polygon"), F.lit(0).alias("ring"), F.posexplode(ring).alias("ord", "p"))
    side, zero = c("s_nationkey") + 8, F.lit(0)
    square = lambda low, high: F.array(corner(low, low), corner(high, low), corner(high, high), corner(low, high))
    rings = F.array(F.struct(F.lit(0).alias("ring"), square(zero, side).alias("points")), F.struct(F.lit(1).alias("ring"), square(F.lit(3), F.lit(6)).alias("points")))
    frames = table(spark, folder, "supplier").select(F.lit("frame").alias("kind"), c("s_suppkey").alias("polygon"), F.explode(rings).alias("r"))
    frames = frames.select("kind", "polygon", "r.ring", F.posexplode("r.points").alias("ord", "p"))
    return combs.unionByName(frames).select("kind", "polygon", "ring", "ord", "p.x", "p.y")


@query("g6_sweep_rectangles", f"""WITH {COMBS}, teeth AS (SELECT *, unnest(generate_series(0, teeth - 1)) AS i FROM combs)
SELECT 'comb' AS kind, polygon, CAST(0 AS DOUBLE) AS xmin, CAST(y AS DOUBLE) AS ymin, CAST(2 * teeth - 1 AS DOUBLE) AS xmax, CAST(y + 1 AS DOUBLE) AS ymax FROM combs
UNION ALL SELECT 'comb', polygon, 2 * i, y + 1, 2 * i + 1, y + 3 FROM teeth
UNION ALL SELECT 'frame', polygon, 0, 0, side, 3 FROM frames UNION ALL SELECT 'frame', polygon, 0, 3, 3, 6 FROM frames
UNION ALL SELECT 'frame', polygon, 6, 3, side, 6 FROM frames UNION ALL SELECT 'frame', polygon, 0, 6, side, side FROM frames""")
def sweep_rectangles(spark, folder):
    sides = polygons.vertical_sides(combs_and_frames(spark, folder), ["kind", "polygon", "ring"])
    return polygons.sweep_rectangles(sides, ["kind", "polygon"])


@query("io4_load_design", f"""WITH {s.INSTANCES}, {s.BBOX}, {s.PLACED}
SELECT "CellName", row_number() OVER (PARTITION BY "CellName" ORDER BY {s.LINE_ORDER_SQL}) AS inum, "RefCellName", {ROUNDED} FROM placed""")
def load_design(spark, folder):
    """A whole design stored and loaded: instances numbered in their cells, with the boxes of what they refer to, placed."""
    base = f"{shared_folder(spark)}/design-{uuid.uuid4().hex}"
    one, none = F.lit(1).cast("bigint"), F.lit(0.0)
    stored = s.instances(spark, folder).withColumns({"IsArray": F.lit(False), "Columns": one, "Rows": one, "DX": none, "DY": none})
    parts = table(spark, folder, "part").select(F.concat(F.lit("P"), "p_partkey").alias("CellName"))
    tables.persist({
        "instances": stored, "bbox": s.bbox(spark, folder), "defcomponents": s.components(spark, folder),
        "geometries": parts.select("CellName", one.alias("Layer"), one.alias("DataType"), F.lit("Box").alias("ShapeType"), F.lit("[]").alias("X_JSON"), F.lit("[]").alias("Y_JSON")),
        "textlabels": parts.select("CellName", one.alias("Layer"), one.alias("TextType"), none.alias("X"), none.alias("Y"), c("CellName").alias("Label"))}, base)
    design = tables.load_design(spark, base, s.LINE_ORDER, with_hierarchy=False)
    boxes = {n: n for n in ("XMIN", "YMIN", "XMAX", "YMAX")}
    found = spatial.place_boxes(lookup.lookup(design["instances"], design["bbox"], {"RefCellName": "CellName"}, boxes, strict=True))
    return found.select("CellName", "inum", "RefCellName", *rounded(BOX))


@query("j5_box_overlap", f"""WITH {WIDE}
SELECT a.id AS id, b.id AS id_2 FROM wide a JOIN wide b
ON a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax AND a.id < b.id""")
def box_overlap(spark, folder):
    boxes = wide_boxes(spark, folder)
    return spatial.overlap_join(boxes, boxes, "id", "id", distinct_pairs_of_one_table=True)


@query("a8_bloated_extent", f"""WITH {s.LAYER_BOXES}
SELECT layer, least(min(xmin), 100) - 500 AS xmin, least(min(ymin), 100) - 500 AS ymin, greatest(max(xmax), 200) + 500 AS xmax, greatest(max(ymax), 200) + 500 AS ymax
FROM layer_boxes GROUP BY 1""")
def bloated_extent(spark, folder):
    return s.layer_boxes(spark, folder).groupBy("layer").agg(*spatial.extent(stack.BLOAT, (100.0, 100.0, 200.0, 200.0)))


@query("r1_topo_numbers", f"WITH RECURSIVE {s.HIERARCHY} SELECT name, CAST(level AS INTEGER) AS level, number FROM numbers")
def topo_numbers(spark, folder):
    return hierarchy.topological_numbers(hierarchy.edges(s.hierarchy(spark, folder), "CellName", "RefCellName"))


@query("r1_edge_check", f"""WITH RECURSIVE {s.HIERARCHY}, given AS (SELECT name, CASE WHEN number % 5 = 0 THEN number // 5 ELSE number END AS number FROM numbers)
SELECT count(*) FILTER (WHERE c.number >= p.number) AS violations FROM hierarchy h JOIN given c ON h.child = c.name JOIN given p ON h.parent = p.name""")
def edge_check(spark, folder):
    """Every fifth number is spoilt, so that some children come after their parents."""
    pairs = hierarchy.edges(s.hierarchy(spark, folder), "CellName", "RefCellName")
    spoilt = F.when(c("number") % 5 == 0, F.expr("number div 5")).otherwise(c("number"))
    given = hierarchy.topological_numbers(pairs).withColumn("number", spoilt)
    return hierarchy.ordering_violations(pairs, given).agg(F.count("*").alias("violations"))


@query("r2_children_numbers", f"""WITH RECURSIVE {s.HIERARCHY},
seen AS (SELECT parent, number AS child_number, min(ord) AS f FROM hierarchy JOIN numbers ON child = name GROUP BY 1, 2)
SELECT p.name AS "CellName", p.number AS "CellNumber", child_number AS "RefCellNumber",
       CASE WHEN child_number IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY p.name ORDER BY f, child_number) END AS place
FROM numbers p LEFT JOIN seen ON parent = p.name""")
def children_numbers(spark, folder):
    """Children per node as rows, leaves kept: the unbounded form of the children arrays."""
    from lamina.durable import materialise
    from lamina.operators.numbering import position_in_group

    rows = s.hierarchy(spark, folder)
    numbers = materialise(hierarchy.topological_numbers(hierarchy.edges(rows, "CellName", "RefCellName")))
    seen = materialise(hierarchy.child_rows(hierarchy.number_instances(rows, numbers), ["ord"]))
    placed_rows = position_in_group(seen, ["CellName"], ["first_seen", "RefCellNumber"], "place").withColumnRenamed("CellName", "_p")
    joined = numbers.join(placed_rows, c("name") == c("_p"), "left")
    return joined.select(c("name").alias("CellName"), c("number").alias("CellNumber"), "RefCellNumber", F.coalesce("place", F.lit(0)).alias("place"))


@query("r2_parentchild", f"""WITH RECURSIVE {s.HIERARCHY},
seen AS (SELECT parent, number AS child_number, min(ord) AS f FROM hierarchy JOIN numbers ON child = name GROUP BY 1, 2),
kids AS (SELECT parent, string_agg(CAST(child_number AS VARCHAR), ',' ORDER BY f, child_number) AS kids FROM seen GROUP BY 1)
SELECT name AS "CellName", coalesce(kids, '') AS "Children", number AS "CellNumber" FROM numbers LEFT JOIN kids ON parent = name""")
def parentchild(spark, folder):
    """The parentchild table itself."""
    _, _, out = hierarchy.analyse_hierarchy(s.hierarchy(spark, folder), ["ord"])
    return out.select("CellName", F.concat_ws(",", c("ChildrenNum").cast("array<string>")).alias("Children"), "CellNumber")


@query("io2_top_cells", f"""WITH {s.INSTANCES} SELECT 'P' || p_partkey AS "CellName" FROM part WHERE 'P' || p_partkey NOT IN (SELECT "RefCellName" FROM instances)
UNION ALL SELECT DISTINCT "CellName" FROM instances""")
def top_cells(spark, folder):
    rows = s.instances(spark, folder)
    cells = s.bbox(spark, folder).select("CellName").union(rows.select("CellName"))
    return hierarchy.top_cells(rows, cells, "CellName", "RefCellName")


@query("io3_top_shapes", f"""WITH {s.INSTANCES}, {s.BBOX}, tops AS (SELECT s_suppkey FROM supplier WHERE 'S' || s_suppkey NOT IN (SELECT "RefCellName" FROM instances))
SELECT "CellName", "RefCellName", "X", "Y" FROM instances WHERE "CellName" = (SELECT 'S' || min(s_suppkey) FROM tops)""")
def top_shapes(spark, folder):
    """Rows of the first supplier that nothing refers to."""
    rows = s.instances(spark, folder)
    cells = table(spark, folder, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("CellName"), "s_suppkey")
    return hierarchy.first_top_shapes(rows.select("CellName", "RefCellName", "X", "Y"), rows, cells, "s_suppkey")


@query("a4_checked_extrema", f"WITH {s.COMPONENTS.split('),')[0]}) SELECT min(\"InstanceName\") AS min_value, max(\"InstanceName\") AS max_value FROM components")
def checked_extrema(spark, folder):
    from lamina.operators.grouping import extrema

    return extrema(s.components(spark, folder), "InstanceName", strict=True)


@query("g6_rectangles", f"WITH {s.STAIRCASE_BOXES} SELECT layer, polygon, xmin, ymin, xmax, ymax FROM stair_boxes")
def rectangles(spark, folder):
    cut = s.staircases(spark, folder).select("layer", "polygon", F.explode(polygons.slab_rectangles(c("ring"))).alias("b"))
    return cut.select("layer", "polygon", "b.*")


@query("g7_root_labels", f"""WITH {s.STAIRCASE_BOXES}, b AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY polygon, step) AS box FROM stair_boxes)
SELECT layer, polygon, box, min(box) OVER (PARTITION BY layer, polygon) AS root, xmin, ymin, xmax, ymax FROM b""")
def root_labels(spark, folder):
    return polygons.labelled_boxes(s.staircases(spark, folder), ["layer"], ["polygon"])


@query("a9_ring_bbox", f"""WITH {s.STAIRCASE_BOXES} SELECT polygon, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM stair_boxes GROUP BY 1""")
def ring_bbox(spark, folder):
    return s.staircases(spark, folder).select("polygon", *[v.alias(n) for n, v in polygons.ring_box(c("ring")).items()])


@query("g9_area_kept", f"""WITH {s.STAIRCASE_BOXES} SELECT layer, sum((xmax - xmin) * (ymax - ymin)) AS area, 0 AS lost FROM stair_boxes GROUP BY 1""")
def area_kept(spark, folder):
    """Shoelace area per layer, and how many polygons lose area in the decomposition."""
    boxes = polygons.slab_rectangles(c("ring"))
    cut = F.aggregate(boxes, F.lit(0.0), lambda acc, b: acc + (b["xmax"] - b["xmin"]) * (b["ymax"] - b["ymin"]))
    areas = s.staircases(spark, folder).select("layer", polygons.ring_area(c("ring")).alias("whole"), cut.alias("cut"))
    return areas.groupBy("layer").agg(F.sum("whole").alias("area"), F.count_if(c("whole") != c("cut")).cast("int").alias("lost"))


@query("p14_shape_class", f"""SELECT CASE WHEN p_size % 4 = 0 THEN 'Box' ELSE 'Polygon' END AS shape, count(*) AS n, CAST(sum(CASE WHEN p_size % 4 = 0 THEN 4 ELSE 2 * (p_size % 4 + 1) + 3 END) AS BIGINT) AS points FROM part GROUP BY 1""")
def shape_class(spark, folder):
    rings = s.staircases(spark, folder)
    typed = rings.select(polygons.shape_type(c("ring")).alias("shape"), F.size(polygons.open_rectangle(c("ring"))).alias("points"))
    return typed.groupBy("shape").agg(F.count("*").alias("n"), F.sum("points").alias("points"))


@query("w4_neighbour_vertex", """WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS w, CAST(p_retailprice AS DOUBLE) AS h FROM part),
v AS (SELECT p_partkey, 1 AS position, 0.0 AS x, 0.0 AS y FROM p UNION ALL SELECT p_partkey, 2, w, 0.0 FROM p UNION ALL SELECT p_partkey, 3, w, h FROM p UNION ALL SELECT p_partkey, 4, 0.0, h FROM p)
SELECT a.p_partkey, CAST(a.position AS INTEGER) AS position, CAST(b.x AS DOUBLE) AS prev_x, CAST(b.y AS DOUBLE) AS prev_y, CAST(d.x AS DOUBLE) AS next_x, CAST(d.y AS DOUBLE) AS next_y
FROM v a JOIN v b ON a.p_partkey = b.p_partkey AND b.position = (a.position + 2) % 4 + 1 JOIN v d ON a.p_partkey = d.p_partkey AND d.position = a.position % 4 + 1""")
def neighbour_vertex(spark, folder):
    w, h, zero = c("p_size").cast("double"), c("p_retailprice"), F.lit(0.0)
    ring = polygons.ring(F.array(zero, w, w, zero), F.array(zero, zero, h, h))
    rows = table(spark, folder, "part").select("p_partkey", F.explode(polygons.neighbours(ring)).alias("n"))
    return rows.select("p_partkey", "n.position", c("n.previous.x").alias("prev_x"), c("n.previous.y").alias("prev_y"), c("n.next.x").alias("next_x"), c("n.next.y").alias("next_y"))


@query("s1_coordinate_text", """SELECT p_partkey, '[' || CAST(p_size AS VARCHAR) || '.0, ' || CAST(p_partkey AS VARCHAR) || '.5]' AS x_json, p_size + p_partkey + CAST(0.5 AS DOUBLE) AS total FROM part""")
def coordinate_text(spark, folder):
    text = polygons.coordinates_text(F.array(c("p_size").cast("double"), c("p_partkey") + F.lit(0.5)))
    rows = table(spark, folder, "part").select("p_partkey", text.alias("x_json"))
    back = polygons.coordinates(c("x_json"))
    return rows.select("p_partkey", "x_json", (back[0] + back[1]).alias("total"))


@query("s8_pair_bounds", """SELECT l_orderkey, least(l_quantity, CAST(l_linenumber AS DOUBLE)) AS lo, greatest(l_quantity, CAST(l_linenumber AS DOUBLE)) AS hi FROM lineitem""")
def pair_bounds(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey", F.least("l_quantity", c("l_linenumber").cast("double")).alias("lo"), F.greatest("l_quantity", c("l_linenumber").cast("double")).alias("hi"))


@query("w5_next_layer", f"""WITH {s.LAYER_STACK} SELECT a.layer, a.zmin, coalesce(b.zmax, a.zmax) AS slab_zmax FROM layer_stack a LEFT JOIN layer_stack b ON b.layer = a.layer + 1""")
def next_layer(spark, folder):
    return stack.with_upper(s.layer_stack(spark, folder)).select("layer", "zmin", "slab_zmax")


SOLID = f"""{s.LAYER_BOXES}, {s.LAYER_STACK},
solid AS (SELECT b.*, zmin, zmax, is_via, xmax - xmin AS dx, ymax - ymin AS dy, zmax - zmin AS dz FROM layer_boxes b JOIN layer_stack s ON b.layer = s.layer)"""


@query("g8_extrude", f"WITH {SOLID} SELECT l_orderkey, l_partkey, layer, zmin, zmax, dx, dy, dz FROM solid")
def extrude(spark, folder):
    solid = stack.extrude(s.layer_boxes(spark, folder), s.layer_stack(spark, folder))
    return solid.select("l_orderkey", "l_partkey", "layer", "zmin", "zmax", "dx", "dy", "dz")


@query("j8_layer_lookup", """WITH conductor AS (SELECT DISTINCT l_linenumber - 1 AS id FROM lineitem WHERE l_linenumber <= 4), via AS (SELECT DISTINCT l_linenumber - 1 AS id FROM lineitem WHERE l_linenumber > 4),
dim AS (SELECT id + 1 AS layer, id * 100 AS zmin, id * 100 + 50 AS zmax, false AS is_via FROM conductor UNION ALL SELECT id + 1, id * 100, id * 100 + 80, true FROM via)
SELECT l_orderkey, l_partkey, CAST(l_linenumber AS INTEGER) AS layer, CAST(zmin AS INTEGER) AS zmin, CAST(zmax AS INTEGER) AS zmax, is_via FROM lineitem JOIN dim ON l_linenumber = layer""")
def layer_lookup(spark, folder):
    ids = table(spark, folder, "lineitem").select((c("l_linenumber") - 1).alias("id")).distinct()
    layers = ids.where("id < 4").select("id", (c("id") * 100).alias("zmin"), (c("id") * 100 + 50).alias("zmax"))
    vias = ids.where("id >= 4").select("id", (c("id") * 100).alias("zmin"), (c("id") * 100 + 80).alias("zmax"))
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", c("l_linenumber").alias("layer"))
    return lookup.lookup(rows, stack.stack_table(layers, vias), {"layer": "layer"}, {n: n for n in ("zmin", "zmax", "is_via")}, strict=True)


@query("g9_violations", f"""WITH {SOLID}, spoilt AS (SELECT CASE WHEN layer = 4 THEN zmin - 5 ELSE zmax END AS top, zmin, CASE WHEN dx > 45 THEN 0 ELSE dx END AS wide, dy, layer FROM solid)
SELECT count(*) FILTER (WHERE top < zmin) AS z_order, count(*) FILTER (WHERE top - zmin <= 0) AS height, count(*) FILTER (WHERE wide <= 0 OR dy <= 0) AS area FROM spoilt""")
def violations(spark, folder):
    """Layer 4 upside down, and the widest boxes without any width."""
    from lamina.checks import violation_counts

    boxes = s.layer_boxes(spark, folder).withColumn("xmax", F.when(c("xmax") - c("xmin") > 45, c("xmin")).otherwise(c("xmax")))
    layers = s.layer_stack(spark, folder).withColumn("zmax", F.when(c("layer") == 4, c("zmin") - 5).otherwise(c("zmax")))
    return violation_counts(stack.extrude(boxes, layers), stack.solid_rules())


@query("g10_physical_ids", f"""WITH {s.LAYER_BOXES}, g AS (SELECT DISTINCT layer, root FROM layer_boxes), i AS (SELECT layer * 200 + root AS physical_id FROM g)
SELECT physical_id, count(*) AS groups FROM i GROUP BY 1 HAVING count(*) > 1""")
def physical_ids(spark, folder):
    return stack.physical_id_collisions(s.layer_boxes(spark, folder), "layer", "root")


@query("g11_inset", f"""WITH {SOLID} SELECT l_orderkey, l_partkey, layer, xmin + CASE WHEN is_via THEN 0 ELSE 20 END AS x0, ymin + CASE WHEN is_via THEN 0 ELSE 20 END AS y0,
CAST(zmin + 20 AS DOUBLE) AS z0, xmax - xmin - 40 AS dx, ymax - ymin AS dy, CAST(zmax - zmin - 40 AS DOUBLE) AS dz FROM solid""")
def inset(spark, folder):
    solid = s.layer_boxes(spark, folder).join(s.layer_stack(spark, folder), "layer")
    return stack.inset(solid).select("l_orderkey", "l_partkey", "layer", "x0", "y0", "z0", "dx", "dy", "dz")


@query("g8_dielectric_slabs", f"""WITH {s.LAYER_BOXES}, {s.LAYER_STACK}, metal AS (SELECT * FROM layer_stack WHERE NOT is_via),
e AS (SELECT min(xmin) - 500 AS xmin, min(ymin) - 500 AS ymin, max(xmax) + 500 AS xmax, max(ymax) + 500 AS ymax FROM layer_boxes WHERE layer IN (SELECT layer FROM metal))
SELECT a.layer, xmin, ymin, CAST(a.zmin AS DOUBLE) AS z0, xmax - xmin AS dx, ymax - ymin AS dy, CAST(coalesce(b.zmax, a.zmax) - a.zmin AS DOUBLE) AS dz
FROM metal a LEFT JOIN metal b ON b.layer = a.layer + 1, e""")
def dielectric_slabs(spark, folder):
    from lamina.sources.geo_text import dielectric_slabs as slabs

    layers = s.layer_stack(spark, folder).where("NOT is_via")
    # one row per layer; a join by layer would send all boxes of a layer to one task
    return slabs(s.layer_boxes(spark, folder).join(F.broadcast(layers.select("layer")), "layer", "left_semi"), layers)
