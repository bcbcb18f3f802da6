"""Queries: projection, filters, lookups, aggregates, numbering, ordering, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.checks import require_columns
from lamina.constants import literal_rows
from lamina.durable import materialise
from lamina.operators import grouping, hierarchy, lookup, numbering
from lamina.operators.placement import ORIENTATIONS, orientation_code
from lamina.plans import standins as s
from lamina.plans.registry import query, table

c = F.col


@query("p1_projection", f'WITH {s.INSTANCES} SELECT "X", "Y", "RefCellName" FROM instances')
def projection(spark, folder):
    return s.instances(spark, folder).select("X", "Y", "RefCellName")


@query("p2_equality_filter", f"""WITH {s.INSTANCES} SELECT "CellName", "RefCellName", "X", "Y" FROM instances WHERE "X" = 25 AND "CellName" = 'S1'""")
def equality_filter(spark, folder):
    return s.instances(spark, folder).where((c("X") == 25) & (c("CellName") == "S1")).select("CellName", "RefCellName", "X", "Y")


@query("p3_range_filter", f'WITH {s.INSTANCES} SELECT "CellName", "X", "Y" FROM instances WHERE "X" > 10 AND "X" < 20 AND "Y" > 1')
def range_filter(spark, folder):
    return s.instances(spark, folder).where("X > 10 AND X < 20 AND Y > 1").select("CellName", "X", "Y")


@query("p4_like_conjunction", f"""WITH {s.COMPONENTS.split('),')[0]}) SELECT "InstanceName", "X", "Y" FROM components
WHERE "InstanceName" LIKE '%_1_%7' AND "X" > 5000 AND "X" < 30000""")
def like_conjunction(spark, folder):
    return s.components(spark, folder).where("InstanceName LIKE '%_1_%7' AND X > 5000 AND X < 30000").select("InstanceName", "X", "Y")


@query("p5_group_pick", f"""WITH {s.INSTANCES} SELECT "CellName", "RefCellName", "X", "Y", "ANGLE" FROM instances WHERE "CellName" = 'S7'""")
def group_pick(spark, folder):
    return lookup.pick_group(s.instances(spark, folder), "CellName", "S7").select("CellName", "RefCellName", "X", "Y", "ANGLE")


@query("p6_default_column", f"""WITH {s.INSTANCES} SELECT "CellName", "RefCellName", "X", '' AS "InstanceName" FROM instances""")
def default_column(spark, folder):
    return s.instances(spark, folder).select("CellName", "RefCellName", "X", F.lit("").alias("InstanceName"))


@query("p7_conditional", f'WITH {s.INSTANCES} SELECT "CellName", CASE WHEN "X" <= 10 THEN "X" + 5 ELSE "X" END AS score FROM instances')
def conditional(spark, folder):
    return s.instances(spark, folder).select("CellName", F.when(c("X") <= 10, c("X") + 5).otherwise(c("X")).alias("score"))


@query("p9_drop_missing", """SELECT count(quality) AS kept, count(*) - count(quality) AS dropped
FROM documents LEFT JOIN labels USING (doc_id)""")
def drop_missing(spark, folder):
    joined = table(spark, folder, "documents").select("doc_id").join(table(spark, folder, "labels").select("doc_id", "quality"), "doc_id", "left")
    return lookup.dropped_rows(joined, "doc_id", "quality")


@query("p9_dictionary_with_missing", """WITH d AS (SELECT CASE WHEN o_orderkey % 7 > 0 THEN 'C' || o_custkey END AS name, CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey END AS number, o_orderkey AS ord FROM orders)
SELECT name, arg_max(number, ord) AS number FROM d WHERE name IS NOT NULL AND number IS NOT NULL GROUP BY 1""")
def dictionary_with_missing(spark, folder):
    """Names and numbers, some of either missing: such rows are left out, the last row of a name wins."""
    orders = table(spark, folder, "orders")
    rows = orders.select(
        F.when(c("o_orderkey") % 7 > 0, F.concat(F.lit("C"), "o_custkey")).alias("name"), F.when(c("o_orderkey") % 11 > 0, c("o_orderkey")).alias("number"), c("o_orderkey").alias("ord"))
    return lookup.name_numbers(rows, "name", "number", ["ord"])


@query("p10_column_check", f'WITH {s.BBOX} SELECT "CellName", "XMIN", "XMAX" FROM bbox')
def column_check(spark, folder):
    return require_columns(s.bbox(spark, folder), ["CellName", "XMIN", "XMAX"]).select("CellName", "XMIN", "XMAX")


@query("p11_nested_box", f'WITH {s.BBOX} SELECT "CellName", "XMIN" AS llx, "YMIN" AS lly, "XMAX" AS urx, "YMAX" AS ury FROM bbox')
def nested_box(spark, folder):
    corner = lambda x, y: F.struct(c(x).alias("x"), c(y).alias("y"))
    nested = s.bbox(spark, folder).select("CellName", F.struct(corner("XMIN", "YMIN").alias("ll"), corner("XMAX", "YMAX").alias("ur")).alias("box"))
    return nested.select("CellName", c("box.ll.x").alias("llx"), c("box.ll.y").alias("lly"), c("box.ur.x").alias("urx"), c("box.ur.y").alias("ury"))


@query("w1_inum", f"""WITH {s.INSTANCES}
SELECT "CellName", "RefCellName", "X", "Y", row_number() OVER (PARTITION BY "CellName" ORDER BY {s.LINE_ORDER_SQL}) AS inum FROM instances""")
def inum(spark, folder):
    numbered = numbering.position_in_group(s.instances(spark, folder), ["CellName"], s.LINE_ORDER)
    return numbered.select("CellName", "RefCellName", "X", "Y", "inum")


@query("w2_global_ids", f"""SELECT l_orderkey, l_partkey, row_number() OVER (ORDER BY {s.LINE_ORDER_SQL}) AS id FROM lineitem""")
def global_ids(spark, folder):
    rows = table(spark, folder, "lineitem").select(*s.LINE_ORDER)
    return numbering.global_position(rows, s.LINE_ORDER, "id").select("l_orderkey", "l_partkey", "id")


@query("w3_running_offset", f"""WITH {s.LAYER_BOXES}, f AS (SELECT layer, root, count(*) AS freq FROM layer_boxes GROUP BY 1, 2)
SELECT layer, root, freq, CAST(sum(freq) OVER (ORDER BY layer, root) - freq + 1 AS BIGINT) AS first,
       CAST(sum(freq) OVER (ORDER BY layer, root) AS BIGINT) AS last FROM f""")
def running_offset(spark, folder):
    from lamina.sources.geo_text import group_ranges

    return group_ranges(s.layer_boxes(spark, folder))


@query("j1_left_children", f"""WITH {s.INSTANCES}, names AS (SELECT DISTINCT "CellName" AS n FROM instances UNION SELECT "RefCellName" FROM instances),
kids AS (SELECT "CellName" AS p, count(DISTINCT "RefCellName") AS n_children, min("RefCellName") AS first_child, max("RefCellName") AS last_child
         FROM instances GROUP BY 1)
SELECT n AS "CellName", coalesce(n_children, 0) AS n_children, coalesce(first_child, '') AS first_child, coalesce(last_child, '') AS last_child
FROM names LEFT JOIN kids ON n = p""")
def left_children(spark, folder):
    rows = s.instances(spark, folder)
    names = hierarchy.union_distinct(rows, "CellName", "RefCellName", "CellName")
    pairs = hierarchy.edges(rows, "CellName", "RefCellName")
    kids = pairs.groupBy("parent").agg(F.count("*").alias("n_children"), F.min("child").alias("first_child"), F.max("child").alias("last_child"))
    joined = names.join(kids, names["CellName"] == kids["parent"], "left")
    return joined.select("CellName", F.coalesce("n_children", F.lit(0)).alias("n_children"),
                         F.coalesce("first_child", F.lit("")).alias("first_child"), F.coalesce("last_child", F.lit("")).alias("last_child"))


@query("j2_dict_numbers", f"""WITH {s.INSTANCES},
first AS (SELECT "RefCellName" AS v, min(({s.LINE_ORDER_SQL})) AS f FROM instances GROUP BY 1),
dict AS (SELECT v, row_number() OVER (ORDER BY f) AS id FROM first)
SELECT "CellName", "RefCellName", id AS "RefCellNumber", "X" FROM instances JOIN dict ON "RefCellName" = v""")
def dict_numbers(spark, folder):
    rows = s.instances(spark, folder)
    ids = numbering.dictionary_encode(rows, "RefCellName", s.LINE_ORDER)
    numbered = lookup.lookup(rows, ids, {"RefCellName": "RefCellName"}, {"id": "RefCellNumber"}, strict=True)
    return numbered.select("CellName", "RefCellName", "RefCellNumber", "X")


@query("j2_last_name_wins", """WITH rows AS (SELECT p_name AS name, p_size AS number, p_partkey AS ord FROM part)
SELECT name, arg_max(number, ord) AS number FROM rows GROUP BY name""")
def last_name_wins(spark, folder):
    rows = table(spark, folder, "part").select(c("p_name").alias("name"), c("p_size").alias("number"), c("p_partkey").alias("ord"))
    return lookup.name_numbers(rows, "name", "number", ["ord"])


@query("j3_box_lookup", f"""WITH {s.INSTANCES}, {s.BBOX}
SELECT i."CellName", "RefCellName", "X", "Y", "XMIN", "YMIN", "XMAX", "YMAX" FROM instances i JOIN bbox b ON "RefCellName" = b."CellName" """)
def box_lookup(spark, folder):
    boxes = {n: n for n in ("XMIN", "YMIN", "XMAX", "YMAX")}
    found = lookup.lookup(s.instances(spark, folder), s.bbox(spark, folder), {"RefCellName": "CellName"}, boxes, strict=True)
    return found.select("CellName", "RefCellName", "X", "Y", *boxes)


@query("j6_interval_lookup", """WITH dim(ord, name, zmin, zmax) AS (VALUES (1, 'FOX', 0.0, 120.0), (2, 'PSG', 120.0, 936.1), (3, 'NILD2', 936.1, 1376.1),
  (4, 'NILD3', 1376.1, 2006.1), (5, 'NILD4', 2006.1, 2786.1), (6, 'NILD5', 2786.1, 4021.1), (7, 'NILD6', 4021.1, 5371.1), (8, 'PI1', 5371.1, 11883.4)),
z AS (SELECT l_orderkey, l_extendedprice / CAST(8.0 AS DOUBLE) AS z FROM lineitem)
SELECT l_orderkey, z, name FROM z LEFT JOIN dim ON z >= CAST(zmin AS DOUBLE) AND z < CAST(zmax AS DOUBLE)""")
def interval(spark, folder):
    # Dielectric layers with their z ranges in nanometres.
    dim = literal_rows(
        spark, [(1, "FOX", 0.0, 120.0), (2, "PSG", 120.0, 936.1), (3, "NILD2", 936.1, 1376.1), (4, "NILD3", 1376.1, 2006.1),
         (5, "NILD4", 2006.1, 2786.1), (6, "NILD5", 2786.1, 4021.1), (7, "NILD6", 4021.1, 5371.1), (8, "PI1", 5371.1, 11883.4)],
        "ord int, name string, zmin double, zmax double")
    z = table(spark, folder, "lineitem").select("l_orderkey", (c("l_extendedprice") / F.lit(8.0)).alias("z"))
    return lookup.interval_lookup(z, "z", dim, "zmin", "zmax", "name", "ord", "name")


@query("j6_interval_table", """WITH dim AS (SELECT p_partkey AS ord, p_name || p_partkey AS name, p_retailprice * CAST(40.0 AS DOUBLE) AS lo,
  p_retailprice * CAST(40.0 AS DOUBLE) + p_size AS hi FROM part),
hits AS (SELECT o_orderkey, arg_min(name, ord) AS band FROM orders JOIN dim ON o_totalprice >= lo AND o_totalprice < hi GROUP BY 1)
SELECT o.o_orderkey, band FROM orders o LEFT JOIN hits h ON o.o_orderkey = h.o_orderkey""")
def interval_table(spark, folder):
    low = c("p_retailprice") * F.lit(40.0)
    dim = table(spark, folder, "part").select(
        c("p_partkey").alias("ord"), F.concat("p_name", "p_partkey").alias("name"), low.alias("lo"), (low + c("p_size")).alias("hi"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return lookup.interval_lookup(orders, "o_totalprice", dim, "lo", "hi", "name", "ord", "band").select("o_orderkey", "band")


@query("j9_orientation", f"""SELECT l_orderkey, {s.ORIENTATION} AS name, CAST(l_linenumber % 8 AS INTEGER) AS code FROM lineitem""")
def orientation(spark, folder):
    name = s.orientation_of(c("l_linenumber"))
    return table(spark, folder, "lineitem").select("l_orderkey", name.alias("name"), orientation_code(name).alias("code"))


@query("a1_first_seen_children", f"""WITH {s.INSTANCES}, seen AS (SELECT "CellName", "RefCellName", min(({s.LINE_ORDER_SQL})) AS f FROM instances GROUP BY 1, 2)
SELECT "CellName", "RefCellName", row_number() OVER (PARTITION BY "CellName" ORDER BY f) AS place FROM seen""")
def first_seen_children(spark, folder):
    seen = grouping.first_seen_distinct(s.instances(spark, folder), ["CellName"], "RefCellName", s.LINE_ORDER, "first_seen")
    return numbering.position_in_group(seen, ["CellName"], ["first_seen"], "place").select("CellName", "RefCellName", "place")


@query("a1_children_array", """WITH seen AS (SELECT c_nationkey, c_mktsegment, min(c_custkey) AS f FROM customer GROUP BY 1, 2)
SELECT c_nationkey, string_agg(c_mktsegment, ',' ORDER BY f) AS segments FROM seen GROUP BY 1""")
def children_array(spark, folder):
    seen = grouping.first_seen_distinct(table(spark, folder, "customer"), ["c_nationkey"], "c_mktsegment", ["c_custkey"], "first_seen")
    folded = grouping.as_array(seen, ["c_nationkey"], "c_mktsegment", "first_seen", "segments")
    return folded.select("c_nationkey", F.concat_ws(",", "segments").alias("segments"))


@query("a2_number_extrema", """SELECT min(l_extendedprice) AS min_value, max(l_extendedprice) AS max_value FROM lineitem WHERE l_suppkey = 3""")
def number_extrema(spark, folder):
    return grouping.extrema(table(spark, folder, "lineitem").where("l_suppkey = 3"), "l_extendedprice")


@query("a3_string_extrema", """SELECT min(p_name || '_' || p_partkey) AS min_value, max(p_name || '_' || p_partkey) AS max_value FROM part""")
def string_extrema(spark, folder):
    return grouping.extrema(table(spark, folder, "part").select(F.concat("p_name", F.lit("_"), "p_partkey").alias("name")), "name", strict=True)


@query("a5_formatted_count", "SELECT format('{:,}', count(*)) AS num_services FROM lineitem")
def formatted_count(spark, folder):
    from lamina.functions.scalars import thousands

    return table(spark, folder, "lineitem").agg(thousands(F.count("*")).alias("num_services"))


@query("a6_frequency", """SELECT l_linenumber, l_partkey, count(*) AS freq FROM lineitem GROUP BY 1, 2""")
def frequency(spark, folder):
    return grouping.frequency(table(spark, folder, "lineitem"), "l_linenumber", "l_partkey")


@query("a7_word_count", r"""SELECT word, count(*) AS freq FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS word FROM documents) WHERE word <> '' GROUP BY word""")
def word_count(spark, folder):
    return grouping.word_count(table(spark, folder, "documents"), "text")


@query("a14_conditional_count", """SELECT l_suppkey, count(*) FILTER (WHERE l_quantity > 25) AS hits, count(*) AS trials FROM lineitem GROUP BY 1""")
def conditional_count(spark, folder):
    return table(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.count_if(c("l_quantity") > 25).alias("hits"), F.count("*").alias("trials"))


@query("a18_total_of_sizes", """WITH f AS (SELECT l_linenumber, count(*) AS n FROM lineitem GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS total_boxes, count(*) AS layers FROM f""")
def total_of_sizes(spark, folder):
    sizes = grouping.frequency(table(spark, folder, "lineitem"), "l_linenumber")
    return sizes.agg(F.sum("freq").alias("total_boxes"), F.count("*").alias("layers"))


@query("a22_distinct_labels", """WITH w AS (SELECT event_type || '-' || (user_id % 97) AS label, event_id FROM events),
f AS (SELECT label, min(event_id) AS f FROM w GROUP BY 1) SELECT label, row_number() OVER (ORDER BY f) AS id FROM f""")
def distinct_labels(spark, folder):
    labels = table(spark, folder, "events").select(F.concat("event_type", F.lit("-"), c("user_id") % 97).alias("label"), "event_id")
    return numbering.dictionary_encode(labels, "label", ["event_id"])


@query("o1_composite_sort", """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice, o_orderkey) AS place FROM orders""")
def composite_sort(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return numbering.global_position(rows, ["o_orderpriority", "o_totalprice", "o_orderkey"], "place").select("o_orderkey", "place")


@query("o2_sorted_names", """SELECT name, row_number() OVER (ORDER BY name) AS id FROM (SELECT DISTINCT p_type || '/' || p_brand AS name FROM part)""")
def sorted_names(spark, folder):
    names = table(spark, folder, "part").select(F.concat("p_type", F.lit("/"), "p_brand").alias("name")).distinct()
    return numbering.global_position(names, ["name"], "id")


@query("o3_limit", f"""SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_linenumber > 1 ORDER BY {s.LINE_ORDER_SQL} LIMIT 10""")
def limit(spark, folder):
    return table(spark, folder, "lineitem").where("l_linenumber > 1").orderBy(*s.LINE_ORDER).limit(10).select("l_orderkey", "l_extendedprice")


@query("o4_first_101", f"""WITH {s.INSTANCES}, {s.BBOX}, {s.PLACED}
SELECT round(xmin, 6) AS xmin, round(ymin, 6) AS ymin, round(xmax, 6) AS xmax, round(ymax, 6) AS ymax FROM placed WHERE "CellName" = 'S5'
ORDER BY {s.LINE_ORDER_SQL} LIMIT 101""")
def first_101(spark, folder):
    from lamina.plans.layout import placed

    rows = lookup.pick_group(placed(spark, folder), "CellName", "S5")
    return rows.orderBy(*s.LINE_ORDER).limit(101).select(*[F.round(n, 6).alias(n) for n in ("xmin", "ymin", "xmax", "ymax")])


@query("o5_first_and_last", """(SELECT 'first' AS part_of, p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 5)
UNION ALL (SELECT 'last', p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey DESC LIMIT 5)""")
def first_and_last(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_retailprice")
    first = parts.orderBy("p_retailprice", "p_partkey").limit(5).select(F.lit("first").alias("part_of"), "*")
    last = parts.orderBy(c("p_retailprice").desc(), c("p_partkey").desc()).limit(5).select(F.lit("last").alias("part_of"), "*")
    return first.unionByName(last)


@query("o6_every_10000th", f"""WITH n AS (SELECT l_orderkey, l_partkey, row_number() OVER (ORDER BY {s.LINE_ORDER_SQL}) AS id FROM lineitem)
SELECT * FROM n WHERE id % 10000 = 0""")
def every_10000th(spark, folder):
    return global_ids(spark, folder).where("id % 10000 = 0")


@query("d1_union_distinct", """SELECT l_suppkey AS name FROM lineitem UNION SELECT l_partkey FROM lineitem""")
def union_distinct(spark, folder):
    return hierarchy.union_distinct(table(spark, folder, "lineitem"), "l_suppkey", "l_partkey")


@query("d2_first_seen_ids", f"""WITH f AS (SELECT l_suppkey AS v, min(({s.LINE_ORDER_SQL})) AS f FROM lineitem GROUP BY 1)
SELECT v AS l_suppkey, row_number() OVER (ORDER BY f) AS id FROM f""")
def first_seen_ids(spark, folder):
    return numbering.dictionary_encode(table(spark, folder, "lineitem"), "l_suppkey", s.LINE_ORDER)


@query("d2_growing_dictionary", f"""WITH f AS (SELECT l_suppkey AS v, min((l_orderkey % 3, {s.LINE_ORDER_SQL})) AS f FROM lineitem GROUP BY 1)
SELECT v AS l_suppkey, row_number() OVER (ORDER BY f) AS id FROM f""")
def growing_dictionary(spark, folder):
    """Three batches of line items, each added to the dictionary stored after the one before."""
    lines = table(spark, folder, "lineitem")
    known = materialise(numbering.dictionary_encode(lines.where("l_orderkey % 3 = 0"), "l_suppkey", s.LINE_ORDER))
    for batch in (1, 2):
        known = materialise(numbering.grow_dictionary(known, lines.where(c("l_orderkey") % 3 == batch), "l_suppkey", s.LINE_ORDER))
    return known


@query("d3_append", """SELECT o_orderkey AS k, o_totalprice AS v FROM orders UNION ALL SELECT l_orderkey, l_extendedprice FROM lineitem""")
def append(spark, folder):
    orders = table(spark, folder, "orders").select(c("o_orderkey").alias("k"), c("o_totalprice").alias("v"))
    return orders.unionByName(table(spark, folder, "lineitem").select(c("l_orderkey").alias("k"), c("l_extendedprice").alias("v")))


@query("d4_coordinate_set", f"""WITH {s.STAIRCASE_BOXES}, v AS (SELECT polygon, ymin AS y FROM stair_boxes UNION SELECT polygon, ymax FROM stair_boxes)
SELECT polygon, y FROM v""")
def coordinate_set(spark, folder):
    ys = F.array_distinct(F.transform("ring", lambda p: p["y"]))
    return s.staircases(spark, folder).select("polygon", F.explode(ys).alias("y"))


@query("d5_simple_edges", f"""WITH {s.INSTANCES} SELECT DISTINCT "CellName" AS parent, "RefCellName" AS child FROM instances""")
def simple_edges(spark, folder):
    return hierarchy.edges(s.instances(spark, folder), "CellName", "RefCellName")


@query("d6_scatter", f"""WITH {s.BBOX}, n AS (SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) AS number FROM part)
SELECT number, "XMAX", "YMAX" FROM n JOIN bbox ON "CellName" = 'P' || p_partkey""")
def scatter(spark, folder):
    parts = table(spark, folder, "part").select("p_name", "p_partkey")
    numbers = numbering.global_position(parts, ["p_name", "p_partkey"], "number").withColumn("name", F.concat(F.lit("P"), "p_partkey"))
    boxes = lookup.lookup(s.bbox(spark, folder), numbers, {"CellName": "name"}, {"number": "number"}, strict=True)
    return numbering.require_permutation(boxes, "number").select("number", "XMAX", "YMAX")
