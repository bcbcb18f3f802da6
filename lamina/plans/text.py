"""Queries: text formats in and out, meshes, netlists, tables on storage.

Input lines are formatted from the tables by Spark, then read back by the parsers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lamina import schemas
from lamina.constants import literal_rows
from lamina.durable import materialise, shared_folder
from lamina.functions.scalars import general_text
from lamina.operators import polygons
from lamina.operators.lookup import interval_lookup
from lamina.operators.numbering import global_position
from lamina.plans import standins as s
from lamina.plans.registry import query, table
from lamina.sources import delimited, dielectric, geo_text, gzip_members, layout_text, lines, matrices, mesh, netlist, ordered_text, placements, tables

c = F.col


def _scratch(spark) -> str:
    return f"{shared_folder(spark)}/lamina-{uuid.uuid4().hex}"


@query("io4_load_with_order", f"""SELECT count(*) AS n, count(DISTINCT (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS positions FROM lineitem""")
def load_with_order(spark, folder):
    rows = tables.with_source_order(table(spark, folder, "lineitem").select("l_orderkey"))
    places = rows.select("ord_file", "ord_row").distinct().agg(F.count("*").alias("positions"))
    return rows.agg(F.count("*").alias("n")).select("n", places.scalar().alias("positions"))


@query("io7_parquet_round_trip", "SELECT p_partkey, p_name, p_retailprice FROM part")
def parquet_round_trip(spark, folder):
    path = _scratch(spark)
    tables.export_parquet(table(spark, folder, "part").select("p_partkey", "p_name", "p_retailprice"), path, level=7)
    return spark.read.parquet(path)


@query("io6_replace_table", "SELECT s_suppkey, s_acctbal + 1 AS s_acctbal FROM supplier")
def replace_table(spark, folder):
    base = _scratch(spark)
    tables.persist({"supplier": table(spark, folder, "supplier").select("s_suppkey", "s_acctbal")}, base)
    current = spark.read.parquet(f"{base}/supplier.parquet")
    return spark.read.parquet(tables.replace_table(current.withColumn("s_acctbal", c("s_acctbal") + 1), base, "supplier"))


@query("io6_atomic_replace", "SELECT s_suppkey, s_acctbal + 3 AS s_acctbal FROM supplier WHERE s_suppkey % 3 > 0")
def atomic_replace(spark, folder):
    """Three versions, each made from the one before it."""
    base = _scratch(spark)
    tables.publish(table(spark, folder, "supplier").select("s_suppkey", "s_acctbal"), base, "supplier")
    current = tables.read_published(spark, base, "supplier")
    tables.publish(current.withColumn("s_acctbal", c("s_acctbal") + 3), base, "supplier")
    tables.publish(tables.read_published(spark, base, "supplier").where("s_suppkey % 3 > 0"), base, "supplier")
    return tables.read_published(spark, base, "supplier")


@query("io5_persist", f"""WITH {s.BBOX}, {s.INSTANCES} SELECT i."CellName", count(*) AS n, sum("XMAX") AS width FROM instances i JOIN bbox b ON "RefCellName" = b."CellName" GROUP BY 1""")
def persist(spark, folder):
    base = _scratch(spark)
    tables.persist({"bbox": s.bbox(spark, folder), "instances": s.instances(spark, folder).select("CellName", "RefCellName")}, base)
    tables.register_views({n: spark.read.parquet(f"{base}/{n}.parquet") for n in ("bbox", "instances")})
    return spark.sql("SELECT i.CellName, count(*) AS n, sum(XMAX) AS width FROM instances i JOIN bbox b ON RefCellName = b.CellName GROUP BY 1")


@query("io26_typed_pipe", f"WITH {s.BBOX} SELECT * FROM bbox")
def typed_pipe(spark, folder):
    path = _scratch(spark)
    tables.pipe(s.bbox(spark, folder), schemas.BBOX, path)
    return spark.read.parquet(path)


@query("io15_technology", """SELECT 'METAL' AS block, 'm' || p_partkey AS name, CAST(p_size AS BIGINT) AS layer, p_retailprice AS height, CAST(NULL AS VARCHAR) AS top FROM part
UNION ALL SELECT 'VIA', 'v' || s_suppkey, CAST(s_nationkey AS BIGINT), NULL, 'm' || (s_suppkey + 1) FROM supplier""")
def technology(spark, folder):
    parts, suppliers = table(spark, folder, "part"), table(spark, folder, "supplier")
    n, m = parts.count(), suppliers.count()
    metal = parts.select((c("p_partkey") + 3).alias("line"), F.concat_ws("\t", F.concat(F.lit("m"), "p_partkey"), "p_size", F.lit("20"), "p_retailprice", F.lit("0.36")).alias("value"))
    via = suppliers.select((c("s_suppkey") + n + 5).alias("line"), F.concat_ws(" ", F.concat(F.lit("v"), "s_suppkey"), "s_nationkey", F.lit("44"), F.concat(F.lit("m"), "s_suppkey"),
                                                                            F.concat(F.lit("m"), c("s_suppkey") + 1)).alias("value"))
    fixed = literal_rows(spark, [(1, "METAL{"), (2, "# name, layer, datatype, height, thickness"), (n + 3, "}"), (n + 4, "VIA{"), (n + m + 5, "}")], "line bigint, value string")
    metals, vias = dielectric.parse_technology(fixed.unionByName(metal).unionByName(via).withColumn("file", F.lit("tech")))
    none = F.lit(None)
    return metals.select(F.lit("METAL").alias("block"), "name", "layer", "height", none.cast("string").alias("top")).unionByName(
        vias.select(F.lit("VIA").alias("block"), "name", "layer", none.cast("double").alias("height"), "top"))


@query("io12_copy_database", """SELECT 'region' AS name, count(*) AS n, CAST(sum(r_regionkey) AS BIGINT) AS keys FROM region UNION ALL SELECT 'nation', count(*), CAST(sum(n_nationkey) AS BIGINT) FROM nation
UNION ALL SELECT 'customer', count(*), CAST(sum(c_custkey) AS BIGINT) FROM customer UNION ALL SELECT 'supplier', count(*), CAST(sum(s_suppkey) AS BIGINT) FROM supplier
UNION ALL SELECT 'part', count(*), CAST(sum(p_partkey) AS BIGINT) FROM part UNION ALL SELECT 'orders', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders
UNION ALL SELECT 'lineitem', count(*), CAST(sum(l_orderkey) AS BIGINT) FROM lineitem UNION ALL SELECT 'events', count(*), CAST(sum(event_id) AS BIGINT) FROM events
UNION ALL SELECT 'documents', count(*), CAST(sum(doc_id) AS BIGINT) FROM documents UNION ALL SELECT 'embeddings', count(*), CAST(sum(vec_id) AS BIGINT) FROM embeddings
UNION ALL SELECT 'pages', count(*), CAST(sum(page_id) AS BIGINT) FROM pages UNION ALL SELECT 'benchmark', count(*), CAST(sum(item_id) AS BIGINT) FROM benchmark
UNION ALL SELECT 'labels', count(*), CAST(sum(doc_id) AS BIGINT) FROM labels UNION ALL SELECT 'conversations', count(*), CAST(sum(conv_id) AS BIGINT) FROM conversations""")
def copy_database(spark, folder):
    """Every table of the folder copied, and counted in the copy with the sum of its first column."""
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
    base, counts = _scratch(spark), None
    tables.copy_tables(spark, folder, base, names)
    for name in names:
        copy = spark.read.parquet(f"{base}/{name}.parquet")
        key = {"customer": "c_custkey", "orders": "o_orderkey", "lineitem": "l_orderkey"}.get(name, copy.columns[0])
        own = copy.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.sum(c(key).cast("bigint")).alias("keys"))
        counts = own if counts is None else counts.unionByName(own)
    return counts


@query("io12_copy_tables", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def copy_tables(spark, folder):
    base = _scratch(spark)
    tables.copy_tables(spark, folder, base, ["nation", "region"])
    tables.register_views({n: spark.read.parquet(f"{base}/{n}.parquet") for n in ("nation", "region")})
    return spark.sql("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey == r_regionkey")


@query("io8_component_file", f"""WITH {s.COMPONENTS.split("),")[0]}) SELECT "InstanceName", "CellName", "X", CAST("Y" AS INTEGER) AS "Y", "Orientation" FROM components""")
def component_file(spark, folder):
    path = _scratch(spark)
    rows = s.components(spark, folder).select("InstanceName", "CellName", "X", "Y", "Orientation")
    rows.write.csv(path, sep=" ", header=False, compression="gzip")
    return delimited.read_components(spark, path)


@query("io9_member_csv", """SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders""")
def member_csv(spark, folder):
    """Orders as compressed CSV in few files of many members, read back by ranges of bytes."""
    path = _scratch(spark)
    lines = table(spark, folder, "orders").select(F.to_csv(F.struct("o_orderkey", "o_orderstatus", "o_totalprice")).alias("value"))
    gzip_members.write_members(lines.coalesce(2), path)
    return gzip_members.read_csv(spark, path, "o_orderkey bigint, o_orderstatus string, o_totalprice double", chunk=32 << 10)


@query("io10_csv_copy", """SELECT vec_id, label, len(embedding) AS width, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS total FROM embeddings""")
def csv_copy(spark, folder):
    path = _scratch(spark)
    rows = table(spark, folder, "embeddings").select("vec_id", "label", c("embedding").cast("array<double>").alias("embedding"))
    delimited.write_csv(rows, path)
    back = delimited.read_csv_copy(spark, path, rows.schema)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return back.select("vec_id", "label", F.size("embedding").cast("bigint").alias("width"), F.round(total, 5).alias("total"))


@query("io13_def_placements", f"""WITH {s.COMPONENTS.split("),")[0]}) SELECT "InstanceName", "CellName", "X", CAST("Y" AS INTEGER) AS "Y", "Orientation" FROM components""")
def def_placements(spark, folder):
    line = F.format_string("    - %s %s + PLACED ( %d %d ) %s ;", "InstanceName", "CellName", "X", "Y", "Orientation")
    return placements.parse_components(s.components(spark, folder).select(line.alias("value")))


def _layout_lines(spark, folder):
    """Layout text with one layer of rectangles, one ring of five points per part."""
    parts = table(spark, folder, "part")
    n = parts.count()
    x, y = c("p_partkey") * 3, c("p_size")
    ring = [F.concat_ws(", ", x + dx, y + dy) for dx, dy in ((0, 0), (2, 0), (2, 5), (0, 5), (0, 0))]
    body = parts.select((c("p_partkey") * 6 + 8).alias("first"), F.posexplode(F.array(F.lit("5"), *ring)).alias("k", "value"))
    head = [(1, "2"), (2, "0, 0, 119"), (3, "1, 119, 238"), (4, "1"), (5, "2, 505, 936, 1, 2"), (6, "1"), (7, str(n))]
    frame = literal_rows(spark, head, "line bigint, value string")
    return frame.unionByName(body.select((c("first") + c("k")).alias("line"), "value")).withColumn("file", F.lit("layout"))


@query("io14_layout_text", """SELECT CAST(1 AS BIGINT) AS layer_id, row_number() OVER (ORDER BY p_partkey) AS polygon, CAST(p_partkey * 3 AS DOUBLE) AS xmin, CAST(p_size AS DOUBLE) AS ymin,
CAST(p_partkey * 3 + 2 AS DOUBLE) AS xmax, CAST(p_size + 5 AS DOUBLE) AS ymax FROM part""")
def layout(spark, folder):
    parsed = layout_text.parse_layout(_layout_lines(spark, folder))["polygons"]
    return parsed.select("layer_id", "polygon", *[v.alias(n) for n, v in polygons.ring_box(c("ring")).items()])


@query("io16_dielectrics", """SELECT p_partkey AS line, 'D' || p_partkey AS name, CAST(p_size AS DOUBLE) / 8 * 1000 AS zmin, CAST(p_size + 1 AS DOUBLE) / 8 * 1000 AS zmax, p_retailprice AS eps FROM part""")
def dielectrics(spark, folder):
    text = F.concat_ws("  ", F.concat(F.lit("D"), "p_partkey"), c("p_size") / 8, (c("p_size") + 1) / 8, "p_retailprice")
    return dielectric.parse_dielectrics(table(spark, folder, "part").select(c("p_partkey").alias("line"), text.alias("value")))


@query("io17_mesh_nodes", f"WITH {s.MESH} SELECT id, x, y, CAST(0.0 AS DOUBLE) AS z FROM mesh_nodes")
def mesh_nodes(spark, folder):
    nodes, _ = mesh.parse_mesh(s.mesh_lines(spark, folder))
    return nodes.drop("file")


@query("io17_mesh_elements", f"""WITH {s.MESH} SELECT id, kind AS type, CAST(0 AS INTEGER) AS tag1, tag2, concat_ws(',', n1, n2, CASE WHEN kind >= 2 THEN n3 END, CASE WHEN kind = 3 THEN n4 END) AS nodes FROM mesh_elements""")
def mesh_elements(spark, folder):
    _, elements = mesh.parse_mesh(s.mesh_lines(spark, folder))
    return elements.select("id", "type", "tag1", "tag2", F.concat_ws(",", c("nodes").cast("array<string>")).alias("nodes"))


@query("p12_element_type", f"WITH {s.MESH} SELECT kind AS type, count(*) AS n FROM mesh_elements WHERE kind IN (2, 3) GROUP BY 1")
def element_type(spark, folder):
    _, elements = mesh.parse_mesh(s.mesh_lines(spark, folder))
    return elements.where(c("type").isin(mesh.TRIANGLE, mesh.QUADRILATERAL)).groupBy("type").agg(F.count("*").alias("n"))


@query("p13_boundary", f"""WITH {s.MESH} SELECT e.id, n1 AS node1, n2 AS node2, abs(x) = 1 OR abs(y) = 1 AS fixed FROM mesh_elements e JOIN mesh_nodes n ON n1 = n.id WHERE kind = 1""")
def boundary(spark, folder):
    nodes, elements = mesh.parse_mesh(s.mesh_lines(spark, folder))
    return mesh.boundary(elements, nodes)


@query("j7_line_coordinates", f"""WITH {s.MESH} SELECT e.id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM mesh_elements e JOIN mesh_nodes a ON n1 = a.id JOIN mesh_nodes b ON n2 = b.id WHERE kind = 1""")
def line_coordinates(spark, folder):
    from lamina.operators.lookup import lookup

    nodes, elements = mesh.parse_mesh(s.mesh_lines(spark, folder))
    ends = elements.where(c("type") == mesh.LINE).select("id", F.get("nodes", F.lit(0)).alias("a"), F.get("nodes", F.lit(1)).alias("b"))
    first = lookup(ends, nodes, {"a": "id"}, {"x": "x1", "y": "y1"}, strict=True)
    return lookup(first, nodes, {"b": "id"}, {"x": "x2", "y": "y2"}, strict=True).drop("a", "b")


@query("io18_solver_files", f"""WITH {s.MESH}, l AS (SELECT e.*, abs(x) = 1 OR abs(y) = 1 AS fixed FROM mesh_elements e LEFT JOIN mesh_nodes n ON n1 = n.id AND kind = 1),
body AS (SELECT 'coordinates' AS file, CAST(id AS BIGINT) AS n, concat_ws(chr(9), id, x, y) AS value FROM mesh_nodes
 UNION ALL SELECT 'element3', row_number() OVER (ORDER BY id), concat_ws(chr(9), row_number() OVER (ORDER BY id), n1, n2, n3) FROM mesh_elements WHERE kind = 2
 UNION ALL SELECT 'element4', row_number() OVER (ORDER BY id), concat_ws(chr(9), row_number() OVER (ORDER BY id), n1, n2, n3, n4) FROM mesh_elements WHERE kind = 3
 UNION ALL SELECT 'dirichlet', row_number() OVER (ORDER BY id), concat_ws(chr(9), row_number() OVER (ORDER BY id), n1, n2) FROM l WHERE kind = 1 AND fixed
 UNION ALL SELECT 'neumann', row_number() OVER (ORDER BY id), concat_ws(chr(9), row_number() OVER (ORDER BY id), n1, n2) FROM l WHERE kind = 1 AND NOT fixed)
SELECT file, n + 2 AS line, value FROM body""")
def solver_files(spark, folder):
    """The five solver files as lines, headers aside."""
    from lamina.durable import materialise

    nodes, elements = (materialise(t) for t in mesh.parse_mesh(s.mesh_lines(spark, folder)))
    out = None
    for name, rows in mesh.solver_tables(nodes, elements).items():
        text = mesh.solver_lines(name, rows).withColumn("file", F.lit(name))
        out = text if out is None else out.unionByName(text)
    return out.where("line > 2")


@query("io18_solver_text", f"""WITH {s.MESH}, l AS (SELECT e.*, abs(x) = 1 OR abs(y) = 1 AS fixed FROM mesh_elements e LEFT JOIN mesh_nodes n ON n1 = n.id AND kind = 1),
body AS (SELECT 'element3' AS file, row_number() OVER (ORDER BY id) AS n, concat_ws(chr(9), row_number() OVER (ORDER BY id), n1, n2, n3) AS value FROM mesh_elements WHERE kind = 2
 UNION ALL SELECT 'dirichlet', row_number() OVER (ORDER BY id), concat_ws(chr(9), row_number() OVER (ORDER BY id), n1, n2) FROM l WHERE kind = 1 AND fixed
 {"".join(f"UNION ALL SELECT '{name}', {k} - {len(mesh.HEADERS[name])}, '{line}' " for name in ("element3", "dirichlet") for k, line in enumerate(mesh.HEADERS[name], 1))})
SELECT file, n + CASE file WHEN 'element3' THEN {len(mesh.HEADERS["element3"])} ELSE {len(mesh.HEADERS["dirichlet"])} END AS line, value FROM body""")
def solver_text(spark, folder):
    """Two solver files whole, with their headers, each written in order by several tasks."""
    nodes, elements = (materialise(t) for t in mesh.parse_mesh(s.mesh_lines(spark, folder)))
    out, every = None, mesh.solver_tables(nodes, elements)
    for name in ("element3", "dirichlet"):
        path = _scratch(spark)
        ordered_text.write_ordered(mesh.solver_lines(name, every[name]), path, ["line"])
        text = ordered_text.read_ordered(spark, path).withColumn("file", F.lit(name))
        out = text if out is None else out.unionByName(text)
    return out


def _dump_lines(spark, folder):
    """One ``row r: (c, v) ...`` line per order line, 0-based."""
    pair = F.format_string("(%d, %s)  (%d, %s)", "l_partkey", c("l_quantity").cast("string"), c("l_suppkey") + 100000, c("l_discount").cast("string"))
    return table(spark, folder, "lineitem").select(F.concat(F.lit("row "), "l_orderkey", F.lit(": "), pair).alias("value"))


@query("io19_row_dump", """SELECT l_orderkey + 1 AS i, l_partkey + 1 AS j, l_quantity AS v FROM lineitem UNION ALL SELECT l_orderkey + 1, l_suppkey + 100001, l_discount FROM lineitem""")
def row_dump(spark, folder):
    return matrices.parse_row_dump(_dump_lines(spark, folder))


@query("io19_matrix_market", f"""WITH {s.COO}, b AS (SELECT row_number() OVER (ORDER BY i, j) + 2 AS line, i || ' ' || j || ' ' || v AS value FROM coo)
SELECT 1 AS line, '%%MatrixMarket matrix coordinate real general' AS value UNION ALL SELECT 2, max(i) || ' ' || max(j) || ' ' || count(*) FROM coo UNION ALL SELECT * FROM b""")
def matrix_market(spark, folder):
    return matrices.matrix_market_lines(s.coo(spark, folder))


@query("io20_matrix_market_read", f"WITH {s.COO} SELECT i, j, v FROM coo")
def matrix_market_read(spark, folder):
    path = _scratch(spark)
    lines.write_lines(matrices.matrix_market_lines(s.coo(spark, folder)), path, "value", ["line"])
    # part files carry on the text of the one before: numbered by name, then line, they are one file again
    text = global_position(lines.read_lines(spark, path), ["file", "line"], "at").select(F.lit("all").alias("file"), c("at").alias("line"), "value")
    return matrices.parse_matrix_market(text)[0].select("i", "j", "v")


@query("io21_list_literal", """WITH n AS (SELECT max(p_partkey) + 1 AS n FROM part)
SELECT 1 AS line, 'A := [' AS value UNION ALL SELECT p_partkey + 2, '  [' || p_partkey || ', ' || p_size || ']' || CASE WHEN p_partkey + 1 < n THEN ',' ELSE '' END FROM part, n UNION ALL SELECT n + 2, '];' FROM n""")
def list_literal(spark, folder):
    rows = table(spark, folder, "part").select((c("p_partkey") + 1).alias("i"), F.array("p_partkey", c("p_size").cast("bigint")).alias("values"))
    return matrices.list_literal_lines(rows)


STAIR_ROWS = f"""{s.STAIRCASE_BOXES}, st AS (SELECT layer + 1 AS layer, polygon, step, xmin, ymin, xmax, ymax FROM stair_boxes),
bx AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY polygon, step) AS box, row_number() OVER (ORDER BY layer, polygon, step) AS id FROM st),
rt AS (SELECT *, min(box) OVER (PARTITION BY layer, polygon) AS root FROM bx), tot AS (SELECT count(*) AS total FROM rt),
e AS (SELECT min(xmin) - 500 AS xmin, min(ymin) - 500 AS ymin, max(xmax) + 500 AS xmax, max(ymax) + 500 AS ymax FROM rt WHERE layer <> 3)"""


def _num(x):
    return f"CASE WHEN {x} < 0 THEN '' ELSE ' ' END || CAST(CAST({x} AS BIGINT) AS VARCHAR)"


def _box_sql(n, *v):
    return f"'Box(' || {n} || ') = {{' || " + " || ', ' || ".join(_num(x) for x in v) + " || '};'"


SCRIPT_SQL = f"""WITH {STAIR_ROWS}, per AS (SELECT layer, count(*) AS freq FROM rt GROUP BY 1),
spans AS (SELECT layer, freq, CAST(sum(freq) OVER (ORDER BY layer) AS BIGINT) AS stop, total + layer AS n FROM per, tot), cut AS (SELECT * FROM spans WHERE layer <> 3),
grp AS (SELECT layer, root, min(id) AS low, max(id) AS high FROM rt WHERE layer <> 3 GROUP BY 1, 2),
gr AS (SELECT *, row_number() OVER (ORDER BY layer, root) AS g FROM grp)
SELECT 1 AS section, layer AS number, {_box_sql("n", "xmin", "ymin", "layer * 100", "xmax - xmin", "ymax - ymin", "CASE WHEN layer IN (1, 4) THEN 160 ELSE 60 END")}
  || ' // PhysicalGroup=' || n || ', layer=' || layer AS value FROM cut, e
UNION ALL SELECT 2, id, {_box_sql("id", "xmin", "ymin", "layer * 100", "xmax - xmin", "ymax - ymin", "60")} || ' // id=' || id || ', layer=' || layer FROM rt
UNION ALL SELECT 3, layer, 'my_fragments' || n || '() = BooleanFragments{{ Volume{{' || n || '}}; Delete; }}{{ Volume{{' || (stop - freq + 1) || ' : ' || stop || '}}; Delete; }};' FROM cut
UNION ALL SELECT 4, g, 'Physical Volume("L_' || layer || '_R_' || root || '",' || (total + 99 + g) || ' ) = {{' || low || ' : ' || high || '}};' FROM gr, tot
UNION ALL SELECT 5, layer, 'Physical Volume("Diel' || layer || '", ' || n || ') = my_fragments' || n || '();' FROM cut"""


@query("io22_mesh_script", SCRIPT_SQL)
def mesh_script(spark, folder):
    return geo_text.box_script(*stair_boxes(spark, folder))


def stair_boxes(spark, folder):
    """Staircases on layers 1, 2, 4 and 5 as conductors and layer 3 as a via between them: boxes and layers."""
    rings = s.staircases(spark, folder).withColumn("layer", c("layer") + 1)
    boxes = polygons.labelled_boxes(rings, ["layer"], ["polygon"])
    layer = rings.select("layer").distinct()
    stack = layer.select("layer", (c("layer") * 100).alias("zmin"), (c("layer") * 100 + 60).alias("zmax"), (c("layer") == 3).alias("is_via"))
    return boxes, stack


@query("io22_whole_script", f"""WITH body AS ({SCRIPT_SQL}), lines AS (SELECT * FROM body
UNION ALL SELECT 0, 1, 'SetFactory("OpenCASCADE");' UNION ALL SELECT 0, 2, 'lc = 0.5; // Characteristic length (mesh size)'
UNION ALL SELECT 6, 1, 'Physical Volume("boxes") = {{1 : ' || count(*) || '}};' FROM body WHERE section = 2
UNION ALL SELECT 6, 2, '// Define the mesh size for all points' UNION ALL SELECT 6, 3, 'Mesh.MeshSizeMin = lc;')
SELECT row_number() OVER (ORDER BY section, number) AS line, value FROM lines""")
def whole_script(spark, folder):
    """The script from its head to its end, written as one ordered text by several tasks and read back."""
    path = _scratch(spark)
    ordered_text.write_ordered(geo_text.whole_box_script(*stair_boxes(spark, folder)), path, ["section", "number"])
    return ordered_text.read_ordered(spark, path)


@query("io23_conductor_script", """WITH p AS (SELECT p_size % 5 + 1 AS layer, p_partkey, p_size, p_size % 4 + 1 AS steps FROM part)
SELECT CAST(layer AS BIGINT) AS layer, p_partkey AS polygon, CASE WHEN steps = 1 THEN
  'x0=' || format('{:.6f}', CAST(p_partkey + CASE WHEN layer = 5 THEN 0 ELSE 20 END AS DOUBLE)) || '; y0=' || format('{:.6f}', CAST(p_size + CASE WHEN layer = 5 THEN 0 ELSE 20 END AS DOUBLE))
  || '; z0=' || format('{:.6f}', CAST(layer * 100 + 20 AS DOUBLE)) || '; dx=-38.000000; dy=1.000000; dz=20.000000; lc = lc_inner;' || chr(10) || 'Call "BuildBox";' || chr(10)
 ELSE 'px[] = {' || p_partkey || '.0,' || (p_partkey + 2 * steps) || '.0,' || list_aggregate(list_transform(generate_series(0, steps - 1), lambda i: (p_partkey + 2 * (steps - i)) || '.0,' || (p_partkey + 2 * (steps - i) - 2) || '.0'), 'string_agg', ',')
  || '};' || chr(10) || 'py[] = {' || p_size || '.0,' || p_size || '.0,' || list_aggregate(list_transform(generate_series(0, steps - 1), lambda i: (p_size + i + 1) || '.0,' || (p_size + i + 1) || '.0'), 'string_agg', ',') || '};' || chr(10)
  || 'z0=' || format('{:.6f}', CAST(layer * 100 + 20 AS DOUBLE)) || '; dz=20.000000; lc = lc_inner;' || chr(10) || 'Call "BuildPolygon";' || chr(10) END
 || 'Physical Surface("L_' || layer || '_R_' || p_partkey || '",' || (layer * 200 + p_partkey) || ') = { all_surfs[]};' || chr(10) || 'conductor_loops[] += sl_id;' AS value FROM p""")
def conductor_script(spark, folder):
    rings = s.staircases(spark, folder).withColumn("layer", c("layer") + 1)
    layer = rings.select("layer").distinct()
    stack = layer.select("layer", (c("layer") * 100).alias("zmin"), (c("layer") * 100 + 60).alias("zmax"), (c("layer") == 5).alias("is_via"))
    return geo_text.conductor_script(rings, stack)


@query("io24_words", r"""SELECT count(*) AS words FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS word FROM documents) WHERE word <> ''""")
def words(spark, folder):
    path = _scratch(spark)
    table(spark, folder, "documents").select("text").write.text(path)
    return lines.read_words(spark, path).agg(F.count("*").alias("words"))


@query("s18_gates", """SELECT o_orderkey, 'n' || o_orderkey AS lhs, o_orderkey % 2 = 0 AS neg1, 'i' || o_custkey AS rhs1, o_custkey % 3 = 0 AS neg2, 'n' || (o_orderkey // 2) AS rhs2 FROM orders""")
def gates(spark, folder):
    line = F.concat(F.lit("n"), "o_orderkey", F.lit(" = "), F.when(c("o_orderkey") % 2 == 0, "! ").otherwise(""), F.lit("i"), "o_custkey", F.lit(" * "),
                    F.when(c("o_custkey") % 3 == 0, "!").otherwise(""), F.lit("n"), F.floor(c("o_orderkey") / 2), F.when(c("o_orderkey") % 5 == 0, ";").otherwise(" "))
    return netlist.parse_gates(table(spark, folder, "orders").select("o_orderkey", line.alias("value")))


@query("s20_general_text", """SELECT p_partkey, CAST(p_partkey * 3 AS VARCHAR) AS whole, p_partkey || '.5' AS half FROM part""")
def general(spark, folder):
    rows = table(spark, folder, "part")
    return rows.select("p_partkey", general_text((c("p_partkey") * 3).cast("double")).alias("whole"), general_text(c("p_partkey") + F.lit(0.5)).alias("half"))


@query("j6_layer_of_price", """WITH d AS (SELECT p_size AS ord, 'D' || p_size AS name, CAST(min(p_size) AS DOUBLE) * 1000 AS zmin, CAST(min(p_size) + 1 AS DOUBLE) * 1000 AS zmax FROM part GROUP BY 1)
SELECT o_orderkey, name AS layer FROM orders LEFT JOIN d ON o_totalprice / 10 >= zmin AND o_totalprice / 10 < zmax""")
def layer_of_price(spark, folder):
    """Dielectric text lines parsed and used as the interval table."""
    text = table(spark, folder, "part").select(c("p_size").cast("bigint").alias("line")).distinct().select(
        "line", F.concat_ws(" ", F.concat(F.lit("D"), "line"), "line", c("line") + 1, F.lit("3.9")).alias("value"))
    table_rows = dielectric.parse_dielectrics(text)
    orders = table(spark, folder, "orders").select("o_orderkey", (c("o_totalprice") / 10).alias("z"))
    return interval_lookup(orders, "z", table_rows, "zmin", "zmax", "name", "line", "layer").select("o_orderkey", "layer")
