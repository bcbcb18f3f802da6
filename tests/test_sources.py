"""Readers and writers on small files with known contents."""

import pytest
from pyspark.sql import functions as F

from lamina import schemas
from lamina.checks import StrictModeError
from lamina.operators import polygons
from lamina.sources import delimited, dielectric, geo_text, layout_text, lines, matrices, mesh, netlist, placements, tables
from tests.conftest import rows

c = F.col


def text_lines(spark, text, file="f"):
    data = [(file, k, l.strip()) for k, l in enumerate((l for l in text.splitlines() if l.strip()), 1)]
    return spark.createDataFrame(data, "file string, line bigint, value string")


def test_read_lines_numbers_every_file(spark, tmp_path):
    for name, n in (("a.txt", 50), ("b.txt", 3)):
        (tmp_path / name).write_text("\n\n".join(f"  {name} {k} " for k in range(1, n + 1)))
    got = [(r["file"].rsplit("/", 1)[1], r["line"], r["value"]) for r in lines.read_lines(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted((f, k, f"{f} {k}") for f, n in (("a.txt", 50), ("b.txt", 3)) for k in range(1, n + 1))


def test_read_lines_of_a_file_in_many_splits(spark, tmp_path):
    (tmp_path / "big.txt").write_text("\n".join(f"line {k}" for k in range(1, 5001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = lines.read_lines(spark, str(tmp_path / "big.txt"))
        assert got.where(F.concat(F.lit("line "), c("line")) != c("value")).isEmpty() and got.count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_write_lines_keeps_order(spark, tmp_path):
    df = spark.range(200).select("id", F.concat(F.lit("v"), "id").alias("value"))
    lines.write_lines(df, str(tmp_path / "out"), "value", ["id"])
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert [l for p in parts for l in p.read_text().split()] == [f"v{k}" for k in range(200)]
    assert rows(lines.read_words(spark, str(tmp_path / "out")).agg(F.count("*"))) == [(200,)]


PLACED = """- _348_ sky130_fd_sc_hd__buf_4 + PLACED ( 324300 46240 ) FS ;
- _349_ sky130_fd_sc_hd__nand2_8 + PLACED ( 508300 65280 ) N ;
END COMPONENTS"""


def test_placements_and_component_file(spark, tmp_path):
    parsed = placements.parse_components(text_lines(spark, PLACED)).drop("file", "line")
    want = [("_348_", "sky130_fd_sc_hd__buf_4", 324300, 46240, "FS"), ("_349_", "sky130_fd_sc_hd__nand2_8", 508300, 65280, "N")]
    assert rows(parsed) == want
    parsed.write.csv(str(tmp_path / "c"), sep=" ", compression="gzip")
    back = delimited.read_components(spark, str(tmp_path / "c"))
    assert rows(back) == want and back.schema == schemas.DEFCOMPONENTS


def test_csv_round_trip_with_arrays(spark, tmp_path):
    df = spark.createDataFrame([("a", [1, 2], 3), ("b", [], 4)], schemas.PARENTCHILD)
    delimited.write_csv(df, str(tmp_path / "pc"))
    back = delimited.read_csv_copy(spark, str(tmp_path / "pc"), schemas.PARENTCHILD)
    assert {r[0]: (list(r[1]), r[2]) for r in back.collect()} == {"a": ([1, 2], 3), "b": ([], 4)}
    table = delimited.csv_lines(spark, "ParentName,ChildName\n Top,Frame\n Top,Core", delimited.StructType.fromDDL("ParentName string, ChildName string"))
    assert rows(table) == [("Top", "Core"), ("Top", "Frame")]


def test_dielectrics(spark):
    text = "FOX   0 0.12 3.9\nPSG   0.12 0.9361 3.9\nPI1 5.3711 11.8834 2.94"
    got = rows(dielectric.parse_dielectrics(text_lines(spark, text)), "name", "zmin", "zmax", "eps")
    assert got == [("FOX", 0.0, 120.0, 3.9), ("PI1", 5371.1, 11883.4, 2.94), ("PSG", 120.0, 936.1, 3.9)]
    with pytest.raises(StrictModeError, match="bad dielectric"):
        dielectric.parse_dielectrics(text_lines(spark, "8\n" + text))


def test_technology(spark):
    text = "METAL{\n# name layer\nnwell\t64\t20 0 0.12\nmet5\t72\t20 5.3711 1.26\n}\nVIA{\n# x\nmcon\t67\t44 li1  met1\n}"
    metals, vias = dielectric.parse_technology(text_lines(spark, text))
    assert rows(metals.drop("line")) == [("met5", 72, 20, 5.3711, 1.26), ("nwell", 64, 20, 0.0, 0.12)]
    assert rows(vias.drop("line")) == [("mcon", 67, 44, "li1", "met1")]


LAYOUT = """3
0, 0, 119
1, 119, 238
2, 326, 505
2
3, 505, 936, 1, 2
4, 1036, 1376, 2, 3
0
1
5
-190, 1305
3410, 1305
3410, 2930
-190, 2930
-190, 1305
1
0
2
2
7
0, 0
2, 0
2, 1
1, 1
1, 2
0, 2
0, 0
5
10, 10
12, 10
12, 11
10, 11
10, 10
3
1
5
1, 1
2, 1
2, 2
1, 2
1, 1"""


def test_layout_text(spark):
    both = text_lines(spark, LAYOUT).union(text_lines(spark, LAYOUT, "g"))
    parsed = layout_text.parse_layout(both)
    assert rows(parsed["layers"].where("file = 'f'").drop("file")) == [(0, 0, 119), (1, 119, 238), (2, 326, 505)]
    assert rows(parsed["vias"].where("file = 'g'").drop("file")) == [(3, 505, 936, 1, 2), (4, 1036, 1376, 2, 3)]
    got = rows(parsed["polygons"].where("file = 'g'"), "layer_id", "polygon", "vertices", F.size("ring"))
    assert got == [(0, 1, 5, 5), (2, 1, 7, 7), (2, 2, 5, 5), (3, 1, 5, 5)]
    ring = parsed["polygons"].where("file = 'f' and layer_id = 2 and polygon = 1").first()["ring"]
    assert [tuple(p) for p in ring] == [(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2), (0, 0)]


def test_layout_text_is_not_broadcast(spark, monkeypatch):
    plans, write = [], layout_text.materialise

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(layout_text, "materialise", kept)
    layout_text.parse_layout(text_lines(spark, LAYOUT))
    assert "BroadcastHashJoin" not in plans[0] and "SortMergeJoin" in plans[0]


def test_matrix_lines_are_not_gathered_by_file(spark):
    text = text_lines(spark, "%%MatrixMarket matrix coordinate real general\n2 2 2\n1 1 0.5\n2 1 3")
    entries, sizes = matrices.parse_matrix_market(text)
    assert "strategy=broadcast" in entries._jdf.queryExecution().optimizedPlan().toString()
    assert rows(entries.drop("file")) == [(1, 1, 0.5), (2, 1, 3.0)] and rows(sizes.drop("file")) == [(2, 2, 2)]


@pytest.mark.parametrize("old,new,message", [
    ("\n7\n", "\n6\n", "outside a polygon"), ("\n7\n", "\n8\n", "fewer vertices"), ("\n2\n2\n7", "\n2\n3\n7", "another number of polygons"),
    ("936, 1, 2", "936, 1, 9", "unknown layer"), ("10, 11\n", "10, x\n", "fewer vertices")])
def test_layout_text_errors(spark, old, new, message):
    with pytest.raises(StrictModeError, match=message):
        layout_text.parse_layout(text_lines(spark, LAYOUT.replace(old, new, 1)))


# A published sample of the mesh format, kept as golden input.
MESH = """$MeshFormat
2.2 0 8
$EndMeshFormat
$Nodes
9
1 0 0 0
2 1 0 0
3 1 1 0
4 0 1 0
5 0.499999999998694 0 0
6 1 0.499999999998694 0
7 0.5000000000020591 1 0
8 0 0.5000000000020591 0
9 0.5000000000003766 0.5000000000003767 0
$EndNodes
$Elements
16
1 15 2 0 1 1
2 15 2 0 2 2
3 15 2 0 3 3
4 15 2 0 4 4
5 1 2 0 1 1 5
6 1 2 0 1 5 2
7 1 2 0 2 2 6
8 1 2 0 2 6 3
9 1 2 0 3 3 7
10 1 2 0 3 7 4
11 1 2 0 4 4 8
12 1 2 0 4 8 1
13 3 2 0 6 4 8 9 7
14 3 2 0 6 7 9 6 3
15 3 2 0 6 8 1 5 9
16 3 2 0 6 9 5 2 6
$EndElements"""


def test_mesh(spark):
    nodes, elements = mesh.parse_mesh(text_lines(spark, MESH))
    assert nodes.count() == 9 and rows(elements.groupBy("type").count()) == [(1, 8), (3, 4), (15, 4)]
    assert rows(elements.where("id = 13"), "tag1", "tag2", "nodes") == [(0, 6, [4, 8, 9, 7])]
    out = mesh.solver_tables(nodes, elements)
    assert rows(out["element4"])[0] == (1, 4, 8, 9, 7) and out["element3"].isEmpty()
    assert rows(out["dirichlet"]) == [(1, 2, 6), (2, 6, 3), (3, 3, 7), (4, 7, 4), (5, 4, 8)]
    assert rows(out["neumann"]) == [(1, 1, 5), (2, 5, 2), (3, 8, 1)]
    text = mesh.solver_lines("neumann", out["neumann"]).orderBy("line")
    assert [r["value"] for r in text.collect()][1:3] == ["% Neumann-Edge-count / 1-Node / 2-Node", "1\t1\t5"]


@pytest.mark.parametrize("old,new", [("\n9\n1 0", "\n8\n1 0"), ("2 1 0 0", "7 1 0 0"), ("$EndElements", ""), ("1 15 2 0 1 1", "1 77 2 0 1 1"), ("16 3 2 0 6 9 5 2 6", "16 3 2 0 6 9 5 2")])
def test_mesh_errors(spark, old, new):
    with pytest.raises(StrictModeError):
        mesh.parse_mesh(text_lines(spark, MESH.replace(old, new, 1)))


def test_matrix_text(spark, tmp_path):
    dump = text_lines(spark, "header\nrow 124263: (36163, -943.335)  (36164, -4465.48)\nrow 0: ( 1 , 2e-3)")
    entries = matrices.parse_row_dump(dump)
    want = [(1, 2, 0.002), (124264, 36164, -943.335), (124264, 36165, -4465.48)]
    assert rows(entries) == want
    text = [r["value"] for r in matrices.matrix_market_lines(entries).orderBy("line").collect()]
    assert text == ["%%MatrixMarket matrix coordinate real general", "124264 36165 3", "1 2 0.002", "124264 36164 -943.335", "124264 36165 -4465.48"]
    back, sizes = matrices.parse_matrix_market(text_lines(spark, "\n".join([text[0], "% note", *text[1:]])))
    assert rows(back.drop("file")) == want and rows(sizes.drop("file")) == [(124264, 36165, 3)]
    small = spark.createDataFrame([(1, [1, 2]), (2, [3, 4])], "i bigint, values array<int>")
    assert [r["value"] for r in matrices.list_literal_lines(small).orderBy("line").collect()] == ["A := [", "  [1, 2],", "  [3, 4]", "];"]


NETLIST = """# half of a small adder
INORDER = a b carry
OUTORDER = sum
t1 = a * ! b
t2 = ! a * b
sum = ! t1 * !t2;
keep = carry * sum"""


def test_gates(spark):
    gates = netlist.parse_gates(text_lines(spark, NETLIST)).drop("file", "line")
    assert rows(gates) == [("keep", False, "carry", False, "sum"), ("sum", True, "t1", True, "t2"), ("t1", False, "a", True, "b"), ("t2", True, "a", False, "b")]


def test_mesh_scripts(spark):
    parsed = layout_text.parse_layout(text_lines(spark, LAYOUT))
    rings = parsed["polygons"].withColumn("layer", c("layer_id") + 1)
    stack = spark.createDataFrame([(1, 0, 119, False), (2, 119, 238, False), (3, 326, 505, False), (4, 505, 936, True), (5, 1036, 1376, True)], "layer bigint, zmin bigint, zmax bigint, is_via boolean")
    blocks = {(r["layer"], r["polygon"]): r["value"] for r in geo_text.conductor_script(rings, stack).collect()}
    assert blocks[1, 1].startswith("x0=-170.000000; y0=1325.000000; z0=20.000000; dx=3560.000000; dy=1625.000000; dz=79.000000; lc = lc_inner;\nCall \"BuildBox\";\n")
    assert 'Physical Surface("L_1_R_1",201) = { all_surfs[]};' in blocks[1, 1]
    assert blocks[3, 1].startswith("px[] = {0.0,2.0,2.0,1.0,1.0,0.0};\npy[] = {0.0,0.0,1.0,1.0,2.0,2.0};\nz0=346.000000; dz=139.000000; lc = lc_inner;")
    assert blocks[4, 1].startswith("x0=1.000000; y0=1.000000; z0=525.000000; dx=-39.000000;")

    boxes = polygons.labelled_boxes(rings, ["layer"], ["polygon"])
    script = [tuple(r) for r in geo_text.box_script(boxes, stack).orderBy("section", "number").collect()]
    assert script[0][2] == "Box(6) = {-690, -500,  0,  4600,  3930,  238}; // PhysicalGroup=6, layer=1"
    assert script[2][2] == "Box(8) = {-690, -500,  326,  4600,  3930,  179}; // PhysicalGroup=8, layer=3"
    assert (2, 2, "Box(2) = { 0,  0,  326,  2,  1,  179}; // id=2, layer=3") in script
    assert [r[2] for r in script if r[0] == 4] == ['Physical Volume("L_1_R_1",105 ) = {1 : 1};', 'Physical Volume("L_3_R_1",106 ) = {2 : 3};', 'Physical Volume("L_3_R_3",107 ) = {4 : 4};']
    assert [r[2] for r in script if r[0] == 5] == ['Physical Volume("Diel1", 6) = my_fragments6();', 'Physical Volume("Diel3", 8) = my_fragments8();']
    between = stack.withColumn("is_via", c("layer") == 1)
    late = [r[0] for r in geo_text.box_script(boxes, between).where("section = 4").orderBy("number").select("value").collect()]
    assert late[0] == 'Physical Volume("L_3_R_1",105 ) = {2 : 3};' and late[2] == 'Physical Volume("L_4_R_1",107 ) = {5 : 5};'
    for script_of, shapes in ((geo_text.box_script, boxes), (geo_text.conductor_script, rings)):
        with pytest.raises(StrictModeError, match="unknown layer"):
            script_of(shapes, stack.where("layer <> 3"))
    outer = spark.createDataFrame([(-1000.0, -1000.0, 6000.0, 6000.0)], "xmin double, ymin double, xmax double, ymax double")
    assert geo_text.outer_box_text(outer).first()[0].startswith("x0=-1000.000000; y0=-1000.000000; z0=0.000000; dx=7000.000000; dy=7000.000000; dz=4000.000000;")


def test_table_bundle(spark, tmp_path):
    base, other = str(tmp_path / "design"), str(tmp_path / "copy")
    made = {n: spark.createDataFrame([], s) for n, s in schemas.LAYOUT_TABLES.items()}
    made["instances"] = spark.createDataFrame([("T", f"c{k % 2}", float(k), 0.0, 1.0, 0.0, False, False, 1, 1, 0.0, 0.0) for k in range(6)], schemas.INSTANCES)
    tables.persist(made, base)
    with pytest.raises(Exception, match="already exists"):
        tables.persist({"bbox": made["bbox"]}, base)
    design = tables.load_design(spark, base, ["X"])
    assert rows(design["instances"], "inum", "X") == [(k + 1, float(k)) for k in range(6)]
    assert "parentchild" not in tables.load_design(spark, base, ["X"], with_hierarchy=False)
    current = spark.read.parquet(f"{base}/instances.parquet")
    tables.replace_table(current.where("X > 2"), base, "instances")
    tables.copy_tables(spark, base, other, ["instances"])
    assert spark.read.parquet(f"{other}/instances.parquet").count() == 3
    ordered = tables.with_source_order(spark.read.parquet(f"{other}/instances.parquet"))
    assert ordered.select("ord_file", "ord_row").distinct().count() == 3
    tables.pipe(made["bbox"], schemas.BBOX, str(tmp_path / "sink"))
    with pytest.raises(StrictModeError, match="types differ"):
        tables.pipe(made["bbox"], schemas.RELABEL, str(tmp_path / "sink2"))


def test_layout_records(spark):
    from lamina.sources import ingest

    P = "cell string, layer int, datatype int, ring array<struct<x: double, y: double>>"
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    shapes = spark.createDataFrame([("leaf", 1, 0, square), ("mid", 2, 0, square[:3])], P)
    got = rows(ingest.geometry_rows(shapes), "CellName", "ShapeType", "X_JSON", "Y_JSON")
    assert got == [("leaf", "Box", "[0.0, 2.0, 2.0, 0.0]", "[0.0, 0.0, 1.0, 1.0]"), ("mid", "Polygon", "[0.0, 2.0, 2.0]", "[0.0, 0.0, 1.0]")]
    assert ingest.geometry_rows(shapes).schema.simpleString() == schemas.GEOMETRIES.simpleString()
    R = "cell string, ref string, x double, y double, magnification double, rotation double, x_reflection boolean, columns int, rows int, dx double, dy double"
    refs = spark.createDataFrame([
        ("mid", "leaf", 10.0, 0.0, 2.0, None, False, 3, 2, 5.0, 7.0), ("top", "mid", 0.0, 0.0, None, 3.141592653589793, True, None, 2, 1.0, 1.0),
        ("top", "leaf", -50.0, 3.0, None, None, None, None, None, None, None)], R)
    instances = ingest.instance_rows(refs)
    assert instances.schema.simpleString() == schemas.INSTANCES.simpleString()
    assert rows(instances, "CellName", "RefCellName", "MAG", "ANGLE", "IsArray", "Columns", "Rows", "DX") == [
        ("mid", "leaf", 2.0, 0.0, True, 3, 2, 5.0), ("top", "leaf", 1.0, 0.0, False, 1, 1, 0.0), ("top", "mid", 1.0, 180.0, False, 1, 1, 0.0)]
    assert rows(ingest.cell_boxes(shapes, instances)) == [("leaf", 0.0, 0.0, 2.0, 1.0), ("mid", 0.0, 0.0, 24.0, 9.0), ("top", -50.0, 0.0, 0.0, 9.0)]
    labels = spark.createDataFrame([("leaf", 1, 0, 0.5, 0.5, "A")], "cell string, layer int, texttype int, x double, y double, text string")
    assert ingest.label_rows(labels).schema.simpleString() == schemas.TEXTLABELS.simpleString()


def test_lines_of_one_mesh_stay_where_they_are(spark, monkeypatch):
    """The lines of a file are not gathered by its name."""
    from lamina.sources import mesh

    plans, once = [], mesh.materialise
    monkeypatch.setattr(mesh, "materialise", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or once(df))
    text = ["$Nodes", "2", "1 0 0 0", "2 1 0 0", "$EndNodes", "$Elements", "1", "1 1 2 0 3 1 2", "$EndElements"]
    lines = spark.createDataFrame([("m", k, v) for k, v in enumerate(text, 1)], "file string, line bigint, value string").repartition(3)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        nodes, elements = mesh.parse_mesh(lines)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert nodes.count() == 2 and [r.nodes for r in elements.collect()] == [[1, 2]]
    assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0]
