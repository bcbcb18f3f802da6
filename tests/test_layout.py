"""Placement, boxes, polygons and stacks: worked examples and properties."""

import itertools
import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lamina.checks import StrictModeError, require_rules
from lamina.operators import placement, polygons, spatial, spatial_index, stack
from tests.conftest import rows

TAP_BOX = (-0.19, -0.24, 0.65, 2.96)


@pytest.fixture(scope="module")
def bbox(spark):
    return spark.createDataFrame([("tap", *TAP_BOX), ("conb", 0.0, 0.0, 1.0, 1.0)], "CellName string, XMIN double, YMIN double, XMAX double, YMAX double")


def place(spark, bbox, comps, **kw):
    df = spark.createDataFrame(comps, "InstanceName string, CellName string, X int, Y int, Orientation string")
    return {r["InstanceName"]: (r["gds_x"], r["gds_y"]) for r in placement.place_components(df, bbox, **kw).collect()}


def test_offsets_of_all_orientations(spark, bbox):
    got = place(spark, bbox, [(o, "tap", 0, 0, o) for o in placement.ORIENTATIONS])
    assert got == {"N": (0, 0), "S": (460, 2720), "W": (2770, -50), "E": (50, 410), "FN": (460, 0), "FS": (0, 2720), "FW": (50, -50), "FE": (2770, 410)}
    derived = place(spark, bbox, [(o, "tap", 0, 0, o) for o in placement.ORIENTATIONS], table="derived")
    assert derived == {**got, "FE": got["FW"], "FW": got["FE"]}


def test_worked_placements(spark, bbox):
    got = place(spark, bbox, [("a", "tap", 372600, 372640, "FS"), ("b", "tap", 372600, 372640, "N")])
    assert got == {"a": (372600, 375360), "b": (372600, 372640)}
    with pytest.raises(StrictModeError, match="orientation"):
        place(spark, bbox, [("a", "tap", 0, 0, "n")], strict=True)


def test_instance_naming(spark, bbox):
    instances = spark.createDataFrame(
        [("TOP", "tap", 2555.76, 2350.08), ("TOP", "tap", 2555.76, 2355.52), ("TOP", "conb", 6.9, 239.36)], "CellName string, RefCellName string, X double, Y double")
    comps = spark.createDataFrame(
        [("TAP_61388", "tap", 2555760, 2352800, "FS", 1), ("TAP_61613", "tap", 2555760, 2358240, "FS", 2), ("w_320", "conb", 6900, 239360, "N", 3)],
        "InstanceName string, CellName string, X int, Y int, Orientation string, ord int")
    named = placement.name_instances(instances, comps, bbox, ["ord"], "TOP")
    assert rows(named.fillna("-"), "Y", "InstanceName") == [(239.36, "w_320"), (2350.08, "-"), (2355.52, "TAP_61388")]
    assert tuple(placement.name_extrema(named, "TOP").first()) == ("TAP_61388", "w_320")
    with pytest.raises(StrictModeError):
        placement.name_instances(instances, comps, bbox, ["ord"], "TOP", strict=True)
    with pytest.raises(StrictModeError):
        placement.name_extrema(named, "TOP", strict=True)


def test_transform_box_at_any_angle(spark):
    rng = random.Random(3)
    cases = [(rng.uniform(-9, 9), rng.uniform(-9, 9), rng.uniform(-360, 360), rng.random() < 0.5) for _ in range(40)]
    cases += [(1.0, 2.0, a, m) for a in (0.0, 90.0, 180.0, 270.0, -90.0, 450.0) for m in (True, False)]
    df = spark.createDataFrame(cases, "X double, Y double, ANGLE double, IsXReflect boolean")
    df = df.withColumns(dict(zip(("XMIN", "YMIN", "XMAX", "YMAX"), map(F.lit, TAP_BOX))))
    for r in spatial.place_boxes(df).collect():
        c, s = math.cos(math.radians(r["ANGLE"])), math.sin(math.radians(r["ANGLE"]))
        m = -1 if r["IsXReflect"] else 1
        pts = [(r["X"] + x * c - m * y * s, r["Y"] + x * s + m * y * c) for x in TAP_BOX[::2] for y in TAP_BOX[1::2]]
        want = (min(p[0] for p in pts), min(p[1] for p in pts), max(p[0] for p in pts), max(p[1] for p in pts))
        assert all(abs(a - b) < 1e-9 for a, b in zip(want, (r["xmin"], r["ymin"], r["xmax"], r["ymax"])))


def test_quarter_turn_is_exact(spark):
    df = spark.createDataFrame([(0.0, 0.0, 90.0, False)], "X double, Y double, ANGLE double, IsXReflect boolean")
    df = df.withColumns(dict(zip(("XMIN", "YMIN", "XMAX", "YMAX"), map(F.lit, (0.0, 0.0, 3.0, 1.0)))))
    assert rows(spatial.place_boxes(df), *spatial.BOX) == [(-1.0, 0.0, 0.0, 3.0)]


def test_extent_of_nothing_is_the_empty_box(spark):
    none = spark.createDataFrame([], "xmin double, ymin double, xmax double, ymax double")
    inf = float("inf")
    assert tuple(none.agg(*spatial.extent()).first()) == (inf, inf, -inf, -inf)
    one = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0)], none.schema)
    assert tuple(one.agg(*spatial.extent(0.5, (0.0, -3.0, 0.0, 0.0))).first()) == (-0.5, -3.5, 1.5, 1.5)


@pytest.mark.parametrize("tile,limit", [(None, 20_000), (4.0, 5), (100.0, 3)])
def test_overlap_join_equals_brute_force(spark, tile, limit):
    rng = random.Random(11)
    data = []
    for k in range(160):
        # a third of the boxes crowd one spot, some lie at negative coordinates, some touch
        x, y = (1.0, 1.0) if k % 3 == 0 else (float(rng.randrange(-20, 20)), float(rng.randrange(-20, 20)))
        data.append((k, x, y, x + rng.randrange(0, 9), y + rng.randrange(0, 9)))
    data[7] = (7, -500.0, -30.0, 9000.0, 5.0)  # one box far larger than the others
    data[8] = (8, 0.0, -7000.0, 0.5, 7000.0)
    df = spark.createDataFrame(data, "id int, xmin double, ymin double, xmax double, ymax double")
    meets = lambda a, b: a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]
    want = sorted((a[0], b[0]) for a, b in itertools.combinations(data, 2) if meets(a, b))
    got = [tuple(r) for r in spatial.overlap_join(df, df, "id", "id", tile, True, limit).collect()]
    assert sorted(got) == want
    windows = df.where("id < 20").withColumnRenamed("id", "w")
    want = sorted((a[0], b[0]) for a in data for b in data[:20] if meets(a, b))
    assert sorted(tuple(r) for r in spatial.overlap_join(df, windows, "id", "w", tile, tile_rows=limit).collect()) == want


def test_pairs_of_one_table_go_to_about_one_tile_each(spark, monkeypatch):
    rng = random.Random(5)
    data = [(k, x := float(rng.randrange(4000)), y := float(rng.randrange(4000)), x + rng.randrange(1, 40), y + rng.randrange(1, 40)) for k in range(6000)]
    df = spark.createDataFrame(data, "id int, xmin double, ymin double, xmax double, ymax double")
    seen, once = [], spatial._tile_join
    monkeypatch.setattr(spatial, "_tile_join", lambda *given: seen.append(given[0].count() + given[1].count()) or once(*given))
    pairs = spatial.overlap_join(df, df, "id", "id", distinct_pairs_of_one_table=True)
    meets = lambda a, b: a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]
    assert sorted(map(tuple, pairs.collect())) == sorted((a[0], b[0]) for a, b in itertools.combinations(data, 2) if meets(a, b))
    assert sum(seen) == 0  # the tile join showed both sides on every level
    tile = spatial.roomy_tile(df)
    assert spatial.tiles(df, tile).count() < 1.2 * len(data) < spatial.tiles(df, spatial.suggested_tile(df)).count()


def test_repeated_and_missing_ids_make_no_pairs(spark):
    data = [(None, 0.0, 0.0, 5.0, 5.0), (1, 0.0, 0.0, 5.0, 5.0), (1, 1.0, 1.0, 2.0, 2.0), (2, 1.0, 1.0, 2.0, 2.0), (3, None, 1.0, 2.0, 2.0)]
    df = spark.createDataFrame(data, "id int, xmin double, ymin double, xmax double, ymax double")
    assert sorted(map(tuple, spatial.overlap_join(df, df, "id", "id", 4.0, True).collect())) == [(1, 2), (1, 2)]


def ring_df(spark, rings):
    points = [(k, [(float(x), float(y)) for x, y in r]) for k, r in enumerate(rings, 1)]
    return spark.createDataFrame(points, "polygon int, ring array<struct<x: double, y: double>>")


L_SHAPE = [(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2), (0, 0)]
# Rings with 12 and 8 corners as they occur in a layout, clockwise and not repeating the first point.
S_SHAPE = list(zip([625, 625, 215, 215, 695, 695, 845, 845, 485, 485, 775, 775], [105, 730, 730, 1770, 1770, 2615, 2615, 1620, 1620, 880, 880, 105]))
T_SHAPE = list(zip([1055, 1055, 875, 875, 1055, 1055, 1205, 1205], [105, 1065, 1065, 1410, 1410, 2615, 2615, 105]))


def test_l_shape(spark):
    got = ring_df(spark, [L_SHAPE]).select(F.explode(polygons.slab_rectangles(F.col("ring"))).alias("b")).select("b.*")
    assert rows(got) == [(0.0, 0.0, 2.0, 1.0), (0.0, 1.0, 1.0, 2.0)]


def test_decomposition_keeps_the_area(spark):
    u_shape = [(0, 0), (5, 0), (5, 4), (4, 4), (4, 1), (1, 1), (1, 4), (0, 4)]
    df = ring_df(spark, [L_SHAPE, S_SHAPE, T_SHAPE, u_shape, list(reversed(S_SHAPE))])
    cut = F.aggregate(polygons.slab_rectangles(F.col("ring")), F.lit(0.0), lambda a, b: a + (b["xmax"] - b["xmin"]) * (b["ymax"] - b["ymin"]))
    for r in df.select(polygons.ring_area(F.col("ring")).alias("whole"), cut.alias("cut")).collect():
        assert r["whole"] == r["cut"] > 0


def test_odd_crossings_fail(spark):
    # a closed ring crosses evenly; a missing coordinate breaks that
    points = [(0.0, 0.0), (2.0, 0.0), (2.0, None), (0.0, 1.0), (0.0, 0.5), (0.0, 0.0)]
    bad = spark.createDataFrame([(points,)], "ring array<struct<x: double, y: double>>")
    with pytest.raises(PySparkException, match="odd number of crossings"):
        bad.select(polygons.slab_rectangles(F.col("ring"))).collect()


def test_roots_and_shapes(spark):
    box = [(0, 0), (3, 0), (3, 1), (0, 1), (0, 0)]
    df = ring_df(spark, [L_SHAPE, box, T_SHAPE]).withColumn("layer", F.lit(1))
    got = rows(polygons.labelled_boxes(df, ["layer"], ["polygon"]), "box", "polygon", "root")
    assert got == [(1, 1, 1), (2, 1, 1), (3, 2, 3), (4, 3, 4), (5, 3, 4), (6, 3, 4)]
    assert rows(df, "polygon", polygons.shape_type(F.col("ring"))) == [(1, "Polygon"), (2, "Box"), (3, "Polygon")]
    assert rows(df.where("polygon = 2"), F.size(polygons.open_rectangle(F.col("ring")))) == [(4,)]


def test_coordinate_text_round_trip(spark):
    df = spark.createDataFrame([([1.0, 2.5, -3.0], [4.0, 5.0, 6.0])], "x array<double>, y array<double>")
    text = df.select(polygons.coordinates_text(F.col("x")).alias("x"), polygons.coordinates_text(F.col("y")).alias("y"))
    assert rows(text) == [("[1.0, 2.5, -3.0]", "[4.0, 5.0, 6.0]")]
    assert text.select(polygons.coordinates(F.col("x")).alias("x")).first()["x"] == [1.0, 2.5, -3.0]


def test_stack(spark):
    layers = spark.createDataFrame([(0, 0, 119), (1, 119, 238), (2, 326, 505)], "id int, zmin int, zmax int")
    vias = spark.createDataFrame([(3, 505, 936)], "id int, zmin int, zmax int")
    table = stack.stack_table(layers, vias)
    assert rows(stack.with_upper(table.where("not is_via")), "layer", "slab_zmax") == [(1, 238), (2, 505), (3, 505)]
    boxes = spark.createDataFrame([(1, -190.0, 1305.0, 1570.0, 2910.0), (4, 0.0, 0.0, 170.0, 170.0)], "layer int, xmin double, ymin double, xmax double, ymax double")
    solid = stack.inset(boxes.join(table, "layer"))
    assert rows(solid, "layer", "x0", "y0", "z0", "dx", "dy", "dz") == [(1, -170.0, 1325.0, 20.0, 1720.0, 1605.0, 79.0), (4, 0.0, 0.0, 525.0, 130.0, 170.0, 391.0)]
    good = stack.extrude(boxes, table)
    assert require_rules(good, stack.solid_rules()) is good
    with pytest.raises(StrictModeError, match="area"):
        require_rules(good.withColumn("dx", F.lit(0.0)), stack.solid_rules())
    ids = spark.createDataFrame([(1, 201), (2, 1), (3, 5)], "layer int, polygon int")
    assert rows(stack.physical_id_collisions(ids)) == [(401, 2)]


def points_of(polygon, ring, corners):
    return [(polygon, ring, k, float(x), float(y)) for k, (x, y) in enumerate(corners)]


def test_sweep_agrees_with_rings_in_one_row(spark):
    r = random.Random(12)
    data, rings = [], {}
    for polygon in range(12):
        xs, heights = sorted(r.sample(range(100), 2 * r.randrange(1, 6) + 1)), [r.randrange(1, 9) for _ in range(12)]
        corners = [(xs[0], 0), (xs[-1], 0)]
        for k in range(len(xs) - 1, 0, -1):  # a skyline
            corners += [(xs[k], heights[k % 12]), (xs[k - 1], heights[k % 12])]
        rings[polygon] = corners
        data += points_of(polygon, 0, corners + corners[:1] * (polygon % 2))
    points = spark.createDataFrame(data, "polygon int, ring int, ord int, x double, y double").repartition(3)
    got = rows(polygons.sweep_rectangles(polygons.vertical_sides(points, ["polygon", "ring"]), ["polygon"]), "polygon", "xmin", "ymin", "xmax", "ymax")
    one_row = spark.createDataFrame([(k, [(float(x), float(y)) for x, y in v]) for k, v in rings.items()], f"polygon int, ring {polygons.POINTS}")
    want = one_row.select("polygon", F.explode(polygons.slab_rectangles(F.col("ring"))).alias("b")).select("polygon", "b.xmin", "b.ymin", "b.xmax", "b.ymax")
    assert got == rows(want)


def test_sweep_of_a_large_comb_with_holes(spark):
    teeth = 3000
    comb = [(0, 0), (2 * teeth - 1, 0)] + [p for k in range(teeth - 1, -1, -1) for p in ((2 * k + 1, 2), (2 * k + 1, 5), (2 * k, 5), (2 * k, 2))]
    holes = [points_of(1, 1 + k, [(4 * k + 1, 0.5), (4 * k + 2, 0.5), (4 * k + 2, 1.5), (4 * k + 1, 1.5)]) for k in range(500)]
    points = spark.createDataFrame(points_of(1, 0, comb) + [p for h in holes for p in h], "polygon int, ring int, ord int, x double, y double")
    boxes = polygons.sweep_rectangles(polygons.vertical_sides(points, ["polygon", "ring"]), ["polygon"])
    area = boxes.agg(F.sum((F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))), F.count("*")).first()
    assert area[0] == (2 * teeth - 1) * 2 + 3 * teeth - 500 and area[1] == teeth + 2 + 501


def test_sweep_refuses_slanted_and_open_rings(spark):
    schema = "polygon int, ring int, ord int, x double, y double"
    with pytest.raises(StrictModeError):
        polygons.vertical_sides(spark.createDataFrame(points_of(1, 0, [(0, 0), (2, 0), (1, 1)]), schema), ["polygon", "ring"])
    with pytest.raises(StrictModeError):
        polygons.sweep_rectangles(spark.createDataFrame([(1, 0.0, 0.0, 1.0)], "polygon int, x double, low double, high double"), ["polygon"])


def test_repeated_arrays_and_windows_are_searched_once(spark, monkeypatch):
    from lamina.operators import arrays

    seen, once = [], arrays.overlap_join
    monkeypatch.setattr(arrays, "overlap_join", lambda a, b, *more: seen.append((a.count(), b.count())) or once(a, b, *more))
    placed = spark.range(60).selectExpr("id", "double(id % 3) AS xmin", "0D AS ymin", "id % 3 + 1D AS xmax", "1D AS ymax", "4L AS Columns", "1L AS Rows", "10D AS DX", "if(id = 59, NULL, 0D) AS DY")
    windows = spark.range(100).selectExpr("id AS w", "10D + id % 2 * 100 AS xmin", "0D AS ymin", "20D + id % 2 * 100 AS xmax", "1D AS ymax")
    found = arrays.expand_hits(arrays.array_hits(placed, windows, "id", "w")).collect()
    assert seen == [(4, 2)]
    want = {(k, w, n, 0) for k in range(59) for w in range(0, 100, 2) for n in range(4) if k % 3 + 10 * n <= 20 and 10 <= k % 3 + 1 + 10 * n}
    got = sorted((r.id, r.w, r.column, r.row) for r in found if r.id != 59)
    assert got == sorted(want)


def test_sides_of_rings_join_the_last_points_only(spark):
    points = [(p, k, x, y) for p in (1, 2) for k, (x, y) in enumerate([(0.0, 0.0), (2.0 + p, 0.0), (2.0 + p, 3.0), (0.0, 3.0)])]
    sides = polygons.vertical_sides(spark.createDataFrame([(p, 0, k, x, y) for p, k, x, y in points], "polygon int, ring int, ord int, x double, y double"), ["polygon", "ring"])
    assert sorted(map(tuple, sides.collect())) == [(1, 0.0, 0.0, 3.0), (1, 3.0, 0.0, 3.0), (2, 0.0, 0.0, 3.0), (2, 4.0, 0.0, 3.0)]
    plan = sides._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "isnull(from" in plan


def test_a_larger_index_has_larger_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(spatial_index, "MOST_PARTS", 4, raising=False)
    boxes = spark.range(400).selectExpr("id", "cast(id % 20 as double) as xmin", "cast(id div 20 as double) as ymin", "cast(id % 20 + 1 as double) as xmax", "cast(id div 20 + 1 as double) as ymax")
    spatial_index.write_index(boxes, "id", f"{tmp_path}/index", leaf_rows=5, part_leaves=2)
    assert len(list((tmp_path / "index" / "boxes").glob("part=*"))) == 4
    assert spark.read.parquet(f"{tmp_path}/index/boxes").groupBy("leaf").count().where("count <> 5").isEmpty()
    window = spark.createDataFrame([(1, 3.5, 3.5, 4.5, 3.6)], "w int, xmin double, ymin double, xmax double, ymax double")
    assert sorted(r.id for r in spatial_index.search_index(spark, f"{tmp_path}/index", window, "w", ["id"]).collect()) == [63, 64]


def test_layers_are_broadcast(spark):
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 1.0), (3, 0.0, 0.0, 1.0, 1.0)], "layer bigint, xmin double, ymin double, xmax double, ymax double")
    layers = spark.createDataFrame([(1, 100, 161), (2, 200, 262)], "layer bigint, zmin bigint, zmax bigint")
    solid = stack.extrude(boxes, layers)
    assert "strategy=broadcast" in solid._jdf.queryExecution().optimizedPlan().toString()
    assert rows(solid, "layer", "zmin", "dz") == [(1, 100, 61), (3, None, None)]


@pytest.mark.parametrize("limit", [0, 100])
def test_boxes_far_from_all_windows_stay(spark, monkeypatch, limit):
    """With few window tiles, other boxes are left out before the shuffle; with many, the join is the same."""
    monkeypatch.setattr(spatial, "BROADCAST_TILES", limit)
    boxes = [(k, float(x), float(y), float(x + w), float(y + w)) for k, (x, y, w) in enumerate((13 * k % 400, 7 * k % 300, 1 + 40 * (k % 9 == 0)) for k in range(300))]
    windows = [(1, -5.0, -5.0, 9.0, 9.0), (2, 50.0, 60.0, 59.0, 66.0), (3, 390.0, 10.0, 560.0, 12.0), (4, None, 0.0, 1.0, 1.0)]
    want = sorted((b[0], w[0]) for b in boxes for w in windows[:3] if b[1] <= w[3] and w[1] <= b[3] and b[2] <= w[4] and w[2] <= b[4])
    columns = "xmin double, ymin double, xmax double, ymax double"
    found = spatial.overlap_join(spark.createDataFrame(boxes, f"id int, {columns}"), spark.createDataFrame(windows, f"w int, {columns}"), "id", "w", 8.0)
    assert sorted(map(tuple, found.collect())) == want
    assert ("LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()) == (limit > 0)


def test_ids_of_equal_arrays_share_a_list(spark, monkeypatch):
    """Equal arrays or windows have one list of ids, more only when they are very many, and the hits are the same."""
    from lamina.operators import arrays

    placed = spark.range(90).selectExpr("id", "double(id % 3) AS xmin", "0D AS ymin", "id % 3 + 1D AS xmax", "1D AS ymax", "2L AS Columns", "1L AS Rows", "if(id < 60, 5D, NULL) AS DX", "0D AS DY")
    windows = spark.range(40).selectExpr("id AS w", "id % 2 * 100D AS xmin", "0D AS ymin", "id % 2 * 100 + 5.5D AS xmax", "1D AS ymax")
    lattice = placed.drop("id").columns
    assert arrays._classes(placed, "id", lattice, "_array")[1].count() == 6
    want = sorted((k, w, n, 0) for k in range(60) for w in range(0, 40, 2) for n in range(2) if k % 3 + 5 * n <= 5.5)
    for listed, broadcast in ((1 << 16, 1 << 20), (4, 0)):
        monkeypatch.setattr(arrays, "LISTED", listed)
        monkeypatch.setattr(arrays, "BROADCAST", broadcast)
        for one, other, a, b in ((placed, windows, "id", "w"), (placed.where("id % 9 = 0"), windows, "id", "w")):
            found = arrays.expand_hits(arrays.array_hits(one, other, a, b)).where("id < 60").collect()
            assert sorted((r.id, r.w, r.column, r.row) for r in found) == [x for x in want if one is placed or x[0] % 9 == 0]
    lists = arrays._classes(placed, "id", lattice, "_array")[1].selectExpr("count(*)", "sum(size(_arrays))", "max(size(_arrays))").first()
    assert 6 < lists[0] <= 30 and lists[1] == 90 and lists[2] < 20
