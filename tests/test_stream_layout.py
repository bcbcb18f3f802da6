"""Binary layout streams: round trips over many tasks, deceptive bytes, paths, lattices and broken files."""

import io
import math
import struct

import pytest
from pyspark.sql import functions as F

from lamina.checks import StrictModeError
from lamina.sources import stream_layout as s

UNIT = 0.001


def record(kind, form=0, data=b""):
    return struct.pack(">HBB", len(data) + 4, kind, form) + data


def element(kind, *fields):
    return record(kind) + b"".join(fields) + record(s.ENDEL)


def xy(*points):
    return record(s.XY, 3, struct.pack(f">{2 * len(points)}i", *[v for p in points for v in p]))


def library(*structures):
    head = record(s.HEADER, 2, b"\x02\x58") + record(s.BGNLIB, 2, bytes(24)) + record(s.LIBNAME, 6, b"LB") + record(s.UNITS, 5, s.to_real8(UNIT) + s.to_real8(1e-9))
    return head + b"".join(record(s.BGNSTR, 2, bytes(24)) + record(s.STRNAME, 6, name) + body + record(s.ENDSTR) for name, body in structures) + record(s.ENDLIB)


def box(x, y, layer=1):
    return element(s.BOUNDARY, record(s.LAYER, 2, struct.pack(">h", layer)), record(s.DATATYPE, 2, b"\0\0"), xy((x, y), (x + 10, y), (x + 10, y + 5), (x, y + 5), (x, y)))


@pytest.mark.parametrize("value", [0.0, 1.0, 0.001, -90.0, 1e-9, 359.123456, 2.0 ** 40])
def test_real8(value):
    assert s.real8(s.to_real8(value)) == value


def test_chunks_of_any_size_give_the_same_rows(spark, tmp_path):
    # the label's text holds what looks like the end of an element and the start of the next
    trap = element(s.TEXT, record(s.LAYER, 2, b"\0\7"), record(s.TEXTTYPE, 2, b"\0\0"), xy((1, 2)), record(s.STRING, 6, (record(s.ENDEL) + record(s.BOUNDARY) + b"ab") * 8))
    cells = [(b"AA", b"".join(box(k, 2 * k) for k in range(40))), (b"BBBB", trap * 5), (b"EMPTY1", b""), (b"TOP1", b"".join(
        element(s.SREF, record(s.SNAME, 6, b"AA"), xy((k, -k))) for k in range(30)))]
    path = tmp_path / "a.stream"
    path.write_bytes(library(*cells) + bytes(2048))  # padded
    want = None
    for chunk in (1 << 20, 512, 150):
        rows = sorted((r.place, r.kind, r.cell, r.x, r.layer, len(r.ring or [])) for r in s.read_elements(spark, str(path), chunk).collect())
        want = want or rows
        assert rows == want
        assert len(rows) == 75 and {r[2] for r in rows} == {"AA", "BBBB", "TOP1"}
    assert s.read_elements(spark, str(path), 512).select("chunk").distinct().count() > 3


def test_broken_files(spark, tmp_path):
    whole = library((b"AA", box(0, 0) * 20))
    at = [place for place, _, _ in s.records(io.BytesIO(whole), 0)][40]
    for name, data in (("cut", whole[:-30]), ("junk", whole[:at] + b"\0\1" + whole[at + 2:])):
        path = tmp_path / name
        path.write_bytes(data)
        with pytest.raises(StrictModeError):
            s.read_elements(spark, str(path), 128)


def test_references(spark, tmp_path):
    turned = record(s.STRANS, 1, b"\x80\0") + record(s.MAG, 5, s.to_real8(2.0)) + record(s.ANGLE, 5, s.to_real8(90.0))
    array = lambda *points: element(s.AREF, record(s.SNAME, 6, b"AA"), turned, record(s.COLROW, 2, struct.pack(">2h", 3, 2)), xy(*points))
    body = array((0, 0), (300, 0), (0, 80)) + array((0, 0), (0, 300), (-80, 0)) + array((0, 0), (300, 30), (0, 80))
    path = tmp_path / "refs"
    path.write_bytes(library((b"TOP1", body)))
    rows = s.read_elements(spark, str(path)).orderBy("place", "x", "y").collect()
    assert [(r.columns, r.rows, r.dx, r.dy) for r in rows[:2]] == [(3, 2, 0.1, 0.04), (2, 3, -0.04, 0.1)]
    assert rows[0].magnification == 2.0 and rows[0].x_reflection and rows[0].rotation == math.pi / 2
    assert sorted((round(r.x, 6), round(r.y, 6)) for r in rows[2:]) == sorted((round(i * 0.1, 6), round(i * 0.01 + j * 0.04, 6)) for i in range(3) for j in range(2))


def test_paths():
    straight = s.path_ring([(0, 0), (10, 0)], 4, 0)
    assert sorted((round(x, 9), round(y, 9)) for x, y in straight) == [(0, -2), (0, 2), (10, -2), (10, 2)]
    longer = s.path_ring([(0, 0), (10, 0)], 4, 2)
    assert sorted({round(x, 9) for x, _ in longer}) == [-2, 12]
    corner = s.path_ring([(0, 0), (10, 0), (10, 10)], 2, 0)
    assert (9.0, 1.0) in [(round(x, 9), round(y, 9)) for x, y in corner] and (11.0, -1.0) in [(round(x, 9), round(y, 9)) for x, y in corner]
    assert min(x for x, _ in s.path_ring([(0, 0), (10, 0)], 4, 1)) == pytest.approx(-2)
    assert s.path_ring([(1, 1), (1, 1)], 4, 0) == []


def test_written_and_read_back(spark, tmp_path):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (2, 0), (2, 1), (0, 1))])
    shapes = spark.range(500).select(F.lit("shape").alias("kind"), F.concat(F.lit("C"), F.col("id") % 7).alias("cell"), (F.col("id") % 3).cast("int").alias("layer"), F.lit(0).alias("datatype"), ring.alias("ring"), "id")
    refs = spark.range(20).select(F.lit("ref").alias("kind"), F.lit("TOP").alias("cell"), F.concat(F.lit("C"), F.col("id") % 7).alias("ref"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"), "id")
    s.write_stream(shapes.unionByName(refs, allowMissingColumns=True), str(tmp_path / "out"), ["id"], parts=3)
    tables = s.read_layout(spark, str(tmp_path / "out"), chunk=2048)
    assert tables["geometries"].where("ShapeType = 'Box'").groupBy("CellName").count().count() == 7
    assert tables["geometries"].count() == 500 and tables["instances"].count() == 20 and tables["textlabels"].count() == 0
    boxes = {r.CellName: (r.XMIN, r.YMIN, r.XMAX, r.YMAX) for r in tables["bbox"].collect()}
    assert boxes["C3"] == (0, 0, 2, 1) and boxes["TOP"] == (0, 0, 21, 1)


def test_structures_of_one_element_are_shared_by_chunks(spark, tmp_path):
    path = tmp_path / "cells"
    path.write_bytes(library(*[(f"C{k:05d}".encode(), box(k, k)) for k in range(300)]))
    rows = s.read_elements(spark, str(path), 2048).select("chunk", "cell", "place").collect()
    assert sorted(r.cell for r in rows) == [f"C{k:05d}" for k in range(300)]
    assert len({r.chunk for r in rows}) > 10  # every chunk decodes its own part


def test_kinds_and_single_fields(spark, tmp_path):
    """Fields of unusual size, bad letters and elements that end twice give what a walk over single records gives."""
    odd = element(s.TEXT, record(s.LAYER, 2, b"\7"), record(s.TEXTTYPE, 2, b"\0\1"), xy((1, 2)), record(s.STRING, 6, b"a\xffb\0\0"))
    plain = element(s.TEXT, record(s.LAYER, 2, b"\xff\xfe"), xy((3, -4)), record(s.STRING, 6, b"z\xff\0\0")) + record(s.ENDEL)
    line = element(s.PATH, record(s.WIDTH, 3, b"\0\0\0\4"), xy((0, 0), (10, 0)))
    path = tmp_path / "odd"
    path.write_bytes(library((b"AA", odd + plain + line + element(s.SREF, xy((5, 6))) + box(0, 0))))
    rows = s.read_elements(spark, str(path)).orderBy("place").collect()
    assert [(r.kind, r.layer, r.datatype, r.text, r.ref) for r in rows] == [
        ("label", 7, 1, "a�b", None), ("label", -2, 0, "z�", None), ("shape", 0, 0, None, None), ("ref", None, None, None, ""), ("shape", 1, 0, None, None)]
    assert [len(rows[2].ring), len(rows[4].ring)] == [4, 4]
    assert [r.kind for r in s.read_elements(spark, str(path), kinds=("ref",)).collect()] == ["ref"]


def test_coordinates_beyond_four_bytes(spark, tmp_path):
    """Elements that lie too far out for the unit of a file go to files of coarser units, exactly or not at all."""
    far = 7_199_999.0
    ring = lambda x: F.array(*[F.struct((x + float(dx)).alias("x"), F.lit(float(y)).alias("y")) for dx, y in ((0, 0), (2, 0), (2, 1), (0, 1))])
    shapes = spark.range(300).select(F.lit("shape").alias("kind"), F.concat(F.lit("C"), F.col("id")).alias("cell"), F.lit(1).alias("layer"), F.lit(0).alias("datatype"),
                                     ring(F.when(F.col("id") % 2 == 0, F.lit(far) + F.col("id")).otherwise(-F.col("id").cast("double"))).alias("ring"), "id")
    refs = spark.range(40).select(F.lit("ref").alias("kind"), F.concat(F.lit("C"), F.col("id")).alias("cell"), F.lit("C0").alias("ref"), (F.col("id") + F.lit(0.125)).alias("x"),
                                  F.when(F.col("id") < 9, F.lit(3e9)).otherwise(F.lit(0.0)).alias("y"), F.lit(3).alias("columns"), F.lit(1).alias("rows"), F.lit(0.25).alias("dx"), F.lit(0.0).alias("dy"), "id")
    near = refs.where("id >= 9")
    s.write_stream(shapes.unionByName(near, allowMissingColumns=True), str(tmp_path / "out"), ["kind", "id"], parts=3)
    rows = s.read_elements(spark, str(tmp_path / "out"), 4096).collect()
    assert sorted((r.cell, [(p.x, p.y) for p in r.ring]) for r in rows if r.kind == "shape") == sorted(
        (f"C{k}", [(x, 0), (x + 2, 0), (x + 2, 1), (x, 1)]) for k in range(300) for x in [far + k if k % 2 == 0 else -float(k)])
    assert sorted((r.cell, r.x, r.y, r.columns, r.dx) for r in rows if r.kind == "ref") == sorted((f"C{k}", k + 0.125, 0, 3, 0.25) for k in range(9, 40))
    with pytest.raises(Exception, match="no multiple of 0.1|no multiple of 1.0|no multiple of 0.01"):  # 0.125 and 3,000,000,000 have no unit in common
        s.write_stream(refs, str(tmp_path / "never"), ["id"])
