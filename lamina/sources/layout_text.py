"""Layer text: counted layer, via and polygon blocks.

Grammar, one item per line::

    L, then L lines  id, zmin, zmax
    V, then V lines  id, zmin, zmax, bottom, top
    per layer        id, then polygon count, then per polygon: vertex count and x, y lines

Every line names itself by its number of fields and of the line after it: a lone number followed
by a coordinate pair opens a polygon, other lone numbers alternate between layer id and polygon
count. The counts are used to address lines by number, so parsing is a set of joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lamina.checks import require_none
from lamina.durable import materialise
from lamina.operators.numbering import position_in_group


def parse_layout(lines: DataFrame, strict: bool = True) -> dict[str, DataFrame]:
    """``layers``, ``vias`` and ``polygons`` of files given as ``(file, line, value)``.

    Polygons carry ``layer_id``, their 1-based ``polygon`` order in the layer, and a ``ring`` of
    the vertices as written.
    """
    fields = F.split("value", ",")
    cells = [F.trim(F.get("_f", F.lit(k))).alias(f"_c{k}") for k in range(5)]
    numbered = lines.withColumn("_f", fields).select("file", "line", F.size("_f").alias("_n"), *cells)
    after = numbered.select("file", (F.col("line") - 1).alias("line"), F.col("_n").alias("_next"))
    # as long as the text: its size is guessed from what it is made of, and a broadcast would fill every task's memory
    tagged = materialise(numbered.join(after.hint("merge"), ["file", "line"], "left"))

    def number(i: int, kind: str = "bigint"):
        return F.col(f"_c{i}").try_cast(kind)

    # one row per file each; a join by file would send all lines of a large file to one task
    layer_count = F.broadcast(tagged.where("line = 1").select("file", number(0).alias("_l")))
    via_count = tagged.join(layer_count, "file").where("line = _l + 2").select("file", "_l", number(0).alias("_v"))
    body = tagged.join(F.broadcast(via_count), "file")

    layers = body.where("line > 1 AND line <= _l + 1").select("file", number(0).alias("id"), number(1).alias("zmin"), number(2).alias("zmax"))
    vias = body.where("line > _l + 2 AND line <= _l + _v + 2").select(
        "file", number(0).alias("id"), number(1).alias("zmin"), number(2).alias("zmax"), number(3).alias("bottom"), number(4).alias("top"))

    shapes = body.where("line > _l + _v + 2")
    opens = (F.col("_n") == 1) & (F.coalesce("_next", F.lit(0)) == 2)
    starts = shapes.where(opens).select("file", F.col("line").alias("start"), number(0).alias("vertices"))
    heads = position_in_group(
        shapes.where((F.col("_n") == 1) & ~opens).select("file", "line", number(0).alias("value")), ["file"], ["line"], "_k")
    # layer id and polygon count sit on neighbouring lines
    ids = heads.where("_k % 2 = 1").select("file", F.col("line").alias("head"), F.col("value").alias("layer_id"), ((F.col("_k") + 1) / 2).cast("bigint").alias("_h"))
    counts = heads.where("_k % 2 = 0").select("file", (F.col("line") - 1).alias("head"), F.col("value").alias("expected"))
    # the next header closes the range of lines of this one
    closing = ids.select("file", (F.col("_h") - 1).alias("_h"), F.col("head").alias("_stop"))
    spans = ids.join(counts, ["file", "head"], "left").join(closing, ["file", "_h"], "left")

    # headers per file number at most one per layer; the equi-join is on the file
    owned = starts.join(spans, "file").where("start > head AND (_stop IS NULL OR start < _stop)")
    owned = position_in_group(owned.select("file", "layer_id", "start", "vertices"), ["file", "layer_id"], ["start"], "polygon")

    points = shapes.where("_n = 2").select("file", "line", number(0, "double").alias("x"), number(1, "double").alias("y"))
    addressed = owned.select("*", F.explode(F.sequence(F.col("start") + 1, F.col("start") + F.col("vertices"))).alias("line"))
    joined = addressed.join(points.hint("merge"), ["file", "line"], "left")
    keys = ["file", "layer_id", "polygon", "vertices"]
    # a ring is bounded by the vertex count of its polygon
    rings = joined.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("line", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"),
        F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("_lost"))
    if strict:
        rings = materialise(rings)
        require_none(rings.where("_lost > 0").select(*keys), "polygon has fewer vertices than announced")
        found = owned.groupBy("file", "layer_id").agg(F.count("*").alias("found"))
        off = spans.join(found, ["file", "layer_id"], "left").where("expected IS NULL OR expected <> coalesce(found, 0)")
        require_none(off.select("file", "layer_id", "expected", "found"), "layer has another number of polygons than announced")
        stray = points.join(addressed.select("file", "line").hint("merge"), ["file", "line"], "left_anti")
        require_none(stray, "vertex outside a polygon")
        bad = vias.join(layer_count, "file").where("bottom < 1 OR top < 1 OR bottom > _l OR top > _l")
        require_none(bad, "via connects an unknown layer")
    return {"layers": layers, "vias": vias, "polygons": rings.drop("_lost")}
