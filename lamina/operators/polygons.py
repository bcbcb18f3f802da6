"""Orthogonal polygons kept as one ring of points per row, and the boxes they decompose into."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lamina.checks import require_none
from lamina.durable import materialise
from lamina.operators.numbering import global_position, position_in_group, previous_in_order, running_total

POINTS = "array<struct<x: double, y: double>>"


def ring(xs: Column, ys: Column) -> Column:
    """Points from two coordinate arrays."""
    return F.zip_with(xs, ys, lambda x, y: F.struct(x.alias("x"), y.alias("y")))


def coordinates_text(values: Column, separator: str = ", ") -> Column:
    """Number array as bracketed text, the form the geometry table stores."""
    return F.concat(F.lit("["), F.concat_ws(separator, values.cast("array<string>")), F.lit("]"))


def coordinates(text: Column) -> Column:
    return F.from_json(text, "array<double>")


def open_rectangle(points: Column) -> Column:
    """Drop the closing point of a five-point ring that ends where it began."""
    closed = (F.size(points) == 5) & (F.try_element_at(points, F.lit(1)) == F.try_element_at(points, F.lit(5)))
    return F.when(closed, F.slice(points, 1, 4)).otherwise(points)


def shape_type(points: Column) -> Column:
    return F.when(F.size(open_rectangle(points)) == 4, "Box").otherwise("Polygon")


def ring_box(points: Column) -> dict[str, Column]:
    """Extent of a ring as four columns."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return {"xmin": F.array_min(xs), "ymin": F.array_min(ys), "xmax": F.array_max(xs), "ymax": F.array_max(ys)}


def slab_rectangles(points: Column) -> Column:
    """Rectangles of an orthogonal ring, cut at every distinct y, bottom to top then left to right.

    An odd number of crossings in a slab means the ring is not orthogonal or not simple, and fails.
    """
    ys = F.array_sort(F.array_distinct(F.transform(points, lambda p: p["y"])))
    following = F.concat(F.slice(points, F.lit(2), F.size(points)), F.slice(points, 1, 1))
    sides = F.zip_with(points, following, lambda a, b: F.struct(
        a["x"].alias("x"), F.least(a["y"], b["y"]).alias("low"), F.greatest(a["y"], b["y"]).alias("high")))
    slabs = F.zip_with(F.slice(ys, 1, F.greatest(F.size(ys) - 1, F.lit(0))), F.slice(ys, F.lit(2), F.size(ys)),
                       lambda low, high: F.struct(low.alias("low"), high.alias("high")))

    def crossings(slab: Column) -> Column:
        middle = (slab["low"] + slab["high"]) / 2
        crossing = F.filter(sides, lambda s: (s["low"] < middle) & (middle < s["high"]))
        return F.array_sort(F.transform(crossing, lambda s: s["x"]))

    def pairs(slab: Column) -> Column:
        xs = slab["xs"]
        odd = F.size(xs) % 2 == 1
        failure = F.raise_error(F.concat(F.lit("odd number of crossings above y="), slab["low"].cast("string")))
        left = F.when(odd, failure.cast("array<double>")).otherwise(F.filter(xs, lambda _, i: i % 2 == 0))
        right = F.filter(xs, lambda _, i: i % 2 == 1)
        boxes = F.zip_with(left, right, lambda a, b: F.struct(
            a.alias("xmin"), slab["low"].alias("ymin"), b.alias("xmax"), slab["high"].alias("ymax")))
        return F.filter(boxes, lambda box: box["xmax"] > box["xmin"])

    crossed = F.transform(slabs, lambda s: F.struct(s["low"].alias("low"), s["high"].alias("high"), crossings(s).alias("xs")))
    return F.flatten(F.transform(crossed, pairs))


def boxes_of(points: Column) -> Column:
    """Boxes of a ring: its extent when it has at most five points, else its slab rectangles."""
    whole = F.array(F.struct(*[v.alias(n) for n, v in ring_box(points).items()]))
    return F.when(F.size(points) > 5, slab_rectangles(points)).otherwise(whole)


def neighbours(points: Column) -> Column:
    """Each point with the one before and after it on the ring, wrapping around."""
    size = F.size(points)
    return F.transform(points, lambda p, i: F.struct(
        (i + 1).alias("position"), p.alias("point"),
        F.element_at(points, F.when(i == 0, size).otherwise(i)).alias("previous"),
        F.element_at(points, F.when(i == size - 1, F.lit(1)).otherwise(i + 2)).alias("next")))


def labelled_boxes(polygons: DataFrame, keys: Sequence[str], order_by: Sequence[str], points: str = "ring") -> DataFrame:
    """Boxes of every polygon with ``box`` (1-based index in the layer) and ``root``.

    ``keys`` name the layer, ``order_by`` the polygon order in it; ``root`` is the index of the
    polygon's first box, shared by all its boxes.
    """
    # a small file of polygons is one task's: they are spread before they are cut, and cut once
    parts = int(polygons.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = materialise(polygons.repartition(parts).select(*keys, *order_by, boxes_of(F.col(points)).alias("_boxes")))
    cut = cut.withColumn("_n", F.size("_boxes").cast("bigint"))
    counted = running_total(cut, "_n", order_by, "_before", keys)
    return counted.select(
        *keys, *order_by, (F.col("_before") + 1).alias("root"), F.posexplode("_boxes").alias("_i", "_box"),
    ).select(*keys, *order_by, (F.col("root") + F.col("_i")).alias("box"), "root", "_box.*")


def ring_area(points: Column) -> Column:
    """Shoelace area, used to check that a decomposition loses nothing."""
    following = F.concat(F.slice(points, F.lit(2), F.size(points)), F.slice(points, 1, 1))
    cross = F.zip_with(points, following, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda acc, v: acc + v)) / 2


# ---- rings as rows, for rings of any number of points -----------------------------------------

def vertical_sides(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Vertical sides ``(*keys[:-1], x, low, high)`` of rings given as rows ``(*keys, ord, x, y)``.

    The last key tells the rings of one polygon apart, its outline and its holes. A ring is closed from its
    last point to its first; a repeated first point at the end does no harm.
    """
    corner = F.struct("x", "y")
    ahead = materialise(previous_in_order(points.select(*keys, "ord", "x", "y"), keys, "ord", "from", corner))
    last = ahead.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max_by(corner, "ord").alias("_last"))
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    # only the first point of a ring needs its last one
    closing = ahead.where("from IS NULL").join(last, same).withColumn("from", F.col("_last")).select(*ahead.columns)
    sides = ahead.where("from IS NOT NULL").unionByName(closing)
    level, upright = F.col("y") == F.col("from.y"), F.col("x") == F.col("from.x")
    require_none(sides.where(~level & ~upright).select(*keys, "ord"), "a side is neither upright nor level")
    return sides.where(upright & ~level).select(*keys[:-1], "x", F.least("y", "from.y").alias("low"), F.greatest("y", "from.y").alias("high"))


def sweep_rectangles(sides: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rectangles ``(*keys, xmin, ymin, xmax, ymax)`` of polygons given by their vertical sides, as ``slab_rectangles`` cuts.

    The y of a polygon's corners bound its slabs. A side stands in every slab between its ends; in the order
    of x, sides are in turn left and right ends of rectangles. Slabs and turns come from positions in range
    partitions, so neither a polygon of very many points nor a slab of very many crossings is one task's.
    """
    sides = materialise(sides.select(*keys, "x", "low", "high"))
    ys = sides.select(*keys, F.explode(F.array("low", "high")).alias("y")).distinct()
    ranked = materialise(global_position(ys, [*keys, "y"], "slab"))
    at = lambda name, end: ranked.select(*keys, F.col("y").alias(end), F.col("slab").alias(name))
    spans = sides.join(at("first", "low"), [*keys, "low"]).join(at("beyond", "high"), [*keys, "high"])
    crossings = spans.select("x", F.explode(F.sequence("first", F.col("beyond") - 1)).alias("slab"))
    # equal crossings would change places from run to run, but pair up to the same ends
    turns = position_in_group(crossings, ["slab"], ["x"], "turn")
    pairs = materialise(turns.groupBy("slab", F.expr("(turn + 1) div 2").alias("pair")).agg(F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.count(F.lit(1)).alias("ends")))
    require_none(pairs.where("ends <> 2"), "odd number of crossings")
    low = ranked.withColumnRenamed("y", "ymin")
    high = ranked.select((F.col("slab") - 1).alias("slab"), F.col("y").alias("ymax"))
    boxes = pairs.where("xmax > xmin").join(low, "slab").join(high, "slab")
    return boxes.select(*keys, "xmin", "ymin", "xmax", "ymax")
