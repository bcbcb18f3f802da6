"""Mesh scripts as numbered text lines, for an external mesher.

``box_script`` lists the boxes of all layers with their dielectric slabs and physical groups;
``conductor_script`` writes one build call per polygon.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lamina.checks import require_none
from lamina.constants import literal_rows
from lamina.durable import materialise, materialise_counted
from lamina.functions.scalars import general_text
from lamina.operators.grouping import frequency
from lamina.operators.numbering import global_position, running_total
from lamina.operators.spatial import extent
from lamina.operators.stack import BLOAT, POLYGONS_PER_LAYER, INSET, extrude, inset, with_upper


def _space_padded(value: Column) -> Column:
    return F.concat(F.when(value < 0, "").otherwise(" "), general_text(value))


def box_text(number: Column, x: Column, y: Column, z: Column, dx: Column, dy: Column, dz: Column) -> Column:
    sides = F.concat_ws(", ", *[_space_padded(c.cast("double")) for c in (x, y, z, dx, dy, dz)])
    return F.concat(F.lit("Box("), number.cast("string"), F.lit(") = {"), sides, F.lit("};"))


def dielectric_slabs(boxes: DataFrame, conductors: DataFrame) -> DataFrame:
    """One slab per conductor layer: the bloated extent of all boxes, up to the top of the next layer.

    ``conductors`` is the layer table.
    """
    whole = boxes.agg(F.struct(*extent(BLOAT)).alias("extent")).scalar()
    slabs = with_upper(conductors).withColumn("_e", whole)
    return slabs.select(
        "layer", "_e.xmin", "_e.ymin", F.col("zmin").cast("double").alias("z0"), (F.col("_e.xmax") - F.col("_e.xmin")).alias("dx"),
        (F.col("_e.ymax") - F.col("_e.ymin")).alias("dy"), (F.col("slab_zmax") - F.col("zmin")).cast("double").alias("dz"))


def group_ranges(boxes: DataFrame) -> DataFrame:
    """Consecutive box number ranges per (layer, root): ``first`` to ``last``, roots in order.

    Boxes are numbered by layer and root, each group starting where the one before it ended.
    """
    counted = running_total(frequency(boxes, "layer", "root"), "freq", ["layer", "root"], "_before")
    return counted.select("layer", "root", "freq", (F.col("_before") + 1).alias("first"), (F.col("_before") + F.col("freq")).alias("last"))


def box_script(boxes: DataFrame, stack: DataFrame) -> DataFrame:
    """``(section, number, value)`` lines: slabs, boxes, cuts, groups, slab groups.

    ``boxes`` carry layer, box (order in the layer), root and extent; ``stack`` has layer, zmin,
    zmax, is_via. Conductors get cuts and groups, vias only boxes; ranges are those of the box numbers,
    which count vias too. A box on a layer that ``stack`` doesn't have is refused.
    """
    stored, count = materialise_counted(boxes)
    return _box_lines(stored, count["rows"], materialise(stack))


def _box_lines(boxes: DataFrame, rows: int, stack: DataFrame) -> DataFrame:
    """``box_script`` of stored boxes, ``rows`` in number."""
    require_none(boxes.join(stack, "layer", "left_anti"), "box on an unknown layer")
    conductors = stack.where(~F.col("is_via"))
    numbered = materialise(global_position(extrude(boxes, stack), ["layer", "box"], "id"))
    metal = numbered.join(conductors.select("layer"), "layer", "left_semi")
    ends = [F.min("id").alias("first"), F.max("id").alias("last")]
    total = F.lit(rows).cast("bigint")

    slabs = dielectric_slabs(metal, conductors).withColumn("_n", total + F.col("layer"))
    lines = slabs.select(
        F.lit(1).alias("section"), F.col("layer").cast("bigint").alias("number"),
        F.concat(box_text(F.col("_n"), *[F.col(c) for c in ("xmin", "ymin", "z0", "dx", "dy", "dz")]),
                 F.format_string(" // PhysicalGroup=%d, layer=%d", F.col("_n").cast("bigint"), F.col("layer").cast("bigint"))).alias("value"))

    lines = lines.unionByName(numbered.select(
        F.lit(2).alias("section"), F.col("id").alias("number"),
        F.concat(box_text(F.col("id"), *[F.col(c) for c in ("xmin", "ymin", "zmin", "dx", "dy", "dz")]),
                 F.format_string(" // id=%d, layer=%d", F.col("id"), F.col("layer").cast("bigint"))).alias("value")))

    cut = metal.groupBy("layer").agg(*ends).withColumn("_n", (total + F.col("layer")).cast("bigint"))
    lines = lines.unionByName(cut.select(
        F.lit(3).alias("section"), F.col("layer").cast("bigint").alias("number"),
        F.format_string("my_fragments%d() = BooleanFragments{ Volume{%d}; Delete; }{ Volume{%d : %d}; Delete; };", "_n", "_n",
                        "first", "last").alias("value")))

    groups = global_position(metal.groupBy("layer", "root").agg(*ends), ["layer", "root"], "_g")
    lines = lines.unionByName(groups.select(
        F.lit(4).alias("section"), F.col("_g").alias("number"),
        F.format_string('Physical Volume("L_%d_R_%d",%d ) = {%d : %d};', F.col("layer").cast("bigint"), "root",
                        total + 99 + F.col("_g"), "first", "last").alias("value")))

    return lines.unionByName(cut.select(
        F.lit(5).alias("section"), F.col("layer").cast("bigint").alias("number"),
        F.format_string('Physical Volume("Diel%d", %d) = my_fragments%d();', F.col("layer").cast("bigint"), "_n", "_n").alias("value")))


def whole_box_script(boxes: DataFrame, stack: DataFrame, name: str = "boxes", size: float = 0.5) -> DataFrame:
    """``box_script`` with its head (section 0: geometry kernel, mesh size) and its end (section 6: group of all boxes)."""
    # Lines that the mesher needs before and after the boxes.
    head = ['SetFactory("OpenCASCADE");', f"lc = {size}; // Characteristic length (mesh size)"]
    end = ["// Define the mesh size for all points", "Mesh.MeshSizeMin = lc;"]
    spark = boxes.sparkSession
    stored, count = materialise_counted(boxes)
    fixed = literal_rows(spark, [(0, k, v) for k, v in enumerate(head, 1)] + [(6, k, v) for k, v in enumerate(end, 2)], "section int, number bigint, value string")
    lines = _box_lines(stored, count["rows"], materialise(stack)).unionByName(fixed)
    if not count["rows"]:
        return lines
    group = [(6, 1, f'Physical Volume("{name}") = {{1 : {count["rows"]}}};')]
    return lines.unionByName(literal_rows(spark, group, "section int, number bigint, value string"))


def conductor_script(polygons: DataFrame, stack: DataFrame) -> DataFrame:
    """``(layer, polygon, value)``: the script block of every polygon.

    Rings repeat their first point at the end. Rings of up to five points become inset boxes,
    longer ones a coordinate list; both get a physical surface numbered by layer and polygon.
    A polygon on a layer that ``stack`` doesn't have is refused.
    """
    require_none(polygons.join(stack, "layer", "left_anti").select("layer", "polygon"), "polygon on an unknown layer")
    solid = polygons.join(stack, "layer")
    points = F.slice("ring", 1, F.size("ring") - 1)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    flat = inset(solid.withColumns({"xmin": F.array_min(xs), "xmax": F.array_max(xs), "ymin": F.array_min(ys), "ymax": F.array_max(ys)}))
    layer, polygon = F.col("layer").cast("bigint"), F.col("polygon").cast("bigint")
    box = F.concat(
        F.format_string("x0=%f; y0=%f; z0=%f; dx=%f; dy=%f; dz=%f; lc = lc_inner;\n", *[F.col(c).cast("double") for c in ("x0", "y0", "z0", "dx", "dy", "dz")]),
        F.lit('Call "BuildBox";\n'))
    prism = F.concat(
        F.lit("px[] = {"), F.concat_ws(",", xs.cast("array<string>")), F.lit("};\npy[] = {"), F.concat_ws(",", ys.cast("array<string>")), F.lit("};\n"),
        F.format_string("z0=%f; dz=%f; lc = lc_inner;\n", (F.col("zmin") + INSET).cast("double"), (F.col("zmax") - F.col("zmin") - 2 * INSET).cast("double")),
        F.lit('Call "BuildPolygon";\n'))
    surface = F.format_string('Physical Surface("L_%d_R_%d",%d) = { all_surfs[]};\nconductor_loops[] += sl_id;', layer, polygon,
                              layer * POLYGONS_PER_LAYER + polygon)
    return flat.select("layer", "polygon", F.concat(F.when(F.size("ring") > 5, prism).otherwise(box), surface).alias("value"))


def outer_box_text(extent_row: DataFrame, height: float = 4000.0) -> DataFrame:
    """Closing box around an extent row (xmin, ymin, xmax, ymax), with side lengths."""
    c = F.col
    return extent_row.select(F.format_string(
        "x0=%f; y0=%f; z0=%f; dx=%f; dy=%f; dz=%f; lc = lc_inner; // Diel", c("xmin"), c("ymin"), F.lit(0.0),
        c("xmax") - c("xmin"), c("ymax") - c("ymin"), F.lit(height)).alias("value"))
