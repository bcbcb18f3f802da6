"""Layer stacks: z ranges, extrusion, physical ids and mesh validations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lamina.operators.lookup import lookup

POLYGONS_PER_LAYER = 200  # id block of a layer in physical ids
INSET = 20.0  # gap kept around a conductor in the mesh
BLOAT = 500.0  # margin of the dielectric around all conductors


def stack_table(layers: DataFrame, vias: DataFrame) -> DataFrame:
    """Conductor layers and vias as one z-range table with 1-based ``layer``."""
    conductor = layers.select((F.col("id") + 1).alias("layer"), "zmin", "zmax", F.lit(False).alias("is_via"))
    via = vias.select((F.col("id") + 1).alias("layer"), "zmin", "zmax", F.lit(True).alias("is_via"))
    return conductor.unionByName(via)


def with_upper(layers: DataFrame) -> DataFrame:
    """Add ``slab_zmax``: the top of the layer above, or the layer's own top for the last one."""
    above = layers.select((F.col("layer") - 1).alias("layer"), F.col("zmax").alias("_above"))
    return layers.join(above, "layer", "left").withColumn("slab_zmax", F.coalesce("_above", "zmax")).drop("_above")


def extrude(boxes: DataFrame, stack: DataFrame, strict: bool = False) -> DataFrame:
    """Give boxes of a ``layer`` their z range and side lengths."""
    # one row per layer; a join by layer would send all boxes of a layer to one task
    solid = lookup(boxes, F.broadcast(stack), {"layer": "layer"}, {"zmin": "zmin", "zmax": "zmax"}, strict)
    return solid.withColumns({
        "dx": F.col("xmax") - F.col("xmin"), "dy": F.col("ymax") - F.col("ymin"), "dz": F.col("zmax") - F.col("zmin"),
    })


def solid_rules() -> dict[str, Column]:
    """Rules a mesh box has to meet."""
    return {
        "z_order": F.col("zmax") >= F.col("zmin"),
        "height": F.col("dz") > 0,
        "area": (F.col("dx") > 0) & (F.col("dy") > 0),
    }


def physical_id(layer: Column, polygon: Column) -> Column:
    """Group id of a polygon (both 1-based); unique up to the block size of a layer."""
    return layer * POLYGONS_PER_LAYER + polygon


def physical_id_collisions(groups: DataFrame, layer: str = "layer", polygon: str = "polygon") -> DataFrame:
    """Ids that more than one (layer, polygon) would receive."""
    ids = groups.select(layer, polygon).distinct().withColumn("physical_id", physical_id(F.col(layer), F.col(polygon)))
    return ids.groupBy("physical_id").agg(F.count("*").alias("groups")).where("groups > 1")


def inset(boxes: DataFrame, gap: float = INSET) -> DataFrame:
    """Origin and side lengths of mesh boxes kept ``gap`` away from the layer limits.

    Only conductors move in x and y; the x length of every box shrinks by two gaps.
    """
    moved = F.when(F.col("is_via"), F.lit(0.0)).otherwise(F.lit(gap))
    return boxes.withColumns({
        "x0": F.col("xmin") + moved, "y0": F.col("ymin") + moved, "z0": F.col("zmin") + gap,
        "dx": F.col("xmax") - F.col("xmin") - 2 * gap, "dy": F.col("ymax") - F.col("ymin"),
        "dz": F.col("zmax") - F.col("zmin") - 2 * gap,
    })
