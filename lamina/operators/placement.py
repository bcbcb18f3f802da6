"""Component placements: orientation rules, coordinate transfer and instance naming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lamina.checks import require_none
from lamina.operators.lookup import first_match, lookup

DBU = 1000  # database units per micrometre

# The eight placement orientations in the order of their codes.
ORIENTATIONS = ("N", "E", "S", "W", "FS", "FN", "FE", "FW")


def to_dbu(micrometres: Column) -> Column:
    """Integer database units, halves to even."""
    return F.rint(micrometres * F.lit(float(DBU))).cast("bigint")


def orientation_code(text: Column) -> Column:
    """0-based code of a case-sensitive orientation name; null when unknown."""
    code = F.lit(None).cast("int")
    for i, name in enumerate(ORIENTATIONS):
        code = F.when(text == name, F.lit(i)).otherwise(code)
    return code


def _offsets(orientation: Column, llx: Column, lly: Column, urx: Column, ury: Column, table: str) -> tuple[Column, Column]:
    """What a placement's x and y move by, from the corners of the cell box; null for an unknown orientation.

    "derived" swaps FE and FW as the mirror and rotation table implies.
    """
    fe, fw = ("FE", "FW") if table == "executed" else ("FW", "FE")
    none = F.lit(0).cast("bigint")
    dx = F.when(orientation.isin("N", "FS"), none).when(orientation.isin("E", fw), llx - lly)
    dx = dx.when(orientation.isin("S", "FN"), llx + urx).when(orientation.isin("W", fe), llx + ury)
    dy = F.when(orientation.isin("N", "FN"), none).when(orientation.isin("W", fw), lly - llx)
    dy = dy.when(orientation.isin("E", fe), lly + urx).when(orientation.isin("S", "FS"), lly + ury)
    return dx, dy


def placed_origin(
    x: Column, y: Column, orientation: Column, box_um: tuple[Column, Column, Column, Column], table: str = "executed"
) -> tuple[Column, Column]:
    """Layout origin (DBU) of a placed component; null for an unknown orientation."""
    if table not in ("executed", "derived"):
        raise ValueError("table is 'executed' or 'derived'")
    dx, dy = _offsets(orientation, *map(to_dbu, box_um), table)
    return x + dx, y + dy


def place_components(components: DataFrame, bbox: DataFrame, strict: bool = False, table: str = "executed") -> DataFrame:
    """Add ``gds_x, gds_y`` to components, using the box of their cell."""
    joined = lookup(components, bbox, {"CellName": "CellName"},
                    {n: f"_{n}" for n in ("XMIN", "YMIN", "XMAX", "YMAX")}, strict)
    box = tuple(F.col(f"_{n}") for n in ("XMIN", "YMIN", "XMAX", "YMAX"))
    gx, gy = placed_origin(F.col("X").cast("bigint"), F.col("Y").cast("bigint"), F.col("Orientation"), box, table)
    if strict:
        require_none(components.where(orientation_code(F.col("Orientation")).isNull()), "unknown orientation")
    return joined.withColumns({"gds_x": gx, "gds_y": gy}).drop("_XMIN", "_YMIN", "_XMAX", "_YMAX")


def name_instances(
    instances: DataFrame,
    components: DataFrame,
    bbox: DataFrame,
    order_by: list[str],
    top_cell: str | None = None,
    strict: bool = False,
    table: str = "executed",
) -> DataFrame:
    """Give instances the name of the first component placed on the same spot with the same cell.

    ``order_by`` is the components' row order. ``top_cell`` narrows the work to one parent.
    """
    placed = place_components(components, bbox, strict, table)
    target = instances if top_cell is None else instances.where(F.col("CellName") == top_cell)
    target = target.withColumns({"_x": to_dbu(F.col("X")), "_y": to_dbu(F.col("Y"))})
    named = first_match(
        target, placed, {"_x": "gds_x", "_y": "gds_y", "RefCellName": "CellName"},
        "InstanceName", order_by, "InstanceName", strict,
    )
    return named.drop("_x", "_y")


def name_extrema(named: DataFrame, top_cell: str | None = None, strict: bool = False) -> DataFrame:
    """Smallest and largest instance name, of one parent or of every parent."""
    if top_cell is not None:
        named = named.where(F.col("CellName") == top_cell)
    if strict:
        require_none(named.where("InstanceName IS NULL OR InstanceName = ''"), "instance without a name")
    bounds = [F.min("InstanceName").alias("min_i"), F.max("InstanceName").alias("max_i")]
    return named.agg(*bounds) if top_cell is not None else named.groupBy("CellName").agg(*bounds)
