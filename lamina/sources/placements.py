"""Placement lines of a DEF file: ``- name cell + PLACED ( x y ) orientation ;``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def parse_components(lines: DataFrame, value: str = "value") -> DataFrame:
    """Second and third field, then the fifth, fourth and second from the end, of lines with over three fields."""
    kept = [c for c in lines.columns if c != value]
    fields = lines.withColumn("_f", F.split(F.trim(value), r"\s+")).where(F.size("_f") > 3)
    return fields.select(
        *kept,
        F.element_at("_f", 2).alias("InstanceName"), F.element_at("_f", 3).alias("CellName"),
        F.try_element_at("_f", F.lit(-5)).try_cast("int").alias("X"), F.try_element_at("_f", F.lit(-4)).try_cast("int").alias("Y"),
        F.try_element_at("_f", F.lit(-2)).alias("Orientation"),
    )
