"""Dielectric tables and layer technology files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lamina.checks import require_none


def parse_dielectrics(lines: DataFrame, strict: bool = True) -> DataFrame:
    """``name zmin zmax eps`` lines; z is scaled by 1000. Lines with another field count are errors.

    ``lines`` has ``line`` and ``value``; the result keeps ``line`` as the table order.
    """
    fields = lines.withColumn("_f", F.split(F.trim("value"), r"\s+"))
    if strict:
        require_none(fields.where(F.size("_f") != 4).select("line", "value"), "bad dielectric line")
    number = [F.get("_f", F.lit(i)).try_cast("double") for i in (1, 2, 3)]
    return fields.where(F.size("_f") == 4).select(
        "line", F.get("_f", F.lit(0)).alias("name"), (number[0] * 1000).alias("zmin"), (number[1] * 1000).alias("zmax"), number[2].alias("eps"))


def parse_technology(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(metals, vias) of a file with ``METAL{ .. }`` and ``VIA{ .. }`` blocks and # comments.

    A line belongs to the block whose first and last line numbers enclose it.
    """
    starts = lines.select("file", F.col("line").alias("start"), F.regexp_extract("value", r"^(METAL|VIA)\s*\{", 1).alias("block")).where("block <> ''")
    ends = lines.where("value = '}'").select("file", F.col("line").alias("stop"))
    blocks = starts.join(ends, "file").where("stop > start").groupBy("file", "start", "block").agg(F.min("stop").alias("stop"))
    rows = (
        lines.where(~F.col("value").startswith("#")).join(blocks, "file").where("line > start AND line < stop")
        .withColumn("_f", F.split("value", r"\s+"))
    )
    metals = rows.where("block = 'METAL'").select(
        "line", F.get("_f", F.lit(0)).alias("name"), F.get("_f", F.lit(1)).try_cast("bigint").alias("layer"), F.get("_f", F.lit(2)).try_cast("bigint").alias("datatype"),
        F.get("_f", F.lit(3)).try_cast("double").alias("height"), F.get("_f", F.lit(4)).try_cast("double").alias("thickness"))
    vias = rows.where("block = 'VIA'").select(
        "line", F.get("_f", F.lit(0)).alias("name"), F.get("_f", F.lit(1)).try_cast("bigint").alias("layer"), F.get("_f", F.lit(2)).try_cast("bigint").alias("datatype"),
        F.get("_f", F.lit(3)).alias("bottom"), F.get("_f", F.lit(4)).alias("top"))
    return metals, vias
