"""Small fixed tables as literals, so that they cost neither a job nor a Python worker."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def literal_rows(spark: SparkSession, rows: Sequence[Sequence[object]], columns: str) -> DataFrame:
    """Table from literal rows; ``columns`` is ``"name type, name type"``."""
    fields = [c.split() for c in columns.split(",")]
    structs = [F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, fields)]) for row in rows]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))
