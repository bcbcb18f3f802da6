"""Cutting lineage with tables in the shared folder named by ``spark.checkpoint.dir``.

A written parquet table survives the loss of an executor, keeps columns prunable and gives the
planner real sizes, so loops and two-pass operators restart from it rather than from their source.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the session's setting, or a new one for local sessions."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lamina-"))
    return context.getCheckpointDir().rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once and return a scan of the written table."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lamina-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_counted(df: DataFrame, **rows) -> tuple[DataFrame, dict[str, int]]:
    """``materialise`` that also counts, during the write, all rows and those meeting conditions."""
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("rows")] + [F.count_if(condition).alias(name) for name, condition in rows.items()]
    stored = materialise(df.observe(seen, *counts))
    return stored, {name: value or 0 for name, value in seen.get.items()}
