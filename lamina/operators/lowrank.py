"""Gram matrices of tall dense tables.

A table holds one row vector per record. Every batch of rows gives a partial Gram matrix, sent on in
blocks of columns and summed by place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

COLUMNS = 512  # columns in a block of the Gram matrix


def gram(df: DataFrame, vector: str, shift: float = 0.0) -> DataFrame:
    """Column Gram matrix ``M' M + shift I`` as ``(i, j, v)`` with 1-based indices."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                m = np.stack(batch["v"].to_numpy()).astype(np.float64)
                for k in range(0, m.shape[1], COLUMNS):
                    block = m.T @ m[:, k:k + COLUMNS]
                    i, j = np.divmod(np.arange(block.size), block.shape[1])
                    yield pd.DataFrame({"i": i + 1, "j": j + k + 1, "v": block.ravel()})

    parts = df.select(F.col(vector).alias("v")).mapInPandas(partial, "i bigint, j bigint, v double")
    summed = parts.groupBy("i", "j").agg(F.sum("v").alias("v"))
    return summed.withColumn("v", F.col("v") + F.when(F.col("i") == F.col("j"), F.lit(shift)).otherwise(F.lit(0.0)))
