"""Dropping wide rows by key: filters of fixed size decide on most of them where they are read."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lamina.llm.jaccard_join import FILTER_BITS, _filter_of


def key_filter(keys: DataFrame) -> Callable[[Column], Column]:
    """Test of a bigint hash that holds for every hash in the one column of ``keys``, and for few others.

    However many keys there are, only the filter's ``FILTER_BITS`` bits reach the driver; a full one
    holds for every hash.
    """
    bits, mask = keys.sparkSession.sparkContext.broadcast(_filter_of(keys.toDF("class"))), FILTER_BITS - 1

    @F.pandas_udf("boolean")
    def may_be_in(hashes: pd.Series) -> pd.Series:
        place = hashes.to_numpy() & mask
        return pd.Series((bits.value[place >> 3] >> (place & 7).astype("uint8") & 1).astype(bool))

    return may_be_in


def drop_keys(rows: DataFrame, name: str, gone: DataFrame) -> DataFrame:
    """``rows`` without those whose integer column ``name`` has a value in the one column of ``gone``; null is a value too.

    Rows that the filter of ``gone`` doesn't hold stay. Of the others, the keys alone are joined with
    ``gone``; those that stay make a second filter, and what it doesn't hold is gone. Only rows that pass
    both are joined whole.
    """
    theirs = gone.select(F.col(gone.columns[0]).cast("bigint").alias("_gone"))
    own, is_gone = F.col(name).cast("bigint"), F.col("_own").eqNullSafe(F.col("_gone"))
    listed = key_filter(theirs.select(F.xxhash64("_gone")))
    keys = rows.select(own.alias("_own")).where(listed(F.xxhash64("_own")))
    staying = key_filter(keys.join(theirs, is_gone, "left_anti").select(F.xxhash64("_own")))
    doubtful = rows.where(listed(F.xxhash64(own)) & staying(F.xxhash64(own))).withColumn("_own", own)
    return rows.where(~listed(F.xxhash64(own))).unionByName(doubtful.join(theirs, is_gone, "left_anti").drop("_own"))
