"""Point and rectangle hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import LongType

# 64-bit FNV offset basis and prime.
FNV_BASIS = 14695981039346656037
FNV_PRIME = 1099511628211


@F.pandas_udf(LongType())
def _fnv1a(x: pd.Series, y: pd.Series) -> pd.Series:
    data = np.stack([x.to_numpy(np.int64), y.to_numpy(np.int64)], axis=1).astype("<i8").view(np.uint8)
    state = np.full(len(data), FNV_BASIS, dtype=np.uint64)
    for k in range(16):
        state = (state ^ data[:, k].astype(np.uint64)) * np.uint64(FNV_PRIME)
    return pd.Series(state.view(np.int64))


def point_hash(x: Column, y: Column) -> Column:
    """64-bit FNV-1a over the 16 little-endian bytes of (x, y), as a signed bigint; null for nulls."""
    zero = F.lit(0).cast("bigint")
    hashed = _fnv1a(F.coalesce(x.cast("bigint"), zero), F.coalesce(y.cast("bigint"), zero))
    return F.when(x.isNotNull() & y.isNotNull(), hashed)


def rectangle_hash(lower: Column, upper: Column) -> Column:
    """Combination of two point hashes."""
    return lower.bitwiseXOR(F.shiftleft(upper, 1))


def simple_hash(x: Column, y: Column) -> Column:
    return x * 31 + y
