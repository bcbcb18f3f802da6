"""Primes, Collatz lengths, integration by trials, and equidistribution."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType

from lamina.operators.numbering import global_position

SEGMENT = 1 << 20  # numbers sieved by one task at a time


def _small_primes(limit: int) -> np.ndarray:
    """Primes up to ``limit``."""
    flags = np.ones(limit + 1, dtype=bool)
    flags[:2] = False
    for p in range(2, math.isqrt(limit) + 1):
        if flags[p]:
            flags[p * p :: p] = False
    return np.flatnonzero(flags)


def primes_below(spark: SparkSession, limit: int) -> DataFrame:
    """All primes smaller than ``limit``, sieved segment by segment in parallel.

    A task needs only the primes up to sqrt(limit), which it derives itself.
    """
    segments = max(0, (limit - 2 + SEGMENT - 1) // SEGMENT)

    def sieve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = _small_primes(math.isqrt(max(limit - 1, 0)))
        for batch in batches:
            for segment in batch["id"]:
                low = 2 + int(segment) * SEGMENT
                high = min(low + SEGMENT, limit)
                flags = np.ones(high - low, dtype=bool)
                for p in base[base * base < high]:
                    first = max(int(p) * int(p), -(-low // int(p)) * int(p))
                    flags[first - low :: p] = False
                yield pd.DataFrame({"n": np.flatnonzero(flags) + low})

    return spark.range(segments).mapInPandas(sieve, "n bigint")


def first_primes(spark: SparkSession, count: int) -> DataFrame:
    """The first ``count`` primes; the n-th prime is below n (ln n + ln ln n) for n > 5."""
    bound = 15 if count < 6 else int(count * (math.log(count) + math.log(math.log(count)))) + 2
    return global_position(primes_below(spark, bound), ["n"], "k").where(F.col("k") <= count).select("n")


@F.pandas_udf(LongType())
def _collatz(n: pd.Series) -> pd.Series:
    value = n.to_numpy(np.int64).copy()
    length = np.ones(len(value), dtype=np.int64)
    live = np.flatnonzero(value > 1)
    top = (2**63 - 2) // 3
    while len(live):
        v = value[live]
        odd = (v & 1) == 1
        large = live[odd & (v > top)]
        for k in large:  # beyond 64 bits: exact integers
            w, steps = int(value[k]), 0
            while w != 1:
                w, steps = (3 * w + 1 if w & 1 else w >> 1), steps + 1
            value[k], length[k] = 1, length[k] + steps
        small = ~(odd & (v > top))
        index = live[small]
        v, odd = v[small], odd[small]
        value[index] = np.where(odd, 3 * v + 1, v >> 1)
        length[index] += 1
        live = index[value[index] != 1]
    return pd.Series(length)


def collatz_length(n: Column) -> Column:
    """Numbers in the Collatz sequence from n down to 1, both ends counted; null below 1."""
    n = n.cast("bigint")
    return F.when(n >= 1, _collatz(F.coalesce(n, F.lit(1).cast("bigint"))))


def golden_point(n: Column, multiplier: float) -> Column:
    """Point ``frac(n * multiplier)`` of a low-discrepancy sequence in [0, 1)."""
    scaled = n.cast("double") * F.lit(multiplier)
    return scaled - F.floor(scaled)


def trial_point(n: Column, a: Column, b: Column, top: Column) -> tuple[Column, Column]:
    """n-th trial point in [a, b] x [0, top]: fractional parts of n over the plastic number's powers."""
    # 1/g and 1/g^2 with g the real root of g^3 = g + 1.
    return (a + (b - a) * golden_point(n, 0.7548776662466927), top * golden_point(n, 0.5698402909980532))


def trial_integral(hits: Column, trials: Column, a: Column, b: Column, top: Column) -> Column:
    """Area estimate from the share of trial points under the curve."""
    return (b - a) * (top * hits / trials)


def pi_fraction(n: Column) -> Column:
    """Fractional part of n * pi."""
    return (n.cast("double") * F.lit(math.pi)) % F.lit(1.0)


def grid_points(rows: DataFrame, number: str, size: Column | int) -> DataFrame:
    """Turn 0-based cell numbers into unit-square grid points ``x, y`` of a size x size mesh."""
    n = F.lit(size) if isinstance(size, int) else size
    step = F.lit(1.0) / n
    return rows.withColumns({"y": F.floor(F.col(number) / n) * step, "x": F.pmod(F.col(number), n) * step})
