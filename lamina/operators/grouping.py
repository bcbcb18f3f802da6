"""Aggregates: distinct children, frequencies, histograms, conditional areas, diagnostics."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lamina.checks import StrictModeError
from lamina.operators.numbering import order_key

# Shape kinds that have an area rule; other kinds count as nothing.
SHAPE_RECTANGLE, SHAPE_CIRCLE, SHAPE_POLYGON, SHAPE_TRAPEZOID = 1, 2, 3, 4


def first_seen_distinct(df: DataFrame, keys: Sequence[str], value: str, order_by: Sequence[str], name: str) -> DataFrame:
    """Distinct values of each group with the place of their first appearance, one row each.

    This row form suits groups of any size; ``as_array`` folds it into one array per group.
    """
    return df.groupBy(*keys, value).agg(F.min(order_key(order_by)).alias(name))


def as_array(seen: DataFrame, keys: Sequence[str], value: str, order_by: str, name: str) -> DataFrame:
    """Fold ``first_seen_distinct`` rows into arrays in first-seen order.

    An array has to fit in one row; the row form has no such bound and suits groups of any size.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order_by).alias("o"), F.col(value).alias("v"))))
    return seen.groupBy(*keys).agg(F.transform(ordered, lambda s: s["v"]).alias(name))


def extrema(df: DataFrame, value: str, strict: bool = False) -> DataFrame:
    """Smallest and largest value; with ``strict`` an empty table or an empty text is an error."""
    result = df.agg(F.min(value).alias("min_value"), F.max(value).alias("max_value"))
    if strict and result.first()["min_value"] in (None, ""):
        raise StrictModeError(f"{value} has no smallest value")
    return result


def frequency(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("freq"))


def word_count(df: DataFrame, text: str) -> DataFrame:
    """Count of each whitespace-separated word."""
    words = df.select(F.explode(F.split(F.col(text), r"\s+")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("freq"))


def shape_area(kind: Column, width: Column, height: Column, radius: Column) -> Column:
    return (
        F.when(kind == SHAPE_RECTANGLE, width * height)
        .when(kind == SHAPE_CIRCLE, F.lit(math.pi) * radius * radius)
        .otherwise(F.lit(0.0))
    )


def active_area(area: Column, color: Column, active: Column | int) -> Column:
    """Sum of the areas whose colour is the active one."""
    return F.sum(F.when(color == active, area).otherwise(F.lit(0.0)))


def histogram(df: DataFrame, value: Column, bins: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Counts in ``bins`` equal bins, empty ones included: bin, low, high, count, frequency.

    A value at or above the upper end goes to the last bin. Values below ``low`` are counted in a row
    with bin 0 and nulls in one with a null bin, if there are any; frequencies are shares of all rows.
    """
    width = (high - low) / bins
    place = F.when(value.isNotNull(), F.greatest(F.least(F.floor((value - low) / width) + 1, F.lit(bins)), F.lit(0)))
    counts = df.groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(1, bins + 1).withColumnRenamed("id", "bin")
    filled = grid.join(counts, "bin", "full").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy())  # over the bins only
    return filled.select(
        "bin", F.when(F.col("bin") > 0, F.lit(low) + (F.col("bin") - 1) * width).alias("bin_low"), (F.lit(low) + F.col("bin") * width).alias("bin_high"),
        "n", (F.col("n") / total).alias("freq"))


def max_deviation(hist: DataFrame, bins: int) -> DataFrame:
    """Largest distance of a bin frequency from the even share."""
    return hist.agg(F.max(F.abs(F.col("freq") - F.lit(1.0 / bins))).alias("max_deviation"))


def argmax(df: DataFrame, key: str, value: str) -> DataFrame:
    """Key of the largest value, the smallest such key on ties."""
    return df.agg(F.max_by(key, F.struct(F.col(value), -F.col(key))).alias(key), F.max(value).alias(value))


def l2_norm(value: Column) -> Column:
    return F.sqrt(F.sum(value * value))


def norm(value: Column, kind: str = "L2") -> Column:
    """Only the Euclidean norm is defined; the other kinds are zero."""
    return l2_norm(value) if kind == "L2" else F.lit(0.0)


def array_norm(values: Column) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def midpoint_sum(function: Callable[[Column, Column], Column], ux: Column, uy: Column, vx: Column, vy: Column,
                 weighted: bool = False) -> Column:
    """Sum of a function at the middle of each line; ``weighted`` multiplies by the line length."""
    value = function((ux + vx) * 0.5, (uy + vy) * 0.5)
    if weighted:
        value = value * F.sqrt((vx - ux) * (vx - ux) + (vy - uy) * (vy - uy))
    return F.sum(value)


def mean_ratio(value: Column) -> dict[str, Column]:
    """Arithmetic mean, geometric mean and their ratio."""
    mean, geometric = F.avg(value), F.exp(F.avg(F.ln(value)))
    return {"mean": mean, "geometric_mean": geometric, "ratio": mean / geometric}


def effective_rank(df: DataFrame, weight: str, keys: Sequence[str] = ()) -> DataFrame:
    """Entropy-based effective rank ``exp(-sum p ln p)`` with ``p = w / sum w``.

    With S = sum w and T = sum w ln w the entropy is ``ln S - T / S``: one pass, no shares needed.
    """
    w = F.col(weight) + F.lit(2.0**-52)
    return df.groupBy(*keys).agg(F.exp(F.ln(F.sum(w)) - F.sum(w * F.ln(w)) / F.sum(w)).alias("effective_rank"))


def squared_error(predicted: Column, actual: Column, batch: float) -> Column:
    return F.sum((predicted - actual) * (predicted - actual)) / F.lit(float(batch))
