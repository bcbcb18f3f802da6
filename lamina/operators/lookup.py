"""Keyed, first-match and interval lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lamina.checks import require_columns, require_none, require_some
from lamina.durable import materialise
from lamina.operators.numbering import order_key, running_total

INTERVAL_LITERALS = 1_000  # interval tables up to this many rows become one CASE expression


def lookup(
    df: DataFrame,
    table: DataFrame,
    on: Mapping[str, str],
    take: Mapping[str, str],
    strict: bool = False,
) -> DataFrame:
    """N:1 lookup. ``on`` maps df columns to table columns, ``take`` maps table columns to new names.

    Without ``strict`` unmatched rows keep nulls. The planner decides on broadcasting from sizes.
    """
    side = table.select(
        *[F.col(t).alias(f"_k{i}") for i, t in enumerate(on.values())],
        *[F.col(t).alias(new) for t, new in take.items()],
    )
    condition = None
    for i, column in enumerate(on):
        term = df[column] == side[f"_k{i}"]
        condition = term if condition is None else condition & term
    keys = [f"_k{i}" for i in range(len(on))]
    if strict:
        require_none(side.groupBy(*keys).count().where("count > 1"), "lookup table repeats a key")
        # the keys alone: whole rows would be shuffled once more beside the lookup itself
        wanted = df.select(*[F.col(c).alias(f"_w{i}") for i, c in enumerate(on)]).distinct()
        known = [F.col(f"_w{i}") == F.col(key) for i, key in enumerate(keys)]
        require_none(wanted.join(side, known, "left_anti").toDF(*on), "lookup value not found")
    return df.join(side, condition, "left").drop(*keys)


def name_numbers(df: DataFrame, name: str, number: str, order_by: Sequence[str]) -> DataFrame:
    """Name to number dictionary: rows lacking either are left out, the last row of a name wins."""
    require_columns(df, [name, number, *order_by])
    return (
        df.where(F.col(name).isNotNull() & F.col(number).isNotNull())
        .groupBy(name)
        .agg(F.max_by(number, order_key(order_by)).alias(number))
    )


def dropped_rows(df: DataFrame, *columns: str) -> DataFrame:
    """How many rows lack one of ``columns``, beside the rows kept."""
    kept = F.lit(True)
    for c in columns:
        kept = kept & F.col(c).isNotNull()
    return df.agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("dropped"))


def pick_group(df: DataFrame, key: str, value: object, strict: bool = True) -> DataFrame:
    """Rows of one group; an absent group is an error in strict mode."""
    group = df.where(F.col(key) == F.lit(value))
    return require_some(group, f"no rows with {key} = {value}") if strict else group


def first_match(
    df: DataFrame,
    table: DataFrame,
    on: Mapping[str, str],
    take: str,
    order_by: Sequence[str],
    name: str,
    strict: bool = False,
) -> DataFrame:
    """Exact composite-key lookup keeping, of several matches, the first in table order.

    The table is reduced to one row per key before the join, with partial aggregation.
    """
    firsts = table.groupBy(*on.values()).agg(F.min_by(take, order_key(order_by)).alias("_take"))
    return lookup(df, firsts, on, {"_take": name}, strict)


def interval_lookup(
    df: DataFrame,
    value: str,
    table: DataFrame,
    low: str,
    high: str,
    take: str,
    order_by: str,
    name: str,
    literal_limit: int = INTERVAL_LITERALS,
) -> DataFrame:
    """First interval (in table order) with ``low <= value < high``; null outside all of them.

    A short table turns into one CASE expression, without a join; a longer one is numbered and
    joined by stretch between interval ends.
    """
    rows = table.select(low, high, take, order_by).orderBy(order_by).limit(literal_limit + 1).collect()
    if len(rows) <= literal_limit:
        return df.withColumn(name, _interval_case(F.col(value), [(r[0], r[1], r[2]) for r in rows], table.schema[take].dataType))
    return df.join(_interval_winners(df.select(value), value, table, low, high, take, order_by, name), value, "left")


def _interval_winners(values: DataFrame, value: str, table: DataFrame, low: str, high: str, take: str, order_by: str, name: str) -> DataFrame:
    """``(value, name)`` of the distinct values that lie in some interval of a large table.

    Sorted together with the values, the interval ends number the stretches between them, and every
    value learns its stretch from a running count. An interval covers a range of stretches, written
    as at most two aligned blocks of 2^k stretches per k; a block keeps its first interval only.
    The winner of a stretch is the first among the blocks above it. Nothing pairs values with
    intervals, so crowded or overlapping intervals cost no more than others.
    """
    whole = ("tinyint", "smallint", "int", "bigint")
    kinds = {values.schema[value].dataType.simpleString(), table.schema[low].dataType.simpleString(), table.schema[high].dataType.simpleString()}
    kind = "bigint" if kinds <= set(whole) else "double"  # whole numbers stay exact
    spans = table.where(F.col(low) < F.col(high)).select(
        F.col(low).cast(kind).alias("_lo"), F.col(high).cast(kind).alias("_hi"), F.col(take).alias("_take"), F.col(order_by).alias("_ord"))
    ends = spans.select(F.explode(F.array("_lo", "_hi")).alias("_z")).distinct().withColumn("_end", F.lit(1).cast("bigint"))
    points = values.where(F.col(value).isNotNull()).select(F.col(value).cast(kind).alias("_z")).distinct().withColumn("_end", F.lit(0).cast("bigint"))
    ranked = materialise(running_total(ends.unionByName(points), "_end", ["_z", F.col("_end").desc()], "_before"))
    numbered = ranked.where("_end = 1").select("_z", (F.col("_before") + 1).alias("_rank"))
    total = numbered.count()
    levels = F.sequence(F.lit(0), F.lit(max(total, 1).bit_length()))

    start = numbered.withColumnsRenamed({"_z": "_lo", "_rank": "_a"})
    stop = numbered.withColumnsRenamed({"_z": "_hi", "_rank": "_b"})
    ranged = spans.join(start, "_lo").join(stop, "_hi").select("_a", "_b", "_take", "_ord", F.explode(levels).alias("_k"))
    size = F.expr("shiftleft(1L, _k)")
    left, right = F.ceil(F.col("_a") / size), F.floor(F.col("_b") / size)
    block = F.array(F.when((left < right) & (left % 2 == 1), left), F.when((left < right) & (right % 2 == 1), right - 1))
    blocks = ranged.select("_k", F.explode(F.array_compact(block)).alias("_block"), "_take", "_ord")
    firsts = blocks.groupBy("_k", "_block").agg(F.min(F.struct("_ord", "_take")).alias("_first"))

    above = numbered.select("_rank", F.explode(levels).alias("_k")).withColumn("_block", F.expr("shiftright(_rank, _k)"))
    winners = above.join(firsts, ["_k", "_block"]).groupBy("_rank").agg(F.min("_first").alias("_first")).select("_rank", F.col("_first._take").alias(name))
    found = ranked.where("_end = 0").select(F.col("_z").alias(value), F.col("_before").alias("_rank"))
    return found.join(winners, "_rank").select(F.col(value).cast(values.schema[value].dataType).alias(value), name)


def _interval_case(value: Column, intervals: Sequence[tuple[float, float, object]], dtype) -> Column:
    result = F.lit(None).cast(dtype)
    for low, high, take in reversed(intervals):
        result = F.when((value >= F.lit(low)) & (value < F.lit(high)), F.lit(take)).otherwise(result)
    return result
