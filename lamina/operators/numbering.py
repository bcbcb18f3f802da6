"""Dense numbering and running sums that never gather a large group in one task.

The data is range-partitioned on the full ordering, so a value that holds a third of the rows is
spread over many partitions. Each partition numbers its own rows; a table with one row per
partition carries the offsets. The partitioned rows are written first, because a range exchange
samples its bounds anew whenever it is planned again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lamina.checks import StrictModeError
from lamina.durable import materialise, materialise_counted

BROADCAST_GROUPS = 10_000  # so many groups' first rows at most go to every task, and the table stays where it is
ROW_BITS = 33  # low bits of monotonically_increasing_id hold the row's position in its partition


def order_key(order_by: Sequence[str]) -> Column:
    """One comparable value for an ordering; a single column stays as it is, which hashes cheaply."""
    return F.col(order_by[0]) if len(order_by) == 1 else F.struct(*order_by)


def _range_parts(df: DataFrame, order_by: Sequence[str | Column]) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(parts, *order_by).sortWithinPartitions(*order_by)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return materialise(ordered.withColumns({"_part": F.spark_partition_id(), "_row": row}))


def _part_offsets(stored: DataFrame, value: Column) -> DataFrame:
    """Sum of ``value`` over earlier partitions; one row per partition, so the window stays tiny."""
    sums = stored.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))


def global_position(df: DataFrame, order_by: Sequence[str | Column], name: str = "pos") -> DataFrame:
    """Add a dense 1-based position over the whole table in the given order."""
    stored = _range_parts(df, order_by)
    offsets = _part_offsets(stored, F.lit(1).cast("bigint"))
    # one row per range partition: bounded by the shuffle partition setting
    return (
        stored.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_row") + F.col("_offset") + 1)
        .drop("_part", "_row", "_offset")
    )


def position_in_group(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], name: str = "inum") -> DataFrame:
    """Add a dense 1-based position inside each group: the global position less that of the group's first row."""
    placed = global_position(df, [*keys, *order_by], "_at")
    starts = placed.groupBy(*[F.col(k).alias(f"_{n}") for n, k in enumerate(keys)]).agg(F.min("_at").alias("_start"))
    starts, count = materialise_counted(starts)
    if count["rows"] <= BROADCAST_GROUPS:  # a join by few groups would gather each in one task
        starts = F.broadcast(starts)
    same = [F.col(k).eqNullSafe(F.col(f"_{n}")) for n, k in enumerate(keys)]
    numbered = placed.join(starts, same)
    return numbered.withColumn(name, F.col("_at") - F.col("_start") + 1).select(*df.columns, name)


def running_total(
    df: DataFrame,
    value: str,
    order_by: Sequence[str],
    name: str = "running",
    group_by: Sequence[str] = (),
) -> DataFrame:
    """Add the sum of ``value`` over all earlier rows (the current one excluded), per group if given."""
    order = [*group_by, *order_by]
    stored = _range_parts(df, order)
    offsets = _part_offsets(stored, F.col(value))
    inside = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    total = (
        stored.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(F.broadcast(offsets), "_part")  # one row per range partition
        .withColumn(name, F.col("_inside") + F.col("_offset"))
    )
    scratch = ["_part", "_row", "_inside", "_offset"]
    if not group_by:
        return total.drop(*scratch)
    place = F.col("_part").cast("bigint") * (1 << ROW_BITS) + F.col("_row")
    base = total.groupBy(*group_by).agg(F.min_by(name, place).alias("_base"))
    return total.join(base, list(group_by)).withColumn(name, F.col(name) - F.col("_base")).drop(*scratch, "_base")


def previous_in_order(df: DataFrame, keys: Sequence[str], value: str, name: str = "before", take: Column | None = None) -> DataFrame:
    """Add the next smaller ``value`` of the same group (the same one for a repeated value), null for the group's first.

    ``take`` adds something else of that row instead. The first row of a range partition takes it from the last row
    of the partition before.
    """
    stored = _range_parts(df, [*keys, value])
    row = F.struct(*keys, (F.col(value) if take is None else take).alias("_take"))
    last = stored.groupBy("_part").agg(F.max_by(row, "_row").alias("_last"))  # one row per range partition
    ahead = last.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_ahead"))
    inside = F.lag(row).over(Window.partitionBy("_part").orderBy("_row"))
    both = stored.withColumn("_inside", inside).join(F.broadcast(ahead), "_part")
    before = F.coalesce("_inside", "_ahead")
    same = reduce(lambda a, b: a & b, [before[k].eqNullSafe(F.col(k)) for k in keys], F.lit(True))
    return both.select(*df.columns, F.when(same, before["_take"]).alias(name))


def dictionary_encode(df: DataFrame, value: str, order_by: Sequence[str], name: str = "id") -> DataFrame:
    """Distinct values with 1-based ids in order of first appearance: ``(value, name)``.

    The table is the two-way dictionary; join on ``value`` to encode and on ``name`` to decode.
    """
    first = df.groupBy(value).agg(F.min(order_key(order_by)).alias("_first"))
    return global_position(first, ["_first"], name).select(value, name)


def grow_dictionary(stored: DataFrame, df: DataFrame, value: str, order_by: Sequence[str], name: str = "id") -> DataFrame:
    """A dictionary with the new values of one more batch: known ones keep their ids, new ones follow in first-seen order.

    ``stored`` is (value, name), empty at first. Batches one after the other give what ``dictionary_encode`` gives for
    their rows in that order. Only the batch is ordered; the stored table is joined once.
    """
    new = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(order_key(order_by)).alias("_first")).join(stored.select(value), value, "left_anti")
    most = stored.agg(F.coalesce(F.max(name), F.lit(0)).cast("bigint")).first()[0]
    numbered = global_position(new, ["_first"], name).select(value, (F.col(name) + most).alias(name))
    return stored.select(value, F.col(name).cast("bigint").alias(name)).unionByName(numbered)


def require_permutation(df: DataFrame, number: str) -> DataFrame:
    """Check that ``number`` takes each of 1..n exactly once, then return the rows."""
    # n distinct integers lying in 1..n are a permutation; distinctness is an aggregate by value
    repeated = df.groupBy(number).count().where("count > 1")
    stats = df.agg(F.count("*").alias("n"), F.min(number).alias("lo"), F.max(number).alias("hi")).first()
    if stats["n"] and (stats["lo"] != 1 or stats["hi"] != stats["n"] or not repeated.isEmpty()):
        raise StrictModeError(f"{number} is not a permutation of 1..{stats['n']}")
    return df
