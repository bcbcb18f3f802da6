"""Text files as numbered lines.

Grammars that count their lines are parsed by joining on line numbers, so a large file is spread
over many tasks like any other table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lamina.operators.numbering import position_in_group


def read_lines(spark: SparkSession, path: str, keep_blank: bool = False) -> DataFrame:
    """Trimmed lines as ``(file, line, value)``, ``line`` dense from 1 within the file.

    A file's splits are ordered by their byte offset, lines of a split by reading order.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"), F.trim("value").alias("value"))
    if not keep_blank:
        raw = raw.where("value <> ''")
    return position_in_group(raw, ["file"], ["_block", "_seq"], "line").select("file", "line", "value")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace-separated words of text files."""
    words = spark.read.text(path).select(F.explode(F.split("value", r"\s+")).alias("word"))
    return words.where("word <> ''")


def write_lines(lines: DataFrame, path: str, value: str, order_by: list[str]) -> None:
    """Write text in order: part files sorted by name hold the ordered lines."""
    lines.repartitionByRange(*order_by).sortWithinPartitions(*order_by).select(value).write.mode("errorifexists").text(path)
