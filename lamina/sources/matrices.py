"""Matrix text: solver row dumps, MatrixMarket files and nested list literals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lamina.constants import literal_rows
from lamina.operators.numbering import global_position
from lamina.operators.sparse import matrix_stats

# Fixed value: the first line that the file format asks for.
BANNER = "%%MatrixMarket matrix coordinate real general"


def parse_row_dump(lines: DataFrame, value: str = "value") -> DataFrame:
    """Entries of ``row r: (c, v) (c, v)`` lines, moved from 0-based to 1-based indices.

    The head is what stands before the colon: its last two words are ``row`` and the number. The rest
    falls into pieces at closing brackets, each with one pair behind its opening one.
    """
    head = F.split(F.trim(F.split_part(value, F.lit(":"), F.lit(1))), " +")
    pieces = F.split(F.split_part(value, F.lit(":"), F.lit(2)), "[)]")
    cells = F.transform(pieces, lambda p: F.split(F.substring_index(p, "(", -1), ","))
    rows = lines.where(F.col(value).contains(":")).select(
        F.try_element_at(head, F.lit(-2)).alias("name"), F.try_element_at(head, F.lit(-1)).try_cast("bigint").alias("r"), F.filter(cells, lambda p: F.size(p) == 2).alias("cells"))
    entries = rows.where("name = 'row' AND r IS NOT NULL").select("r", F.explode("cells").alias("p"))
    return entries.select(
        (F.col("r") + 1).alias("i"), (F.trim(F.col("p")[0]).cast("bigint") + 1).alias("j"), F.trim(F.col("p")[1]).cast("double").alias("v"))


def matrix_market_lines(matrix: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """Numbered lines of a MatrixMarket file: banner, sizes, entries by row and column."""
    placed = global_position(matrix, order_by or ["i", "j"], "_pos")
    body = placed.select((F.col("_pos") + 2).alias("line"), F.concat_ws(" ", *[F.col(c).cast("string") for c in ("i", "j", "v")]).alias("value"))
    sizes = matrix_stats(matrix).select(F.lit(2).cast("bigint").alias("line"), F.concat_ws(" ", "rows", "cols", "entries").alias("value"))
    banner = literal_rows(matrix.sparkSession, [(1, BANNER)], "line bigint, value string")
    return banner.unionByName(sizes).unionByName(body)


def parse_matrix_market(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, sizes) of a MatrixMarket file given as ``(file, line, value)``; % lines are comments."""
    data = lines.where(~F.col("value").startswith("%"))
    first = data.groupBy("file").agg(F.min("line").alias("_first"))
    # one row per file; a join by file would send all lines of a large file to one task
    fields = data.join(F.broadcast(first), "file").withColumn("_f", F.split("value", r"\s+"))

    def number(k: int, kind: str):
        return F.get("_f", F.lit(k)).try_cast(kind)

    sizes = fields.where("line = _first").select("file", number(0, "bigint").alias("rows"), number(1, "bigint").alias("cols"), number(2, "bigint").alias("entries"))
    entries = fields.where("line > _first").select("file", number(0, "bigint").alias("i"), number(1, "bigint").alias("j"), number(2, "double").alias("v"))
    return entries, sizes


def list_literal_lines(rows: DataFrame, values: str = "values", row: str = "i", name: str = "A") -> DataFrame:
    """Numbered lines ``name := [ [..], .. ];`` of a dense matrix given as one array per row 1..n."""
    text = F.concat(F.lit("  ["), F.concat_ws(", ", F.col(values).cast("array<string>")), F.lit("]"))
    last = rows.agg(F.max(row).cast("bigint").alias("last"))
    body = rows.select(
        (F.col(row) + 1).cast("bigint").alias("line"), F.concat(text, F.when(F.col(row) < last.scalar(), ",").otherwise("")).alias("value"))
    head = literal_rows(rows.sparkSession, [(1, f"{name} := [")], "line bigint, value string")
    foot = last.select((F.col("last") + 2).alias("line"), F.lit("];").alias("value"))
    return head.unionByName(body).unionByName(foot)
