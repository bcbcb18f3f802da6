"""Layout table bundles on shared storage: load, persist, replace, copy."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from lamina.checks import require_columns, require_same_schema
from lamina.operators.numbering import position_in_group
from lamina.schemas import LAYOUT_TABLES


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Scan one table; its columns have to cover the declared ones."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    declared = LAYOUT_TABLES.get(name)
    return require_columns(df, declared.fieldNames()) if declared else df


def with_source_order(df: DataFrame, file: str = "ord_file", row: str = "ord_row") -> DataFrame:
    """Add the position of parquet rows (file, row in file), the order that first-match rules use."""
    return df.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))


def load_design(spark: SparkSession, folder: str, order_by: list[str], with_hierarchy: bool = True) -> dict[str, DataFrame]:
    """All tables of a design; instances get ``inum``, their position within the parent cell."""
    names = [n for n in LAYOUT_TABLES if with_hierarchy or n != "parentchild"]
    design = {n: read_table(spark, folder, n) for n in names}
    design["instances"] = position_in_group(design["instances"], ["CellName"], order_by)
    return design


def persist(tables: dict[str, DataFrame], folder: str, compression: str = "zstd") -> None:
    """Write tables to new locations; an existing table is an error."""
    for name, df in tables.items():
        df.write.mode("errorifexists").option("compression", compression).parquet(f"{folder}/{name}.parquet")


def export_parquet(df: DataFrame, path: str, level: int | None = None) -> None:
    """Parquet with zstd, optionally at a given level."""
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    if level is not None:
        writer = writer.option("parquet.compression.codec.zstd.level", str(level))
    writer.parquet(path)


def replace_table(df: DataFrame, folder: str, name: str) -> str:
    """Replace a table that ``df`` may be reading from: stage the new rows, then overwrite."""
    spark = df.sparkSession
    staged = f"{folder}/_staged_{name}_{uuid.uuid4().hex}"
    target = f"{folder}/{name}.parquet"
    df.write.parquet(staged)
    spark.read.schema(df.schema).parquet(staged).write.mode("overwrite").parquet(target)
    return target


POINTER = "current.pointer"  # file in a versioned table's folder that names the version to read


def _rename_over(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file, replacing the target in one step of the file system."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(source)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration())
    options = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(path, jvm.org.apache.hadoop.fs.Path(target), options)


def publish(df: DataFrame, folder: str, name: str) -> str:
    """Write a new version of a table and make it the current one; ``df`` may read the current one.

    Readers see the old version until the new one is whole: the last step renames the pointer file. A job that fails
    before it leaves the table as it was. Returns the version's folder.
    """
    spark = df.sparkSession
    version = uuid.uuid4().hex
    df.write.parquet(f"{folder}/{name}/{version}")
    staged = f"{folder}/{name}/next-{version}"
    spark.range(1).select(F.lit(version)).coalesce(1).write.text(staged)
    # the one part of a text folder is the pointer's content
    part = spark.read.text(staged).select(F.col("_metadata.file_path")).first()[0]
    _rename_over(spark, part, f"{folder}/{name}/{POINTER}")
    return f"{folder}/{name}/{version}"


def read_published(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The current version of a table."""
    version = spark.read.text(f"{folder}/{name}/{POINTER}").first()[0]
    return spark.read.parquet(f"{folder}/{name}/{version}")


def copy_tables(spark: SparkSession, source: str, target: str, names: Iterable[str]) -> None:
    """Copy tables from one location to another."""
    for name in names:
        spark.read.parquet(f"{source}/{name}.parquet").write.mode("errorifexists").parquet(f"{target}/{name}.parquet")


def register_views(tables: dict[str, DataFrame]) -> None:
    """Make tables queryable by name from SQL."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def pipe(source: DataFrame, sink_schema: StructType, path: str) -> None:
    """Write a source to a sink only when their types agree."""
    require_same_schema(source.schema, sink_schema)
    source.write.mode("errorifexists").parquet(path)
