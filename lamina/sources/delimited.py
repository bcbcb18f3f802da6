"""Delimited text: placements, compressed CSV, and CSV copies of enriched tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StructType

from lamina.schemas import DEFCOMPONENTS


def read_csv(spark: SparkSession, path: str, schema: StructType, sep: str = ",", header: bool = False) -> DataFrame:
    """CSV with a declared schema; malformed rows fail. Gzip files are read whole, one task each."""
    return spark.read.csv(path, schema=schema, sep=sep, header=header, mode="FAILFAST")


def read_components(spark: SparkSession, path: str) -> DataFrame:
    """Space-delimited component list without a header."""
    return read_csv(spark, path, DEFCOMPONENTS, sep=" ")


def csv_lines(spark: SparkSession, text: str, schema: StructType) -> DataFrame:
    """Table from CSV text with a header line, for examples and tests."""
    lines = [line.strip() for line in text.strip().splitlines()]
    return spark.read.csv(spark.createDataFrame([(l,) for l in lines], "value string").rdd.map(lambda r: r[0]), schema=schema, header=True)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays become JSON text."""
    flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, ArrayType) else F.col(f.name) for f in df.schema.fields]
    df.select(*flat).write.mode("errorifexists").csv(path, header=True)


def read_csv_copy(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Read back a table written by ``write_csv``."""
    arrays = [f for f in schema.fields if isinstance(f.dataType, ArrayType)]
    flat = StructType.fromDDL(", ".join(
        f"`{f.name}` {'string' if f in arrays else f.dataType.simpleString()}" for f in schema.fields))
    df = read_csv(spark, path, flat, header=True)
    return df.withColumns({f.name: F.from_json(f.name, f.dataType.simpleString()) for f in arrays}) if arrays else df
