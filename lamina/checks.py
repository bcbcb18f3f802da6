"""Strict-mode checks. Each one runs a single action and raises on the first violation kind."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType


class StrictModeError(ValueError):
    """Data breaks a rule the caller asked to enforce."""


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Raise before any job runs when a needed column is absent."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise StrictModeError(f"missing columns {missing}; have {df.columns}")
    return df


def require_same_schema(source: StructType, sink: StructType) -> None:
    """Names and types must agree between what is read and what is to be written."""
    left = [(f.name, f.dataType) for f in source.fields]
    right = [(f.name, f.dataType) for f in sink.fields]
    if left != right:
        raise StrictModeError(f"source and sink types differ: {left} / {right}")


def require_none(df: DataFrame, message: str) -> None:
    """Raise when ``df`` (the violating rows) is not empty; shows one offender."""
    row = df.first()
    if row is not None:
        raise StrictModeError(f"{message}: {row.asDict(recursive=True)}")


def require_some(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise StrictModeError(message)
    return df


def violation_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One row with, per rule, the number of rows where the rule does not hold."""
    return df.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])


def require_rules(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    broken = {k: v for k, v in violation_counts(df, rules).first().asDict().items() if v}
    if broken:
        raise StrictModeError(f"violated rules: {broken}")
    return df
