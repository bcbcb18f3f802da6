"""Two-input gate equations ``out = [!]a * [!]b``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

GATE = r"^\s*(\w+)\s*=\s*(!?)\s*(\w+)\s*\*\s*(!?)\s*(\w+)\s*;?\s*$"


def parse_gates(lines: DataFrame, value: str = "value") -> DataFrame:
    """Gates of the lines that are gate equations; order declarations and comments are passed over."""
    kept = [c for c in lines.columns if c != value]

    def part(k: int):
        return F.regexp_extract(value, GATE, k)

    gates = lines.where(F.col(value).rlike(GATE) & ~part(1).isin("INORDER", "OUTORDER"))
    return gates.select(
        *kept, part(1).alias("lhs"), (part(2) == "!").alias("neg1"), part(3).alias("rhs1"), (part(4) == "!").alias("neg2"), part(5).alias("rhs2"))
