"""Toxicity: severity grades by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lamina.llm.ordinal import OrdinalModel, fit_labels, grade_texts

REJECT = 0.5  # documents whose chance of any severity reaches this are rejected


def severity(docs: DataFrame, model: OrdinalModel, text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """``docs`` with ``expected_severity``, ``toxic_chance`` (of more than the lowest grade) and ``rejected``.

    Every whole text is read; null, empty and blank texts have one feature, that they are without words.
    A model of fewer than two grades rejects nothing. Columns of these names are replaced.
    """
    mine = ("expected_severity", "toxic_chance", "rejected")
    kept = [c for c in docs.columns if c not in (*mine, "expected_grade", "tails")]
    chance = F.coalesce(F.get("tails", F.lit(0)), F.lit(0.0))
    return grade_texts(docs.select(*kept), model, text_col).select(*kept, F.col("expected_grade").alias(mine[0]), chance.alias(mine[1]), (chance >= reject).alias(mine[2]))


def fit_severity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fit to the ordered grades in ``label_col``; of an id with several labels the highest counts."""
    return fit_labels(docs, labels, label_col, id_col, text_col)
