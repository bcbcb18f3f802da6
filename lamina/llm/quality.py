"""Quality classifier: ordinal cumulative-link regression on graded ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lamina.llm.ordinal import OrdinalModel, fit_labels, grade_texts

KEEP = 0.5  # documents whose chance of reaching the wanted grade is at least this are kept


def rate_quality(docs: DataFrame, model: OrdinalModel, text_col: str = "text", wanted: int = 1, keep: float = KEEP) -> DataFrame:
    """``docs`` with ``expected_grade``, ``tail_chance`` of the ``wanted``-th grade or better, and ``kept``.

    Grades are counted from 0 in the order of the labels. Every whole text is read; null, empty and blank
    texts have one feature, that they are without words. A model without the wanted grade keeps all.
    Columns of these names are replaced.
    """
    mine = ("tail_chance", "kept")
    kept = [c for c in docs.columns if c not in (*mine, "expected_grade", "tails")]
    chance = F.coalesce(F.get("tails", F.lit(wanted - 1)), F.lit(1.0))
    return grade_texts(docs.select(*kept), model, text_col).select(*kept, "expected_grade", chance.alias(mine[0]), (chance >= keep).alias(mine[1]))


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fit to the ordered grades in ``label_col``; of an id with several labels the highest counts."""
    return fit_labels(docs, labels, label_col, id_col, text_col)
