"""A training corpus in five stages: toxicity, exact and near duplicates, benchmark leaks, packing.

Every stage reads what its predecessor kept from Parquet and, but for the last, returns the columns of
``documents``. ``run`` applies them to the ``documents`` table of a folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lamina.durable import materialise, shared_folder
from lamina.llm import decontamination, exact_dedup, jaccard_join, packing, toxicity
from lamina.llm.membership import drop_keys
from lamina.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _row_key() -> Column:
    """Tells rows apart, those that share an id too; rows alike in id and text are one row that repeats."""
    return F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` without the rows of these row keys."""
    gone = materialise(keys.toDF("_row").distinct())
    return drop_keys(docs.select(*COLUMNS, _row_key().alias("_row")), "_row", gone).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the severity model doesn't reject.

    Every row is judged by its own text, so null and repeated ids make no difference; a null text is judged as an empty
    one. The model learns from the rows of ``labels`` with an id and a grade. Without rows there are none to return.
    """
    model = toxicity.fit_severity(docs, _table(spark, folder, "labels"))
    return toxicity.severity(docs.select(*COLUMNS), model).where("NOT rejected").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of equal texts; a null text counts as empty, null and repeated ids take part."""
    return exact_dedup.keep_distinct(docs.select(*COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The document with the smallest id of each group of linked documents.

    Rows are told apart by id and text. Of several rows with a group's smallest id (or without any id) the one with
    the smallest row key stays, as often as it repeats; a row without an id goes where the group has one. Texts
    without words are in no group and stay. Without rows there are none to return.
    """
    linked = materialise(jaccard_join.join_rows(docs).where("n_links > 0"))
    least = F.col("doc_id").eqNullSafe(F.col("component_id"))
    stays = linked.where(least).groupBy("component_key").agg(F.min("row_key").alias("_stays"))
    lost = linked.join(stays, "component_key").where(~least | (F.col("row_key") != F.col("_stays")))
    return _without(docs, lost.select("row_key"))


def drop_leaks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that leak no item of the benchmark; every row is searched on its own, whatever its id.

    Null and empty texts leak nothing, and so does a benchmark without rows. Without rows there are none to return.
    """
    leaks = decontamination.find_leaks(docs.select("text", _row_key().alias("_row")), _table(spark, folder, "benchmark"), id_col="_row")
    return _without(docs, leaks.select("_row"))


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Places of all pieces of the documents in sequences of tokens."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("ngram_jaccard_join", drop_near_copies),
    ("template_decontamination", drop_leaks), ("best_fit_packing", pack)]

ORACLE_SQL = None  # the first stage is a trained model, which SQL can't express


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, folder)
