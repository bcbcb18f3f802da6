"""Exact deduplication with a heavy-hitter split.

Texts are equal when they agree after deleting every character of ``[\\x20\\x09-\\x0D]``; they are compared
by the SHA-256 of what is left. Misra-Gries counters in every task propose frequent digests. An
aggregate over all rows counts the proposals and finds their winners exactly, so a wrong proposal costs
time only. The verified winners (at most ``HEAVY`` rows) are broadcast and their copies are settled
where they are read; the other digests take an ordinary shuffle, in which none is frequent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lamina.durable import materialise
from lamina.llm.membership import key_filter
from lamina.llm.words import by_size, small_batches, texts_of

COUNTERS = 512  # Misra-Gries counters of a task: finds what holds over 1/512 of its rows
HEAVY = 4096  # proposals that are verified
BLANKS = b" \t\n\x0b\x0c\r"


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(id, chars, digest)``: code points of the original text, SHA-256 of the normalised one."""
    for batch in by_size(batches, "text"):
        chars, names = [], []
        for text in texts_of(batch, "text"):
            text = text or b""
            chars.append(len(text.decode()))
            names.append(hashlib.sha256(text.translate(None, BLANKS)).digest())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(chars, pa.int64()), pa.array(names, pa.binary())], ["id", "chars", "digest"])


def misra_gries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Proposals of one task with lower bounds of their counts."""
    counts: dict[bytes, int] = {}
    for batch in batches:
        for digest in batch.column("digest").to_pylist():
            if digest in counts:
                counts[digest] += 1
            elif len(counts) < COUNTERS:
                counts[digest] = 1
            else:
                counts = {k: v - 1 for k, v in counts.items() if v > 1}
    counts = {k: v for k, v in counts.items() if v > 1}
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["digest", "seen"])


def _winner() -> list[Column]:
    """Most code points, then smallest id (a null id last); the number of rows."""
    best = F.max(F.struct(F.col("chars"), F.col("id").isNotNull(), -F.col("id"))).alias("best")
    return [best, F.count(F.lit(1)).alias("group_size")]


def _settled(rows: DataFrame) -> DataFrame:
    best = F.col("best")
    wins = (F.col("chars") == best["chars"]) & F.col("id").eqNullSafe(-best["col3"])
    return rows.select("id", "digest", "chars", (-best["col3"]).alias("keep_id"), "group_size", wins.alias("kept"))


def settle(compact: DataFrame) -> DataFrame:
    """``compact`` (id, chars, digest) with ``keep_id``, ``group_size`` and ``kept``."""
    proposed = compact.mapInArrow(misra_gries, "digest binary, seen bigint").groupBy("digest").agg(F.sum("seen").alias("seen"))
    proposed = proposed.orderBy(F.desc("seen"), "digest").limit(HEAVY).select("digest")
    heavy = compact.join(F.broadcast(proposed), "digest").groupBy("digest").agg(*_winner())
    heavy = materialise(heavy)  # at most HEAVY rows, one for each proposal
    hot = compact.join(F.broadcast(heavy), "digest")
    cold = compact.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    return _settled(hot).unionByName(_settled(cold.join(cold.groupBy("digest").agg(*_winner()), "digest")))


def _compact(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return materialise(source.mapInArrow(digests, "id bigint, chars bigint, digest binary"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of equal texts, the row with the most code points, then the smallest id stays. Null counts as
    empty. A null id loses against any other. Rows that repeat id and length of the winner are all
    marked as kept; ``keep_distinct`` returns one of them. Other columns are not used.
    """
    rows = settle(_compact(docs, id_col, text_col))
    return rows.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Most rows are decided by their id where they are read: a filter of fixed size holds the ids of
    dropped rows, another the ids that stay although the first one holds them. Only rows that pass both
    are shuffled and decided by their text. Rows that repeat the winner's id and length leave one row.
    """
    compact = _compact(docs, id_col, text_col)
    twice = materialise(settle(compact).where("group_size > 1").select("id", "digest", "chars", "kept"))
    lost = twice.where("NOT kept").select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), F.col("chars").alias("_chars")).distinct()
    won = materialise(twice.where("kept").groupBy("digest", "id", "chars").agg(F.count(F.lit(1)).alias("repeats")))
    dropped = key_filter(lost.select(F.xxhash64("_id")).union(won.where("repeats > 1").select(F.xxhash64("id"))))
    is_lost = F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")) & (F.col("chars") == F.col("_chars"))
    stays = key_filter(compact.where(dropped(F.xxhash64("id"))).join(lost, is_lost, "left_anti").select(F.xxhash64("id")))
    name = F.xxhash64(F.col(id_col).cast("bigint"))
    alone, doubtful = docs.where(~dropped(name)), docs.where(dropped(name) & stays(name))

    blank = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "[\\x20\\x09-\\x0D]+", "")
    keyed = doubtful.select(
        F.struct(*docs.columns).alias("row"), F.unhex(F.sha2(blank, 256)).alias("digest"), F.col(id_col).cast("bigint").alias("own"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("bigint").alias("length"))
    held = keyed.join(won, "digest", "left").where("repeats IS NULL OR (own <=> id AND length = chars)")
    once = held.where("repeats IS NULL OR repeats = 1").select("row.*")
    again = held.where("repeats > 1").dropDuplicates(["digest"]).select("row.*")
    return alone.unionByName(once).unionByName(again)
