"""Words and their 64-bit hashes inside Arrow tasks.

A word is a maximal run of characters outside ``[\\x20\\x09-\\x0D]`` after lower-casing A-Z. Both steps
work on UTF-8 bytes, where ``bytes.lower`` and ``bytes.split`` mean exactly that.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import SparkSession

REMEMBERED = 300_000  # words whose value a task remembers; only saves time
PIECE = 4_000_000  # bytes of text that a task holds as Python objects at once, or one text
BATCH = 8 << 20  # bytes of an Arrow batch, or one row
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


class Remembered(dict):
    """A mapping filled by ``compute`` and emptied when it grows beyond its bound."""

    def __init__(self, compute: Callable, bound: int = REMEMBERED):
        super().__init__()
        self.compute, self.bound = compute, bound

    def __missing__(self, key):
        if len(self) >= self.bound:
            self.clear()
        value = self[key] = self.compute(key)
        return value


def hash_words() -> Remembered:
    return Remembered(xxhash.xxh3_64_intdigest)


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def distinct_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of all texts, the place there of each text's words (one text after the other), and the words of each text.

    Gives the words of ``words_of``, split as an Arrow column; of words that differ in case only, each is listed.
    """
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    parts = split.flatten().dictionary_encode()
    words, places = pc.ascii_lower(parts.dictionary), parts.indices.to_numpy()
    ends = np.cumsum(pc.list_value_length(split).to_numpy())
    empty = pc.index(words, "").as_py()  # between a blank and an end of the text
    if empty >= 0:
        there = places != empty
        ends = np.concatenate([[0], np.cumsum(there)])[ends]
        places = places[there]
        places, words = places - (places > empty), pa.concat_arrays([words.slice(0, empty), words.slice(empty + 1)])
    return words, places, np.diff(ends, prepend=0)


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """UTF-8 bytes of a text column; null stays ``None``."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def small_batches(spark: SparkSession) -> SparkSession:
    """Bounds the session's Arrow batches to ``BATCH`` bytes; another bound than Spark's default stays.

    The default of 64 MB is held several times for each task: in the executor's direct memory while a batch is filled and
    sent, and by the worker that reads it.
    """
    if spark.conf.get(_BATCH_SETTING, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_SETTING, str(BATCH))
    return spark


def give_back() -> None:
    """Return freed memory to the system: a worker lives on after its task and would hold its peak beside later ones."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def by_size(batches: Iterator[pa.RecordBatch], name: str, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes of the column ``name``; one row is never cut.

    After each batch, freed memory goes back to the system.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False) + 1
        for part in runs(sizes.tolist(), most):
            yield batch.slice(part.start, part.stop - part.start)
        give_back()


def hashed(words: list[bytes], known: Remembered) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def runs(sizes: list[int] | np.ndarray, most: int) -> Iterator[slice]:
    """Slices of consecutive rows with about ``most`` units together."""
    start = total = 0
    for k, size in enumerate(sizes):
        if total and total + size > most:
            yield slice(start, k)
            start, total = k, 0
        total += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def within(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges ``starts[k] .. starts[k] + counts[k]``."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)
