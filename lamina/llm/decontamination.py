"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, names and units are replaced by typed placeholders, other words are
lower-cased and freed of punctuation at their ends. Windows of a template are hashed. Documents are
tested against a filter of fixed size that holds every benchmark window; what passes is joined with the
benchmark windows by hash. Matches are gathered by document, item and the distance between
their places. On such an alignment each filler of the item must stand for one filler of the document
throughout. A document leaks an item when consistent windows of it make up at least ``SHARE`` of the
item's windows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lamina.durable import materialise
from lamina.llm.words import Remembered, by_size, runs, small_batches, texts_of

WINDOW = 8  # template words in a window; a shorter item is one window
LITERAL = 4  # a window needs as many words that aren't placeholders, a shorter one half its length
SHARE = 0.5  # of an item's windows that a document must hold
FILTER_BITS = 1 << 23

# Words that are read as units.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g gram grams kg kilogram kilograms lb lbs pound pounds oz ounce "
    "ounces ml l liter liters litre litres gal gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks "
    "month months year years km/h mph kmh hz khz mhz ghz b kb mb gb tb w kw kwh v volts watts % percent degrees celsius fahrenheit usd eur "
    "dollar dollars cent cents euro euros".split())
_NUMBER = re.compile(r"[-+$€£]?\d[\d.,:/]*(?:st|nd|rd|th)?")
_COMMON_ENDS = ".,;:!?\"'()[]{}<>|#$%&*-_=+~/\\"
_ENDS = re.compile(r"^[\W_]+|[\W_]+$")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
WORD, NUMBER, UNIT, NAME = range(4)  # kinds of template words


def _core(text: str) -> str:
    core = text.strip(_COMMON_ENDS)
    return core if core and core[0].isalnum() and core[-1].isalnum() else _ENDS.sub("", core)


def _marked(token: bytes) -> int:
    """Hash of the word; its low bits are the kind and marks of a capital, a sentence's end and no word."""
    text = token.decode()
    core = _core(text)
    low = core.lower()
    kind = NUMBER if _NUMBER.fullmatch(core) else UNIT if low in UNITS or text in UNITS else WORD
    capital = kind == WORD and len(core) > 1 and core[0].isupper() and core[1:] == low[1:]
    ends = text.rstrip("\"')]}»”’")[-1:] in (".", "!", "?", ":")
    marks = kind | capital << 2 | ends << 3 | (not core and kind == WORD) << 4
    return xxhash.xxh3_64_intdigest(low) & ~31 | int(marks)


def template(tokens: list[bytes], known: Remembered) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the template's words, their kinds, and the places of their tokens."""
    words = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    marks = (words & np.uint64(31)).astype(np.int64)
    ended = np.concatenate([[True], (marks[:-1] & 8) > 0]) if len(marks) else np.zeros(0, bool)
    kinds = np.where((marks & 4 > 0) & ~ended, NAME, marks & 3)
    kept = np.flatnonzero(marks & 16 == 0)
    words = np.where(kinds == WORD, words >> np.uint64(5), kinds.astype(np.uint64))
    return words[kept], kinds[kept], kept


def window_hashes(words: np.ndarray, kinds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the windows of one length that have enough literal words."""
    n = len(words) - size + 1
    if n <= 0 or size <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = np.full(n, size, np.uint64)
    for k in range(size):
        sums = (sums ^ (sums >> np.uint64(29))) * _MULTIPLIER + words[k:k + n]
    sums ^= sums >> np.uint64(32)
    literal = np.concatenate([[0], np.cumsum(kinds == WORD)])
    enough = np.flatnonzero(literal[size:] - literal[:n] >= min(LITERAL, (size + 1) // 2))
    return enough, sums[enough]


def _slots(tokens: list[bytes], kinds: np.ndarray, kept: np.ndarray, at: int, size: int) -> list[str]:
    return [f"{kinds[k]}{_core(tokens[kept[k]].decode()).lower()}" for k in range(at, at + size) if kinds[k] != WORD]


_SCHEMA = "id bigint, place bigint, size int, window bigint, slots array<string>"


def _windows(sizes: list[int], bits) -> Callable:
    """Rows of ``_SCHEMA`` and, for items (without ``bits``), the window of ``WINDOW`` or the whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered(_marked)
        held = bits.value if bits is not None else None
        for batch in by_size(batches, "text"):
            ids, rows = batch.column("id").to_pylist(), []
            for k, text in enumerate(texts_of(batch, "text")):
                tokens = text.split() if text else []
                words, kinds, kept = template(tokens, known)
                for size in sizes if held is not None else [min(WINDOW, len(words))]:
                    places, hashes = window_hashes(words, kinds, size)
                    if held is not None:
                        at = hashes % np.uint64(FILTER_BITS)
                        some = np.flatnonzero(held[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
                        places, hashes = places[some], hashes[some]
                    rows += [(ids[k], int(p), size, int(np.int64(h.view(np.int64))), _slots(tokens, kinds, kept, int(p), size)) for p, h in zip(places, hashes)]
            for part in runs([1] * len(rows), 50_000):
                columns = list(zip(*rows[part]))
                kinds_ = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds_)], ["id", "place", "size", "window", "slots"])

    return run


def _filter_of(windows: DataFrame) -> np.ndarray:
    """Bits of a filter of fixed size; as many rows reach the driver as the filter has words."""
    place = F.expr(f"window & {FILTER_BITS - 1}")
    words = windows.select(place.alias("p")).select(F.expr("p div 64").alias("word"), F.expr("shiftleft(1L, CAST(p & 63 AS INT))").alias("bit"))
    held = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # at most FILTER_BITS / 64 rows
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[held["word"].to_numpy(np.int64)] = held["bits"].to_numpy(np.int64)
    return bits.view(np.uint8)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", share: float = SHARE) -> DataFrame:
    """``(id, item, windows, held, consistent)`` for every document and item with a consistent match of enough windows.

    Rows with a null id are searched too, together as one id; so are rows that repeat an id. Null, empty
    or wordless texts and items match nothing, as do items whose every window is mostly placeholders.
    Items that share an id are taken together; items without an id are passed over.
    """
    spark = small_batches(docs.sparkSession)
    items = benchmark.select(F.col(item_col).cast("bigint").alias("id"), F.col(item_text_col).cast("string").alias("text"))
    items = materialise(items.where("id IS NOT NULL").mapInArrow(_windows([], None), _SCHEMA))
    sizes = sorted(r[0] for r in items.select("size").distinct().limit(WINDOW + 1).collect())
    bits = spark.sparkContext.broadcast(_filter_of(items))
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = materialise(source.mapInArrow(_windows(sizes, bits), _SCHEMA))
    totals = items.groupBy(F.col("id").alias("item")).agg(F.count_distinct("place").alias("windows"))
    theirs = items.select(F.col("id").alias("item"), F.col("place").alias("item_place"), "size", "window", F.col("slots").alias("item_slots"))
    met = found.join(theirs, ["window", "size"]).withColumn("shift", F.col("place") - F.col("item_place"))
    met = materialise(met.select("id", "item", "shift", "item_place", F.arrays_zip("item_slots", "slots").alias("pairs")))
    spot = ["id", "item", "shift"]
    # a filler of the item that stands for several fillers along an alignment spoils its windows
    filled = met.select(*spot, F.explode("pairs").alias("pair")).select(*spot, F.col("pair.item_slots").alias("from"), F.col("pair.slots").alias("to"))
    torn = filled.groupBy(*spot, "from").agg(F.min("to").alias("one"), F.max("to").alias("two")).where("one <> two")
    torn = torn.groupBy(*spot).agg(F.collect_set("from").alias("torn"))
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"t.{c}")) for c in spot]
    sound = met.alias("m").join(torn.alias("t"), same[0] & same[1] & same[2], "left")
    clean = F.coalesce(~F.exists("m.pairs", lambda p: F.array_contains(F.col("t.torn"), p["item_slots"])), F.lit(True))
    sound = sound.select("m.*", clean.alias("clean"))
    held = sound.groupBy("id", "item").agg(F.count_distinct("item_place").alias("held"), F.count_distinct(F.when(F.col("clean"), F.col("item_place"))).alias("consistent"))
    held = held.join(totals, "item")
    return held.where(F.col("consistent") >= share * F.col("windows")).select(F.col("id").alias(id_col), F.col("item").alias(item_col), "windows", "held", "consistent")


def mark_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", share: float = SHARE) -> DataFrame:
    """``docs`` with ``leaked_items`` (how many items it leaks), ``first_item`` and ``contaminated``; replaced if present."""
    mine = ("leaked_items", "first_item", "contaminated")
    kept = [c for c in docs.columns if c not in mine]
    leaks = find_leaks(docs, benchmark, id_col, text_col, item_col, item_text_col, share)
    per = materialise(leaks.groupBy(F.col(id_col).alias("_leaking")).agg(F.count(F.lit(1)).alias(mine[0]), F.min(item_col).alias(mine[1])))
    marked = docs.select(*kept).join(per, F.col(id_col).cast("bigint").eqNullSafe(F.col("_leaking")), "left")
    count = F.coalesce(mine[0], F.lit(0))
    return marked.select(*kept, count.alias(mine[0]), mine[1], (count > 0).alias(mine[2]))
