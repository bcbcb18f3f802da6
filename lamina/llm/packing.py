"""Hierarchical best-fit packing of token pieces into sequences of fixed capacity.

Tasks tokenise whole texts, cut what is longer than a sequence and describe each piece by one row; the
tokens themselves are not moved. Pieces are dealt out at random, so every task holds the same mix of
lengths, and packed by best fit, longest first. Nearly full bins are final. Underfull bins travel on as
items of their own: a round joins the bins of ``FAN_IN`` tasks and packs them again, until one task is
left. Of two bins that are at most half full best fit makes one, so a task has at most one such bin,
and a bin over half can only take one of those: with ``CARRIED`` bins a task, those with most room,
further rounds lose nothing that they could have joined but where bins have more room than all items
of their task need, and no task ever holds more than ``FAN_IN * CARRIED`` bins.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import lru_cache
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lamina.durable import materialise
from lamina.llm.words import REMEMBERED, by_size, small_batches, within

CAPACITY, END = 4096, 1
NEARLY_FULL = 16  # a bin with less room is final
ITEMS = 100_000  # pieces in a task of the first round
FAN_IN, CARRIED = 8, 20_000
SLICE = 2_000_000  # bytes of text that a task splits into words at once
_ENDS = punctuation
_PLAIN = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[!-/:-@\[-`{-~]*)$"  # letters that stay one each when lower-cased, punctuation
_BIN_BITS = 32


@lru_cache(maxsize=1)
def _tokenizers(path: str) -> tuple:
    """The tokenizer of a file, and one that only does its byte-pair step on lower-case words with blanks between."""
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    whole = Tokenizer.from_file(path)
    bare = Tokenizer(models.BPE(model["vocab"], list(map(tuple, model["merges"])), cache_capacity=0, end_of_word_suffix=model["end_of_word_suffix"]))
    bare.normalizer = normalizers.Sequence([])
    bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return whole, bare


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, with a memory of words.

    For a byte-pair tokenizer that lower-cases and splits at white space and between letters and punctuation before
    anything else, so that parts between blanks can be encoded on their own, and words apart from the punctuation after
    them. Texts are split and words looked up as Arrow columns; a slice of texts looks at each different part once. What it
    has of new words goes through the tokenizer as one text; the ends of the words show in tokens that only end a word.
    Words of Latin letters that lower-casing and composing can't split or join skip both steps. Words are
    remembered for two generations: a full memory grows old, and what is used again gets young.
    """

    def __init__(self, path: str, bound: int = REMEMBERED // 3):
        self.bound = bound
        self.tokenizer, self.bare = _tokenizers(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[k for word, k in vocabulary.items() if word.endswith("</w>")]] = True
        self.words: tuple[dict, dict] = ({}, {})  # young and old, by word of letters

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode_words(self, words: list[str], tokenizer) -> list[bytes]:
        """Ids of each word of letters."""
        ids = np.array(tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        at = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(at) != len(words) or at[-1] != 4 * len(ids):  # a word that is several, or no such ends
            return list(map(self._encode, words))
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *at[:-1].tolist()], at.tolist())]

    def _recall(self, wanted: set[str]) -> list[str]:
        """Makes the remembered ones of the wanted words young; returns the others."""
        young, old = self.words if len(self.words[0]) < self.bound else ({}, self.words[0])
        unknown = []
        for word in wanted - young.keys():
            if word in old:
                young[word] = old[word]
            else:
                unknown.append(word)
        self.words = young, old
        return unknown

    def _parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids one after the other; where those of each part begin, and their number."""
        plain = pc.extract_regex(parts, _PLAIN)
        is_plain = plain.is_valid().to_numpy(zero_copy_only=False)
        plain = plain.drop_null()
        latin = pc.utf8_lower(plain.field("word")).dictionary_encode()
        tailed = plain.field("tail").dictionary_encode()
        tails = tailed.dictionary.to_pylist()
        tail_of = {tail: k for k, tail in enumerate(tails)}
        words = latin.dictionary.to_numpy(zero_copy_only=False).tolist()  # faster than to_pylist
        entry, tail = np.empty(len(parts), np.int64), np.full(len(parts), -1)
        entry[is_plain], tail[is_plain] = latin.indices.to_numpy(), tailed.indices.to_numpy()

        others, odd = {}, []  # words of other letters, and what is no word
        for at in np.flatnonzero(~is_plain).tolist():
            text = parts[at].as_py()
            core = text.rstrip(_ENDS)
            if core.isalpha() and core.lower().isalpha():
                entry[at] = len(words) + others.setdefault(core, len(others))
                tail[at] = tail_of.setdefault(text[len(core):], len(tail_of))
            else:
                odd.append((at, text))
        new = self._recall({*words, *others})
        memory = self.words[0]
        for tokenizer, own in ((self.bare, [w for w in new if w not in others]), (self.tokenizer, [w for w in new if w in others])):
            for at in range(0, len(own), 4096):
                memory.update(zip(own[at:at + 4096], self._encode_words(own[at:at + 4096], tokenizer)))
        known = [*map(memory.__getitem__, words), *map(memory.__getitem__, others)]
        for at, text in odd:
            entry[at] = len(known)
            known.append(self._encode(text) if text else b"")
        tail = np.where(tail < 0, len(tail_of), tail) + len(known)
        known += [self._encode(text) if text else b"" for text in tail_of] + [b""]

        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts = np.cumsum(sizes) - sizes
        both = np.column_stack([entry, tail])
        ids = np.frombuffer(b"".join(known), "<u4")[within(starts[both].ravel(), sizes[both].ravel())]
        counts = sizes[both].sum(1)
        return ids, np.cumsum(counts) - counts, counts

    def __call__(self, texts: pa.Array) -> list[bytes]:
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts.cast(pa.string()), ""), "\n", " "), " ")
        parts = split.flatten().dictionary_encode()
        ids, starts, counts = self._parts(parts.dictionary)
        places = parts.indices.to_numpy()
        data = ids[within(starts[places], counts[places])].tobytes()
        ends = np.concatenate([[0], np.cumsum(counts[places])])[np.cumsum(pc.list_value_length(split).to_numpy())] * 4
        return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def _pieces(path: str, capacity: int, end: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = Encoder(path), np.array([end], "<u4").tobytes()
        for batch in by_size(batches, "text", SLICE):
            rows: dict[str, list] = {"row": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            for k, ids in enumerate(encode(batch.column("text"))):
                ids += last
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    for name, value in zip(rows, (k, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                        rows[name].append(value)
            kinds = {"piece": pa.int32()}
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows["row"], pa.int64()))] + [pa.array(rows[n], kinds.get(n, pa.int64())) for n in list(rows)[1:]], ["id", *list(rows)[1:]])

    return run


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the fill of each bin; longest first, into the fullest bin with room."""
    bins, offsets, fills = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # rooms that some bin has, ascending
    for k in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[k])
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
        else:
            chosen, room = len(fills), capacity
            fills.append(0)
        bins[k], offsets[k] = chosen, fills[chosen]
        fills[chosen] += size
        room -= size
        if room:
            if not by_room[room]:
                insort(rooms, room)
            by_room[room].append(chosen)
    return bins, offsets, np.array(fills, np.int64)


def _pack(capacity: int, level: int, final: bool) -> Callable:
    """Adds ``bin<level>``, ``offset<level>``, ``fill`` and ``done`` to the items of one task."""
    def run(table: pa.Table) -> pa.Table:
        task = table.column("task")[0].as_py()
        bins, offsets, fills = best_fit(table.column("length").to_numpy(), capacity)
        done = fills > capacity - NEARLY_FULL
        if not final:
            done[np.argsort(fills, kind="stable")[CARRIED:]] = True
        else:
            done[:] = True
        names = (level << 58) | (task << _BIN_BITS) | bins
        for name, values in ((f"bin{level}", names), (f"offset{level}", offsets), ("fill", fills[bins]), ("done", done[bins])):
            table = table.append_column(name, pa.array(values))
        return table.drop_columns(["task", "length"] if level else ["task"])

    return run


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    ``tokenizer`` is a path that every task can read. Every row of ``docs`` gives its text's ids
    (none for a null or empty text) and ``end``; only texts of more than ``capacity`` ids are cut. Repeated
    rows and ids, and null ids, are packed like any other row. Other columns are not used.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces = materialise(source.mapInArrow(_pieces(tokenizer, capacity, end), "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"))
    whole = pieces.where(F.col("length") == capacity)
    rest = pieces.where(F.col("length") < capacity)
    tasks = max(1, -(-rest.count() // ITEMS))
    columns = ["id", "piece", "start", "length", "ids_crc32"]

    def schema(df: DataFrame, level: int) -> str:
        own = [f"{n} {t}" for n, t in df.dtypes if n != "task" and not (level and n == "length")]
        return ", ".join([*own, f"bin{level} bigint", f"offset{level} bigint", "fill bigint", "done boolean"])

    dealt = rest.withColumn("task", F.pmod(F.xxhash64(*columns), F.lit(tasks)))
    level = 0
    packed = materialise(dealt.groupBy("task").applyInArrow(_pack(capacity, 0, tasks == 1), schema(dealt, 0)))
    levels = [packed]
    while tasks > 1:
        name = f"bin{level}"
        under = levels[-1].where("NOT done").select(name, F.col("fill").alias("length")).distinct()
        task = F.shiftright(name, _BIN_BITS).bitwiseAND(F.lit((1 << 26) - 1))
        tasks, level = -(-tasks // FAN_IN), level + 1
        under = under.withColumn("task", F.floor(task / FAN_IN).cast("bigint"))
        levels.append(materialise(under.groupBy("task").applyInArrow(_pack(capacity, level, tasks == 1), schema(under, level))))
    placed = packed.select(*columns, F.col("bin0").alias("sequence"), F.col("offset0").alias("offset"))
    for k, later in enumerate(levels[1:], 1):
        moved = later.select(F.col(f"bin{k - 1}").alias("sequence"), F.col(f"bin{k}").alias("into"), F.col(f"offset{k}").alias("by"))
        placed = placed.join(moved, "sequence", "left").select(*columns, F.coalesce("into", "sequence").alias("sequence"), (F.col("offset") + F.coalesce("by", F.lit(0))).alias("offset"))
    # full pieces are sequences of their own, numbered below zero
    alone = whole.select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence"), F.lit(0).cast("bigint").alias("offset"))
    named = {"id": id_col, "sequence": "sequence_id"}
    return placed.unionByName(alone).withColumnsRenamed(named).select(id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
