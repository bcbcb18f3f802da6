"""N-gram Jaccard join: blocked sparse matrix product of document by n-gram incidence.

Documents with equal shingle sets form one class and are joined once. For a link, two sets of sizes
na and nb must overlap in at least t / (100 + t) * (na + nb) shingles. In any common order of the
shingles, linked sets therefore meet within their first n - ceil(t * n / 100) + 1 shingles, and the
number of meetings there cannot fall below what the rest of the larger set leaves open. The join:

1. One pass hashes every whole text and writes ids, classes and sets.
2. Shingles that many documents of a batch share come last in the order (a list of bounded length;
   any order gives the same result, this one keeps common passages out of most prefixes). The list
   gets too short as tables grow, so shingles that lead more than ``GROUP`` prefixes come before
   it, behind all others: a filter of fixed size holds them, found by counting once or twice.
3. The prefixes are dealt out as blocks of columns. Each block multiplies its columns: groups of up to
   ``GROUP`` documents give pairs, whose counts are added up and held against the bound. Larger groups
   give memberships, one per document.
4. Pairs and memberships connect documents into panels; no link leaves a panel. Panels are cut into
   blocks of documents, and each pair of blocks is one product of full incidence rows: exact overlaps,
   of which those below the size-derived bound are discarded.
5. Block products return counts and a spanning forest of their links, not the links themselves.

A group of near copies is never paired up row by row: it costs one small matrix product for each
pair of blocks. This remains quadratic in the blocks of a panel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lamina.durable import materialise
from lamina.llm.components import connected_components, smallest_labels
from lamina.llm.words import REMEMBERED, by_size, give_back, hash_words, hashed, runs, small_batches, texts_of, within, words_of

GROUP = 16  # larger column groups go to panels instead of pairs
COMMON, COMMON_LEAST = 1 << 17, 4  # length of the list of common shingles, and least count to be on it
SHARED = 2  # documents of a batch that must have a shingle for the batch to report it
COLUMN_BLOCK = 500_000  # prefix entries in a block of columns
RUN, SHARED_RUN = 400_000, 4_000_000  # shingles that a task spreads out or sorts at once, some 40 MB of arrays; a set is never cut
CELLS = 1_000_000  # pairs of rows that a product of blocks adds up at once, some 60 MB of arrays
ROW_BLOCK, ROW_BLOCK_SHINGLES = 1024, 1_000_000  # documents and shingles in a block of rows
FILTER_BITS = 1 << 24  # fixed size of the filter for documents that are in any panel
CROWDED_BITS, CROWDED_ROUNDS = 1 << 27, 2  # fixed size of the filter for crowded shingles, and counts that fill it at most
_STEP = 200_000  # words handled together

_BYTES = 6  # of a shingle's hash; two sets of a thousand meet by chance once in 10^8 pairs
_MASK = np.uint64((1 << 8 * _BYTES) - 1)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _packed(shingles: np.ndarray) -> bytes:
    return shingles.view(np.uint8).reshape(-1, 8)[:, :_BYTES].tobytes()


def _unpacked(parts: list[bytes]) -> np.ndarray:
    out = np.zeros(sum(map(len, parts)) // _BYTES, np.uint64)
    wide, at = out.view(np.uint8).reshape(-1, 8), 0
    for part in parts:
        own = np.frombuffer(part, np.uint8).reshape(-1, _BYTES)
        wide[at:at + len(own), :_BYTES] = own
        at += len(own)
    return out


SPARSE = 43  # smallest set whose first bytes take less room as a list of bits


def _stored(shingles: np.ndarray) -> bytes:
    """A sorted set: the low bytes of each hash, and its highest byte, which never falls, as a one behind so many zeros."""
    n = len(shingles)
    if n < SPARSE:
        return _packed(shingles)
    steps = np.zeros(n + 256, np.uint8)
    steps[(shingles >> np.uint64(40)).astype(np.int64) + np.arange(n)] = 1
    return shingles.view(np.uint8).reshape(-1, 8)[:, :_BYTES - 1].tobytes() + np.packbits(steps).tobytes()


def _restored(parts: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """Concatenated hashes of stored sets of the given sizes."""
    out = np.zeros(int(sizes.sum()), np.uint64)
    wide, at = out.view(np.uint8).reshape(-1, 8), 0
    for part, n in zip(parts, sizes.tolist()):
        own, low = np.frombuffer(part, np.uint8), _BYTES - (n >= SPARSE)
        wide[at:at + n, :low] = own[:n * low].reshape(-1, low)
        if n >= SPARSE:
            wide[at:at + n, low] = np.flatnonzero(np.unpackbits(own[n * low:])) - np.arange(n)
        at += n
    return out


def _narrow(sizes: np.ndarray) -> bytes:
    """Sizes of a block's entries, in two bytes each when all fit."""
    return sizes.astype(np.uint16 if sizes.max(initial=0) < 1 << 16 else np.int32).tobytes()


def _wide(data: bytes, entries: int) -> np.ndarray:
    return np.frombuffer(data, np.uint16 if len(data) == 2 * entries else np.int32).astype(np.int32)


def shingle_sets(texts: list[bytes | None], size: int, known) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text; a shorter text is one shingle."""
    def flush(parts: list[np.ndarray]) -> Iterator[np.ndarray]:
        words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        sums = np.zeros(max(0, len(words) - size + 1), np.uint64)
        for k in range(size):
            sums = sums * _MULTIPLIER + words[k:k + len(sums)]
        sums, start = _mix(sums) & _MASK, 0
        for part in parts:
            n = len(part)
            if n >= size:
                own = np.sort(sums[start:start + n - size + 1])
                yield own[np.concatenate([[True], own[1:] != own[:-1]])]
            elif n:
                yield np.array([xxhash.xxh3_64_intdigest(part.tobytes(), seed=n)], np.uint64) & _MASK
            else:
                yield part
            start += n

    parts, total = [], 0
    for text in texts:
        parts.append(hashed(words_of(text), known))
        total += len(parts[-1])
        if total >= _STEP:
            yield from flush(parts)
            parts, total = [], 0
    yield from flush(parts)


def _sets(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, emitted = hash_words(), set()
        for piece in by_size(batches, "text"):
            counts, classes, sets = [], [], []
            for own in shingle_sets(texts_of(piece, "text"), size, known):
                data = _packed(own)
                name = xxhash.xxh3_64_intdigest(data, seed=len(own)) - (1 << 63)
                counts.append(len(own))
                classes.append(name)
                sets.append(None if not len(own) or name in emitted else _stored(own))
                if len(emitted) >= REMEMBERED:  # a set that is written again does no harm
                    emitted.clear()
                emitted.add(name)
            yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("key"), pa.array(counts, pa.int64()), pa.array(classes, pa.int64()), pa.array(sets, pa.binary())], ["id", "key", "n", "class", "shingles"])

    return run


def _rows(batch: pa.RecordBatch, most: int = RUN) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Classes, set sizes and concatenated shingles, some rows at a time."""
    sizes = batch.column("n").to_numpy()
    for part in runs(sizes, most):
        piece = batch.slice(part.start, part.stop - part.start)
        n = piece.column("n").to_numpy()
        yield piece.column("class").to_numpy(), n, _restored(piece.column("shingles").to_pylist(), n)


def _shared_within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def shared(parts: list[np.ndarray]) -> pa.RecordBatch:
        shingles = np.concatenate(parts)
        parts.clear()
        shingles.sort()  # in place
        values, counts = np.unique(shingles[1:][shingles[1:] == shingles[:-1]], return_counts=True)  # each once less than it is there
        many = counts >= SHARED - 1
        return pa.RecordBatch.from_arrays([pa.array(values[many].view(np.int64)), pa.array(counts[many] + 1)], ["shingle", "count"])

    parts, total = [], 0  # of several batches
    for batch in batches:
        for _, _, shingles in _rows(batch):
            parts.append(shingles)
            total += len(shingles)
            if total >= SHARED_RUN:
                yield shared(parts)
                total = 0
    if parts:
        yield shared(parts)


def prefix_lengths(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-percent * n // 100) + 1


def _crowd_place(shingles: np.ndarray) -> np.ndarray:
    """Four bytes of each hash, of which the lowest ``CROWDED_BITS`` name its place in the filter."""
    return (shingles >> np.uint64(16)).astype(np.uint32)


def _leading(common, crowded: np.ndarray, n: np.ndarray, shingles: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The row of each shingle, the shingles that are among the first ``length`` of their row, and which of all are listed and crowded."""
    listed, rank = common  # sorted shingles, and the place of each in the order
    row = np.repeat(np.arange(len(n)), n)
    at = np.minimum(np.searchsorted(listed, shingles), max(0, len(listed) - 1))
    is_common = listed[at] == shingles if len(listed) else np.zeros(len(shingles), bool)
    place = _crowd_place(shingles) & np.uint32(CROWDED_BITS - 1)
    is_crowded = ~is_common & (crowded[place >> np.uint32(3)] >> (place & np.uint32(7)).astype(np.uint8) & 1).astype(bool)
    is_late = is_common | is_crowded
    own = np.cumsum(~is_late)
    ahead = np.concatenate([[0], np.cumsum(np.bincount(row, ~is_late, len(n)))[:-1]]).astype(np.int64)
    kept = np.flatnonzero(~is_late & (own - 1 - ahead[row] < length[row]))
    late = np.flatnonzero(is_late)
    later = np.where(is_common[late], rank[at[late]], 0) if len(listed) else np.zeros(len(late), np.int64)
    late = late[np.lexsort((later, row[late]))]
    free = np.maximum(0, length - np.bincount(row, ~is_late, len(n)).astype(np.int64))
    first = np.searchsorted(row[late], np.arange(len(n)))
    late = late[np.arange(len(late)) - first[row[late]] < free[row[late]]]
    return row, np.concatenate([kept, late]), is_common, is_crowded


def _places(common, crowded, blocks: int, percent: int) -> Callable:
    """The places of prefix entries that are neither listed nor crowded, in blocks of columns.

    A quarter more than the prefix counts: so much may come forward when crowded ones go back.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, n, shingles in _rows(batch):
                length = prefix_lengths(n, percent)
                _, entry, is_common, is_crowded = _leading(common.value, crowded.value, n, shingles, length + length // 4)
                own = shingles[entry[~(is_common | is_crowded)[entry]]]
                block = (own % np.uint64(blocks)).astype(np.int64)
                order = np.argsort(block, kind="stable")
                block, place = block[order], _crowd_place(own)[order]
                cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
                parts = [place[s:e].tobytes() for s, e in zip(cuts, [*cuts[1:], len(block)])]
                yield pa.RecordBatch.from_arrays([pa.array(block[cuts]), pa.array(parts, pa.binary())], ["block", "places"])

    return run


def _crowds(group: int) -> Callable:
    """The places that more than ``group`` entries of a block have."""
    def run(table: pa.Table) -> pa.Table:
        give_back()
        places = np.frombuffer(b"".join(table.column("places").to_pylist()), np.uint32).copy()
        places.sort()
        start = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]])) if len(places) else np.zeros(0, np.int64)
        many = np.diff(np.concatenate([start, [len(places)]]))
        return pa.table({"class": places[start[many > group]].astype(np.int64)})

    return run


def _prefixes(common, crowded, blocks: int, percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for classes, n, shingles in _rows(batch):
                row, entry, is_common, _ = _leading(common.value, crowded.value, n, shingles, prefix_lengths(n, percent))
                hot = is_common[entry]
                block = np.where(hot, _mix(classes[row[entry]].view(np.uint64)), shingles[entry]) % np.uint64(blocks)
                block = block.astype(np.int64)
                order = np.argsort(block, kind="stable")
                block, entry, hot = block[order], entry[order], hot[order]
                cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
                ends = np.concatenate([cuts[1:], [len(block)]])
                columns = {"block": [], "shingles": [], "classes": [], "sizes": [], "hot": []}
                for s, e in zip(cuts, ends):
                    own = entry[s:e]
                    columns["block"].append(int(block[s]))
                    columns["shingles"].append(_packed(shingles[own]))
                    columns["classes"].append(classes[row[own]].tobytes())
                    columns["sizes"].append(_narrow(n[row[own]]))
                    columns["hot"].append(np.packbits(hot[s:e]).tobytes())
                if len(cuts):
                    yield pa.RecordBatch.from_arrays([pa.array(columns["block"], pa.int64()), *[pa.array(columns[k], pa.binary()) for k in list(columns)[1:]]], list(columns))

    return run


def _column_product(percent: int, group: int) -> Callable:
    """Rows ``(a, b, na, nb)``: pairs of classes that meet once more; membership has ``nb`` null and the shingle as ``b``."""
    def run(table: pa.Table) -> pa.Table:
        give_back()
        join = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        shingles, classes = _unpacked(table.column("shingles").to_pylist()), join("classes", np.int64)
        sizes = np.concatenate([_wide(s, len(c) // 8) for s, c in zip(table.column("sizes").to_pylist(), table.column("classes").to_pylist())])
        hot = np.concatenate([np.unpackbits(np.frombuffer(h, np.uint8), count=len(c) // 8) for h, c in zip(table.column("hot").to_pylist(), table.column("classes").to_pylist())]).astype(bool)
        named = np.flatnonzero(hot)
        rest = np.flatnonzero(~hot)
        rest = rest[np.lexsort((classes[rest], shingles[rest]))]
        if len(rest):  # the same class from two tasks counts once
            rest = rest[np.concatenate([[True], (shingles[rest][1:] != shingles[rest][:-1]) | (classes[rest][1:] != classes[rest][:-1])])]
        s = shingles[rest]
        start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
        many = np.diff(np.concatenate([start, [len(s)]]))
        named = np.concatenate([named, rest[within(start[many > group], many[many > group])]])
        left, right = [], []
        for size in range(2, group + 1):  # all groups of one size at once
            at = start[many == size]
            if len(at):
                i, j = np.triu_indices(size, 1)
                left.append((at[:, None] + i).ravel())
                right.append((at[:, None] + j).ravel())
        a, b = (rest[np.concatenate(x)] if x else np.zeros(0, np.int64) for x in (left, right))
        fits = 100 * np.minimum(sizes[a], sizes[b]).astype(np.int64) >= percent * np.maximum(sizes[a], sizes[b]).astype(np.int64)
        a, b = a[fits], b[fits]
        return pa.table({
            "a": np.concatenate([classes[a], classes[named]]),
            "b": np.concatenate([classes[b], shingles[named].view(np.int64)]),
            "na": pa.array(np.concatenate([sizes[a], sizes[named]])),
            "nb": pa.array(np.concatenate([sizes[b], np.zeros(len(named), np.int32)]), mask=np.arange(len(a) + len(named)) >= len(a)),
        })

    return run


def overlaps(rows: tuple[np.ndarray, np.ndarray], columns: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Matrix of overlap counts of two blocks of incidence rows, each as sizes and concatenated shingles."""
    (na, sa), (nb, sb) = rows, columns
    found = np.zeros((len(na), len(nb)), np.float32)
    ra, rb = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
    oa, ob = np.argsort(sa, kind="stable"), np.argsort(sb, kind="stable")
    sa, ra, sb, rb = sa[oa], ra[oa], sb[ob], rb[ob]
    values, first, count = np.unique(sa, return_index=True, return_counts=True)
    at, to = np.searchsorted(sb, values, "left"), np.searchsorted(sb, values, "right")
    dense = (count > 32) & (to - at > 32)
    light = np.flatnonzero((to > at) & ~dense)
    cells = count[light] * (to - at)[light]
    for part in runs(cells, CELLS):  # few rows in a column: add up its pairs
        own, many = light[part], cells[part]
        inner = within(np.zeros(len(own), np.int64), many)
        width = np.repeat((to - at)[own], many)
        i, j = ra[np.repeat(first[own], many) + inner // width], rb[np.repeat(at[own], many) + inner % width]
        found += np.bincount(i * len(nb) + j, minlength=found.size).reshape(found.shape)
    heavy = np.flatnonzero(dense)
    for k in range(0, len(heavy), 2048):  # many rows: a dense product of some columns
        own = heavy[k:k + 2048]
        left, right = np.zeros((len(na), len(own)), np.float32), np.zeros((len(own), len(nb)), np.float32)
        left[ra[within(first[own], count[own])], np.repeat(np.arange(len(own)), count[own])] = 1
        right[np.repeat(np.arange(len(own)), (to - at)[own]), rb[within(at[own], (to - at)[own])]] = 1
        found += left @ right
    return found


def _row_product(percent: int) -> Callable:
    """Rows ``(class, partner, links)``: forest edges have a partner, counts have links."""
    def run(table: pa.Table) -> pa.Table:
        give_back()
        side = table.column("side").to_numpy()
        blocks = []
        for k in (0, 1):
            own = table.filter(pa.array(side == k))
            order = np.argsort(own.column("class").to_numpy(), kind="stable")
            names = own.column("class").to_numpy()[order]
            order = order[np.concatenate([[True], names[1:] != names[:-1]])] if len(order) else order
            own = own.take(pa.array(order))
            sizes = own.column("n").to_numpy()
            blocks.append((own.column("class").to_numpy(), own.column("copies").to_numpy(), sizes, _restored(own.column("shingles").to_pylist(), sizes)))
        (ca, wa, na, sa), (cb, wb, nb, sb) = blocks
        diagonal = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        if diagonal:
            cb, wb, nb, sb = ca, wa, na, sa
        common = overlaps((na, sa), (nb, sb)).astype(np.int64)
        linked = 100 * common >= percent * (na[:, None] + nb[None, :] - common)
        if diagonal:
            np.fill_diagonal(linked, False)
        i, j = np.nonzero(linked)
        names = ca if diagonal else np.concatenate([ca, cb])
        links = linked @ wb if diagonal else np.concatenate([linked @ wb, linked.T @ wa])
        label = smallest_labels(i, j if diagonal else j + len(ca), len(names))
        tree = np.flatnonzero(label != np.arange(len(names)))
        some = np.flatnonzero(links > 0)
        return pa.table({
            "class": np.concatenate([names[tree], names[some]]),
            "partner": pa.array(np.concatenate([names[label[tree]], np.zeros(len(some), np.int64)]), mask=np.arange(len(tree) + len(some)) >= len(tree)),
            "links": np.concatenate([np.zeros(len(tree), np.int64), links[some].astype(np.int64)]),
        })

    return run


def _in_filter(bits) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(bits.value, bitorder="little").view(bool)
        for batch in batches:
            yield batch.filter(pa.array(held[batch.column("class").to_numpy() & (FILTER_BITS - 1)]))

    return run


def _filter_of(classes: DataFrame, size: int = 0) -> np.ndarray:
    """A filter of fixed size (``FILTER_BITS`` unless given) that holds every given class."""
    size = size or FILTER_BITS
    parts = classes.groupBy(F.expr(f"bitmap_bucket_number(class & {size - 1})").alias("part")).agg(F.expr(f"bitmap_construct_agg(bitmap_bit_position(class & {size - 1}))").alias("bits"))
    bits = np.zeros(size // 8 + 4096, np.uint8)
    for part, own in parts.collect():  # at most size / 32768 + 1 rows of 4 KB
        # bucket k holds the values (k - 1) * 32768 + 1 .. k * 32768 at bits 0 .. 32767; bucket 0 holds 0
        first = 0 if part == 0 else (part - 1) * 32768 + 1
        values = np.flatnonzero(np.unpackbits(np.frombuffer(own, np.uint8), bitorder="little")) + first
        np.bitwise_or.at(bits, values >> 3, (1 << (values & 7)).astype(np.uint8))
    return bits[:size // 8]


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id``, ``n_links``.

    Two documents link when 100 * intersection >= percent * union of their sets of word shingles.
    ``component_id`` is the smallest id reachable by links; ``n_links`` counts the linked documents.
    A text with fewer words than ``size`` is one shingle; null, empty or blank texts have none and link
    with nothing. Repeated rows and ids count as documents of their own. A null id is passed over
    when the smallest is taken, and a component without any id has a null one. Texts of any length are read
    whole; an empty table gives no rows. Other columns of ``docs`` are not used. ``percent`` lies in 1..100.
    """
    return join_rows(docs, id_col, text_col, size, percent).drop("row_key", "component_key")


def join_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """``ngram_jaccard_join`` with ``row_key`` and ``component_key``.

    ``row_key`` is ``xxhash64(id, text)``, which tells rows of one id apart; ``component_key`` names the component
    whatever its ids are, null without shingles.
    """
    spark = small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    source = source.withColumn("key", F.xxhash64("id", "text"))
    rows = materialise(source.mapInArrow(_sets(size), "id bigint, key bigint, n bigint, class bigint, shingles binary"))
    sets = rows.where("shingles IS NOT NULL").select("class", "n", "shingles")
    classes = materialise(rows.where("n > 0").groupBy("class").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"), F.min("n").alias("n")))

    often = sets.mapInArrow(_shared_within, "shingle bigint, count bigint").groupBy("shingle").agg(F.sum("count").alias("count"))
    often = often.where(F.col("count") >= COMMON_LEAST).orderBy(F.desc("count"), "shingle").limit(COMMON).toPandas()  # of bounded length
    values = often["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(values)
    common = spark.sparkContext.broadcast((values[order], (len(values) - np.arange(len(values)))[order]))
    total = rows.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total * (101 - percent) // (100 * COLUMN_BLOCK)))

    bits = np.zeros(CROWDED_BITS // 8, np.uint8)
    crowded = spark.sparkContext.broadcast(bits)
    for _ in range(CROWDED_ROUNDS):
        places = sets.mapInArrow(_places(common, crowded, blocks, percent), "block bigint, places binary")
        crowds = materialise(places.groupBy("block").applyInArrow(_crowds(GROUP), "class bigint"))
        found = crowds.count()
        if found:
            bits |= _filter_of(crowds, CROWDED_BITS)
            crowded = spark.sparkContext.broadcast(bits)
        if found * GROUP < total // 1000:  # they led few prefixes, so what they give way to is hardly more
            break

    dealt = sets.mapInArrow(_prefixes(common, crowded, blocks, percent), "block bigint, shingles binary, classes binary, sizes binary, hot binary")
    met = materialise(dealt.groupBy("block").applyInArrow(_column_product(percent, GROUP), "a bigint, b bigint, na int, nb int"))
    pairs = met.where("nb IS NOT NULL").groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("met"))
    rest = F.greatest(*[F.ceil(F.col(n) * percent / 100) - 1 for n in ("na", "nb")])  # at most so many lie behind the shorter prefix
    pairs = pairs.where((F.col("met") + rest) * (100 + percent) >= percent * (F.col("na") + F.col("nb")))
    # a shingle is a node of its own, with another hash than any class
    members = met.where("nb IS NULL").select("a", F.xxhash64("b").alias("b"))
    panels = materialise(connected_components(pairs.select("a", "b").unionByName(members)).select(F.col("node").alias("class"), F.col("component").alias("panel")))

    inside = materialise(panels.join(classes, "class"))
    widths = inside.groupBy("panel").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("all")).where("docs > 1")
    widths = widths.select("panel", F.greatest(F.ceil(F.col("docs") / ROW_BLOCK), F.ceil(F.col("all") / ROW_BLOCK_SHINGLES)).alias("width"))
    placed = inside.join(widths, "panel").withColumn("own", F.pmod(F.xxhash64("class"), "width"))
    # block i meets blocks 0..i as the first and i+1.. as the second side; i with i has one side only
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    placed = placed.select(
        "panel", F.greatest("own", "other").alias("i"), F.least("own", "other").alias("j"),
        F.when(F.col("own") >= F.col("other"), 0).otherwise(1).alias("side"), "class", "copies")
    bits = spark.sparkContext.broadcast(_filter_of(inside.select("class")))
    near = sets.mapInArrow(_in_filter(bits), "class bigint, n bigint, shingles binary")
    tasks = near.dropDuplicates(["class"]).join(placed, "class")
    found = materialise(tasks.groupBy("panel", "i", "j").applyInArrow(_row_product(percent), "class bigint, partner bigint, links bigint"))
    joined = connected_components(found.where("partner IS NOT NULL").select("class", "partner"))
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    parts = classes.join(joined.withColumnsRenamed({"node": "class"}), "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = parts.groupBy("component").agg(F.min("least").alias("smallest"))
    known = parts.join(least, "component").join(links, "class", "left")
    known = materialise(known.select("class", "smallest", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")))
    some = rows.where("n > 0").select("id", "n", "class", "key").join(known, "class").select("id", "n", F.col("smallest").alias("component_id"), "links", "key", "component")
    none = rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"), F.lit(0).cast("bigint").alias("links"), "key", F.lit(None).cast("bigint").alias("component"))
    return some.unionByName(none).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("links").alias("n_links"), F.col("key").alias("row_key"), F.col("component").alias("component_key"))
