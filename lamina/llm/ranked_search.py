"""Ranked lexical search as exact inner-product search in sparse ball trees.

A document is a sparse vector of term impacts and an item a sparse vector of term weights, all whole numbers;
the score is their inner product. Only terms of the items matter, so the documents' vectors hold only these.

1. One pass over the documents counts all terms and writes the impacts' ingredients of the items' terms.
2. Every task gathers documents up to ``TREE`` of them or ``TREE_ENTRIES`` entries, halves them along the
   line between two far ones until ``LEAF`` are left, and knows of each node its centroid c and radius r.
   No document in it scores above q.c + |q| r; the bound is widened by more than floating point can err.
3. Each item visits the nodes with the highest bounds first and stops when the best one left lies below
   its k-th score so far, which it carries from tree to tree. Leaves are scored in 64-bit integers.
4. The k best of each task are ranked together; the planner's group limit keeps k of each item in every
   task before they meet.

Items come in blocks of bounded size, each a pass over the documents.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window, functions as F

from lamina.durable import materialise
from lamina.llm.words import by_size, texts_of, within
from lamina.operators.numbering import running_total

BLOCK_TERMS, BLOCK_ITEMS = 200_000, 2_000  # distinct terms by item, and items, in a block; an item is never cut
TREE, TREE_ENTRIES = 20_000, 2_000_000  # documents and entries of a tree; a document is never cut
LEAF = 32
#: Bytes below 0x80 other than letters and digits part terms; A-Z is lowered.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


class Items(NamedTuple):
    """A block of items: keys, places of their terms in the vocabulary (row pointers and indices)."""

    keys: list[int]
    ids: list[int | None]
    starts: np.ndarray
    terms: np.ndarray
    vocabulary: list[bytes]


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split(b" ") if text else []


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_size(batches, "text"):
        own = [sorted({t for t in terms_of(x) if t}) for x in texts_of(batch, "text")]
        lists = pa.array(own, pa.list_(pa.binary()))
        yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("item_id"), pa.array([len(t) for t in own], pa.int64()), lists], ["item", "item_id", "n", "terms"])


def _item_blocks(items: DataFrame) -> Iterator[Items]:
    """The items in blocks of about ``BLOCK_TERMS`` terms; only one block at a time is on the driver."""
    cost = F.greatest("n", F.lit(BLOCK_TERMS // BLOCK_ITEMS))
    placed = running_total(items.withColumn("cost", cost.cast("bigint")), "cost", ["item"], "ahead")
    placed = materialise(placed.withColumn("block", F.expr(f"ahead div {BLOCK_TERMS}")).drop("ahead", "cost"))
    for (block,) in placed.select("block").distinct().orderBy("block").toLocalIterator():
        rows = placed.where(F.col("block") == block).orderBy("item").collect()  # bounded, see above
        vocabulary: dict[bytes, int] = {}
        terms = [vocabulary.setdefault(bytes(t), len(vocabulary)) for r in rows for t in r["terms"]]
        starts = np.concatenate([[0], np.cumsum([len(r["terms"]) for r in rows])]).astype(np.int64)
        yield Items([r["item"] for r in rows], [r["item_id"] for r in rows], starts, np.array(terms, np.int64), list(vocabulary))


def _matches(vocabulary) -> Callable:
    """``(id, n, terms, counts)``: all terms of a document by number, and the occurrences of those in the vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: k for k, t in enumerate(vocabulary.value)}
        for batch in by_size(batches, "text"):
            total, terms, counts = [], [], []
            for text in texts_of(batch, "text"):
                words = terms_of(text)
                total.append(len(words) - words.count(b""))
                found = np.fromiter((place[w] for w in words if w in place), np.int64)
                own, many = np.unique(found, return_counts=True)
                terms.append(own.astype("<i4").tobytes() if len(own) else None)
                counts.append(many.astype("<i4").tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(total, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], ["id", "n", "terms", "counts"])

    return run


def _document_counts(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for batch in batches:
            for terms in batch.column("terms").to_pylist():
                held[np.frombuffer(terms, "<i4")] += 1
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], ["term", "docs"])

    return run


class Tree:
    """Ball tree of sparse rows (``starts``, ``terms``, ``values``), with the bounds of every item for every node."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, values: np.ndarray, items: Items, weights: np.ndarray):
        self.starts, self.terms, self.values = starts, terms, values.astype(np.float64)
        self.width, self.items, self.weights = len(weights), items, weights
        self.item_rows = np.repeat(np.arange(len(items.keys)), np.diff(items.starts))
        self.item_values = weights[items.terms].astype(np.float64)
        self.lengths = np.sqrt(np.bincount(self.item_rows, self.item_values ** 2, len(items.keys)))
        self.squares = np.add.reduceat(self.values ** 2, starts[:-1])
        self.bounds: list[np.ndarray] = []
        self.children: list[tuple[int, int] | None] = []
        self.rows: list[np.ndarray] = []
        self._grow(np.arange(len(starts) - 1))

    def _entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        many = np.diff(self.starts)[rows]
        return within(self.starts[rows], many), np.concatenate([[0], np.cumsum(many)[:-1]])

    def _grow(self, rows: np.ndarray) -> int:
        at, firsts = self._entries(rows)
        terms, values = self.terms[at], self.values[at]
        centre = np.bincount(terms, values, self.width) / len(rows)
        # |x - c|^2 for all rows; every sum errs by far less than the part in 10^9 that is added
        apart = self.squares[rows] - 2 * np.add.reduceat(values * centre[terms], firsts) + centre @ centre
        slack = 1e-9 * (self.squares[rows].max() + centre @ centre) + 1
        radius = np.sqrt(max(0.0, apart.max()) + slack)
        own = np.bincount(self.item_rows, self.item_values * centre[self.items.terms], len(self.items.keys))
        node = len(self.bounds)
        self.bounds.append((own + self.lengths * radius) * (1 + 1e-9) + 1)
        self.children.append(None)
        self.rows.append(rows)
        if len(rows) > LEAF and apart.max() > slack:
            far = rows[np.argmax(apart)]
            line = np.zeros(self.width)
            line[self.terms[self.starts[far]:self.starts[far + 1]]] = self.values[self.starts[far]:self.starts[far + 1]]
            distance = self.squares[rows] - 2 * np.add.reduceat(values * line[terms], firsts)
            other = rows[np.argmax(distance)]
            line[self.terms[self.starts[other]:self.starts[other + 1]]] -= self.values[self.starts[other]:self.starts[other + 1]]
            order = np.argsort(np.add.reduceat(values * line[terms], firsts), kind="stable")
            half = len(rows) // 2
            self.rows[node] = rows[:0]
            self.children[node] = self._grow(rows[order[:half]]), self._grow(rows[order[half:]])
        return node

    def best(self, item: int, k: int, found: list[tuple[int, int]], keys: np.ndarray, exact: np.ndarray) -> list[tuple[int, int]]:
        """``found`` (score, -key) and this tree's rows together, the k greatest, ascending.

        ``keys`` orders equal scores: the smaller key comes first.
        """
        weight = np.zeros(self.width, np.int64)
        own = self.items.terms[self.items.starts[item]:self.items.starts[item + 1]]
        weight[own] = self.weights[own]
        queue = [(-self.bounds[0][item], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            if len(found) == k and -bound < found[0][0]:
                break
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(queue, (-min(-bound, self.bounds[child][item]), child))
                continue
            rows = self.rows[node]
            at, firsts = self._entries(rows)
            scores = np.add.reduceat(exact[at] * weight[self.terms[at]], firsts)
            least = found[0][0] if len(found) == k else 1
            for j in np.flatnonzero(scores >= max(1, least)).tolist():
                pair = (int(scores[j]), -int(keys[rows[j]]))
                if len(found) < k:
                    heapq.heappush(found, pair)
                elif pair > found[0]:
                    heapq.heapreplace(found, pair)
        return found


def impacts(counts: np.ndarray, n: np.ndarray, documents: int, occurrences: int) -> np.ndarray:
    """Impact of ``counts`` occurrences in documents of ``n`` terms; whole numbers throughout."""
    m = 10 + 90 * n * documents // max(1, occurrences)
    return 1_000_000_000 * counts // (1000 * counts + 8 * m)


def _search(block, weights: np.ndarray, documents: int, occurrences: int, k: int) -> Callable:
    """The k best of one task for each item: ``(item, item_id, id, score)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = block.value
        found: list[list[tuple[int, int]]] = [[] for _ in items.keys]
        last = np.iinfo(np.int64).max  # a null id comes after every other

        def search(ids: list[np.ndarray], n: list[np.ndarray], terms: list[bytes], counts: list[bytes]) -> None:
            many = np.array([len(t) // 4 for t in terms], np.int64)
            starts = np.concatenate([[0], np.cumsum(many)])
            place = np.frombuffer(b"".join(terms), "<i4").astype(np.int64)
            exact = impacts(np.frombuffer(b"".join(counts), "<i4").astype(np.int64), np.repeat(np.concatenate(n), many), documents, occurrences)
            tree, keys = Tree(starts, place, exact, items, weights), np.concatenate(ids)
            for item in range(len(items.keys)):
                found[item] = tree.best(item, k, found[item], keys, exact)

        ids, n, terms, counts, rows, entries = [], [], [], [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                own = part.column("id").fill_null(last).to_numpy()
                ids.append(own), n.append(part.column("n").to_numpy())
                terms += part.column("terms").to_pylist()
                counts += part.column("counts").to_pylist()
                rows += part.num_rows
                entries += sum(len(t) // 4 for t in terms[-part.num_rows:])
                if rows >= TREE or entries >= TREE_ENTRIES:
                    search(ids, n, terms, counts)
                    ids, n, terms, counts, rows, entries = [], [], [], [], 0, 0
        if rows:
            search(ids, n, terms, counts)
        flat = [(items.keys[place], items.ids[place], None if -key == last else -key, score) for place, own in enumerate(found) for score, key in own]
        kinds = [("item", pa.int64()), ("item_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in flat], t) for c, (_, t) in enumerate(kinds)], [name for name, _ in kinds])

    return run


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``k`` documents with the highest score above 0 of each item: item id, ``rank``, id, ``score``.

    Terms are the maximal runs of letters and digits of ASCII and of any other character beyond it, A-Z lowered. A
    null or empty text has none, so it is in no result and counts for no statistic. Equal scores rank by ascending id,
    a null id last. Repeated rows and ids are documents of their own; repeated items are ranked each. An item without
    terms has no rows, and so have empty tables. Texts of any length are read whole. Other columns are not used.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    asked = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    asked = materialise(asked.mapInArrow(_item_terms, "item bigint, item_id bigint, n bigint, terms array<binary>")).where("n > 0")
    results = []
    for block in _item_blocks(asked):
        seen, size = Observation(), len(block.vocabulary)
        words = source.mapInArrow(_matches(spark.sparkContext.broadcast(block.vocabulary)), "id bigint, n bigint, terms binary, counts binary")
        words = words.observe(seen, F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences"))
        hits = materialise(words.where("terms IS NOT NULL"))
        held = hits.mapInArrow(_document_counts(size), "term bigint, docs bigint").groupBy("term").agg(F.sum("docs").alias("docs")).toPandas()  # a row for each term of the block
        documents, occurrences = seen.get["documents"], seen.get["occurrences"]
        df = np.zeros(size, np.int64)
        df[held["term"].to_numpy(np.int64)] = held["docs"].to_numpy(np.int64)
        weights = np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)
        run = _search(spark.sparkContext.broadcast(block), weights, documents, occurrences, k)
        results.append(hits.mapInArrow(run, "item bigint, item_id bigint, id bigint, score bigint"))
    if not results:
        return spark.createDataFrame([], f"{item_col} bigint, rank int, {id_col} bigint, score bigint")
    best = results[0]
    for more in results[1:]:
        best = best.unionByName(more)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score")
