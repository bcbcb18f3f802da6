"""Cumulative-link ordinal regression on hashed words.

P(grade > k) = logistic(w . x - b_k): one weight vector for all thresholds, which are kept in order by
fitting the lowest and the logarithms of the gaps. Features are the hashed distinct words of the whole
text, without punctuation at their ends, their beginnings, and marks of their shape (see
``features_of``). The fit uses at most ``SAMPLE`` labelled rows per grade, chosen by a hash of the id,
and runs on the driver; scoring reads every text in Arrow tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lamina.llm.words import Remembered, by_size, small_batches, texts_of

BITS = 18  # words and beginnings each: size of the hashed feature space
SAMPLE = 4000  # labelled rows of each grade that a fit uses at most
GRADES = 16  # most grades a label may have
_ENDS = b".,;:!?\"'()[]{}<>|#$%&*-_=+~/\\"
MARKS = ("upper", "digits", "long", "marked", "repeated", "none")
SHARES = 8  # steps into which a mark's share of the words is cut
BEGINNING = 4  # characters of a word that make a feature of their own
HELD_OUT = 4  # one in so many rows of the sample sets scale and thresholds instead of weights
FEWEST = 3  # texts of the sample that must have a feature for it to get a weight


def _place(word: bytes) -> int:
    """Places of a word and of its beginning, with the word's marks above them."""
    core = word.strip(_ENDS)
    lowered = core.lower()
    marks = (core != lowered and core.upper() == core and len(core) > 1) | any(48 <= c < 58 for c in core) << 1
    marks |= (len(core) > 24) << 2 | (len(word) - len(core) > 1 or not core) << 3
    head = lowered.decode()[:BEGINNING].encode()
    mask = (1 << BITS) - 1
    return xxhash.xxh3_64_intdigest(lowered) & mask | (xxhash.xxh3_64_intdigest(head, seed=1) & mask) << BITS | int(marks) << 2 * BITS


def places() -> Remembered:
    return Remembered(_place)


def features_of(text: bytes | None, known: Remembered) -> np.ndarray:
    """Distinct features of a text: its words, their beginnings, and one step for each mark's share.

    Marks: words in capitals, with digits, of over 24 bytes, with runs of punctuation; words that
    repeat earlier ones; texts without words.
    """
    words = text.split() if text else []
    base = 2 << BITS
    if not words:
        return np.array([base + (len(MARKS) - 1) * SHARES])
    places = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    mask, flags = (1 << BITS) - 1, places >> 2 * BITS
    own = np.unique(places & mask)
    heads = np.unique(places >> BITS & mask) + (1 << BITS)
    shares = [np.count_nonzero(flags & 1 << k) / len(words) for k in range(4)] + [1 - len(own) / len(words)]
    steps = [base + k * SHARES + min(SHARES - 1, int(np.ceil(share * 2 * SHARES))) for k, share in enumerate(shares)]
    return np.concatenate([own, heads, steps])


WIDTH = (2 << BITS) + len(MARKS) * SHARES


@dataclass
class OrdinalModel:
    weights: np.ndarray  # one for each feature
    thresholds: np.ndarray  # ascending, one less than grades
    grades: np.ndarray  # the label's values in order

    def tails(self, margins: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - margins[:, None], -60, 60)))

    def expected(self, tails: np.ndarray) -> np.ndarray:
        return self.grades[0] + tails @ np.diff(self.grades)


def fit(rows: list[np.ndarray], labels: np.ndarray, rounds: int = 120, rate: float = 0.3, decay: float = 3e-4, seed: int = 0) -> OrdinalModel:
    """Fit by Adam over all rows, each grade weighing the same in total; every text's features count once.

    A text of many words has many features, so a margin is divided by the root of their number.
    """
    grades = np.unique(labels)
    if len(grades) > GRADES:
        raise ValueError(f"a label has {len(grades)} values; {GRADES} grades are the most")
    if len(grades) < 2:
        return OrdinalModel(np.zeros(WIDTH), np.zeros(max(0, len(grades) - 1)), grades if len(grades) else np.zeros(1))
    sizes = np.array([len(r) for r in rows])
    row = np.repeat(np.arange(len(rows)), sizes)
    features = np.concatenate(rows)
    often = np.bincount(features, minlength=WIDTH)[features] >= min(FEWEST, len(rows))
    row, features = row[often], features[often]
    used, place = np.unique(features, return_inverse=True)
    level = np.searchsorted(grades, labels)
    share = (1 / np.bincount(level))[level] / len(grades)
    scale = 1 / np.sqrt(sizes)
    k = len(grades) - 1
    above = level[:, None] > np.arange(k)[None, :]
    weights, low, gaps = np.zeros(len(used)), 0.0, np.zeros(k - 1)
    state = [np.zeros(len(used) + k), np.zeros(len(used) + k)]
    for step in range(1, rounds + 1):
        thresholds = low + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        margins = np.bincount(row, weights[place], len(rows)) * scale
        below = 1 / (1 + np.exp(np.clip(margins[:, None] - thresholds[None, :], -60, 60)))  # P(grade <= k)
        edges = np.hstack([np.zeros((len(rows), 1)), below, np.ones((len(rows), 1))])
        chance = np.maximum(1e-9, np.take_along_axis(edges, level[:, None] + 1, 1) - np.take_along_axis(edges, level[:, None], 1))[:, 0]
        slopes = np.hstack([np.zeros((len(rows), 1)), below * (1 - below), np.zeros((len(rows), 1))])
        upper, lower = np.take_along_axis(slopes, level[:, None] + 1, 1)[:, 0], np.take_along_axis(slopes, level[:, None], 1)[:, 0]
        by_margin = share * (upper - lower) / chance  # of minus the logarithm of the chance
        by_threshold = np.zeros(k)
        np.add.at(by_threshold, np.minimum(level, k - 1)[level < k], -(share * upper / chance)[level < k])
        np.add.at(by_threshold, np.maximum(level - 1, 0)[level > 0], (share * lower / chance)[level > 0])
        by_gap = np.cumsum(by_threshold[::-1])[::-1][1:] * np.exp(gaps)
        gradient = np.concatenate([np.bincount(place, (by_margin * scale)[row], len(used)) + decay * weights / 10, [by_threshold.sum()], by_gap])
        state[0] = 0.9 * state[0] + 0.1 * gradient
        state[1] = 0.999 * state[1] + 0.001 * gradient**2
        move = rate * state[0] / (1 - 0.9**step) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8)
        weights, low, gaps = weights - move[:len(used)], low - move[len(used)], gaps - move[len(used) + 1:]
    full = np.zeros(WIDTH)
    full[used] = weights
    return OrdinalModel(full, low + np.concatenate([[0], np.cumsum(np.exp(gaps))]), grades.astype(float))


def calibrate(model: OrdinalModel, rows: list[np.ndarray], labels: np.ndarray) -> OrdinalModel:
    """The model with its scale and thresholds fitted to rows that it has not seen, as they come.

    One step for the scale and the thresholds together, by Newton's method on P(label > k) of all k.
    A half of a row on either side of each threshold keeps them finite. Nothing changes without rows.
    """
    if not rows or not len(model.thresholds):
        return model
    k = len(model.thresholds)
    margins = np.array([model.weights[r].sum() / np.sqrt(len(r)) for r in rows])
    low, high = margins.min(), margins.max()
    x = np.concatenate([np.tile(margins, k), np.repeat([low, high], k)])
    which = np.concatenate([np.repeat(np.arange(k), len(rows)), np.tile(np.arange(k), 2)])
    y = np.concatenate([*[(labels > g) * 1.0 for g in model.grades[:-1]], np.full(2 * k, 0.5)])
    design = np.hstack([x[:, None], -np.eye(k)[which]])
    fitted = np.concatenate([[1.0], model.thresholds])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ fitted, -30, 30)))
        bend = (design * (p * (1 - p) + 1e-6)[:, None]).T @ design + 1e-3 * np.eye(k + 1)
        fitted = fitted + np.clip(np.linalg.solve(bend, design.T @ (y - p)), -1, 1)
    if fitted[0] <= 0:
        return model
    return OrdinalModel(model.weights * fitted[0], np.maximum.accumulate(fitted[1:]), model.grades)


def sample_labels(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, most: int = SAMPLE) -> pd.DataFrame:
    """At most ``most`` labelled texts of each grade, those with the smallest hashes of their ids."""
    named = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("double").alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    named = named.groupBy("id").agg(F.max("label").alias("label")).withColumn("lot", F.xxhash64("id"))
    grades = [r[0] for r in named.select("label").distinct().orderBy("label").limit(GRADES + 1).collect()]
    chosen = None
    for grade in grades:
        own = named.where(F.col("label") == grade).orderBy("lot", "id").limit(most)
        chosen = own if chosen is None else chosen.unionByName(own)
    if chosen is None:
        return pd.DataFrame({"id": [], "label": [], "text": []})
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = places()

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, "text"):
            own = [features_of(t, known).astype(np.int32).tobytes() for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(own, pa.binary())], ["label", "features"])

    small_batches(docs.sparkSession)
    # at most GRADES * most ids: bounded by the parameter
    joined = texts.join(F.broadcast(chosen.select("id", "label")), "id").select("label", "text")
    return joined.mapInArrow(features, "label double, features binary").toPandas()


def fit_labels(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE) -> OrdinalModel:
    sample = sample_labels(docs, labels, label_col, id_col, text_col, most)
    if not len(sample):
        return fit([], np.zeros(0))
    order = np.lexsort((sample["features"].map(lambda b: xxhash.xxh3_64_intdigest(b)).to_numpy(), sample["label"].to_numpy()))
    rows = [np.frombuffer(sample["features"].iloc[k], np.int32) for k in order]
    labels, held = sample["label"].to_numpy()[order], np.arange(len(rows)) % HELD_OUT == 0
    if len(np.unique(labels[~held])) < len(np.unique(labels)):
        return fit(rows, labels)
    model = fit([r for r, h in zip(rows, held) if not h], labels[~held])
    return calibrate(model, [r for r, h in zip(rows, held) if h], labels[held])


def grade_texts(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``expected_grade`` and ``tails`` (P(grade > k) for each threshold), replaced if present."""
    shared = small_batches(docs.sparkSession).sparkContext.broadcast((model.weights, model.thresholds, model.grades))  # of fixed size
    kept = [c for c in docs.columns if c not in ("expected_grade", "tails")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = OrdinalModel(*shared.value), places()
        for batch in by_size(batches, "_text"):
            margins = np.zeros(batch.num_rows)
            for k, text in enumerate(texts_of(batch, "_text")):
                own = features_of(text, known)
                margins[k] = model.weights[own].sum() / np.sqrt(len(own))
            tails = model.tails(margins)
            columns = [batch.column(c) for c in kept] + [pa.array(model.expected(tails), pa.float64()), pa.array(list(tails), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "expected_grade", "tails"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in kept), "expected_grade double", "tails array<double>"])
    return docs.select(*kept, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)
