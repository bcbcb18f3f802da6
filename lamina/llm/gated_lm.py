"""A gated recurrent language model with a class-factored softmax, in numpy.

Words are lower-cased runs between blanks; every text ends in one end token. All training texts are
counted. The most frequent words form the model's vocabulary, in classes of ``CLASS`` by rank. Every
other word belongs to a class by its shape, inside which its chance comes from its count:

    P(word | past) = P(class | state) * P(word | class, state)             for words of the vocabulary
    P(word | past) = P(shape | state) * (count + 1) / (N + V + 1)           for others, N and V of the shape

An unseen word counts as the one unseen event of its shape, so the chances add up to one. The network
is trained by truncated backpropagation on all training texts, whole, in stretches dealt out to parts of bounded size:
tasks train on their parts, all of them in every round, and their parameters are averaged after it, a few at a time. A text is scored whole, window by window, with the
state carried from one to the next. Counts of rare words are joined by hash, not broadcast.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from lamina.durable import materialise
from lamina.llm.words import by_size, distinct_words

CLASS, CLASSES, SHAPES = 64, 64, 16
VOCABULARY = CLASS * CLASSES
LISTED = 1 << 17  # most frequent words whose counts are broadcast; the rest is joined
EMBEDDING, HIDDEN = 16, 24
WINDOW, LANES, TRAINING_LANES = 32, 512, 64
PARTS, TURNS = 6, 3  # fewest parts of a round, averaged rounds
STRETCH = 2048  # tokens of a text that training visits in one run; longer texts have several
PART_TOKENS = 800_000  # tokens of a part, about
REPEATED = PARTS * PART_TOKENS  # above so many training tokens, tasks average the states of their own parts before these are written
FAN = 16  # states that one task averages
_TOP = np.uint64(1 << 63)
SLICE = 2_000_000  # bytes of text that a task splits into words at once
END = pa.array([""])  # no word is empty


def word_keys(words: pa.Array) -> np.ndarray:
    """Hashes with the top bit set and the shape in the lowest four bits."""
    flag = lambda values: values.to_numpy(zero_copy_only=False).astype(np.uint64)
    length = pc.binary_length(words).to_numpy().astype(np.uint64)
    shape = flag(pc.match_substring_regex(words, "[.,!?:;]$")) | flag(pc.invert(pc.string_is_ascii(words))) << 1 | np.minimum(3, length // 5) << 2
    whole = words.cast(pa.binary()).to_numpy(zero_copy_only=False)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, whole), np.uint64, len(words)) & ~np.uint64(15) | shape | _TOP


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]

    def joined() -> tuple[np.ndarray, np.ndarray]:
        keys, counts = map(np.concatenate, zip(*found))
        keys, place = np.unique(keys, return_inverse=True)
        return keys, np.bincount(place, counts, len(keys)).astype(np.int64)

    def rows(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["word", "count"])

    for batch in by_size(batches, "text", SLICE):
        words, places, _ = distinct_words(batch.column("text"))
        found.append((word_keys(pa.concat_arrays([words, END])), np.append(np.bincount(places, minlength=len(words)), len(batch))))
        if sum(len(keys) for keys, _ in found) > 800_000:
            found[:] = [joined()]
            if len(found[0][0]) > 400_000:
                yield rows(*found.pop())
                found.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    yield rows(*joined())


class GatedNetwork:
    """Parameters and passes of the network; ``tokens`` are vocabulary ranks, then shapes, then the start."""

    def __init__(self, parameters: dict):
        self.p = parameters

    @classmethod
    def fresh(cls, class_counts: np.ndarray, word_counts: np.ndarray, seed: int = 0) -> GatedNetwork:
        r, size = np.random.default_rng(seed), VOCABULARY + SHAPES + 1
        f = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        return cls({
            "embed": (f(size, EMBEDDING) * np.float32(0.3 * np.sqrt(size))).astype(np.float32), "wx": f(EMBEDDING, 3 * HIDDEN), "wh": f(HIDDEN, 3 * HIDDEN), "b": np.zeros(3 * HIDDEN, np.float32),
            "wc": f(HIDDEN, CLASSES + SHAPES) / 10, "bc": np.log(class_counts + 0.5).astype(np.float32),
            "ww": (r.standard_normal((CLASSES, HIDDEN, CLASS)) / 50).astype(np.float32), "bw": np.log(word_counts + 0.5).astype(np.float32).reshape(CLASSES, CLASS)})

    def steps(self, given: np.ndarray, state: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States (time, lane, HIDDEN) after each step on tokens (time, lane), and the last one (HIDDEN, lane).

        Inside, lanes are the last axis, so that the parts of a gate are blocks of memory.
        """
        p, wh = self.p, np.ascontiguousarray(self.p["wh"].T)
        gates = np.matmul(p["wx"].T, p["embed"][given].swapaxes(1, 2))
        gates += p["b"][:, None]
        out = np.empty((len(given), HIDDEN, given.shape[1]), np.float32)
        for t in range(len(given)):
            u = wh @ state
            rz, new = gates[t, :2 * HIDDEN], gates[t, 2 * HIDDEN:]
            rz += u[:2 * HIDDEN]
            np.negative(rz, out=rz)
            np.exp(rz, out=rz)
            rz += 1
            np.reciprocal(rz, out=rz)
            reset, update = rz[:HIDDEN], rz[HIDDEN:]
            new += reset * u[2 * HIDDEN:]
            np.tanh(new, out=new)
            if keep is not None:
                keep.append((state, reset, update, new, u[2 * HIDDEN:]))
            np.subtract(state, new, out=out[t])
            out[t] *= update
            out[t] += new
            state = out[t]
        return out.swapaxes(1, 2), state

    def log_chances(self, h: np.ndarray, token: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural logarithms of the chances of tokens after states; a shape stands for all its words.

        Rows are taken by group, so that a class is one product and all else is done once for all classes.
        """
        p = self.p
        group = np.where(token < VOCABULARY, token // CLASS, CLASSES + token - VOCABULARY).astype(np.int16)
        order = np.argsort(group, kind="stable")
        group, word = group[order], token[order] % CLASS
        h1 = np.ones((len(token), HIDDEN + 1), np.float32)  # the last column meets the offsets
        h1[:, :HIDDEN] = h[order]
        outer = np.vstack([p["wc"], p["bc"]])
        chances, d = _softmax(h1 @ outer, group, grads is not None)
        if grads is not None:
            slope = h1.T @ d
            grads["wc"] += slope[:-1]
            grads["bc"] += slope[-1]
            back = d @ p["wc"].T
        cuts = np.searchsorted(group, np.arange(CLASSES + 1))
        classes = [(c, slice(s, e)) for c, (s, e) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())) if e > s]
        inside = int(cuts[-1])
        weights = np.concatenate([p["ww"], p["bw"][:, None]], axis=1)
        inner = np.empty((inside, CLASS), np.float32)
        for c, own in classes:
            np.matmul(h1[own], weights[c], out=inner[own])
        found, d = _softmax(inner, word[:inside], grads is not None)
        chances[:inside] += found
        if grads is not None:
            slopes, behind = np.zeros_like(weights), np.empty((inside, HIDDEN), np.float32)
            for c, own in classes:
                np.matmul(h1[own].T, d[own], out=slopes[c])
                np.matmul(d[own], p["ww"][c].T, out=behind[own])
            grads["ww"] += slopes[:, :-1]
            grads["bw"] += slopes[:, -1]
            back[:inside] += behind
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        return chances[place], back[place] if grads is not None else None

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural log-likelihood of whole token sequences."""
        total = np.zeros(len(texts))
        order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
        for at in range(0, len(order), LANES):
            lanes = order[at:at + LANES]
            sizes = np.array([len(texts[k]) for k in lanes])
            state, last = np.zeros((HIDDEN, len(lanes)), np.float32), np.full(len(lanes), VOCABULARY + SHAPES)
            for start in range(0, int(sizes[0]) if len(sizes) else 0, WINDOW):
                active = int(np.searchsorted(-sizes, -start, "left"))  # the lanes with tokens left come first
                width = min(WINDOW, int(sizes[0]) - start)
                block, there = _block(texts, lanes[:active], start, width)
                given = np.vstack([last[None, :active], block[:-1]])
                h, state = self.steps(given, state[:, :active])
                last = block[-1]
                chances, _ = self.log_chances(h[there], block[there])
                np.add.at(total, np.broadcast_to(np.array(lanes[:active]), there.shape)[there], chances)
        return total

    def train(self, texts: list[np.ndarray], rate: float, moments: dict, seed: int) -> float:
        """One pass over the texts with truncated backpropagation and Adam; the mean loss of a token."""
        r, lost, seen, step = np.random.default_rng(seed), 0.0, 0, moments.get("step", 0)
        flat, self.p = _flat(self.p)
        slope, grads = _flat({k: np.zeros_like(v) for k, v in self.p.items()})
        (first, firsts), (second, seconds) = (_flat({k: moments[k][n] if k in moments else np.zeros_like(v) for k, v in self.p.items()}) for n in (0, 1))
        order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
        groups = [order[k:k + TRAINING_LANES] for k in range(0, len(order), TRAINING_LANES)]
        for g in r.permutation(len(groups)):
            lanes = groups[g]
            sizes = np.array([len(texts[k]) for k in lanes])
            state, last = np.zeros((HIDDEN, len(lanes)), np.float32), np.full(len(lanes), VOCABULARY + SHAPES)
            for start in range(0, int(sizes[0]), WINDOW):
                active = int(np.searchsorted(-sizes, -start, "left"))
                block, there = _block(texts, lanes[:active], start, min(WINDOW, int(sizes[0]) - start))
                given = np.vstack([last[None, :active], block[:-1]])
                keep: list = []
                h, state = self.steps(given, state[:, :active], keep)
                last = block[-1]
                slope.fill(0)
                chances, back = self.log_chances(h[there], block[there], grads)
                lost, seen = lost - chances.sum(), seen + len(chances)
                outer = np.zeros((len(given), HIDDEN, active), np.float32)
                outer.swapaxes(1, 2)[there] = back
                self._backward(given, keep, outer, grads)
                step += 1
                _move(flat, slope, first, second, max(1, len(chances)), rate, step)
        moments |= {k: (firsts[k], seconds[k]) for k in self.p} | {"step": step}
        return lost / max(1, seen)

    def _backward(self, given: np.ndarray, keep: list, outer: np.ndarray, grads: dict) -> None:
        p, dh = self.p, np.zeros_like(outer[0])
        steps = np.empty((len(keep), 3 * HIDDEN, given.shape[1]), np.float32)
        news = np.empty_like(outer)
        for t in range(len(keep) - 1, -1, -1):
            before, reset, update, new, u = keep[t]
            dh += outer[t]
            du, dn, still = steps[t], news[t], 1 - update
            np.multiply(new, new, out=dn)
            np.subtract(1, dn, out=dn)
            dn *= dh
            dn *= still
            np.multiply(dn, reset, out=du[2 * HIDDEN:])
            np.multiply(du[2 * HIDDEN:], u, out=du[:HIDDEN])
            du[:HIDDEN] *= 1 - reset
            dh *= update
            np.subtract(before, new, out=du[HIDDEN:2 * HIDDEN])
            du[HIDDEN:2 * HIDDEN] *= dh
            du[HIDDEN:2 * HIDDEN] *= still
            dh += p["wh"] @ du
        grads["wh"] += np.matmul(np.stack([k[0] for k in keep]), steps.swapaxes(1, 2)).sum(0)
        steps[:, 2 * HIDDEN:] = news
        flat, tokens = steps.swapaxes(1, 2).reshape(-1, 3 * HIDDEN), given.ravel()
        grads["b"] += flat.sum(0)
        grads["wx"] += p["embed"][tokens].T @ flat
        order = np.argsort(tokens.astype(np.int16), kind="stable")
        tokens = tokens[order]
        starts = np.flatnonzero(np.diff(tokens, prepend=-1))
        grads["embed"][tokens[starts]] += np.add.reduceat((flat @ p["wx"].T)[order], starts, axis=0)


def _softmax(scores: np.ndarray, chosen: np.ndarray, slopes: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Logarithms of the chances of each row's chosen column, and how the loss changes with the scores, if asked for."""
    if scores.size and np.abs(scores).max() > 60:  # exponentials could leave the range
        scores -= scores.max(1, keepdims=True)
    at = np.arange(len(scores))
    found = scores[at, chosen]
    wide = np.exp(scores, out=scores)
    total = wide @ np.ones(wide.shape[1], np.float32)
    found -= np.log(total)
    if not slopes:
        return found, None
    wide *= (1 / total)[:, None]
    wide[at, chosen] -= 1
    return found, wide


def _flat(arrays: dict) -> tuple[np.ndarray, dict]:
    """One vector of all arrays, and the arrays as views of it."""
    flat = np.concatenate([a.ravel() for a in arrays.values()])
    parts = np.split(flat, np.cumsum([a.size for a in arrays.values()])[:-1])
    return flat, {k: part.reshape(a.shape) for (k, a), part in zip(arrays.items(), parts)}


def _move(flat: np.ndarray, slope: np.ndarray, first: np.ndarray, second: np.ndarray, count: int, rate: float, step: int) -> None:
    """A step of Adam on all parameters, in pieces that stay in a core's cache."""
    rise, scale = np.float32(rate / (1 - 0.9 ** step)), np.float32(1 / (1 - 0.99 ** step))
    for at in range(0, len(flat), 16_384):
        g, m, v, p = (x[at:at + 16_384] for x in (slope, first, second, flat))
        g *= np.float32(1 / count)
        m *= np.float32(0.9)
        m += np.float32(0.1) * g
        g *= g
        g *= np.float32(0.01)
        v *= np.float32(0.99)
        v += g
        np.multiply(v, scale, out=g)
        np.sqrt(g, out=g)
        g += np.float32(1e-6)
        np.divide(m, g, out=g)
        g *= rise
        p -= g


def _block(texts: list[np.ndarray], lanes: list[int], start: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens (time, lane) of a window and which of them are there."""
    block = np.zeros((width, len(lanes)), np.int64)
    there = np.zeros((width, len(lanes)), bool)
    for k, lane in enumerate(lanes):
        own = texts[lane][start:start + width]
        block[:len(own), k] = own
        there[:len(own), k] = True
    return block, there


def _coded(texts: pa.Array, listed: np.ndarray, order: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Codes of the words of each text and of the end, and the network's tokens for them.

    A code is the rank of a listed word, else the word's key; ``order`` sorts the listed keys.
    """
    words, places, counts = distinct_words(texts)
    codes = word_keys(pa.concat_arrays([words, END]))
    if len(listed):
        ranks = order[np.minimum(np.searchsorted(listed, codes, sorter=order), len(order) - 1)]
        codes = np.where(listed[ranks] == codes, ranks.astype(np.uint64), codes)
    ends = np.cumsum(counts)
    places = np.insert(places, ends, len(words))
    cuts = (ends + np.arange(1, len(ends) + 1))[:-1]
    return np.split(codes[places], cuts), np.split(_tokens(codes, listed)[places], cuts)


def _tokens(codes: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Tokens of the network from codes: ranks inside the vocabulary, else shapes."""
    in_list = codes < _TOP
    key = np.where(in_list, listed[np.where(in_list, codes, 0).astype(np.int64)] if len(listed) else 0, codes)
    shape = VOCABULARY + (key & np.uint64(15)).astype(np.int64)
    return np.where(codes < np.uint64(VOCABULARY), codes.astype(np.int64), shape)


def _stretches(listed, parts: int) -> Callable:
    """Whole texts as tokens, cut into stretches that are dealt to the parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(listed.value)
        for batch in by_size(batches, "text", SLICE):
            rows: list[list] = [[], [], []]
            for tokens, lot in zip(_coded(batch.column("text"), listed.value, order)[1], batch.column("lot").to_pylist()):
                tokens = tokens.astype(np.int16)
                for k, at in enumerate(range(0, len(tokens), STRETCH)):
                    for column, value in zip(rows, ((lot + k) % parts, lot + k, tokens[at:at + STRETCH].tobytes())):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(rows, (pa.int64(), pa.int64(), pa.binary()))], ["part", "lot", "tokens"])

    return run


def _train_part(state, turn: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        parameters, moments = pickle.loads(state.value)
        network = GatedNetwork(parameters)
        part = table.column("part")[0].as_py()
        order = np.argsort(table.column("lot").to_numpy(), kind="stable")
        column = table.column("tokens").to_pylist()
        texts = [np.frombuffer(column[k], np.int16).astype(np.int64) for k in order]
        network.train(texts, 0.01 / (1 + turn), moments, seed=100 * turn + part)
        return pa.table({"part": pa.array([part], pa.int64()), "weight": pa.array([1], pa.int64()), "state": pa.array([pickle.dumps((network.p, moments))], pa.binary())})

    return run


def _score(model, listed, counts) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parameters, by_shape = model.value
        network = GatedNetwork(parameters)
        words, order, logs = listed.value, np.argsort(listed.value), np.log10(counts.value + 1.0)
        for batch in batches:
            for piece in by_size([batch], "text", 16_000_000):
                codes, tokens = [], []
                for part in by_size([piece], "text", SLICE):
                    for whole, own in zip((codes, tokens), _coded(part.column("text"), words, order)):
                        whole += own
                model_log = network.score(tokens) / np.log(10)
                rows: list[list] = [[], [], [], [], []]
                for k, (code, token) in enumerate(zip(codes, tokens)):
                    in_list = code < _TOP
                    ranks = code[in_list].astype(np.int64)
                    rare, often = np.unique(code[~in_list], return_counts=True)
                    outside = token[token >= VOCABULARY] - VOCABULARY
                    inside_log = logs[ranks[ranks >= VOCABULARY]].sum() - by_shape[outside].sum()
                    for column, value in zip(rows, (len(code), len(ranks), logs[ranks].sum(), rare.view(np.int64), often)):
                        column.append(value)
                    model_log[k] += inside_log
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                columns = [piece.column("id"), pa.array(model_log, pa.float64()), *[pa.array(c, t) for c, t in zip(rows, kinds)]]
                yield pa.RecordBatch.from_arrays(columns, ["id", "model", "n_tokens", "listed", "base", "rare", "often"])

    return run


def _average(states: list[bytes], weights: list[int]) -> tuple[dict, dict]:
    loaded = [pickle.loads(s) for s in states]
    mean = lambda values: sum((np.float32(w) * v for w, v in zip(weights[1:], values[1:])), np.float32(weights[0]) * values[0]) / sum(weights)
    params = {k: mean([p[k] for p, _ in loaded]).astype(np.float32) for k in loaded[0][0]}
    moments = {k: tuple(mean([m[k][n] for _, m in loaded]).astype(np.float32) for n in (0, 1)) for k in params}
    return params, moments | {"step": max(m["step"] for _, m in loaded)}


def _average_some(table: pa.Table) -> pa.Table:
    """The average of some parts' states, in their order, as the state of one part."""
    table = table.sort_by("part")
    weights = table.column("weight").to_pylist()
    state = pickle.dumps(_average(table.column("state").to_pylist(), weights))
    return pa.table({"part": pa.array([table.column("part")[0].as_py() // FAN], pa.int64()), "weight": pa.array([sum(weights)], pa.int64()), "state": pa.array([state], pa.binary())})


def _average_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The average of the states of a task's parts, as the state of the first of them."""
    held: dict = {}
    for batch in batches:
        for row in batch.to_pylist():
            both = [held, row] if held else [row]
            state = pickle.dumps(_average([r["state"] for r in both], [r["weight"] for r in both])) if held else row["state"]
            held = {"part": both[0]["part"], "weight": sum(r["weight"] for r in both), "state": state}
    if held:
        yield pa.RecordBatch.from_pylist([held], pa.schema([("part", pa.int64()), ("weight", pa.int64()), ("state", pa.binary())]))


def _train(pieces: DataFrame, network: GatedNetwork, parts: int, few: bool) -> None:
    """Averaged rounds over all parts; unless they are few, a task hands over one state for all of its parts."""
    spark, moments, row = pieces.sparkSession, {}, "part bigint, weight bigint, state binary"
    for turn in range(TURNS):
        state = spark.sparkContext.broadcast(pickle.dumps((network.p, moments)))
        states, left = pieces.groupBy("part").applyInArrow(_train_part(state, turn), row), parts
        states = states if few else states.mapInArrow(_average_own, row)
        while left > FAN:
            states = materialise(states)
            states, left = states.groupBy(F.expr(f"part div {FAN}")).applyInArrow(_average_some, row), -(-left // FAN)
        found = states.orderBy("part").collect()  # at most FAN rows
        if found:
            network.p, moments = _average([r["state"] for r in found], [r["weight"] for r in found])


def score_texts(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    ``training`` says which rows to learn from (null: not). ``base_score`` is the unigram log10 probability
    with one added to each count, ``score`` the model's. Null texts count as empty and have the end token
    only. Repeated rows and ids, and null ids, are scored like any other; without training rows the
    model is what it starts as. Other columns are not used.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(training, F.lit(False)).alias("taught"))
    words = materialise(source.where("taught").select("text").mapInArrow(_count, "word bigint, count bigint").groupBy("word").agg(F.sum("count").alias("count")))
    shape = F.col("word").bitwiseAND(F.lit(SHAPES - 1)).alias("shape")
    stats = words.groupBy(shape).agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("v")).collect()  # a row per shape
    n, v = sum(r["n"] for r in stats), sum(r["v"] for r in stats)
    top = words.orderBy(F.desc("count"), "word").limit(LISTED).toPandas()  # of bounded length
    keys, counts = top["word"].to_numpy(np.int64).view(np.uint64), top["count"].to_numpy(np.float64)
    inner = np.zeros(VOCABULARY)
    inner[:min(VOCABULARY, len(counts))] = counts[:VOCABULARY]
    shape_n, shape_v = np.zeros(SHAPES), np.zeros(SHAPES)
    for r in stats:
        shape_n[r["shape"]], shape_v[r["shape"]] = r["n"], r["v"]
    own = (keys[:VOCABULARY] & np.uint64(15)).astype(np.int64)
    shape_n -= np.bincount(own, counts[:VOCABULARY], SHAPES)
    shape_v -= np.bincount(own, minlength=SHAPES)
    network = GatedNetwork.fresh(np.concatenate([inner.reshape(CLASSES, CLASS).sum(1), shape_n]), inner)
    listed = spark.sparkContext.broadcast(keys)

    parts = max(PARTS, -(-n // PART_TOKENS))
    lot = F.xxhash64("id", "text", F.lit(7)).bitwiseAND(F.lit((1 << 40) - 1)).alias("lot")
    pieces = source.where("taught").select("text", lot).mapInArrow(_stretches(listed, parts), "part bigint, lot bigint, tokens binary")
    _train(materialise(pieces), network, parts, n <= REPEATED)

    by_shape = np.log10(shape_n + shape_v + 1)
    model = spark.sparkContext.broadcast((network.p, by_shape))
    scored = source.select("id", "text").mapInArrow(_score(model, listed, spark.sparkContext.broadcast(counts)), "id bigint, model double, n_tokens bigint, listed bigint, base double, rare array<bigint>, often array<bigint>")
    scored = materialise(scored.withColumn("row", F.monotonically_increasing_id()))
    rare = scored.where("size(rare) > 0").select("row", F.explode(F.arrays_zip("rare", "often")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.often").alias("often"))
    seen = rare.join(words, "word").groupBy("row").agg(F.sum(F.col("often") * F.log10(F.col("count") + 1)).alias("logs"), F.sum("often").alias("met"))
    every = scored.drop("rare", "often").join(seen, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return every.select(
        F.col("id").alias(id_col), "n_tokens", (F.col("listed") + F.coalesce("met", F.lit(0))).alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"), (F.col("model") + logs).alias("score"))
