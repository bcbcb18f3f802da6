"""Main text of web pages by differencing pages with near URLs.

Pages of a site share what isn't their own text. Every page is set against those nearest to it in the order
of URL paths on its host:

1. One pass turns pages into lines (``page_lines``) and writes a digest of each line.
2. Pages of a host with the same lines are one outline, so copies don't delete each other. Outlines take a
   global position by (host, path), which cuts through hosts of any size, and are dealt out in runs of
   consecutive positions. A run also gets the few neighbours behind its ends.
3. An outline is aligned with the ``NEAR`` ones on either side on its host by longest common subsequence. A
   pair that has most of its own text in common is two versions of one page and says nothing. A line that
   at least three quarters of the other pairs share is deleted; one inside an article element only where
   ``INSIDE`` pairs or more agree.
4. The second pass reads the pages again, and the decisions on lines join by outline.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lamina.durable import materialise
from lamina.llm.page_lines import page_lines
from lamina.llm.words import by_size, texts_of
from lamina.operators.numbering import global_position

NEAR = 4  # outlines on either side
INSIDE = 4  # pairs that must share a line before it goes from inside an article
SHARED_PARTS = (3, 4)  # share of the pairs that delete a line
RUN = 512  # positions in a run
ALIGNED = 1 << 26  # cells of an alignment that is traced back at once


def _bits(a: np.ndarray, b: np.ndarray) -> Iterator[int]:
    """After each entry of ``a``: a number whose zero bits mark where the length of the common subsequence with ``b`` grows."""
    places: dict[int, int] = {}
    for k, value in enumerate(b.tolist()):
        places[value] = places.get(value, 0) | 1 << k
    full = (1 << len(b)) - 1
    row = full
    for value in a.tolist():
        match = row & places.get(value, 0)
        row = ((row + match) | (row - match)) & full
        yield row


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with each prefix of ``b``."""
    row = (1 << len(b)) - 1
    for row in _bits(a, b):
        pass
    zeros = 1 - np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[:len(b)].astype(np.int64)
    return np.concatenate([[0], np.cumsum(zeros)])


def align(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of two sequences, in memory bounded by ``ALIGNED`` bits and their lengths."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    ends = [(k, k) for k in range(head)], [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]
    ia, ib = np.arange(head, len(a) - tail), np.arange(head, len(b) - tail)
    ia, ib = ia[np.isin(a[ia], b[ib])], ib[np.isin(b[ib], a[ia])]  # what only one of them has aligns with nothing
    return ends[0] + [(int(ia[i]), int(ib[j])) for i, j in _align(a[ia], b[ib])] + ends[1]


def _align(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    if not len(a) or not len(b):
        return []
    if len(a) == 1:
        return [(0, int(np.flatnonzero(b == a[0])[0]))] if (b == a[0]).any() else []
    if len(a) * len(b) > ALIGNED:  # cut a in the middle and b where both halves align best
        half = len(a) // 2
        cut = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
        return _align(a[:half], b[:cut]) + [(i + half, j + cut) for i, j in _align(a[half:], b[cut:])]
    rows, found = list(_bits(a, b)), []
    i, j = len(a) - 1, len(b) - 1
    while i >= 0 and j >= 0:
        if rows[i] >> j & 1:  # no growth at j
            j -= 1
        elif i and not rows[i - 1] >> j & 1:  # it grew without this entry
            i -= 1
        else:
            found.append((i, j))
            i, j = i - 1, j - 1
    return found[::-1]


def _outlines(with_text: bool) -> Callable:
    """Digest of the lines with, for the first pass, the lines' own digests, lengths and flags; for the second, the lines."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, "html"):
            names, texts, digests, sizes, flags = [], [], [], [], []
            for html in texts_of(batch, "html"):
                lines = page_lines(html.decode("utf-8", "replace") if html else "")
                own = [hashlib.blake2b(line.text.encode(), digest_size=8).digest() for line in lines]
                inside = bytes(line.inside for line in lines)
                names.append(hashlib.blake2b(b"".join(own) + inside, digest_size=16).digest())
                if with_text:
                    texts.append([line.text for line in lines])
                else:
                    digests.append(b"".join(own))
                    sizes.append(np.array([len(line.text) for line in lines], "<i4").tobytes())
                    flags.append(inside)
            outline = pa.array(names, pa.binary())
            if with_text:
                kept = [batch.column(n) for n in batch.schema.names if n != "html"]
                yield pa.RecordBatch.from_arrays([*kept, outline, pa.array(texts, pa.list_(pa.string()))], [*[n for n in batch.schema.names if n != "html"], "outline", "lines"])
            else:
                more = [pa.array(x, pa.binary()) for x in (digests, sizes, flags)]
                yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("path"), outline, *more], ["host", "path", "outline", "digests", "sizes", "flags"])

    return run


def shared_lines(pages: list[tuple[np.ndarray, np.ndarray, np.ndarray]], own: range) -> Iterator[np.ndarray]:
    """For each page of ``own``, the lines to delete; ``pages`` (digests, sizes, inside) are consecutive ones of a host."""
    aligned: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for k in own:
        digests, sizes, inside = pages[k]
        votes, pairs = np.zeros(len(digests), np.int64), 0
        for other in range(max(0, k - NEAR), min(len(pages), k + NEAR + 1)):
            if other == k:
                continue
            pair = (min(k, other), max(k, other))
            if pair not in aligned:
                aligned[pair] = align(pages[pair[0]][0], pages[pair[1]][0])
            common = np.array([p[k > other] for p in aligned[pair]], np.int64)
            if 2 * sizes[common].sum() > min(sizes.sum(), pages[other][1].sum()) and sizes[common].max() > 80:
                continue  # versions of one page
            pairs += 1
            votes[common] += 1
        for pair in [p for p in aligned if p[1] <= k]:
            del aligned[pair]
        part, whole = SHARED_PARTS
        yield (votes > 0) & (votes * whole >= part * pairs) & (~inside | (votes >= INSIDE))


def _decide(table: pa.Table) -> pa.Table:
    """``(host, outline, gone)`` of one run: outlines with lines to delete."""
    table = table.sort_by("pos")
    hosts, guests = table.column("host").to_pylist(), table.column("guest").to_pylist()
    read = lambda name, kind: [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
    pages = list(zip(read("digests", "<u8"), read("sizes", "<i4"), [f.astype(bool) for f in read("flags", np.uint8)]))
    outlines, result = table.column("outline").to_pylist(), {"host": [], "outline": [], "gone": []}
    start = 0
    while start < len(hosts):
        end = start
        while end < len(hosts) and hosts[end] == hosts[start]:
            end += 1
        own = [k for k in range(start, end) if not guests[k]]
        if own:
            group = range(own[0] - start, own[-1] + 1 - start)
            for k, gone in zip(own, shared_lines(pages[start:end], group)):
                if gone.any():
                    for name, value in zip(result, (hosts[k], outlines[k], (np.flatnonzero(gone) + 1).tolist())):
                        result[name].append(value)
        start = end
    return pa.table([pa.array(result["host"], pa.string()), pa.array(result["outline"], pa.binary()), pa.array(result["gone"], pa.list_(pa.int64()))], list(result))


def url_host(url: Column) -> Column:
    """What lies between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lowered; null or none: empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def deletions(pages: DataFrame) -> DataFrame:
    """``(host, outline, gone)`` from ``pages`` (url, html): the 1-based lines to delete of outlines that have any."""
    source = pages.select(url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), "html")
    compact = materialise(source.mapInArrow(_outlines(False), "host string, path string, outline binary, digests binary, sizes binary, flags binary"))
    first = [F.first(n).alias(n) for n in ("digests", "sizes", "flags")]  # equal in all rows of an outline
    distinct = compact.groupBy("host", "outline").agg(F.min("path").alias("path"), *first)
    placed = global_position(distinct, ["host", "path", "outline"], "pos")
    at = F.col("pos") % RUN
    run = F.col("pos").cast("bigint") - at
    places = F.array(
        F.struct(run.alias("run"), F.lit(False).alias("guest")),
        F.when(at < NEAR, F.struct((run - RUN).alias("run"), F.lit(True).alias("guest"))),
        F.when(at >= RUN - NEAR, F.struct((run + RUN).alias("run"), F.lit(True).alias("guest"))))
    dealt = placed.withColumn("place", F.explode(F.array_compact(places))).select("pos", "host", "outline", "digests", "sizes", "flags", "place.*")
    return materialise(dealt.groupBy("run").applyInArrow(_decide, "host string, outline binary, gone array<bigint>"))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, ``text``, ``n_chars`` (its code points).

    The text is the page's lines joined by line feeds, less those shared with pages of near URLs on its host. Null or
    empty html, and pages without text, give an empty text. A null url, or one without ``://``, counts as the empty
    host. Repeated rows are rows of their own with the same text; a page alone on its host keeps every line. Texts
    are read whole, and no table may be too small: an empty one gives an empty result. Other columns are not used.
    """
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    gone = deletions(source)
    kinds = dict(source.dtypes)
    lines = source.mapInArrow(_outlines(True), f"id {kinds['id']}, url string, outline binary, lines array<string>")
    lines = lines.withColumn("host", url_host(F.col("url")))
    judged = lines.join(gone, ["host", "outline"], "left")
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.expr("filter(lines, (line, k) -> NOT array_contains(gone, CAST(k + 1 AS bigint)))"))
    texts = judged.select("id", "url", F.array_join(kept, "\n").alias("text"))
    return texts.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("bigint").alias("n_chars"))
