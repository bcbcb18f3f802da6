"""Binary layout streams (length-prefixed records) as a Spark data source, read and written in parallel.

A stream is one run of records: two bytes of length, a record type, a data type and the data. Nothing marks
where a reader may start, so a file is cut into chunks of bytes and every task finds its own first
element: it looks for the end of an element followed by the start of another, and walks on from there to
the first such place behind its chunk. Such bytes may also occur inside data. Each task therefore reports its
first and last place as a seam, and a chunk counts only when its first place is where the chunk before it
ended. A chunk that fails this is read again from the proven place. So the result is exact, and the
file is read once however many tasks share it. Records are walked one by one, but decoded and encoded a
block at a time, as arrays; only paths, lattices off the axes and fields of unusual size are taken singly.

Elements before the first structure name of a chunk belong to the structure that the chunk before ended in; the
seams, one row for each chunk, carry the names over.
"""

from __future__ import annotations

import json
import math
import re
import struct
import uuid
from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass
from decimal import Decimal
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from lamina.checks import StrictModeError
from lamina.constants import literal_rows
from lamina.durable import materialise
from lamina.sources.ingest import cell_boxes, geometry_rows, instance_rows, label_rows

FORMAT = "lamina_stream_layout"
CHUNK = 64 << 20  # bytes of a file for one task
ROUND = 16  # sides of a half circle at the ends of a path
BLOCK = 1 << 20  # bytes decoded at a time
LEVELS = 10  # units of written files at most, each ten times the one before: so many digits has a coordinate

# Record types of the stream format.
HEADER, BGNLIB, LIBNAME, UNITS, ENDLIB, BGNSTR, STRNAME, ENDSTR = range(0x00, 0x08)
BOUNDARY, PATH, SREF, AREF, TEXT, LAYER, DATATYPE, WIDTH, XY, ENDEL, SNAME, COLROW = range(0x08, 0x14)
NODE, TEXTTYPE, STRING, STRANS, MAG, ANGLE, PATHTYPE, BOX, BOXTYPE, BGNEXTN, ENDEXTN = 0x15, 0x16, 0x19, 0x1A, 0x1B, 0x1C, 0x21, 0x2D, 0x2E, 0x30, 0x31
ELEMENTS = frozenset((BOUNDARY, PATH, SREF, AREF, TEXT, NODE, BOX))
LAST_TYPE = 0x3B
# the end of an element and the start of the next, or the end of the structure: also structures of one element have seams
SEAM = re.compile(rb"\x00\x04\x11\x00(?=\x00\x04[\x07\x08\x09\x0A\x0B\x0C\x15\x2D]\x00)")

SCHEMA = (
    "file string, chunk int, kind string, place bigint, cell string, layer int, datatype int, ring array<struct<x: double, y: double>>, "
    "ref string, x double, y double, magnification double, rotation double, x_reflection boolean, columns int, rows int, dx double, dy double, "
    "text string, first bigint, last bigint")
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
_FIELDS = [(f.split()[0], pa.list_(_POINT) if " array<" in f else _ARROW[f.split()[1]]) for f in re.split(r", (?![^<]*>)", SCHEMA)]


def real8(data: bytes) -> float:
    """A number of eight bytes: sign, exponent of 16 in excess 64, 56 bits of fraction."""
    value = int.from_bytes(data, "big")
    size = math.ldexp(value & (1 << 56) - 1, 4 * ((value >> 56 & 127) - 64) - 56)
    return -size if value >> 63 else size


def to_real8(value: float) -> bytes:
    fraction, power = math.frexp(abs(value))
    if not fraction:
        return bytes(8)
    sixteens = -(-power // 4)
    bits = int(math.ldexp(fraction, power - 4 * sixteens + 56))
    return ((value < 0) << 63 | (sixteens + 64) << 56 | bits).to_bytes(8, "big")


def real8s(data: np.ndarray) -> np.ndarray:
    """``real8`` of many: rows of eight bytes."""
    bits = np.ascontiguousarray(data).view(">u8").ravel().astype(np.uint64)
    size = np.ldexp((bits & np.uint64((1 << 56) - 1)).astype(np.float64), (4 * ((bits >> np.uint64(56) & np.uint64(127)).astype(np.int64) - 64) - 56).astype(np.int32))
    return np.where(bits >> np.uint64(63) == 1, -size, size)


def to_real8s(values: np.ndarray) -> np.ndarray:
    fraction, power = np.frexp(np.abs(values))
    sixteens = -(-power.astype(np.int64) // 4)
    if not (np.isfinite(values) & (sixteens >= -64) & (sixteens < 64)).all():
        raise StrictModeError("a number is out of the range of eight-byte numbers")
    bits = np.ldexp(fraction, (power - 4 * sixteens + 56).astype(np.int32)).astype(np.uint64)
    bits |= (values < 0).astype(np.uint64) << np.uint64(63) | (sixteens + 64).astype(np.uint64) << np.uint64(56)
    return np.where(fraction == 0, np.uint64(0), bits).astype(">u8").view(np.uint8).reshape(-1, 8)


def _open(path: str):
    """File system and path of a plain path or a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://|file:", path) else (fs.LocalFileSystem(), path)


def records(handle, at: int, block: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """``(place, type, data)`` from a place on; ends with the file or where no record can be."""
    held, base, pos = b"", at, 0
    handle.seek(at)
    while True:
        while len(held) - pos < 4 or len(held) - pos < int.from_bytes(held[pos:pos + 2], "big"):
            more = handle.read(block)
            if not more:
                return
            held, base, pos = held[pos:] + more, base + pos, 0
        size, kind = int.from_bytes(held[pos:pos + 2], "big"), held[pos + 2]
        if size < 4 or kind > LAST_TYPE:
            return
        yield base + pos, kind, held[pos + 4:pos + size]
        pos += size


def _first_seam(handle, start: int, end: int, block: int = 1 << 20) -> int | None:
    """First place in ``start .. end`` where an element or the end of a structure seems to follow an element."""
    at, held = start - 4, b""
    handle.seek(at)
    while at < end:
        more = handle.read(block)
        held += more
        found = SEAM.search(held)
        if found:
            return at + found.end() if at + found.end() < end else None
        if not more:
            return None
        at, held = at + max(0, len(held) - 7), held[-7:]
    return None


def path_ring(points: list[tuple[float, float]], width: float, kind: int, begin: float = 0.0, finish: float = 0.0) -> list[tuple[float, float]]:
    """Outline of a path with mitred corners: flush (0), round (1), half a width longer (2) or extended (4) at its ends."""
    line = [p for k, p in enumerate(points) if not k or p != points[k - 1]]
    half = abs(width) / 2
    if len(line) < 2 or not half:
        return []
    turns = [math.atan2(b[1] - a[1], b[0] - a[0]) for a, b in zip(line, line[1:])]
    longer = {2: (half, half), 4: (begin, finish)}.get(kind, (0.0, 0.0))
    line[0] = line[0][0] - longer[0] * math.cos(turns[0]), line[0][1] - longer[0] * math.sin(turns[0])
    line[-1] = line[-1][0] + longer[1] * math.cos(turns[-1]), line[-1][1] + longer[1] * math.sin(turns[-1])
    left, right = [], []
    for k, (x, y) in enumerate(line):
        before, after = turns[max(0, k - 1)], turns[min(k, len(turns) - 1)]
        bend = math.cos((after - before) / 2)
        reach = half / bend if abs(bend) > 0.05 else half  # a path that turns back has no mitre
        across = (before + after) / 2 + math.pi / 2 + (math.pi if bend < 0 else 0.0)
        dx, dy = abs(reach) * math.cos(across), abs(reach) * math.sin(across)
        left.append((x + dx, y + dy))
        right.append((x - dx, y - dy))
    arc = lambda centre, start: [(centre[0] + half * math.cos(start - math.pi * j / ROUND), centre[1] + half * math.sin(start - math.pi * j / ROUND)) for j in range(1, ROUND)]
    caps = (arc(line[-1], turns[-1] + math.pi / 2), arc(line[0], turns[0] - math.pi / 2)) if kind == 1 else ([], [])
    return left + caps[0] + right[::-1] + caps[1]


def _points(data: bytes) -> list[tuple[int, int]]:
    values = struct.unpack(f">{len(data) // 4}i", data)
    return list(zip(values[::2], values[1::2]))


def _int(held: dict[int, bytes], kind: int, default: int | None = 0) -> int | None:
    return int.from_bytes(held[kind], "big", signed=True) if kind in held else default


def _text(data: bytes) -> str:
    return data.rstrip(b"\0").decode("utf-8", "replace")


def _element(kind: int, held: dict[int, bytes], unit: float) -> Iterator[dict]:
    """Rows of one element; coordinates in user units."""
    points = _points(held.get(XY, b""))
    scaled = lambda p: [{"x": x * unit, "y": y * unit} for x, y in p]
    if kind in (BOUNDARY, BOX):
        ring = points[:-1] if len(points) > 1 and points[0] == points[-1] else points
        yield {"kind": "shape", "layer": _int(held, LAYER), "datatype": _int(held, BOXTYPE if kind == BOX else DATATYPE), "ring": scaled(ring)}
    elif kind == PATH:
        ring = path_ring(points, _int(held, WIDTH), _int(held, PATHTYPE), _int(held, BGNEXTN), _int(held, ENDEXTN))
        if ring:
            yield {"kind": "shape", "layer": _int(held, LAYER), "datatype": _int(held, DATATYPE), "ring": scaled(ring)}
    elif kind == TEXT and points:
        yield {"kind": "label", "layer": _int(held, LAYER), "datatype": _int(held, TEXTTYPE), "text": _text(held.get(STRING, b"")),
               "x": points[0][0] * unit, "y": points[0][1] * unit}
    elif kind in (SREF, AREF) and points:
        (x, y), turn = points[0], real8(held[ANGLE]) if ANGLE in held else None
        row = {"kind": "ref", "ref": _text(held.get(SNAME, b"")), "x": x * unit, "y": y * unit, "magnification": real8(held[MAG]) if MAG in held else None,
               "rotation": None if turn is None else math.radians(turn), "x_reflection": bool(held.get(STRANS, b"\0")[0] & 128)}
        if kind == SREF or COLROW not in held or len(points) < 3:
            yield row
            return
        many = struct.unpack(">2h", held[COLROW])
        steps = [((p[0] - x) / max(1, n), (p[1] - y) / max(1, n)) for p, n in zip(points[1:], many)]
        along_axes = lambda: (many[0] == 1 or steps[0][1] == 0) and (many[1] == 1 or steps[1][0] == 0)
        if not along_axes():  # turned by a quarter, columns run along y
            many, steps = many[::-1], steps[::-1]
        if along_axes():
            yield row | {"columns": many[0], "rows": many[1], "dx": steps[0][0] * unit, "dy": steps[1][1] * unit}
            return
        for i in range(many[0]):  # a lattice that is not along the axes has no columns and rows: one placement each
            for j in range(many[1]):
                yield row | {"x": (x + i * steps[0][0] + j * steps[1][0]) * unit, "y": (y + i * steps[0][1] + j * steps[1][1]) * unit}


@dataclass
class Chunk(InputPartition):
    path: str
    number: int
    start: int
    end: int
    proven: int | None


def _blocks(handle, at: int, end: int) -> Iterator[Block]:
    """The records from ``at`` to the first seam at ``end`` or behind it, to the library's end, or as far as there are any."""
    held, previous, wanted = b"", -1, BLOCK
    handle.seek(at)
    while True:
        more = handle.read(wanted)
        held += more
        block = Block(held, at, previous)
        if block.cut(end, not more):
            yield block
            return
        if not len(block.kind):  # the element is longer than what was read
            wanted *= 2
            continue
        yield block
        held, at, previous, wanted = held[block.end - at:], block.end, int(block.kind[-1]), BLOCK


class Block:
    """Successive records, decoded as arrays."""

    def __init__(self, held: bytes, base: int, previous: int):
        places, pos, size = [], 0, len(held)
        while pos + 4 <= size:
            length = held[pos] << 8 | held[pos + 1]
            if length < 4 or pos + length > size:
                break
            places.append(pos)
            pos += length
        self.base, self.previous, self.broken = base, previous, pos + 4 <= size and length < 4
        self.data = np.frombuffer(held, np.uint8)
        self.place = np.array(places, np.int64)
        self.kind = self.data[self.place + 2]
        self.size = np.append(self.place[1:], pos) - self.place - 4

    def _keep(self, count: int) -> None:
        self.place, self.kind, self.size = self.place[:count], self.kind[:count], self.size[:count]

    def cut(self, end: int, whole: bool) -> bool:
        """Leave out what no longer counts, and an element that goes on behind the block; whether the walk ends here."""
        known = np.flatnonzero(self.kind > LAST_TYPE)
        if len(known):
            self.broken = True
            self._keep(known[0])
        begins = np.isin(self.kind, list(ELEMENTS))
        before = np.append(self.previous, self.kind[:-1])[:len(self.kind)]
        seam = np.flatnonzero((begins | (self.kind == ENDSTR)) & (before == ENDEL) & (self.base + self.place >= end))
        final = np.flatnonzero(self.kind == ENDLIB) + 1
        ends = min([int(found[0]) for found in (seam, final) if len(found)], default=None)
        done = ends is not None or self.broken or whole
        if ends is not None:
            self._keep(ends)
        elif not done:
            start, stop = (np.flatnonzero(found)[-1:] for found in (begins, self.kind == ENDEL))
            if len(start) and (not len(stop) or stop[0] < start[0]):
                self._keep(start[0])
        self.end = self.base + (int(self.place[-1] + 4 + self.size[-1]) if len(self.place) else 0)
        return done

    def _names(self) -> list[str]:
        return [_text(self._bytes(k)) for k in np.flatnonzero(self.kind == STRNAME)]

    def last_cell(self, cell: str | None) -> str | None:
        own = np.flatnonzero(self.kind == STRNAME)
        return _text(self._bytes(own[-1])) if len(own) else cell

    def _bytes(self, record: int) -> bytes:
        at = self.place[record] + 4
        return self.data[at:at + self.size[record]].tobytes()

    def batches(self, part: Chunk, cell: str | None, unit: float, kinds: frozenset[str]) -> Iterator[pa.RecordBatch]:
        """Rows of the elements that end in the block."""
        every = np.arange(len(self.kind))
        starts = np.flatnonzero(np.isin(self.kind, list(ELEMENTS)))
        owner = np.cumsum(np.isin(self.kind, list(ELEMENTS))) - 1  # element that began last
        stops = np.full(len(starts), len(self.kind))
        closing = every[(self.kind == ENDEL) & (owner >= 0)][::-1]
        stops[owner[closing]] = closing  # of several ends the first counts
        whole = stops < len(self.kind)
        inside = (owner >= 0) & (every < np.append(stops, 0)[owner])
        names = pa.array([cell, *self._names()], pa.string())
        cells = np.searchsorted(np.flatnonzero(self.kind == STRNAME), stops)
        held: dict[int, np.ndarray] = {}

        def record(kind: int) -> np.ndarray:
            """The first record of a kind in each element, -1 without one."""
            if kind not in held:
                held[kind] = np.full(len(starts), -1)
                found = every[inside & (self.kind == kind)][::-1]
                held[kind][owner[found]] = found
            return held[kind]

        of = lambda *which: whole & np.isin(self.kind[starts], which)
        shape, label, ref = of(BOUNDARY, BOX) & ("shape" in kinds), of(TEXT) & ("label" in kinds), of(SREF, AREF) & ("ref" in kinds)
        single = of(PATH) & ("shape" in kinds)
        for kind, width in ((LAYER, 2), (DATATYPE, 2), (BOXTYPE, 2), (TEXTTYPE, 2), (STRANS, 2), (MAG, 8), (ANGLE, 8), (COLROW, 4)):
            single |= (shape | label | ref) & (record(kind) >= 0) & (self.size[record(kind)] != width)
        points = np.where(record(XY) >= 0, self.size[record(XY)] // 8, 0)
        single |= (shape | label | ref) & (record(XY) >= 0) & (self.size[record(XY)] % 8 != 0)

        def fixed(kind: int, of: np.ndarray, width: int) -> np.ndarray:
            """Data of a field of so many bytes; what stands for missing ones means nothing."""
            return self.data[np.minimum(self.place[record(kind)[of]] + 4, len(self.data) - width)[:, None] + np.arange(width)]

        def word(kind: int, of: np.ndarray) -> np.ndarray:
            value = fixed(kind, of, 2).view(">i2").ravel().astype(np.int32)
            return np.where(record(kind)[of] >= 0, value, 0)

        def point(of: np.ndarray, k: int = 0) -> tuple[np.ndarray, np.ndarray]:
            both = self.data[(self.place[record(XY)[of]] + 4 + 8 * k)[:, None] + np.arange(8)].view(">i4").astype(np.int64)
            return both[:, 0], both[:, 1]

        def spread(at: np.ndarray, many: np.ndarray, step: int) -> np.ndarray:
            return np.repeat(at - step * (np.cumsum(many) - many), many) + step * np.arange(many.sum())

        def text(kind: int, of: np.ndarray) -> pa.Array:
            own = record(kind)[of]
            at, size = self.place[own] + 4, np.where(own >= 0, self.size[own], 0)
            while (padded := (size > 0) & (self.data[at + size - 1] == 0)).any():
                size = size - padded
            offsets = np.append(0, np.cumsum(size)).astype(np.int32)
            raw = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(offsets), pa.py_buffer(self.data[spread(at, size, 1)])])
            try:
                return raw.cast(pa.string())
            except pa.ArrowInvalid:
                return pa.array([b.decode("utf-8", "replace") for b in raw.to_pylist()], pa.string())

        def rows(kind: str, of: np.ndarray, **columns) -> pa.RecordBatch:
            n = len(of)
            columns |= {"file": pa.repeat(part.path, n), "chunk": pa.repeat(pa.scalar(part.number, pa.int32()), n), "kind": pa.repeat(kind, n),
                        "place": self.base + self.place[starts[of]], "cell": names.take(pa.array(cells[of]))}
            arrays = [pa.nulls(n, t) if (own := columns.get(name)) is None else own if isinstance(own, pa.Array) else pa.array(own, t) for name, t in _FIELDS]
            return pa.RecordBatch.from_arrays(arrays, [name for name, _ in _FIELDS])

        if len(of := np.flatnonzero(shape & ~single)):
            many, at = points[of], self.place[record(XY)[of]] + 4
            ends = np.flatnonzero(many > 1)
            same = self.data[at[ends][:, None] + np.arange(8)] == self.data[(at + 8 * many - 8)[ends][:, None] + np.arange(8)]
            many[ends] -= same.all(1)
            xy = self.data[spread(at, many, 8)[:, None] + np.arange(8)].view(">i4").astype(np.int64) * unit
            ring = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)), pa.int32()), pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], fields=list(_POINT)))
            yield rows("shape", of, layer=word(LAYER, of), datatype=np.where(self.kind[starts[of]] == BOX, word(BOXTYPE, of), word(DATATYPE, of)), ring=ring)
        if len(of := np.flatnonzero(label & ~single & (points > 0))):
            x, y = point(of)
            yield rows("label", of, layer=word(LAYER, of), datatype=word(TEXTTYPE, of), text=text(STRING, of), x=x * unit, y=y * unit)
        if len(of := np.flatnonzero(ref & ~single & (points > 0))):
            array = (self.kind[starts[of]] == AREF) & (record(COLROW)[of] >= 0) & (points[of] >= 3)
            x, y = point(of)
            many = np.where(array[:, None], fixed(COLROW, of, 4).view(">i2").astype(np.int32), 1)
            dx, dy = np.zeros(len(of)), np.zeros(len(of))
            (ax, ay), (bx, by) = point(of[array], 1), point(of[array], 2)
            dx[array], dy[array] = (ax - x[array]) / np.maximum(1, many[array, 0]), (by - y[array]) / np.maximum(1, many[array, 1])
            skew = np.zeros(len(of), bool)
            skew[array] = ((many[array, 0] != 1) & (ay != y[array])) | ((many[array, 1] != 1) & (bx != x[array]))
            single[of[skew]] = True
            held_ = lambda kind, value: pa.array(value, mask=record(kind)[of] < 0)
            batch = rows("ref", of, ref=text(SNAME, of), x=x * unit, y=y * unit, magnification=held_(MAG, real8s(fixed(MAG, of, 8))),
                         rotation=held_(ANGLE, real8s(fixed(ANGLE, of, 8)) * (math.pi / 180)), x_reflection=(record(STRANS)[of] >= 0) & (fixed(STRANS, of, 2)[:, 0] & 128 > 0),
                         columns=pa.array(many[:, 0], mask=~array), rows=pa.array(many[:, 1], mask=~array), dx=pa.array(dx * unit, mask=~array), dy=pa.array(dy * unit, mask=~array))
            yield batch.filter(pa.array(~skew)) if skew.any() else batch
        slow = []
        for e in np.flatnonzero(single):
            fields: dict[int, bytes] = {}
            for k in range(starts[e] + 1, stops[e]):
                fields.setdefault(int(self.kind[k]), self._bytes(k))
            name = names[int(cells[e])].as_py()
            slow += [row | {"place": self.base + int(self.place[starts[e]]), "cell": name} for row in _element(int(self.kind[starts[e]]), fields, unit)]
        if slow:
            yield StreamReader._batch(part, slow)


class StreamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("chunk", CHUNK))
        self.kinds = frozenset(options.get("kinds", "shape,ref,label").split(","))  # rows of others are left out
        # file: {chunk: proven first place}; only these are read
        self.again = {f: {int(k): v for k, v in own.items()} for f, own in json.loads(options.get("again", "{}")).items()}

    def partitions(self) -> list[Chunk]:
        from pyarrow import fs

        system, path = _open(self.path)
        info = system.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(path)) if f.is_file and not f.base_name.startswith(("_", "."))]
        prefix = self.path.removesuffix(path)
        chunks = [Chunk(prefix + f.path, k, k * self.size, min(f.size, (k + 1) * self.size), self.again.get(prefix + f.path, {}).get(k))
                  for f in sorted(files, key=lambda f: f.path) for k in range(max(1, -(-f.size // self.size)))]
        return [c for c in chunks if c.proven is not None] if self.again else chunks

    def read(self, part: Chunk) -> Iterator[pa.RecordBatch]:
        system, path = _open(part.path)
        with system.open_input_file(path) as handle:
            unit = next((real8(data[:8]) for _, kind, data in records(handle, 0, 4096) if kind == UNITS), 1.0)
            first = 0 if not part.number else part.proven if part.proven is not None else _first_seam(handle, part.start, part.end)
            cell, last = None, first
            for block in _blocks(handle, first, part.end) if first is not None else ():
                last = block.end
                for batch in block.batches(part, cell, unit, self.kinds):
                    yield batch
                cell = block.last_cell(cell)
            yield self._batch(part, [{"kind": "seam", "cell": cell, "first": first, "last": last, "place": part.end}])

    @staticmethod
    def _batch(part: Chunk, rows: list[dict]) -> pa.RecordBatch:
        own = {"file": part.path, "chunk": part.number}
        return pa.RecordBatch.from_arrays([pa.array([own[n] if n in own else r.get(n) for r in rows], t) for n, t in _FIELDS], [n for n, _ in _FIELDS])


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


def _rows(data: np.ndarray, there: np.ndarray | None = None) -> pa.Array:
    """Rows of bytes as binary values, empty where nothing is there."""
    many = np.full(len(data), data.shape[1]) if there is None else data.shape[1] * there
    kept = data if there is None else data[there]
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(np.append(0, np.cumsum(many)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(kept, np.uint8))])


def _heads(kind: int, form: int, size: np.ndarray) -> pa.Array:
    """The four bytes before data of so many bytes."""
    head = np.empty((len(size), 4), np.uint8)
    head[:, :2] = (size + 4).astype(">u2")[:, None].view(np.uint8)
    head[:, 2:] = kind, form
    return _rows(head)


def _fixed(kind: int, form: int, data: np.ndarray, there: np.ndarray | None = None) -> pa.Array:
    """One record for each row of bytes."""
    head = np.broadcast_to(np.frombuffer(struct.pack(">HBB", data.shape[1] + 4, kind, form), np.uint8), (len(data), 4))
    return _rows(np.hstack([head, data]), there)


def _strings(kind: int, values: pa.Array) -> pa.Array:
    data = values.cast(pa.binary())
    size = pc.binary_length(data).to_numpy(zero_copy_only=False).astype(np.int64)
    odd = size % 2
    if len(size) and (size + odd).max() > 65530:
        raise StrictModeError("a record holds 65,530 bytes at most")
    return _joined(_heads(kind, 6, size + odd), data, pc.if_else(pa.array(odd > 0), pa.scalar(b"\0"), pa.scalar(b"")))


def _whole(values: np.ndarray, kind: type) -> np.ndarray:
    """Rounded numbers as bytes, big end first, a row for each row."""
    rounded, most = np.rint(np.asarray(values, np.float64)), np.iinfo(kind).max
    if not ((rounded >= -most - 1) & (rounded <= most)).all():
        raise StrictModeError(f"a number is out of the range of {np.dtype(kind).itemsize} bytes")
    turned = np.ascontiguousarray(rounded.reshape(len(rounded), -1).astype(np.dtype(kind).newbyteorder(">")))
    return turned.view(np.uint8).reshape(len(rounded), -1)


def _joined(*pieces: pa.Array | bytes) -> pa.Array:
    return pc.binary_join_element_wise(*[pa.scalar(p) if isinstance(p, bytes) else p for p in pieces], pa.scalar(b""))


def _number(rows: pa.RecordBatch, name: str) -> np.ndarray:
    return pc.fill_null(rows.column(name), 0).to_numpy(zero_copy_only=False)


def _there(rows: pa.RecordBatch, name: str) -> np.ndarray:
    return pc.is_valid(rows.column(name)).to_numpy(zero_copy_only=False)


def _corners(rows: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """x and y of the three points of each reference; only an array has more than the first."""
    x, y, array = _number(rows, "x"), _number(rows, "y"), _there(rows, "columns") & _there(rows, "rows")
    return x, y, x + np.where(array, _number(rows, "columns") * _number(rows, "dx"), 0), y, x, y + np.where(array, _number(rows, "rows") * _number(rows, "dy"), 0)


class StreamWriter(DataSourceArrowWriter):
    """One file for each task; the files get their names when all tasks have ended.

    Elements with coordinates out of the range of four bytes go to a file of their own with a coarser unit,
    of which they must be whole multiples.
    """

    def __init__(self, options: dict):
        self.path, self.unit = options["path"], float(options.get("unit", 0.001))

    def _unit(self, level: int) -> float:
        return float(Decimal(repr(self.unit)).scaleb(level))

    def _levels(self, kind: str, rows: pa.RecordBatch) -> np.ndarray:
        """For each row the first of the units in which its coordinates fit four bytes; all rows are of one kind."""
        needed = {"shape": ("ring",), "label": ("x", "y", "text")}.get(kind, ("ref", "x", "y"))
        if any(rows.column(name).null_count for name in needed):
            raise StrictModeError(f"null in {', '.join(needed)} of a {kind}")
        n, most = len(rows), np.iinfo(np.int32).max
        if kind == "shape":
            owner = np.repeat(np.arange(n), pc.list_value_length(rows.column("ring")).to_numpy())
            values = [f.to_numpy(zero_copy_only=False) for f in rows.column("ring").flatten().flatten()]
        else:
            owner, values = np.arange(n), (_number(rows, "x"), _number(rows, "y")) if kind == "label" else _corners(rows)
        values, levels = np.column_stack(values), np.zeros(n, np.int64)
        for level in range(LEVELS):
            rounded = np.rint(values / self._unit(level))
            if level and (rounded * 10.0**level != np.rint(values / self.unit)).any():
                raise StrictModeError(f"a number is out of the range of 4 bytes in units of {self.unit} and no multiple of {self._unit(level)}")
            far = ~((rounded >= -most - 1) & (rounded <= most)).all(1)
            if not far.any() or not np.isfinite(values[far]).all():
                break
            again = np.zeros(n, bool)
            again[owner[far]] = True
            levels[again] = level + 1
            values, owner = values[again[owner]], owner[again[owner]]
        else:
            raise StrictModeError("a number is out of the range of 4 bytes in any unit")
        return levels

    def _record(self, kind: int, form: int, data: bytes = b"") -> bytes:
        data += b"\0" * (len(data) % 2)
        if len(data) > 65530:
            raise StrictModeError("a record holds 65,530 bytes at most")
        return struct.pack(">HBB", len(data) + 4, kind, form) + data

    def _encoded(self, kind: str, rows: pa.RecordBatch, unit: float) -> pa.Array:
        """The bytes of each row; all rows are of one kind."""
        n = len(rows)
        column = {name: rows.column(name) for name in rows.schema.names}
        number, there = (lambda name: _number(rows, name)), (lambda name: _there(rows, name))
        word = lambda kind, name: _fixed(kind, 2, _whole(number(name), np.int16))
        points = lambda *values: _whole(np.column_stack([v / unit for v in values]), np.int32)
        end = self._record(ENDEL, 0)
        if kind == "shape":
            rings, flat = column["ring"], column["ring"].flatten()
            many = pc.list_value_length(rings).to_numpy().astype(np.int64)
            if n and not many.min():
                raise StrictModeError("a ring without points")
            x, y = (f.to_numpy(zero_copy_only=False) for f in flat.flatten())
            stop = np.cumsum(many)
            first, last = stop - many, stop - 1
            open_ = (x[first] != x[last]) | (y[first] != y[last])
            data = points(x, y)
            size = 8 * (many + open_)
            if n and size.max() > 65530:
                raise StrictModeError("a record holds 65,530 bytes at most")
            body = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((8 * np.append(0, stop)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
            return _joined(self._record(BOUNDARY, 0), word(LAYER, "layer"), word(DATATYPE, "datatype"), _heads(XY, 3, size), body, _rows(data[first], open_), end)
        if kind == "label":
            return _joined(self._record(TEXT, 0), word(LAYER, "layer"), word(TEXTTYPE, "datatype"), _fixed(XY, 3, points(number("x"), number("y"))), _strings(STRING, column["text"]), end)
        array, turned, scaled = there("columns") & there("rows"), there("rotation"), there("magnification")
        flip = pc.fill_null(column["x_reflection"], False).to_numpy(zero_copy_only=False).astype(bool)
        columns, rows_ = number("columns"), number("rows")
        far = points(*_corners(rows))
        return _joined(
            _rows(np.where(array[:, None], *(np.frombuffer(self._record(k, 0), np.uint8) for k in (AREF, SREF)))), _strings(SNAME, column["ref"]),
            _fixed(STRANS, 1, np.column_stack([np.where(flip, 128, 0), np.zeros(n)]).astype(np.uint8), flip | scaled | turned),
            _fixed(MAG, 5, to_real8s(number("magnification")), scaled), _fixed(ANGLE, 5, to_real8s(number("rotation") * (180 / math.pi)), turned),
            _fixed(COLROW, 2, _whole(np.where(array[:, None], np.column_stack([columns, rows_]), 0), np.int16), array),
            _fixed(XY, 3, far, array), _fixed(XY, 3, far[:, :8], ~array), end)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = _open(self.path)
        dates, outs, last, names = bytes(24), {}, {}, []
        system.create_dir(path)
        with ExitStack() as stack:
            def begin(level: int) -> None:
                names.append(f"{path}/_part-{uuid.uuid4().hex}.stream")
                unit, outs[level] = self._unit(level), stack.enter_context(system.open_output_stream(names[-1]))
                outs[level].write(self._record(HEADER, 2, struct.pack(">h", 600)) + self._record(BGNLIB, 2, dates) + self._record(LIBNAME, 6, b"LIB") + self._record(UNITS, 5, to_real8(unit) + to_real8(unit * 1e-6)))

            for batch in iterator:
                if not len(batch):
                    continue
                if batch.column("cell").null_count:
                    raise StrictModeError("an element without a cell")
                kind = np.array([k if k in ("shape", "label") else "ref" for k in batch.column("kind").to_pylist()])
                bodies: dict[int, list[tuple[np.ndarray, pa.Array]]] = {}
                for one in np.unique(kind):
                    own = np.flatnonzero(kind == one)
                    levels = self._levels(str(one), batch.take(pa.array(own)))
                    for level in np.unique(levels).tolist():
                        some = own[levels == level]
                        bodies.setdefault(level, []).append((some, self._encoded(str(one), batch.take(pa.array(some)), self._unit(level))))
                for level, parts in sorted(bodies.items()):
                    if level not in outs:
                        begin(level)
                    order = np.concatenate([some for some, _ in parts])
                    body = pa.concat_arrays([b for _, b in parts]).take(pa.array(np.argsort(order)))
                    cells, cell = batch.column("cell").take(pa.array(np.sort(order))), last.get(level)
                    fresh = np.append(cell != cells[0].as_py(), pc.not_equal(cells[1:], cells[:-1]).to_numpy(zero_copy_only=False)).astype(bool)
                    ended = fresh & ~((np.arange(len(fresh)) == 0) & (cell is None))
                    start = _joined(self._record(BGNSTR, 2, dates), _strings(STRNAME, cells))
                    every = _joined(pc.if_else(pa.array(ended), pa.scalar(self._record(ENDSTR, 0)), pa.scalar(b"")), pc.if_else(pa.array(fresh), start, pa.scalar(b"")), body)
                    outs[level].write(every.buffers()[2].slice(0, np.frombuffer(every.buffers()[1], np.int32)[len(every)]))
                    last[level] = cells[len(cells) - 1].as_py()
            if not outs:
                begin(0)
            for level, out in outs.items():
                out.write((self._record(ENDSTR, 0) if level in last else b"") + self._record(ENDLIB, 0))
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = _open(self.path)
        for path in (p for m in messages if m for p in m.paths):
            system.move(path, path.replace("/_part-", "/part-"))

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = _open(self.path)
        for path in (p for m in messages if m for p in m.paths):
            system.delete_file(path)


class StreamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> StreamReader:
        return StreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options)


def write_stream(elements: DataFrame, path: str, order_by: list[str], unit: float = 0.001, parts: int = 1) -> None:
    """Write elements (the columns of ``SCHEMA`` from ``kind`` on, seams and ``place`` left out) as files in a folder.

    Rows are dealt out by ranges of (cell, order): a structure of very many elements goes on in the next file.
    """
    elements.sparkSession.dataSource.register(StreamSource)
    names = [n for n, _ in _FIELDS[2:] if n not in ("place", "first", "last")]
    missing = {n: F.lit(None).cast(dict(f.split(" ", 1) for f in re.split(r", (?![^<]*>)", SCHEMA))[n]) for n in names if n not in elements.columns}
    sorted_ = elements.withColumns(missing).repartitionByRange(parts, "cell", *order_by).sortWithinPartitions("cell", *order_by)
    sorted_.select(*names).write.format(FORMAT).mode("append").option("path", path).option("unit", str(unit)).save()


def read_elements(spark: SparkSession, path: str, chunk: int = CHUNK, kinds: tuple[str, ...] = ("shape", "ref", "label")) -> DataFrame:
    """All elements of a stream file, or of the files of a folder: the columns of ``SCHEMA`` with the cell of every row.

    Every record is walked and proven; rows are made for the elements of ``kinds``.

    ``(file, place)`` is the order of the elements. Coordinates are in user units; a ring doesn't repeat its first
    point; paths are outlines; rotations are in radians. Empty structures leave no row. A file that breaks
    off or holds what is no record raises ``StrictModeError``.
    """
    spark.dataSource.register(StreamSource)
    load = lambda **options: spark.read.format(FORMAT).option("path", path).option("chunk", str(chunk)).option("kinds", ",".join(kinds)).options(**options).load()
    parts = [materialise(load())]
    # one row for each chunk of bytes, far fewer than elements
    seams = {(r.file, r.chunk): r for r in parts[0].where("kind = 'seam'").select("file", "chunk", "cell", "first", "last", "place").collect()}
    entry: list[tuple[str, int, int, str | None]] = []  # file, chunk, which read of it counts, cell it begins in
    for file, own in groupby(sorted(seams), lambda k: k[0]):
        cell, expected = None, 0
        for key in own:
            seam, read = seams[key], 0
            if expected >= seam.place and key[1]:
                continue  # an element or structure reaches over this chunk: nothing begins here
            if seam.first != expected:
                again = materialise(load(again=json.dumps({file: {key[1]: expected}})))
                parts.append(again)
                read, seam = len(parts) - 1, again.where("kind = 'seam'").select("file", "chunk", "cell", "first", "last", "place").first()
            if seam.last < seam.place:
                if not _ends_library(file, seam.last):
                    raise StrictModeError(f"{file} holds no record at byte {seam.last}")
            entry.append((file, key[1], read, cell))
            cell, expected = seam.cell or cell, seam.last
    rows = [part.withColumn("_read", F.lit(k)) for k, part in enumerate(parts)]
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    counts = spark.createDataFrame(entry, "file string, chunk int, _read int, _cell string") if len(entry) > 64 else literal_rows(spark, entry, "file string, chunk int, _read int, _cell string")
    # one row for each chunk
    joined = every.where("kind <> 'seam'").join(F.broadcast(counts), ["file", "chunk", "_read"])
    names = [n for n, _ in _FIELDS if n not in ("first", "last")]
    return joined.withColumn("cell", F.coalesce("cell", "_cell")).select(*names)


def _ends_library(file: str, place: int) -> bool:
    """Whether the library's end lies right before ``place``; a file may be padded behind it."""
    system, path = _open(file)
    with system.open_input_file(path) as handle:
        handle.seek(max(0, place - 4))
        return handle.read(4) == bytes((0, 4, ENDLIB, 0))


def layout_tables(elements: DataFrame) -> dict[str, DataFrame]:
    """``geometries``, ``instances`` and ``textlabels`` from the elements of a stream."""
    labels = elements.where("kind = 'label'").withColumnRenamed("datatype", "texttype")
    return {"geometries": geometry_rows(elements.where("kind = 'shape'")), "instances": instance_rows(elements.where("kind = 'ref'")), "textlabels": label_rows(labels)}


def read_layout(spark: SparkSession, path: str, chunk: int = CHUNK) -> dict[str, DataFrame]:
    """The four layout tables of a stream: those of ``layout_tables`` and ``bbox``."""
    elements = materialise(read_elements(spark, path, chunk))
    tables = layout_tables(elements)
    return tables | {"bbox": cell_boxes(elements.where("kind = 'shape'"), tables["instances"])}
