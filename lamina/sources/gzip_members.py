"""Lines of gzip files made of many members, read by many tasks.

A gzip file may hold any number of members, each compressed on its own; plain readers take the whole file for one
task. Here a task gets a range of bytes and reads the members that start in it. Where one starts shows
only when it ends as its check sum says, so a task tries each place that looks like a header and goes on behind the
member it has proven. The proven members must then cover the file without gap or overlap.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from lamina.checks import StrictModeError
from lamina.durable import materialise
from lamina.sources.stream_layout import _open

FORMAT = "lamina_gzip_members"
CHUNK = 32 << 20  # compressed bytes for one task
BLOCK = 1 << 20
SCHEMA = "file string, member bigint, line bigint, value string, beyond bigint, whole boolean"
MAGIC = b"\x1f\x8b\x08"


def member_lines(handle, start: int) -> Iterator[tuple[list[bytes], int]]:
    """Lines of the member at ``start``, some at a time, with the place behind the member once it is proven (0 before).

    Raises ``zlib.error`` where no member is.
    """
    unpack, rest, at = zlib.decompressobj(wbits=31), b"", start
    handle.seek(start)
    while not unpack.eof:
        data = handle.read(BLOCK)
        if not data:
            raise zlib.error("cut off")
        at += len(data)
        text = rest + unpack.decompress(data)
        lines = text.split(b"\n")
        rest = lines.pop()
        yield lines, 0
    yield ([rest] if rest else []), at - len(unpack.unused_data)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class MemberReader(DataSourceReader):
    def __init__(self, path: str, chunk: int):
        self.path, self.chunk = path, chunk

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        system, path = _open(self.path)
        info = system.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(path)) if f.is_file and not f.base_name.startswith(("_", "."))]
        prefix = self.path.removesuffix(path)
        return [Range(prefix + f.path, at, min(f.size, at + self.chunk)) for f in sorted(files, key=lambda f: f.path) for at in range(0, max(f.size, 1), self.chunk)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        system, path = _open(part.path)
        with system.open_input_file(path) as handle:
            at = part.start
            while at < part.end:
                handle.seek(at)
                data = handle.read(min(BLOCK, part.end - at) + 2)
                found = data.find(MAGIC)
                if found < 0:
                    at += max(1, len(data) - 2)
                    continue
                at += found
                if at >= part.end:
                    break
                number, beyond, proven = 0, 0, True
                try:
                    for _, beyond in member_lines(handle, at):  # a first time for the check sum alone
                        pass
                except zlib.error:
                    proven = False
                if not proven:
                    at += 1
                    continue
                for lines, end in member_lines(handle, at):
                    for k in range(0, len(lines), 8192):
                        own = lines[k:k + 8192]
                        yield self._batch(part.path, at, number, [x.decode("utf-8", "replace") for x in own], [None] * len(own), [None] * len(own))
                        number += len(own)
                    if end:
                        yield self._batch(part.path, at, number, [None], [end], [not lines])
                at = beyond

    @staticmethod
    def _batch(file: str, member: int, first: int, values: list, beyond: list, whole: list) -> pa.RecordBatch:
        n = len(values)
        columns = [pa.array([file] * n), pa.array([member] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()), pa.array(values, pa.string()), pa.array(beyond, pa.int64()), pa.array(whole, pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, ["file", "member", "line", "value", "beyond", "whole"])


@dataclass
class Packed(WriterCommitMessage):
    path: str


class MemberWriter(DataSourceArrowWriter):
    """One file for each task, one member for each Arrow batch of it."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Packed:
        system, path = _open(self.path)
        name = f"{path}/_{uuid.uuid4().hex}.gz"
        system.create_dir(path)
        with system.open_output_stream(name, compression=None) as out:
            for batch in iterator:
                pack = zlib.compressobj(wbits=31)
                out.write(pack.compress(b"".join((v or "").encode() + b"\n" for v in batch.column("value").to_pylist())) + pack.flush())
        return Packed(name)

    def commit(self, messages: list[Packed | None]) -> None:
        system, _ = _open(self.path)
        for m in messages:
            if m:
                system.move(m.path, m.path.replace("/_", "/part-"))

    def abort(self, messages: list[Packed | None]) -> None:
        system, _ = _open(self.path)
        for m in messages:
            if m:
                system.delete_file(m.path)


class GzipMembers(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MemberReader:
        return MemberReader(self.options["path"], int(self.options.get("chunk", CHUNK)))

    def writer(self, schema, overwrite: bool) -> MemberWriter:
        return MemberWriter(self.options["path"])


def write_members(lines: DataFrame, path: str) -> None:
    """Write the column ``value`` as gzip files of many members in a folder."""
    lines.sparkSession.dataSource.register(GzipMembers)
    lines.select(F.col("value").cast("string").alias("value")).write.format(FORMAT).mode("append").option("path", path).save()


def read_members(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """``(file, member, line, value)`` of a gzip file or the files of a folder; members are named by their first byte.

    A member has to end with a line's end, but for a file's last one. Raises ``StrictModeError`` where the members
    don't cover a file, as when it is cut off or isn't gzip.
    """
    spark.dataSource.register(GzipMembers)
    read = spark.read.format(FORMAT).option("path", path).option("chunk", str(chunk)).load()
    rows = materialise(read)
    ends: dict[str, list] = {}
    # one row for each member, far fewer than lines
    for r in rows.where("beyond IS NOT NULL").select("file", "member", "beyond", "whole").collect():
        ends.setdefault(r["file"], []).append((r["member"], r["beyond"], r["whole"]))
    for file in {p.path for p in MemberReader(path, chunk).partitions()}:
        system, own = _open(file)
        size, expected, members = system.get_file_info(own).size, 0, sorted(ends.get(file, []))
        for k, (member, beyond, whole) in enumerate(members):
            if member != expected:
                raise StrictModeError(f"{file} holds no member at byte {expected}")
            if not whole and k < len(members) - 1:
                raise StrictModeError(f"{file}: the member at byte {member} ends inside a line")
            expected = beyond
        if expected != size:
            raise StrictModeError(f"{file} holds no member at byte {expected}")
    return rows.where("beyond IS NULL").select("file", "member", "line", "value")


def read_csv(spark: SparkSession, path: str, schema: str, chunk: int = CHUNK, **options: str) -> DataFrame:
    """Rows of CSV lines without headers; a line that doesn't fit is a row of nulls. Quoted line ends are not supported."""
    parsed = read_members(spark, path, chunk).select(F.from_csv("value", schema, {"mode": "PERMISSIVE", **options}).alias("row"))
    return parsed.select("row.*")
