"""Text files whose lines have an order, written by many tasks.

Rows are dealt out by ranges of their order, so the parts follow each other as the lines do. When all tasks have
ended, the parts get their names and a manifest lists them with the byte and the line that each starts at. Read one
after the other they are the file; whoever needs it as one can join them, and a reader that seeks a byte or line knows the part.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from lamina.durable import materialise
from lamina.operators.numbering import position_in_group
from lamina.sources.stream_layout import _open

FORMAT = "lamina_ordered_text"
MANIFEST = "manifest.json"


@dataclass
class Part(WriterCommitMessage):
    partition: int
    path: str
    size: int
    lines: int


class TextWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        system, path = _open(self.path)
        number, size, lines = TaskContext.get().partitionId(), 0, 0
        name = f"{path}/_{number}-{uuid.uuid4().hex}"  # a task that runs again writes another file
        system.create_dir(path)
        with system.open_output_stream(name) as out:
            for batch in iterator:
                data = b"".join((line or "").encode() + b"\n" for line in batch.column("value").to_pylist())
                out.write(data)
                size, lines = size + len(data), lines + batch.num_rows
        return Part(number, name, size, lines)

    def commit(self, messages: list[Part | None]) -> None:
        system, path = _open(self.path)
        listed, offset, line = [], 0, 1
        for part in sorted((m for m in messages if m), key=lambda m: m.partition):
            if part.lines:
                name = f"part-{offset:020d}.txt"
                system.move(part.path, f"{path}/{name}")
                listed.append({"name": name, "offset": offset, "size": part.size, "first_line": line, "lines": part.lines})
                offset, line = offset + part.size, line + part.lines
            else:
                system.delete_file(part.path)
        system.create_dir(path)
        with system.open_output_stream(f"{path}/_{MANIFEST}") as out:
            out.write(json.dumps({"size": offset, "lines": line - 1, "parts": listed}).encode())
        system.move(f"{path}/_{MANIFEST}", f"{path}/{MANIFEST}")  # the file is there when the manifest is

    def abort(self, messages: list[Part | None]) -> None:
        system, _ = _open(self.path)
        for part in messages:
            if part:
                system.delete_file(part.path)


class TextSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> TextWriter:
        return TextWriter(self.options["path"])


def write_ordered(lines: DataFrame, path: str, order_by: list[str], parts: int | None = None) -> None:
    """Write the column ``value`` in order; ``order_by`` must tell all rows apart. ``path`` is a new folder that tasks can reach."""
    spark = lines.sparkSession
    spark.dataSource.register(TextSink)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # stored first, as the sample of the ranges would work out every line once more
    dealt = materialise(lines.select(*order_by, "value")).repartitionByRange(parts, *order_by).sortWithinPartitions(*order_by)
    dealt.select(F.col("value").cast("string").alias("value")).write.format(FORMAT).mode("append").option("path", path).save()


def manifest(path: str) -> dict:
    """What a written folder holds: ``size`` and ``lines`` in all, and its ``parts`` in order."""
    system, own = _open(path)
    with system.open_input_stream(f"{own}/{MANIFEST}") as handle:
        return json.loads(handle.read())


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """``(line, value)`` of a written folder, lines numbered from 1."""
    parts = manifest(path)["parts"]
    if not parts:
        return spark.createDataFrame([], "line bigint, value string")
    text = spark.read.text([f"{path}/{p['name']}" for p in parts], wholetext=False)
    # rows of a file come in its order, block by block
    named = text.select("value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_at"))
    firsts = spark.createDataFrame([(p["name"], p["first_line"]) for p in parts], "name string, first_line bigint")
    placed = position_in_group(named, ["name"], ["block", "_at"], "inside")
    return placed.join(F.broadcast(firsts), "name").select((F.col("first_line") + F.col("inside") - 1).alias("line"), "value")
