"""Line documents as a Spark data source: read by byte ranges, written with commit and abort.

A document is a file ``<name><suffix>``, or a folder of that name with files ``part-000000.txt`` and so on, whose names
sort in the order of the document. Reading makes a partition for each byte range of a file; the names asked for
go down to the list of files, so files of other names are never opened. Writing puts drafts aside; only those
of tasks that Spark commits get their names, so a repeated or speculative task leaves no second file.

The names go down as an option of each frame. Spark 4.1 can hand filters to a Python source, but keeps what was pushed for
one query of a frame for the others too: ``df.filter("name = 'a'")`` and then ``df.count()`` would count one name.

Paths may be in any store that pyarrow.fs reads and all executors share.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT = "line_documents"
SCHEMA = "name string, part int, at bigint, line string"
#: Bytes of a range, and of one read.
RANGE, CHUNK = 64 << 20, 1 << 20
#: Lines of an Arrow batch.
LINES = 4096
_PART = re.compile(r"part-(\d+)\.txt")


def store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def folder_name(name: str | None) -> str:
    """File name of a document; null counts as the empty name. None starts with a mark of hidden files."""
    text = quote(name or "", safe="")
    return {"": "%"}.get(text, re.sub("^[_.]", lambda m: f"%{ord(m.group()):02X}", text))


def name_of(folder: str) -> str:
    return "" if folder == "%" else unquote(folder)


@dataclass
class Range(InputPartition):
    file: str
    name: str
    part: int
    start: int
    end: int


def lines_of(f, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that start in a range of a file; the last may reach beyond it."""
    at = pos = max(0, start - 1)
    first, rest = start > 0, b""  # what precedes the first line end belongs to the range before
    while pos < size and at < end:
        chunk = f.read_at(min(CHUNK, size - pos), pos)
        pos += len(chunk)
        *whole, rest = (rest + chunk).split(b"\n")
        for line in whole:
            if not first:
                if at >= end:
                    return
                yield at, line
            first, at = False, at + len(line) + 1
    if rest and not first and at < end:
        yield at, rest


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.suffix, self.range = options["path"], options.get("suffix", ""), int(options.get("range", RANGE))
        self.names = set(json.loads(options["names"])) if "names" in options else None

    def partitions(self) -> list[Range]:
        where, root = store(self.path)
        out = []
        for info in where.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            if info.type != fs.FileType.File or any(p.startswith(("_", ".")) for p in info.path.removeprefix(root).strip("/").split("/")):
                continue
            *_, folder, base = f"/{info.path}".split("/")
            part = _PART.fullmatch(base)
            owner = folder if part else base
            if not owner.endswith(self.suffix):
                continue
            name = name_of(owner[: len(owner) - len(self.suffix)])
            if self.names is None or name in self.names:
                ends = [*range(0, info.size, self.range), info.size]
                out += [Range(info.path, name, int(part.group(1)) if part else 0, a, b) for a, b in zip(ends, ends[1:], strict=False)]
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's way to read a source without partitions
            return
        where, _ = store(self.path)
        with where.open_input_file(partition.file) as f:
            held: list[tuple[int, str]] = []
            for at, line in lines_of(f, f.size(), partition.start, partition.end):
                held.append((at, line.removesuffix(b"\r").decode()))
                if len(held) == LINES:
                    yield self._batch(partition, held)
                    held = []
            if held:
                yield self._batch(partition, held)

    def _batch(self, partition: Range, held: list[tuple[int, str]]) -> pa.RecordBatch:
        n = len(held)
        return pa.RecordBatch.from_arrays(
            [pa.array([partition.name] * n, pa.string()), pa.array([partition.part] * n, pa.int32()), pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.string())],
            ["name", "part", "at", "line"])


@dataclass
class _Written(WriterCommitMessage):
    """Names and drafts of one task."""

    task: int
    files: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.suffix, self.overwrite = options["path"], options.get("suffix", ""), overwrite
        self.drafts = f"_drafts-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        where, root = store(self.path)
        task = TaskContext.get()
        folder = f"{root}/{self.drafts}/{task.partitionId()}-{task.taskAttemptId()}"
        files: list[tuple[str, str]] = []
        out, seen = None, set()
        try:
            for batch in batches:
                for name, line in zip(batch.column("name").to_pylist(), batch.column("line").to_pylist(), strict=True):
                    if out is None or name != files[-1][0]:
                        if name in seen:
                            raise ValueError(f"rows of {name!r} don't stand together")
                        seen.add(name)
                        if out:
                            out.close()
                        where.create_dir(folder, recursive=True)
                        files.append((name, f"{folder}/{len(files)}"))
                        out = where.open_output_stream(files[-1][1])
                    out.write(f"{line}\n".encode())
        finally:
            if out:
                out.close()
        return _Written(task.partitionId(), files)

    def commit(self, messages: list[_Written | None]) -> None:
        """Give the drafts of committed tasks their names; what other attempts left goes with the draft folder."""
        where, root = store(self.path)
        if self.overwrite:
            for info in where.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if not info.base_name.startswith("_drafts-"):
                    where.delete_dir(info.path) if info.type == fs.FileType.Directory else where.delete_file(info.path)
        where.create_dir(root, recursive=True)
        made = set()
        for m in messages:
            for name, draft in m.files if m else []:
                folder = f"{root}/{folder_name(name)}{self.suffix}"
                if folder not in made:
                    where.create_dir(folder, recursive=True)
                    made.add(folder)
                where.move(draft, f"{folder}/part-{m.task:06d}.txt")
        self._clear()
        where.open_output_stream(f"{root}/_SUCCESS").close()

    def abort(self, messages: list[_Written | None]) -> None:
        """Tasks that Spark kills may write on for a moment, so the drafts are gone when they stay gone."""
        quiet = 0
        for _ in range(40):
            try:
                quiet = 0 if self._clear() else quiet + 1
            except OSError:  # a draft came while they were deleted
                quiet = 0
            if quiet == 8:
                break
            time.sleep(0.25)

    def _clear(self) -> bool:
        """Whether there were drafts."""
        where, root = store(self.path)
        found = where.get_file_info(f"{root}/{self.drafts}").type == fs.FileType.Directory
        if found:
            where.delete_dir(f"{root}/{self.drafts}")
        return found


class LineDocuments(DataSource):
    """Options: ``path``, ``suffix`` of the documents read or written, ``range`` in bytes, ``names`` to read (a JSON list)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite)


def read_documents(spark: SparkSession, path: str, suffix: str = "", names: list[str] | None = None, size: int = RANGE) -> DataFrame:
    """(name, part, at, line): lines of the documents of a folder, all or those named; (part, at) is their order within a name."""
    spark.dataSource.register(LineDocuments)
    reader = spark.read.format(FORMAT).option("suffix", suffix).option("range", str(size))
    return (reader if names is None else reader.option("names", json.dumps(sorted(names)))).load(path)


def write_documents(rows: DataFrame, path: str, name: str, order: list[str], column: str = "line", suffix: str = "", mode: str = "append") -> None:
    """Write line rows as documents named by column ``name``, lines in the given order.

    Rows are range-partitioned by name and order, so one large document is spread over several tasks, whose
    files sort in its order. ``mode`` append or overwrite.
    """
    rows.sparkSession.dataSource.register(LineDocuments)
    places = [f"_order{i}" for i in range(len(order))]
    named = rows.select(F.col(name).cast("string").alias("name"), F.col(column).alias("line"), *[F.col(c).alias(p) for c, p in zip(order, places, strict=True)])
    ordered = named.repartitionByRange("name", *places).sortWithinPartitions("name", *places)
    ordered.select("name", "line").write.format(FORMAT).option("suffix", suffix).mode(mode).save(path)
