"""Token ids in Arrow IPC files of equal-length sequences.

Each file is an Arrow IPC file whose record batches have two fixed-size-list columns, ``ids`` (uint16
where the vocabulary fits, else uint32) and ``mask`` (boolean, a bit each: set where an id is real). Documents follow one another without
gaps and are cut into sequences of ``length`` ids; only a file's last sequence is
padded. Lists of a fixed size need no offsets, so sequence ``i`` is a slice of the mapped
file and is read without copying. An index file beside each file gives the documents:
doc_id, and first position and number of ids within the file.

Documents are range-partitioned by (doc_id, digest) and sorted, one file for each partition. Files are
written under another name and renamed when whole, so a repeated task replaces
its file by an equal one. Paths may be in any store that pyarrow.fs reads.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from variscope.llm.bpe import Packer
from variscope.session import cut, scratch_dir

INDEX = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64())])


def sequences(length: int, kind: pa.DataType) -> pa.Schema:
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


def id_type(path: str) -> pa.DataType:
    """The narrowest type that holds all ids of a tokenizer file."""
    return pa.uint16() if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else pa.uint32()


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


_packers: dict[str, Packer] = {}


def library_packer(path: str) -> Packer:
    """Packed ids by the tokenizers library, one memory for each Python worker.

    Words of ASCII go to the library's merges directly.
    """
    if path in _packers:
        return _packers[path]
    tokenizer = Tokenizer.from_file(path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    merges = tokenizer.model.tokenize
    whole = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    _packers[path] = Packer(lambda word: [t.id for t in merges(word)] if word.isascii() else whole(word), whole, special)
    return _packers[path]


class _File:
    """Writer of one file and its index."""

    def __init__(self, folder: str, number: int, length: int, batch: int, kind: pa.DataType) -> None:
        self.fs, self.root = _store(folder)
        self.kind, self.schema, self.size = kind, sequences(length, kind), kind.bit_width // 8
        self.length, self.batch, self.name = length, batch, f"{self.root}/part-{number:06d}"
        self.draft = f"{self.name}.{uuid.uuid4().hex}.draft"
        self.out = self.fs.open_output_stream(f"{self.draft}.arrow")
        self.writer = pa.ipc.new_file(self.out, self.schema)
        self.index: list[tuple[int | None, int, int]] = []
        self.rest, self.written = bytearray(), 0

    def _put(self, data: bytes, real: int) -> None:
        n = len(data) // self.size
        ids = pa.FixedSizeListArray.from_arrays(pa.Array.from_buffers(self.kind, n, [None, pa.py_buffer(data)]), self.length)
        mask = pa.FixedSizeListArray.from_arrays(pa.array(np.arange(n) < real), self.length)
        self.writer.write_batch(pa.RecordBatch.from_arrays([ids, mask], schema=self.schema))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.index.append((doc_id, self.written, len(ids)))
        self.written += len(ids)
        self.rest += ids.astype(self.kind.to_pandas_dtype()).tobytes()
        step = self.size * self.length * self.batch
        whole = len(self.rest) // step * step
        if whole:
            self._put(bytes(self.rest[:whole]), whole // self.size)
            del self.rest[:whole]

    def close(self) -> None:
        real = len(self.rest) // self.size
        if real:
            self._put(bytes(self.rest) + bytes(-len(self.rest) % (self.size * self.length)), real)
        self.writer.close()
        self.out.close()
        with self.fs.open_output_stream(f"{self.draft}.index") as out, pa.ipc.new_file(out, INDEX) as writer:
            columns = zip(*self.index, strict=True)
            writer.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=INDEX))
        for kind in ("arrow", "index"):
            self.fs.move(f"{self.draft}.{kind}", f"{self.name}.{kind}")


def write_token_files(docs: DataFrame, folder: str, path: str, *, doc_id: str = "doc_id", text: str = "text", end: int = 1, length: int = 2048, batch: int = 64) -> DataFrame:
    """Write the ids of all documents, each followed by ``end``, in ascending doc_id order.

    Returns the written list of files: file, n_docs, n_tokens, start (ids in all files before).
    Null texts are empty; null ids come first; rows of the same id are ordered by digest of
    their texts. No documents, no files.
    """
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("_digest", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "_digest").sortWithinPartitions("doc_id", "_digest").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, file, tail, kind = library_packer(path), None, array("i", [end]).tobytes(), id_type(path)
        number = TaskContext.get().partitionId()
        for b in batches:
            for i in range(b.num_rows):
                file = file or _File(folder, number, length, batch, kind)
                file.add(b.column(0)[i].as_py(), np.frombuffer(pack(b.column(1)[i].as_py()) + tail, np.int32))
        if file:
            file.close()
            yield pa.RecordBatch.from_pydict({"file": [number], "n_docs": [len(file.index)], "n_tokens": [file.written]}, pa.schema([("file", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    files = cut(ordered.mapInArrow(run, "file long, n_docs long, n_tokens long"))
    # One row for each file: few, whatever the documents.
    before = Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def open_token_file(folder: str, number: int) -> tuple[pa.ipc.RecordBatchFileReader, pa.Table]:
    """Reader of one file and its index; local files are mapped and read without copying."""
    store, root = _store(folder)
    name = f"{root}/part-{number:06d}"

    def opened(kind: str):
        local = isinstance(store, fs.LocalFileSystem)
        return pa.ipc.open_file(pa.memory_map(f"{name}.{kind}") if local else store.open_input_file(f"{name}.{kind}"))

    return opened("arrow"), opened("index").read_all()


def sequence(reader: pa.ipc.RecordBatchFileReader, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of one sequence, found without reading others; the ids are a view of the file.

    All batches but the last have as many rows as the first.
    """
    size = reader.get_batch(0).num_rows
    b, row = reader.get_batch(number // size), number % size
    length = b.schema.field(0).type.list_size
    ids, mask = (b.column(c).flatten().slice(row * length, length) for c in (0, 1))
    return ids.to_numpy(zero_copy_only=True), mask.to_numpy(zero_copy_only=False)


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """One row for each document in the files: doc_id, start, n_tokens, ids_crc32.

    ``files`` is what ``write_token_files`` returned; each task opens files of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                reader, index = open_token_file(folder, number)
                have, at, sums, batch = b"", 0, [], 0  # ids from position ``at`` on that are not worked off yet
                for first, n in zip(index["first"].to_pylist(), index["n_tokens"].to_pylist(), strict=True):
                    crc = 0
                    while n:
                        if not have:
                            part = reader.get_batch(batch)
                            ids = part.column(0).flatten().to_numpy(zero_copy_only=True)[: part.column(1).flatten().true_count]
                            have, batch = memoryview(ids.astype("<u4")).cast("B"), batch + 1
                        take = min(n * 4, len(have))
                        crc, have, n, at = zlib.crc32(have[:take], crc), have[take:], n - take // 4, at + take // 4
                    sums.append(crc)
                starts = pa.array(np.asarray(index["first"]) + base, pa.int64())
                yield pa.RecordBatch.from_arrays([index["doc_id"].combine_chunks(), starts, index["n_tokens"].combine_chunks(), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # Rows of the list are small, but what they stand for is not: about a task for each file.
    tasks = max(1, files.count())
    return files.select("file", "start").repartition(tasks, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_folder(docs: DataFrame) -> str:
    """A new folder below the shared one."""
    return f"{scratch_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
