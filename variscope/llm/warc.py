"""Web archives with a two-level index of captures.

Pages are range-partitioned by a key that starts with the reversed host, so that a site lies together and
a hot host spreads over partitions, and sorted. Each partition becomes an archive of WARC records,
a gzip member each. Payloads that are the same are stored once: the page with the smallest id
is a response, the others are revisits that refer to it.

The index has two levels. Its lines (key, page id, place of the record) are cut into compressed blocks of
``block`` lines; a sparse directory names the first key of each block and its place. A lookup finds
the archive, then the block in the directory, then the line in the block, each by binary search, and reads
only the directory, one block and the bytes of the records.

Files are written under another name and renamed when whole, so a repeated task replaces its file by an equal one.
Paths may be in any store that pyarrow.fs reads.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from variscope.session import cut, scratch_dir

#: Lines of an index block; bytes of neighbouring records that are read at once.
BLOCK, STRETCH = 3000, 4 << 20
#: The table has no time of capture; records need one.
DATE = "1970-01-01T00:00:00Z"
BLOCKS = "file int, block int, first_key string, last_key string, n long, start long, size long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
_URL = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)((?::[0-9]+)?)([^#]*)"


def capture_key(url: Column) -> Column:
    """``org,example,www)/path?query`` of a URL: labels of the host from the last to the first, without fragment.

    Text that is no URL with a host keeps its own form after a bracket; null is the empty text.
    """
    url = F.coalesce(url, F.lit(""))
    host, port, rest = (F.regexp_extract(url, _URL, i) for i in (1, 2, 3))
    turned = F.array_join(F.reverse(F.split(F.lower(host), r"\.")), ",")
    return F.when(host == "", F.concat(F.lit(")"), url)).otherwise(
        F.concat(turned, port, F.lit(")"), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))))


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@dataclass(frozen=True)
class Archive:
    """A written archive: its folder, and a row for each index block (file, block, keys, place)."""

    folder: str
    blocks: DataFrame


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _name(root: str, number: int, kind: str) -> str:
    return f"{root}/part-{number:06d}.{kind}"


def _zipped(data: bytes, level: int = 6) -> bytes:
    out = zlib.compressobj(level, zlib.DEFLATED, 31)
    return out.compress(data) + out.flush()


def _uri(text: str) -> str:
    """Without the characters that would end a header line; ``%`` is kept as it is."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def record(page_id: int | None, url: str | None, payload: bytes, of: tuple[int | None] | None, name: str) -> bytes:
    """One WARC record. ``of`` is None for a response, else holds the page id of the response it refers to."""
    digest = base32_sha1(payload)
    known = lambda p: uuid.uuid5(uuid.NAMESPACE_OID, f"{p}:{digest}")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if of is None else http
    lines = ["WARC/1.1", f"WARC-Type: {'response' if of is None else 'revisit'}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}",
             f"WARC-Record-ID: <urn:uuid:{known(page_id) if of is None else uuid.uuid5(uuid.NAMESPACE_OID, name)}>",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", f"Payload-Length: {len(payload)}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_uri(url)}")
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if of is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{known(of[0])}>"]
        if of[0] is not None:
            lines.append(f"Refers-To-Page-ID: {of[0]}")
    return _zipped("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def parse(member: bytes) -> tuple[dict[str, str], bytes | None]:
    """Headers, and the payload of a response; a record that is cut short or altered raises ValueError."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if lines[0] != "WARC/1.1" or len(block) < int(headers["Content-Length"]):
        raise ValueError("not a whole WARC record")
    if headers["WARC-Type"] == "revisit":
        return headers, None
    payload = block.partition(b"\r\n\r\n")[2]
    if f"sha1:{base32_sha1(payload)}" != headers["WARC-Payload-Digest"] or len(payload) != int(headers["Payload-Length"]):
        raise ValueError(f"payload of {headers['WARC-Record-ID']} differs from its digest")
    return headers, payload


class _File:
    """Writer of one archive, its index and its directory."""

    def __init__(self, folder: str, number: int, block: int) -> None:
        self.fs, root = _store(folder)
        self.number, self.block = number, block
        self.kinds = {kind: (_name(root, number, kind), f"{_name(root, number, kind)}.{uuid.uuid4().hex}.draft") for kind in ("warc.gz", "index", "dir")}
        self.out = {kind: self.fs.open_output_stream(draft) for kind, (_, draft) in self.kinds.items()}
        self.lines: list[list] = []
        self.directory: list[list] = []
        self.at = self.end = self.n = 0

    def add(self, key: str, page_id: int | None, url: str | None, payload: bytes, of: tuple[int | None] | None) -> None:
        data = record(page_id, url, payload, of, f"{self.kinds['warc.gz'][0].rsplit('/', 2)[1]}/{self.number}/{self.n}")
        self.out["warc.gz"].write(data)
        self.lines.append([key, page_id, self.at, len(data)])
        self.at, self.n = self.at + len(data), self.n + 1
        if len(self.lines) == self.block:
            self._end_block()

    def _end_block(self) -> None:
        data = _zipped("\n".join(map(json.dumps, self.lines)).encode())
        self.out["index"].write(data)
        self.directory.append([self.lines[0][0], self.lines[-1][0], len(self.lines), self.end, len(data)])
        self.lines, self.end = [], self.end + len(data)

    def close(self) -> pa.RecordBatch:
        if self.lines:
            self._end_block()
        self.out["dir"].write("\n".join(map(json.dumps, self.directory)).encode())
        for kind, (name, draft) in self.kinds.items():
            self.out[kind].close()
            self.fs.move(draft, name)
        first, last, n, start, size = zip(*self.directory, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array([self.number] * len(n), pa.int32()), pa.array(range(len(n)), pa.int32()), pa.array(first), pa.array(last), *(pa.array(x, pa.int64()) for x in (n, start, size))],
            ["file", "block", "first_key", "last_key", "n", "start", "size"])


def write_warc(pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0, block: int = BLOCK) -> Archive:
    """Write a record for every row, with index and directory.

    Null pages are empty payloads. Of equal payloads of ``least`` bytes or more the one with the smallest page id is
    the response (null ids last, then the smaller URL); smaller payloads are all responses. Rows equal in id, URL and
    payload are kept as often as they come: one response, the others revisits of their own id. No rows, no files.
    """
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("sha", F.when(F.length("payload") >= least, F.unhex(F.sha2("payload", 256))))
    who = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")
    # Only payloads that come more than once: usually few, so that Spark sends them to the tasks; else the pages are the side it splits.
    repeated = cut(rows.where("sha is not null").select("sha", who.alias("w")).groupBy("sha").agg(F.min("w").alias("w"), F.count("*").alias("n")).where("n > 1").select(
        F.col("sha").alias("_sha"), F.col("w.page_id").alias("_page"), F.col("w.url").alias("_url"), F.lit(True).alias("_more")))
    joined = rows.join(repeated, F.col("sha") == F.col("_sha"), "left")
    same = F.col("page_id").eqNullSafe(F.col("_page")) & F.col("url").eqNullSafe(F.col("_url"))
    placed = joined.select(
        capture_key(F.col("url")).alias("key"), "page_id", "url", "payload", F.when(F.col("_more"), F.when(same, 1).otherwise(2)).otherwise(0).alias("kind"), F.col("_page").alias("of"),
        F.coalesce("sha", F.lit(b"")).alias("sha"))
    order = ["key", "page_id", "url", "sha"]
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("sha")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, before = None, None
        for b in batches:
            for i in range(b.num_rows):
                key, number, address, payload, kind, of = (c[i].as_py() for c in b.columns)
                file = file or _File(folder, TaskContext.get().partitionId(), block)
                # Equal rows stand side by side in one partition: the first of them is the response.
                revisit = kind == 2 or (kind == 1 and before == (number, address, payload))
                before = (number, address, payload) if kind == 1 else None
                file.add(key, number, address, payload, (of,) if revisit else None)
        if file:
            yield file.close()

    return Archive(folder, cut(ordered.mapInArrow(run, BLOCKS)))


def _lines(store: fs.FileSystem, root: str, number: int, start: int, size: int) -> list[list]:
    """Lines of one index block, by one range read."""
    with store.open_input_file(_name(root, number, "index")) as f:
        return [json.loads(line) for line in zlib.decompress(f.read_at(size, start), 31).split(b"\n")]


def _stretches(lines: list[list]) -> Iterator[list[list]]:
    """Neighbouring records of about STRETCH bytes."""
    held, size = [], 0
    for line in lines:
        if held and (size + line[3] > STRETCH or line[2] != held[-1][2] + held[-1][3]):
            yield held
            held, size = [], 0
        held.append(line)
        size += line[3]
    if held:
        yield held


def _captures(f, lines: list[list]) -> Iterator[tuple[dict[str, str], bytes | None]]:
    for part in _stretches(lines):
        first = part[0][2]
        data = memoryview(f.read_at(part[-1][2] + part[-1][3] - first, first))
        for _, _, start, size in part:
            yield parse(data[start - first : start - first + size])


def _row(headers: dict[str, str]) -> tuple:
    number = lambda k: int(headers[k]) if k in headers else None
    return (number("Page-ID"), headers.get("WARC-Target-URI"), number("Payload-Length"), headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"], number("Refers-To-Page-ID"))


def _rows(found: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = zip(*found, strict=True) if found else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
_NAMES = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def read_warc(archive: Archive) -> DataFrame:
    """One row for each record: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    Tasks take index blocks; length and digest of a response are worked out from the payload read, those of a
    revisit come from its headers. Records that don't agree with their digest raise.
    """
    folder = archive.folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for b in batches:
            for number, start, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with store.open_input_file(_name(root, number, "warc.gz")) as f:
                    yield _rows([_row(h) for h, _ in _captures(f, _lines(store, root, number, start, size))], _KINDS, _NAMES)

    # A row for each block, but thousands of records behind it: about a task for each.
    tasks = max(1, archive.blocks.count())
    return archive.blocks.select("file", "start", "size").repartition(tasks, "file", "start").mapInArrow(run, RECORDS)


def find_captures(archive: Archive, urls: DataFrame, *, url: str = "url") -> DataFrame:
    """(asked, page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload): captures of each distinct URL in ``urls``.

    URLs meet by capture key, so case of the host and fragments don't matter. Keys are sorted over the tasks;
    each finds the archives that may hold it by binary search over their first keys (a row for each archive is sent to the tasks),
    the blocks in the archive's directory and the lines in a block. The payload of a revisit is null: it is the one of its response.
    """
    folder = archive.folder
    files = sorted((r["first"], r["last"], r["file"]) for r in archive.blocks.groupBy("file").agg(F.min("first_key").alias("first"), F.max("last_key").alias("last")).collect())
    firsts, lasts = [f[0].encode() for f in files], [f[1].encode() for f in files]
    order = sorted(range(len(files)), key=lambda i: firsts[i])
    firsts, lasts, numbers = [firsts[i] for i in order], [lasts[i] for i in order], [files[i][2] for i in order]
    asked = urls.where(F.col(url).isNotNull()).select(capture_key(F.col(url)).alias("key"), F.col(url).alias("asked")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        directory, block = (None, []), (None, [])  # those of the key before: sorted keys mostly share them
        for b in batches:
            found = []
            for key, ask in zip(*(c.to_pylist() for c in b.columns), strict=True):
                k = key.encode()
                for i in range(bisect_left(lasts, k), bisect_right(firsts, k)):
                    number = numbers[i]
                    if directory[0] != number:
                        with store.open_input_file(_name(root, number, "dir")) as f:
                            directory = (number, [json.loads(line) for line in f.read().split(b"\n")])
                    blocks = directory[1]
                    for j in range(bisect_left(blocks, k, key=lambda x: x[1].encode()), bisect_right(blocks, k, key=lambda x: x[0].encode())):
                        if block[0] != (number, j):
                            block = ((number, j), _lines(store, root, number, *blocks[j][3:]))
                        lines = block[1]
                        hits = lines[bisect_left(lines, k, key=lambda x: x[0].encode()) : bisect_right(lines, k, key=lambda x: x[0].encode())]
                        with store.open_input_file(_name(root, number, "warc.gz")) as f:
                            for headers, payload in _captures(f, hits):
                                found.append((ask, *_row(headers), payload))
                                if len(found) == 64:
                                    yield _rows(found, [pa.string(), *_KINDS, pa.binary()], ["asked", *_NAMES, "payload"])
                                    found = []
            yield _rows(found, [pa.string(), *_KINDS, pa.binary()], ["asked", *_NAMES, "payload"])

    return asked.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, f"asked string, {RECORDS}, payload binary")


def warc_folder(pages: DataFrame) -> str:
    """A new folder below the shared one."""
    return f"{scratch_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"


WARC_SQL = """
with p as (select page_id, coalesce(html, '') as h, row_number() over (partition by coalesce(html, '') order by page_id nulls last, url nulls first) as i,
    first(page_id) over (partition by coalesce(html, '') order by page_id nulls last, url nulls first) as f from pages),
d as (select *, sha1(h) as hex from p)
select page_id, strlen(h)::bigint as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, (k // 4) * 5 + 1, 5))::bigint >> (15 - 5 * (k % 4))) & 31)::int, 1)), '') as payload_digest,
  case when i = 1 then 'response' else 'revisit' end as record_type, case when i > 1 then f end as refers_to
from d"""
