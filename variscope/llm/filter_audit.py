"""Audit of how five text filters interact, in every order of them.

One pass over the texts notes for each document which of the filters A to D it fails, as bits of a
mask, and the SHA-256 of its text. Filter E, an identical text with a smaller id, is found by a
counting Bloom filter: every digest counts three cells of a block of 65,536; sparse partial blocks are
merged, and what is kept is a bit for each cell counted twice or more. A digest with a cell counted once is
unique for certain. Only texts that may be repeated are shuffled, whole, to their smallest id; the
documents above it get the bit of E. Blocks follow the number of documents, so that about 3 in 100 unique texts are
shuffled for nothing, whatever the size.

Counts by part and mask (32 at most for each part) are all that the 120 orders need: every figure
of the audit is a sum of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from variscope.session import cut

FILTERS = "ABCDE"
#: Fixed values of the filters: least words, least share of distinct words and largest share of capitals in per cent, marks.
MIN_WORDS, DISTINCT, CAPITALS, MARKS = 200, 50, 2, b"#$%&*|"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Cells of a block, and documents for each block: eight cells a document.
CELLS, FILL = 1 << 16, 1 << 13
#: Bytes of merged blocks that are sent to every task; one byte for each document.
SENT = 64 << 20
#: Parts that a block's digests are dealt to beyond that.
SALTS = 32
#: Digests counted in a task before it hands on its partial blocks.
HELD = 200_000


def failures(words: list[bytes], size: int, capitals: int, marked: bool) -> int:
    """Bits 1, 2, 4 and 8 for the filters A to D that a text fails."""
    n = len(words)
    return (n < MIN_WORDS) | (100 * len(set(words)) < DISTINCT * n) << 1 | (100 * capitals > CAPITALS * size) << 2 | marked << 3


def facts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(doc_id, part, mask, digest) of every row, in its order; null texts and parts are empty."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                masks, digests = [], []
                for raw, size in zip(batch.column(2).cast(pa.binary()), pc.utf8_length(batch.column(2)).to_pylist(), strict=True):
                    b = raw.as_py()
                    masks.append(failures(b.split(), size, len(b) - len(b.translate(None, UPPER)), len(b) != len(b.translate(None, MARKS))))
                    digests.append(hashlib.sha256(b).digest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"])

    return rows.mapInArrow(run, f"doc_id {kind}, part string, mask int, digest binary")


def cells(digests: pa.Array | list[bytes], blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block, and three different cells of it, for each digest of 32 bytes."""
    words = np.frombuffer(b"".join(digests if isinstance(digests, list) else digests.to_pylist()), "<u8").reshape(-1, 4)
    first, step = words[:, 1] % np.uint64(CELLS), words[:, 2] | np.uint64(1)
    return (words[:, 0] % np.uint64(blocks)).astype(np.int64), np.stack([(first + np.uint64(i) * step) % np.uint64(CELLS) for i in range(3)], 1).astype("<u2")


def sketch(digests: DataFrame, blocks: int) -> DataFrame:
    """(block, bits): the merged counting Bloom filter, a bit for each cell counted twice or more.

    A task counts HELD digests and hands on, for each block it met, the cells it hit (one hit twice comes twice,
    not more often). A block's hits follow the number of different digests in it, FILL on average,
    however large the table; copies add two hits for each cell and partial block.
    """

    def partial(held: list[pa.Array]) -> pa.RecordBatch:
        block, cell = cells([d for a in held for d in a.to_pylist()], blocks)
        hit, n = np.unique((block[:, None] * CELLS + cell.astype(np.int64)).ravel(), return_counts=True)
        hit = np.repeat(hit, np.minimum(n, 2))
        at, first = np.unique(hit // CELLS, return_index=True)
        parts = [p.astype("<u2").tobytes() for p in np.split(hit % CELLS, first[1:])]
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(parts, pa.binary())], ["block", "hits"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0))
            n += batch.num_rows
            if n >= HELD:
                yield partial(held)
                held, n = [], 0
        if n:
            yield partial(held)

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        n = np.bincount(np.frombuffer(b"".join(rows["hits"]), "<u2"), minlength=CELLS)
        return pd.DataFrame({"block": rows["block"].iloc[:1], "bits": [np.packbits(n >= 2).tobytes()]})

    return digests.select("digest").mapInArrow(count, "block long, hits binary").groupBy("block").applyInPandas(merge, "block long, bits binary")


def _twice(bits: np.ndarray, row: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Whether all cells of each digest were counted twice; ``bits`` has a row of bytes for each block."""
    return ((bits[row[:, None], cell >> 3] >> (7 - (cell & 7))) & 1).all(1)


def smallest_ids(docs: DataFrame, noted: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sent: int = SENT) -> DataFrame:
    """(digest, first): the smallest id of every text that more than one id has.

    Blocks of ``sent`` bytes at most are sent to every task, and the texts that pass them are
    shuffled whole. Larger ones stay where they are: digests come to their block, dealt to SALTS parts
    so that a text that many documents share isn't one task, and the digests that pass are
    shuffled instead of the texts. Both find the same rows.
    """
    spark = docs.sparkSession
    blocks = max(1, -(-noted.count() // FILL))
    merged = cut(sketch(noted, blocks))
    if blocks * CELLS // 8 <= sent:
        table = np.zeros((blocks, CELLS // 8), np.uint8)
        for r in merged.collect():
            table[r["block"]] = np.frombuffer(r["bits"], np.uint8)
        known = spark.sparkContext.broadcast(table)

        @F.pandas_udf("boolean")
        def repeated(digests: pd.Series) -> pd.Series:
            return pd.Series(_twice(known.value, *cells(digests.to_list(), blocks)) if len(digests) else [], dtype=bool)

        rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        possible = rows.where(repeated(F.unhex(F.sha2("text", 256))))
        least = possible.groupBy("text").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        return least.where("first < last").select(F.unhex(F.sha2("text", 256)).alias("digest"), "first")

    kind = noted.schema["doc_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, _ = cells(batch.column(1), blocks)
            yield pa.RecordBatch.from_arrays([pa.array(block), *batch.columns], ["block", "doc_id", "digest"])

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None
        for batch in batches:
            block, blob = batch.column(0).to_pylist(), batch.column(3)
            keep = np.zeros(batch.num_rows, bool)
            edges = [i for i in range(batch.num_rows) if i == 0 or block[i] != block[i - 1]] + [batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                while a < b and blob[a].is_valid:  # a block's bits, once for each salt met here, come before its digests
                    bits, a = np.frombuffer(blob[a].as_py(), np.uint8)[None, :], a + 1
                if a < b:
                    cell = cells(batch.column(2).slice(a, b - a), blocks)[1]
                    keep[a:b] = _twice(bits, np.zeros(b - a, np.int64), cell)
            yield batch.select([1, 2]).filter(pa.array(keep))

    salt = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(SALTS))
    placed = noted.select("doc_id", "digest").mapInArrow(place, f"block long, doc_id {kind}, digest binary")
    asked = placed.select("block", "doc_id", "digest", F.lit(None).cast("binary").alias("bits"), salt.alias("_salt"))
    held = merged.select("block", F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("binary").alias("digest"), "bits", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")).alias("_salt"))
    met = held.unionByName(asked).repartition("block", "_salt").sortWithinPartitions("block", F.col("bits").isNull())
    possible = met.select("block", "doc_id", "digest", "bits").mapInArrow(passing, f"doc_id {kind}, digest binary")
    least = possible.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    return least.where("first < last").select("digest", "first")


def mask_counts(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "source", sent: int = SENT) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the set of filters they fail, bit 16 for E.

    Every row counts. A document fails E if a smaller id has the same text; a null id has none
    below it and is below none. Labels of a repeated id: 1 wins.
    """
    noted = cut(facts(docs, doc_id=doc_id, text=text, part=part))
    least = cut(smallest_ids(docs, noted, doc_id=doc_id, text=text, sent=sent))
    marked = noted.join(least, "digest", "left").select(
        "doc_id", "part", F.when(F.col("doc_id") > F.col("first"), F.col("mask") + 16).otherwise(F.col("mask")).alias("mask"))
    known = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).cast("long").alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).cast("long").alias("toxic"))
    return marked.join(known, "doc_id", "left").groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def audit(counts: DataFrame) -> DataFrame:
    """One row for each part, order of the five filters and step, zeros included.

    Adds up mask counts: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley. An order
    removes a document at the first filter it fails, so of the 120 orders 120 / f remove it at a given one of its f filters.
    """
    orders = ["".join(p) for p in permutations(FILTERS)]
    per = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("_masks"))  # 32 at most
    rows = per.select("part", "_masks", F.explode(F.lit(orders)).alias("filter_order"))
    rows = rows.select("part", "_masks", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("step"))
    bits = F.transform(F.split("filter_order", ""), lambda x: F.element_at(F.lit([1, 2, 4, 8, 16]), F.ascii(x) - F.ascii(F.lit("A")) + 1))
    rows = rows.withColumn("_upto", F.aggregate(F.slice(bits, F.lit(1), F.col("step")), F.lit(0), lambda a, b: a + b)).withColumn("_own", F.get(bits, F.col("step") - 1))

    def total(value: str, cond) -> Column:
        return F.aggregate("_masks", F.lit(0).cast("long"), lambda a, m: a + F.when(cond(m["mask"]), m[value]).otherwise(F.lit(0)))

    fails = lambda m: m.bitwiseAND(F.col("_own")) != 0
    here = lambda m: m.bitwiseAND(F.col("_upto")) == F.col("_own")
    shares = F.lit([120, 60, 40, 30, 24])
    shapley = F.aggregate("_masks", F.lit(0).cast("long"), lambda a, m: a + F.when(
        fails(m["mask"]), m["n"] * F.element_at(shares, F.bit_count(m["mask"]))).otherwise(F.lit(0)))
    return rows.select(
        "part", "filter_order", "step", total("n", lambda m: m.bitwiseAND(F.col("_upto")) == 0).alias("kept"), total("n", here).alias("removed"),
        total("n", lambda m: fails(m) & ~here(m)).alias("redundant"), total("n", lambda m: m == F.col("_own")).alias("unique_fails"),
        total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"), shapley.alias("shapley"))


AUDIT_SQL = r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels where doc_id is not null group by doc_id),
m as (select part, text, d.doc_id, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    coalesce(d.doc_id > min(d.doc_id) over (partition by text), false) as e,
    len(words) < 200 as a, 100 * len(list_distinct(words)) < 50 * len(words) as b,
    100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text) as c, regexp_matches(text, '[#$%&*|]') as d
  from d left join l using (doc_id)),
f as (select part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x, i: [a, b, c, d, e][i]) as fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by all),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as k),
o as (select p.k || q.k || r.k || s.k || t.k as filter_order from x p, x q, x r, x s, x t where len(list_distinct([p.k, q.k, r.k, s.k, t.k])) = 5),
g as (select part, filter_order, step, n, good, toxic, len(fails) as size,
    list_contains(fails, substr(filter_order, step, 1)) as own,
    len(list_filter(fails, lambda z: instr(substr(filter_order, 1, step - 1), z) > 0)) as earlier
  from f, o, (select unnest([1, 2, 3, 4, 5]) as step))
select part, filter_order, step,
  coalesce(sum(n) filter (where not own and earlier = 0), 0)::bigint as kept, coalesce(sum(n) filter (where own and earlier = 0), 0)::bigint as removed,
  coalesce(sum(n) filter (where own and earlier > 0), 0)::bigint as redundant, coalesce(sum(n) filter (where own and size = 1), 0)::bigint as unique_fails,
  coalesce(sum(good) filter (where own and earlier = 0), 0)::bigint as good_lost, coalesce(sum(toxic) filter (where own and earlier = 0), 0)::bigint as toxic_lost,
  coalesce(sum(n * 120 // greatest(size, 1)) filter (where own), 0)::bigint as shapley
from g group by part, filter_order, step"""
