"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation is learned that turns centred vectors into balanced binary codes: alternating between the
signs of the rotated vectors and the orthogonal Procrustes fit to them. Codes are cut into
substrings, one table for each; vectors that agree on a substring meet in a bucket. Further tables have
the sides of random planes through the origin: as many as find a pair at the least cosine with the wanted
chance, whatever the vectors' length, mean and spread. Of the pairs that meet,
pairs whose codes are near are ranked again by the cosine of the original vectors, in double
precision. Equal vectors are one vector with a count, and a bucket is worked off in pairs of
blocks of bounded size, of which only sums and a spanning forest leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from variscope.llm.common import map_column
from variscope.llm.components import components
from variscope.session import cut

#: Vectors in a block of a bucket; a task compares two blocks at a time.
BLOCK = 512


@dataclass(frozen=True)
class Quantiser:
    """Mean and rotations for vectors of one length."""

    mean: np.ndarray
    rotations: tuple[np.ndarray, ...]

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Bits of each vector, one row each."""
        unit = x / np.linalg.norm(x, axis=1, keepdims=True) - self.mean
        return np.hstack([unit @ r > 0 for r in self.rotations])


def fit_quantiser(vectors: DataFrame, *, column: str = "embedding", sample: int = 10_000, bits: int = 64, rotations: int = 2, rounds: int = 40) -> Quantiser | None:
    """Learn from the ``sample`` vectors with the smallest hashes, of the length most frequent among them.

    Each rotation starts from another random one, which gives tables that miss different pairs.
    """
    rows = vectors.orderBy(F.xxhash64(column), column).limit(sample).select(column).collect()  # bounded sample
    by_length: dict[int, list] = {}
    for r in rows:
        by_length.setdefault(len(r[0]), []).append(r[0])
    if not by_length:
        return None
    x = np.array(max(by_length.values(), key=len), dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mean = x.mean(axis=0)
    x = x - mean
    bits = min(bits, x.shape[1])
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :bits]
    z, found = x @ axes, []
    for seed in range(rotations):
        r = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(z @ r > 0, 1.0, -1.0).T @ z)
            r = (u @ v).T
        found.append(axes @ r)
    return Quantiser(mean, tuple(found))


def random_tables(least: float, width: int, recall: float) -> int:
    """Tables of ``width`` random planes in one of which a pair at the cosine ``least`` agrees with chance ``recall``."""
    agree = (1 - np.arccos(np.clip(least, -1, 1)) / np.pi) ** width
    return 1 if agree >= 1 else int(np.ceil(np.log(1 - recall) / np.log1p(-agree)))


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Vectors that can link: no null or non-finite component, and not zero."""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0))


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each one's component."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
    return root


def _compare(ids: np.ndarray, n: np.ndarray, left: np.ndarray, x: np.ndarray, parts: np.ndarray, number: int, near: int, words: np.ndarray, least: float, same: bool):
    """Links of one pair of blocks: (id, copies linked, smallest linked id) of each member that has any.

    A pair is left to the first table in which it meets, so that it counts once.
    """
    rows, columns = np.flatnonzero(left), np.flatnonzero(~left)
    if same:
        rows = columns = np.arange(len(ids))
    out = []
    for start in range(0, len(rows), 128):
        some = rows[start : start + 128]
        apart = np.zeros((len(some), len(columns)), dtype=np.int64)
        for w in range(words.shape[1]):
            apart += np.bitwise_count(words[some, w][:, None] ^ words[columns, w][None, :])
        hit = apart <= near
        for t in range(number):
            hit &= parts[some, t][:, None] != parts[columns, t][None, :]
        if same:
            hit &= some[:, None] < columns[None, :]
        i, j = np.nonzero(hit)
        i, j = some[i], columns[j]
        good = np.einsum("ij,ij->i", x[i], x[j]) >= least
        out.append((i[good], j[good]))
    a, b = (np.concatenate(k) for k in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int))
    copies = np.bincount(a, n[b], len(ids)) + np.bincount(b, n[a], len(ids))
    order = np.argsort(ids, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(ids))
    root = ids[order][_forest(len(ids), place[a], place[b])][place]
    linked = copies > 0
    return ids[linked], copies[linked].astype(np.int64), root[linked]


def near_vectors(vectors: DataFrame, *, vec_id: str = "vec_id", column: str = "embedding", least: float = 0.9, width: int = 12, near: int = 44, recall: float = 0.99, **fit) -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id, kept.

    Links pairs found with a cosine of ``least`` or more: of pairs at ``least`` itself a share of ``recall`` at least
    is expected, of nearer ones more. ``width`` bits make a table; pairs that differ in over ``near`` of 128
    random planes aren't ranked again (a cosine of 0.9 gives 18 on average).
    A bucket holds about 1 / 2 ** width of all vectors, so give wider tables to larger collections.
    Vectors that are null, zero, or have null or non-finite components link with nothing, vectors of
    different lengths neither. Rows of the same id are one vector each, but share a result.
    """
    every = vectors.select(F.col(vec_id).alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    good = usable(every, "v")
    model = fit_quantiser(good, column="v", **fit)
    if model is None:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    classes = cut(good.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    size = len(model.mean)
    tables = sum(r.shape[1] for r in model.rotations) // width
    more = random_tables(least, width, recall)
    planes = more * width
    words = -(-planes // 64)
    far = near * planes // 128

    def make():
        sides = np.random.default_rng(size).normal(size=(size, planes))

        def work(rows):
            code = np.zeros((len(rows), words * 64), dtype=np.uint8)
            learned = np.zeros((len(rows), tables * width), dtype=np.uint8)
            fits = [i for i, r in enumerate(rows) if len(r) == size]
            if fits:
                x = np.array([rows[i] for i in fits])
                code[fits, :planes] = x / np.abs(x).max(axis=1, keepdims=True) @ sides > 0
                learned[fits] = model.codes(x)[:, : tables * width]
            packed = np.packbits(code, axis=1, bitorder="little").view(np.int64)
            both = np.hstack([learned, code[:, :planes]])
            keys = (both.reshape(len(rows), tables + more, width) @ (1 << np.arange(width))).astype(np.int32)
            return {"code": pa.array(packed.tolist(), pa.list_(pa.int64())), "parts": pa.array(keys.tolist(), pa.list_(pa.int32()))}

        return work

    coded = cut(map_column(classes, "v", make, pa.schema([("code", pa.list_(pa.int64())), ("parts", pa.list_(pa.int32()))]), rows=1024))
    keyed = coded.select(F.size("v").alias("len"), F.posexplode("parts").alias("t", "key"), "rep", "n", "v", "code", "parts")
    # Vectors of other lengths have no codes: all of a length meet, in one table.
    keyed = keyed.where((F.col("len") == size) | (F.col("t") == 0))
    full = keyed.groupBy("len", "t", "key").agg(F.count("*").alias("m")).where("m > 1").select(F.col("len").alias("l"), F.col("t").alias("u"), F.col("key").alias("k"), F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    members = keyed.join(full, (F.col("len") == F.col("l")) & (F.col("t") == F.col("u")) & (F.col("key") == F.col("k"))).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "len", "t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"), "rep", "n", "v", "code", "parts")
    group = ["len", "t", "key", "i", "j"]
    sorted_ = dealt.repartition(*[F.col(c) for c in group]).sortWithinPartitions(*group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(part: pa.Table):
            t, i, j = (part[c][0].as_py() for c in ("t", "i", "j"))
            ids, n = part["rep"].to_numpy(), part["n"].to_numpy()
            x, code, parts = (np.array(part[c].combine_chunks().flatten()).reshape(len(ids), -1) for c in ("v", "code", "parts"))
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            code = code.view(np.uint64)  # bits of a negative number are not counted as they stand
            left = np.array(part["left"].to_pylist())
            found = _compare(ids, n, left, x, parts, t, far, code, least, i == j)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["rep", "copies", "root"])

        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in group]
            cuts = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1).tolist(), batch.num_rows]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                if start == stop:
                    continue
                key = tuple(c[start] for c in columns)
                if held and key != last:
                    yield done(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(start, stop - start))
                last = key
        if held:
            yield done(pa.Table.from_batches(held))

    found = cut(sorted_.mapInArrow(run, "rep long, copies long, root long"))
    counts = found.groupBy("rep").agg(F.sum("copies").alias("copies"))
    comps = components(found.select("rep", "root"), "rep", "root")
    per_class = classes.join(counts, "rep", "left").join(comps.select(F.col("id").alias("rep"), "component"), "rep", "left").select(
        F.col("v").alias("cv"), (F.coalesce("copies", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("comp"))
    joined = every.join(per_class, F.col("v") == F.col("cv"), "left")
    component = F.coalesce("comp", "vec_id")
    return joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
