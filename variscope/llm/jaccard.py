"""Jaccard self-join of documents on word shingles, by parity sketches.

Every shingle flips one bit of a sketch, so the Hamming distance of two sketches is at most the
symmetric difference of their sets. Sets whose likeness is at least ``least`` per cent differ in at most
``d`` shingles, and ``d`` follows from the sizes. For each band of sizes a wide sketch is laid out in more than
``d`` parts: each difference spoils one part at most, so linked documents agree on a part. A part
is kept as the XOR of hashes of its bits, 64 bits wide: equal parts have equal words, and parts with
few shingles don't meet by chance. Documents that agree on one meet in a bucket; pairs whose 4096-bit sketches are near enough are verified
on their whole sets.

No bucket is expanded into its pairs. Equal sets are one class. Buckets with the same members count
once. First, members meet only the smallest of their bucket, which joins groups of copies to
components at a cost in proportion to their size; then pairs of a bucket that are still in
different components, and could be linked after their sketches, are verified. What is in
one component needs no further pair, so the components are exact.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from variscope.llm.common import carried, map_column
from variscope.llm.components import components
from variscope.session import cut

SHINGLE = 4
LEAST = 85
#: Words of 64 bits in the sketch that pairs are filtered with, and in its folded form.
SKETCH, FOLDED = 64, 16
#: Shingles up to which the folded sketch tells sets apart.
LARGE = 900
#: Layouts that a set with many empty words is tried in.
LAYOUTS = 12
#: Entries of a task's memory of word hashes; it is emptied when full.
MEMORY = 100_000


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of a well-known generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: str | None, words: _Words, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles.

    A to Z are lower-cased; a text with fewer words than a shingle has one, all its
    words; a text without words has none.
    """
    split = (text or "").encode().lower().split()
    if len(split) < shingle:
        whole = [xxhash.xxh64_intdigest(b" ".join(split), seed=shingle)] if split else []
        return np.array(whole, dtype=np.uint64)
    h = np.fromiter(map(words.__getitem__, split), np.uint64, len(split))
    n = len(h) - shingle + 1
    total = np.zeros(n, dtype=np.uint64)
    for i in range(shingle):
        total = _mix(total * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(total)


class Bands:
    """Size bands and their sketch layouts for one threshold."""

    def __init__(self, least: int = LEAST, growth: float = 1.4) -> None:
        self.least = least
        smallest = 1
        while self.most(smallest, smallest + 1) < 1:  # below, only equal sets link
            smallest += 1
        self.starts = [smallest + 1]
        while self.starts[-1] < 1 << 50:
            self.starts.append(max(self.starts[-1] + 1, int(self.starts[-1] * growth)))

    def most(self, a: int, b: int) -> int:
        """Largest symmetric difference of linked sets of these sizes."""
        return (a + b) - 2 * -(-self.least * (a + b) // (100 + self.least))

    def schemes(self, n: int) -> Iterator[tuple[int, int, int]]:
        """(band, words, words that may be 0) of the layouts that a set of size ``n`` takes part in.

        These are its own band's, and the next one's if a larger set there can be linked.
        """
        own = bisect.bisect_right(self.starts, n) - 1
        for band in (own, own + 1):
            if band >= 0 and (band == own or 100 * n >= self.least * self.starts[band]):
                top = self.starts[band + 1] - 1
                d = 2 * top * (100 - self.least) // (100 + self.least)
                spare = 2 + d // 12
                yield band, d + 1 + spare, spare

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """Bucket keys of a set.

        Linked sets agree on more words than ``spare``, in any layout. Words that are 0 are equal for sets that have nothing
        in common, so they are no keys: if one of two linked sets has ``spare`` of them at most, the two agree on another
        word. A set with more of them is laid out once more by other hashes, and so on: two linked sets go through
        the same layouts up to the first in which one of them has few, and meet there. In the last of LAYOUTS, which
        hardly any set reaches, words that are 0 count as well.
        """
        out = []
        for band, words, spare in self.schemes(len(shingles)):
            for layout in range(LAYOUTS):
                h = _mix(shingles + np.uint64(((layout << 20) + band + 1) * 0xD1B54A32D192ED03 % 2**64))
                part = ((h >> np.uint64(32)) * np.uint64(words)) >> np.uint64(32)
                sketch = np.zeros(words, dtype=np.uint64)
                np.bitwise_xor.at(sketch, part.astype(np.int64), _mix(h ^ np.uint64(0x8CB92BA72F3D8DD7)))
                place = np.arange(words, dtype=np.uint64) + np.uint64((band << 40) + (layout << 32))
                key = _mix(sketch ^ _mix(place + np.uint64(0x2545F4914F6CDD1D)))
                zero = sketch == 0
                few = zero.sum() <= spare
                out.append(key if layout == LAYOUTS - 1 and not few else key[~zero])
                if few:
                    break
        return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def parity_sketch(shingles: np.ndarray) -> np.ndarray:
    sketch = np.zeros(SKETCH, dtype=np.uint64)
    h = _mix(shingles ^ np.uint64(0xA0761D6478BD642F))
    np.bitwise_xor.at(sketch, (h >> np.uint64(58)).astype(np.int64), np.uint64(1) << (h & np.uint64(63)))
    return sketch.view(np.int64)


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n, digest of the set (two longs) and sketch of each document."""
    added = pa.schema([("n", pa.int64()), ("high", pa.int64()), ("low", pa.int64()), ("sketch", pa.list_(pa.int64()))])

    def make():
        words = _Words()

        def work(texts):
            sets = [shingle_set(t, words, shingle) for t in texts]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            high, low = (pa.array([int.from_bytes(d[i : i + 8], "big", signed=True) for d in digests], pa.int64()) for i in (0, 8))
            return {"n": pa.array([len(s) for s in sets], pa.int64()), "high": high, "low": low, "sketch": pa.array([parity_sketch(s) for s in sets], pa.list_(pa.int64()))}

        return work

    return map_column(docs, "text", make, added).drop("text")


def bucket_keys(docs: DataFrame, least: int, shingle: int) -> DataFrame:
    """(rep, key): a row for each bucket of each document."""

    def make():
        words, bands = _Words(), Bands(least)
        return lambda texts: {"keys": pa.array([bands.keys(shingle_set(t, words, shingle)) for t in texts], pa.list_(pa.int64()))}

    return map_column(docs, "text", make, pa.schema([("keys", pa.list_(pa.int64()))])).select(F.col("doc_id").alias("rep"), F.explode("keys").alias("key"))


def _with_sets(docs: DataFrame, shingle: int) -> DataFrame:
    def make():
        words = _Words()
        return lambda texts: {"shingles": pa.array([shingle_set(t, words, shingle).view(np.int64) for t in texts], pa.list_(pa.int64()))}

    return map_column(docs, "text", make, pa.schema([("shingles", pa.list_(pa.int64()))])).drop("text")


def _could_link(least: int, width: int) -> Column:
    """Sizes near enough, and sketches no farther apart than linked sets can be; ``x`` and ``y`` are the sides."""
    total = F.col("x.n") + F.col("y.n")
    apart = sum((F.bit_count(F.col(f"x.s{i}").bitwiseXOR(F.col(f"y.s{i}"))) for i in range(1, width)), F.bit_count(F.col("x.s0").bitwiseXOR(F.col("y.s0"))))
    near = F.lit(100) * F.least("x.n", "y.n") >= F.lit(least) * F.greatest("x.n", "y.n")
    return near & (apart * (100 + least) <= total * (100 - least))


def _folded(facts: DataFrame) -> DataFrame:
    """Sketches of a quarter of the width: parities of parities are parities."""
    fold = [F.col(f"s{i}").bitwiseXOR(F.col(f"s{i + FOLDED}")).bitwiseXOR(F.col(f"s{i + 2 * FOLDED}")).bitwiseXOR(F.col(f"s{i + 3 * FOLDED}")).alias(f"s{i}") for i in range(FOLDED)]
    return facts.select("rep", "n", *fold)


def _verified(pairs: DataFrame, docs: DataFrame, least: int, shingle: int) -> DataFrame:
    """Pairs (a, b) whose whole sets are linked."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = cut(_with_sets(docs.join(ids, F.col("doc_id") == F.col("id"), "left_semi"), shingle))
    left, right = (sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "ab")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - shared
    return pairs.join(left, "a").join(right, "b").where(shared * 100 >= union * least).select("a", "b").distinct()


def linked_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, shingle: int = SHINGLE) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id.

    Two documents link when they share ``least`` per cent of the shingles of both. The component is the smallest
    id reachable by links, the document's own included. Null texts are empty; empty texts and rows
    without an id link with nothing. Rows of one id and different texts are not told apart: give ids that
    tell documents apart.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    signed = cut(signatures(plain, shingle))
    classes = cut(signed.where("n > 0 and doc_id is not null").groupBy("high", "low").agg(F.min("doc_id").alias("rep")))
    others = signed.join(classes, ["high", "low"]).where("doc_id <> rep").select("doc_id").distinct()

    # Buckets of two documents and more, by one shuffle of (bucket, document).
    keyed = bucket_keys(plain.where("doc_id is not null").join(others, "doc_id", "left_anti"), least, shingle)
    bucket = Window.partitionBy("key")
    met = cut(keyed.withColumns({"low": F.min("rep").over(bucket), "high": F.max("rep").over(bucket)}).where("low < high").select("key", "rep").distinct())
    buckets = (
        met.groupBy("key").agg(F.count("*").alias("m"), F.min("rep").alias("a"), F.max("rep").alias("b"), F.bit_xor(F.xxhash64("rep")).alias("x"))
        .groupBy("m", "a", "b", "x").agg(F.min("key").alias("key")))
    members = cut(met.join(buckets.select("key", "a"), "key").select("key", "a", "rep"))
    reps = members.select("rep").distinct()
    facts = cut(signed.join(reps, F.col("doc_id") == F.col("rep"), "left_semi").groupBy(F.col("doc_id").alias("rep")).agg(
        F.first("n").alias("n"), F.first("sketch").alias("sketch")).select("rep", "n", *[F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH)]))

    def near(pairs: DataFrame) -> DataFrame:
        x, y = (facts.select(F.col("rep").alias(f"{c}_"), F.struct(*facts.columns[1:]).alias(s)) for c, s in (("a", "x"), ("b", "y")))
        joined = pairs.join(x, F.col("a") == F.col("a_")).join(y, F.col("b") == F.col("b_"))
        return joined.where(_could_link(least, SKETCH)).select("a", "b")

    first = cut(near(members.where("a < rep").select("a", F.col("rep").alias("b")).distinct()))
    links = cut(_verified(first, plain, least, shingle))
    joined = components(links)

    placed = members.join(joined, F.col("rep") == F.col("id"), "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    split = placed.groupBy("key").agg(F.count("*").alias("m"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high and m > 2").select("key")
    apart = placed.join(split, "key", "left_semi")

    def unlinked(sketched: DataFrame, width: int, sizes: Column) -> DataFrame:
        found = apart.join(sketched, "rep")
        x, y = found.alias("x"), found.alias("y")
        other = (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.component") != F.col("y.component"))
        return x.join(y, other & sizes & _could_link(least, width)).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))

    # A folded sketch of a large set is half ones whatever the set, and tells nothing: pairs with a large set are told apart by the whole one.
    larger = F.greatest("x.n", "y.n")
    rest = unlinked(_folded(facts.where(F.col("n") <= LARGE)), FOLDED, larger <= LARGE).unionByName(
        unlinked(facts.where(F.col("n") * 100 >= LARGE * least), SKETCH, larger > LARGE))
    second = cut(near(rest.distinct().join(first, ["a", "b"], "left_anti")))
    joined = components(links.unionByName(_verified(second, plain, least, shingle)))

    per_class = classes.join(joined, F.col("rep") == F.col("id"), "left").select(
        F.col("high").alias("h"), F.col("low").alias("l"), F.coalesce("component", "rep").alias("component"))
    found = signed.select("doc_id", "n", "high", "low").join(per_class, (F.col("high") == F.col("h")) & (F.col("low") == F.col("l")), "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def without_near_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id.

    Rows repeated with the same id and text count as copies too. Documents without words, and rows
    without an id, all stay.
    """
    columns = docs.columns
    kept = linked_components(docs, doc_id=doc_id, text=text, **options).where("doc_id = component_id").groupBy(F.col("doc_id").alias("_kept")).agg(F.max("n_shingles").alias("_n"))
    rows = carried(docs, _id=F.col(doc_id), _digest=F.md5(F.col(text).cast("binary")))
    found = rows.join(kept, F.col("_id") == F.col("_kept"), "left").where("_id is null or _kept is not null")
    lone = found.where("_id is null or _n = 0").select("_row")
    firsts = found.where("_n > 0").dropDuplicates(["_id", "_digest"]).select("_row")
    return lone.unionByName(firsts).select(*[F.col(f"_row.`{c}`") for c in columns])
