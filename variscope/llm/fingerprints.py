"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

A fingerprint is the sorted array of the ``k`` smallest distinct 64-bit hashes of a text's word
shingles. Fingerprints of parts merge to the fingerprint of the whole, and two of them
estimate resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from variscope.session import cut

#: Hashes kept; the standard error of a resemblance r is about sqrt(r (1 - r) / K).
K = 128
SHINGLE = 5


def words_of(text: Column) -> Column:
    """Lower-case words of a text; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def sketch(words: str, k: int = K, shingle: int = SHINGLE) -> Column:
    """Fingerprint of the array column ``words``.

    Fewer words than a shingle count as one shingle; no words give an empty fingerprint.
    """
    w = F.col(words)
    one = F.array(F.xxhash64(F.array_join(w, " ")))
    every = F.transform(F.sequence(F.lit(0), F.size(w) - shingle), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(shingle)]))
    hashes = F.when(F.size(w) >= shingle, every).when(F.size(w) > 0, one).otherwise(F.array().cast("array<bigint>"))
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def with_fingerprint(df: DataFrame, text: str = "text", name: str = "fingerprint", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """``df`` with the fingerprint of each whole text (array<bigint>)."""
    words = f"_words_{name}"
    return df.withColumn(words, words_of(F.col(text))).withColumn(name, sketch(words, k, shingle)).drop(words)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness, 0 to 1; 1 for two empty fingerprints, 0 if one is empty."""
    both = F.array_intersect(a, b)
    least = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(least, both)) / F.greatest(F.size(least), F.lit(1)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact for fingerprints that are not full."""
    share = (F.element_at(a, k).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 1 if a has none."""
    r = resemblance(a, b, k)
    shared = r / (1 + r) * (distinct_shingles(a, k) + distinct_shingles(b, k))
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def merge_fingerprints(df: DataFrame, keys: list[str], name: str = "fingerprint", k: int = K) -> DataFrame:
    """One fingerprint for each group: that of all its parts together.

    Equal hashes meet in a partial aggregation and Spark keeps the ``k`` smallest of a
    group in each task before the shuffle, so a hot group needs no task of its own. Groups without any
    hash get an empty fingerprint.
    """
    hashes = df.select(*keys, F.explode(name).alias("_hash")).groupBy(*keys, "_hash").agg(F.lit(1).alias("_one"))
    least = hashes.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_hash"))).where(F.col("_rank") <= k)
    merged = least.groupBy(*keys).agg(F.sort_array(F.collect_list("_hash")).alias(name))
    groups, right = df.select(*keys).distinct(), merged.select(*[F.col(c).alias(f"_{c}") for c in keys], name)
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    return groups.join(right, same, "left").select(*keys, F.coalesce(F.col(name), F.array().cast("array<bigint>")).alias(name))


def _slots(docs: DataFrame, rows: int) -> Column:
    """Number of a range of doc_ids; ranges ascend and hold about ``rows`` documents each.

    128 percentiles of doc_id, and even steps between them, make the borders.
    """
    found = docs.agg(F.count("*").alias("n"), F.percentile_approx("doc_id", [i / 128 for i in range(129)], 10_000).alias("p")).first()
    borders = sorted(set(found["p"] or [0]))
    steps = max(1, -(-found["n"] // (rows * 128)))
    at = F.array(*[F.lit(b) for b in borders])
    k = F.greatest(F.size(F.filter(at, lambda b: b <= F.col("doc_id"))), F.lit(1))
    low, high = F.element_at(at, k), F.coalesce(F.get(at, k), F.element_at(at, k) + 1)
    step = F.least(F.floor((F.col("doc_id") - low) / (high - low) * steps), F.lit(steps - 1))
    return F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.greatest(k * steps + step, F.lit(0))).cast("long")


def with_next(docs: DataFrame, rows: int = 512) -> DataFrame:
    """doc_id, text, fingerprint of each document, and next_text, next_fingerprint of the next by descending doc_id.

    After the last comes the first; null ids come last and rows of equal ids in the order of a digest.
    Documents are dealt into ranges of ids, in one shuffle of the texts; within a range the
    next document is a window away.
    """
    digest = F.xxhash64("text")
    base = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("slot", _slots(docs, rows))
    # A row of three numbers for each range: its first document, by id and digest.
    heads = base.groupBy("slot").agg(F.max(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), digest.alias("digest"))).alias("first"))
    order = Window.orderBy("slot")
    before = F.coalesce(F.lead("slot").over(order), F.min("slot").over(Window.partitionBy(F.lit(0))))
    heads = cut(heads.select("slot", before.alias("before"), "first.*"))
    # The first document of each range also stands at the end of the range before, as a copy.
    found = base.join(heads.select(F.col("slot").alias("_slot"), "before", "id", "digest"), (F.col("slot") == F.col("_slot")) & (F.coalesce("doc_id", F.lit(-(2**63))) == F.col("id")) & (digest == F.col("digest")))
    copies = found.groupBy("before").agg(F.first("text").alias("text")).select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("before").alias("slot"), F.lit(True).alias("copy"))
    dealt = base.withColumn("copy", F.lit(False)).unionByName(copies).repartition("slot")
    own = Window.partitionBy("slot").orderBy("copy", F.col("doc_id").desc_nulls_last(), digest.desc())
    here = with_fingerprint(dealt)
    return here.select("doc_id", "text", "fingerprint", "copy", F.lead("text").over(own).alias("next_text"), F.lead("fingerprint").over(own).alias("next_fingerprint")).where(
        ~F.col("copy")).drop("copy")


def edited(text: Column, next_text: Column) -> Column:
    """The last half of the code points replaced by as many, or all, of the next text's first."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(next_text, F.lit(1), half))


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda h: F.hex(h)), ",")
