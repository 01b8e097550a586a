"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets an exponential key ``-ln(u) / w``: ``u`` is a hash of the document, ``w`` its quality
weight. Within a source the documents in order of their keys are a weighted sample without
replacement of any length. A source is taken as often as it fits whole in its target
(complete epochs), then its documents with the smallest keys fill the rest.

The order is never sorted as a whole. Keys fall into ``buckets`` slices of equal expected mass;
sums for each (source, slice) are made by partial aggregation, prefix sums over these
tell the one slice in which a source's budget ends, and only the documents of that
slice are sorted. A source with a third of all rows costs no more than others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from variscope.llm.common import WORD, carried
from variscope.session import cut

#: Slices of the key; a slice holds about this fraction of a source.
BUCKETS = 1 << 14
#: Sources whose plan is broadcast, and keys of a source beyond.
SENT, SALTS = 10_000, 64


def size_of(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """0.25 to 1: the share of letters and spaces in the text; 0.25 for null or empty texts."""
    kept = F.length(F.regexp_replace(text, r"[^\p{L} ]+", ""))
    share = kept / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.lit(0.25), F.coalesce(share, F.lit(0.0)))


def sampling_key(doc_id: Column, text: Column) -> Column:
    """Exponential key, the same in every run; equal rows get equal keys."""
    digest = F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 1) / F.lit(float(1 << 48))
    return -F.ln(u) / quality_weight(text)


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, budget: Column | None = None) -> DataFrame:
    """Target words of each source from rows (source, source_size).

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all
    sizes (or ``budget``). A target stops at ``most`` times the source's size; the excess is
    shared by weight among the rest. With sources ordered by size for weight, those that
    stop come first, so one pass of prefix sums finds the level.
    """
    turn = F.array(*[F.lit(w) for w in weights])
    order = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    ranked = (
        sources.withColumn("_w", F.element_at(turn, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
        .withColumn("_cap", F.col("source_size") * most)
        .withColumn("_budget", (F.sum("source_size").over(every) if budget is None else budget).cast("double"))
    )
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").cast("binary").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / (
        F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    leveled = ranked.withColumn("_level", level).withColumn("_free", F.col("_cap") >= F.col("_level") * F.col("_w"))
    final = F.min(F.when(F.col("_free"), F.struct(F.col("_cap") / F.col("_w"), "_level"))).over(every)["_level"]
    return leveled.withColumn("_final", final).select(
        "source", "source_size",
        F.when(F.col("_final").isNull(), F.col("_cap").cast("double")).otherwise(F.least(F.col("_cap").cast("double"), F.col("_final") * F.col("_w"))).alias("target"),
    )


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, buckets: int = BUCKETS) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, copies, taken.

    ``copies`` is how often the mix holds the document; ``taken`` is copies times size. Documents are taken
    whole; the one at which the budget ends is taken if that comes nearer to the target. A
    null source is a source of its own. Documents without words have size 0: they come with the
    complete epochs, and with the rest while the budget lasts. Repeated rows count
    each; equal keys are ordered by id and digest, so reruns agree.
    """
    key = sampling_key(F.col(doc_id), F.col(text))
    facts = cut(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"), key.alias("key"),
    ).withColumn("slice", F.least(F.floor(F.lit(buckets) * (F.lit(1.0) - F.exp(-F.col("key") * 0.8))), F.lit(buckets - 1)).cast("int")))
    slices = facts.groupBy("source", "slice").agg(F.sum("size").alias("n"))
    sources = targets(slices.groupBy("source").agg(F.sum("n").alias("source_size")), weights, most)
    plan = sources.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")).withColumn(
        "rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    upto = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = slices.withColumn("_sum", F.sum("n").over(upto)).alias("s").join(plan.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source")))
    edge = ends.groupBy("p.source").agg(
        F.min(F.when(F.col("_sum") >= F.col("rest"), F.col("slice"))).alias("edge"),
        F.max(F.when(F.col("_sum") < F.col("rest"), F.struct("slice", "_sum"))).alias("_last"))
    plan = plan.alias("p").join(edge.alias("e"), F.col("p.source").eqNullSafe(F.col("e.source")), "left").select(
        F.col("p.source").alias("_source"), "source_size", "target", "epochs", "rest", "edge", F.coalesce(F.col("_last._sum"), F.lit(0)).alias("_base"))
    joined = _with_plan(facts, cut(plan))
    at_edge = joined.where(F.col("slice") == F.col("edge"))
    before = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_base") + F.coalesce(F.sum("size").over(before), F.lit(0))
    inner = at_edge.withColumn("more", ((F.col("rest") - start) * 2 >= F.col("size")) & (F.col("rest") > start)).select(*joined.columns, "more")
    others = joined.where(F.col("edge").isNull() | (F.col("slice") != F.col("edge"))).withColumn(
        "more", (F.col("edge").isNull() | (F.col("slice") < F.col("edge"))) & (F.col("rest") > 0))
    copies = (F.col("epochs") + F.col("more").cast("int")).cast("int")
    return inner.unionByName(others).select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).cast("long").alias("taken"), "key")


def _with_plan(facts: DataFrame, plan: DataFrame) -> DataFrame:
    """Each document with its source's row of the plan.

    The plan has a row of seven numbers for each source: with SENT rows at most it is sent to every
    task. Beyond that, sources are spread over ``SALTS`` keys each, so that a hot one isn't one task.
    """
    if plan.count() <= SENT:
        joined = facts.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("_source")))
    else:
        salted = facts.withColumn("_salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
        copies = plan.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(copies, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_salt") == F.col("_copy"))).drop("_salt", "_copy")
    return joined.drop("_source")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with all columns of ``docs``.

    Documents meet their number of copies by id and sampling key, which rows equal in id and text share: such
    rows get, together, the copies that the mix takes of them, dealt out evenly.
    """
    columns = docs.columns
    counted = mix(docs, **options).groupBy("doc_id", "key").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    rows = carried(docs, _id=F.col("doc_id"), _key=sampling_key(F.col("doc_id"), F.col("text")))
    joined = rows.join(counted, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("key")))
    lone = joined.where("rows = 1").select("_row", F.col("copies").alias("_n"))
    number = F.row_number().over(Window.partitionBy("_id", "_key").orderBy("copies"))
    even = F.floor(F.col("copies") / F.col("rows")) + (number <= F.col("copies") % F.col("rows")).cast("long")
    taken = lone.unionByName(joined.where("rows > 1").select("_row", even.alias("_n"))).where("_n > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_copy")).select(*[F.col(f"_row.`{c}`") for c in columns])
