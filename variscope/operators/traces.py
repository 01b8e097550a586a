"""Execution traces: addresses, modules, source locations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from variscope.operators.models import with_row
from variscope.plans.scan import Run, scan
from variscope.plans.skew import lookup
from variscope.session import cut


def trace_addresses(events: DataFrame) -> DataFrame:
    """(event_id, ts, part, addr): start of the function and address of the caller."""
    both = F.array(
        F.struct(F.lit(0).alias("part"), (F.col("addr") - F.col("off")).alias("addr")),
        F.struct(F.lit(1).alias("part"), F.col("caller_addr").alias("addr")),
    )
    return events.select("event_id", "ts", F.explode(both).alias("a")).select("event_id", "ts", "a.part", "a.addr")


def first_seen(addresses: DataFrame) -> DataFrame:
    """Each address once, with its first occurrence."""
    first = F.min(F.struct("event_id", "part", "ts")).alias("f")
    return addresses.groupBy("addr").agg(first).select("addr", "f.event_id", "f.part", "f.ts")


def module_offsets(addresses: DataFrame, modules: DataFrame, bits: int = 16) -> DataFrame:
    """Distinct addresses with the module they lie in (both ends included) and the offset.

    Modules are cut into pieces of ``2**bits`` addresses and addresses join on the piece,
    so neither side is compared as a whole. Where modules overlap the lowest base wins.
    """
    piece = lambda c: F.floor(F.col(c).cast("decimal(20,0)") / F.lit(1 << bits)).cast("decimal(20,0)")
    asked = addresses.select("addr").distinct().withColumn("_piece", piece("addr"))
    spans = modules.withColumn("_end", F.col("base") + F.col("size"))
    n = (piece("_end") - piece("base")).cast("bigint")
    spans = spans.withColumn("_first", piece("base")).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), n))).select(
        "name", "base", "_end", (F.col("_first") + F.col("_k")).cast("decimal(20,0)").alias("_piece")
    )
    hit = lookup(asked, spans, ["_piece"], how="inner").filter(F.col("addr").between(F.col("base"), F.col("_end")))
    best = hit.groupBy("addr").agg(F.min(F.struct("base", "name")).alias("m"))
    return asked.select("addr").join(best, "addr", "left").select(
        "addr", F.col("m.name").alias("module"), (F.col("addr") - F.col("m.base")).alias("module_off")
    )


def seen_functions(events: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """First event of each function; functions of the ignore list are left out."""
    first = events.groupBy("func").agg(F.min("event_id").alias("event_id"))
    return first.join(ignored, "func", "left_anti") if ignored is not None else first


def symbol_at(addresses: DataFrame, functions: DataFrame, width: int = 1 << 20) -> DataFrame:
    """(addr, name, start): the nearest function that starts at or below each address.

    Addresses and function starts are merged in address order; the last start seen
    carries on. Distinct addresses make a segment of ``width`` addresses bounded.
    """
    starts = functions.groupBy(F.col("start").alias("addr")).agg(F.min("name").alias("name")).select(
        "addr", F.struct("name", F.col("addr").alias("start")).alias("_f"), F.lit(0).alias("_tie")
    )
    asked = addresses.select("addr").distinct().select("addr", F.lit(None).cast(starts.schema["_f"].dataType).alias("_f"), F.lit(1).alias("_tie"))
    both = cut(starts.unionByName(asked).withColumn("_all", F.lit(0)))
    out = scan(both, ["_all"], "addr", [Run("f", "last", F.col("_f"))], ties=["_tie"], width=width)
    return out.filter(F.col("_tie") == 1).select("addr", F.col("f.name").alias("name"), F.col("f.start").alias("start"))


def split_by_module(offsets: DataFrame) -> DataFrame:
    """Addresses per module; those in none count as ``unknown``."""
    return offsets.groupBy(F.coalesce("module", F.lit("unknown")).alias("module")).agg(F.count(F.lit(1)).alias("n_addrs"))


def module_lines(offsets: DataFrame) -> DataFrame:
    """(module, addr, line): what a module's document lists, offsets, or bare addresses for ``unknown``."""
    shown = F.when(F.col("module").isNull(), F.col("addr")).otherwise(F.col("module_off"))
    return offsets.select(F.coalesce("module", F.lit("unknown")).alias("module"), "addr", shown.cast("string").alias("line"))


def common_prefix(paths: DataFrame, n: int) -> DataFrame:
    """One row: longest directory prefix shared by the first ``n`` paths (by seq).

    The prefix of a set of strings is that of its smallest and largest member.
    """
    head = paths.orderBy("seq").limit(n)
    ends = head.agg(F.min("path").alias("lo"), F.max("path").alias("hi"))
    lo, hi = F.split("lo", "/"), F.split("hi", "/")
    same = F.transform(
        F.sequence(F.lit(1), F.least(F.size(lo), F.size(hi)) - 1),
        lambda k: F.when(F.slice(lo, 1, k) == F.slice(hi, 1, k), k).otherwise(0),
    )
    depth = F.when(F.least(F.size(lo), F.size(hi)) > 1, F.array_max(same)).otherwise(0)
    prefix = F.concat_ws("/", F.slice(lo, F.lit(1), depth))
    return ends.select(F.when(depth > 0, F.concat(prefix, F.lit("/"))).otherwise("").alias("prefix"))


def relative_paths(paths: DataFrame, prefix: DataFrame) -> DataFrame:
    """Distinct paths with the prefix replaced by ``./``."""
    rows = with_row(paths.select("path").distinct(), prefix)
    cutted = F.expr("substring(path, length(prefix) + 1)")
    starts = F.expr("prefix <> '' and startswith(path, prefix)")
    return rows.select(F.when(starts, F.concat(F.lit("./"), cutted)).otherwise(F.col("path")).alias("path")).distinct()


def drop_ignored(paths: DataFrame, patterns: DataFrame) -> DataFrame:
    """Paths matching none of the patterns; the list becomes one alternation, as a tool would.

    The list is hand-written and short, so it travels as one row.
    """
    one = patterns.agg(F.concat_ws("|", F.array_sort(F.collect_set(F.regexp_replace("pattern", " ", "")))).alias("_any"))
    return with_row(paths, one).filter(F.expr("_any = '' or not path rlike _any")).drop("_any")


def existing_only(locations: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(locations of known files, the others)"""
    known = files.select("path")
    return locations.join(known, "path", "left_semi"), locations.join(known, "path", "left_anti")


def trace_growth(addresses: DataFrame, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """New addresses per tumbling or sliding window."""
    first = addresses.groupBy("addr").agg(F.min("ts").alias("ts"))
    w = F.window(F.col("ts").cast("timestamp"), size, slide or size)
    return first.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n_new")).select(F.col("w.start").alias("start"), "n_new")


def grown_out(growth: DataFrame) -> DataFrame:
    """Windows in which fewer new addresses came up than on average."""
    return with_row(growth, growth.agg(F.avg("n_new").alias("_a"))).select("start", (F.col("n_new") < F.col("_a")).alias("settled"))


def trace_summary(addresses: DataFrame, offsets: DataFrame, short: int = 1000) -> DataFrame:
    """One row: events, distinct addresses, modules touched, and the short-trace flag."""
    a = addresses.agg(F.countDistinct("event_id").alias("n_lines"), F.countDistinct("addr").alias("n_addrs"))
    m = offsets.agg(F.countDistinct("module").alias("n_modules"))
    return with_row(a, m).withColumn("short", F.col("n_lines") < short)


def late_events(events: DataFrame, delay: str = "10 minutes", bucket: str = "1 minute") -> DataFrame:
    """Events behind the watermark a stream in event order would have: the batch twin.

    An event is late when its time is more than ``delay`` before the latest time of any
    earlier event; the running maximum goes over fixed ranges of event ids.
    """
    from variscope.plans.scan import SEGMENT
    from pyspark.sql import Window

    rows = cut(events.select("event_id", F.col("ts").cast("timestamp").alias("ts")).withColumn("_seg", F.floor(F.col("event_id") / SEGMENT)))
    inside = Window.partitionBy("_seg").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy("_seg").agg(F.max("ts").alias("_t")).withColumn("_all", F.lit(0))
    carry = tops.withColumn("_c", F.max("_t").over(Window.partitionBy("_all").orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)))
    seen = lookup(rows.withColumn("_m", F.max("ts").over(inside)), carry.select("_seg", "_c"), ["_seg"])
    mark = F.greatest("_m", "_c") - F.expr(f"interval {delay}")
    return seen.filter(F.col("ts") < mark).select("event_id", "ts")


def late_by_batch(events: DataFrame, delay: str = "10 minutes", lag: int = 2) -> DataFrame:
    """Events (event_id, ts, batch) behind the watermark that their micro-batch sees: the batch twin of a stream.

    A micro-batch drops what isn't later than the largest time of the batches up to ``lag`` before it less ``delay``: Spark
    holds rows against the watermark of the batch before, which that batch had from the ones before itself.
    """
    tops = cut(events.groupBy("batch").agg(F.max(F.col("ts").cast("timestamp")).alias("_top")))
    seen = tops.select(F.col("batch").alias("_b"), F.col("_top").alias("_t"))  # a row for each micro-batch
    marks = tops.join(seen, F.col("_b") <= F.col("batch") - lag).groupBy("batch").agg(F.max("_t").alias("_t"))
    met = lookup(events.withColumn("ts", F.col("ts").cast("timestamp")), marks, ["batch"], how="inner")
    return met.filter(F.col("ts") <= F.col("_t") - F.expr(f"interval {delay}")).select("event_id", "ts", "batch")
