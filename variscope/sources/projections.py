"""Inputs derived from the given parquet tables, one function per table.

Each function reads the table columns it needs and returns the schema named in its
docstring. They stand in for a source tree, models, configurations and traces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from variscope.plans.scan import Run, scan


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _p(i) -> F.Column:
    return F.concat(F.lit("CONFIG_P"), i.cast("string"))


def source_line(spark: SparkSession, sf: str) -> DataFrame:
    """(file_id, line_no, txt): every order line becomes one conditional chain."""
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("file_id"),
        F.col("l_returnflag").alias("rf"),
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        _p(F.col("l_partkey") % 40).alias("a"),
        _p(F.col("l_suppkey") % 40).alias("b"),
    )
    cat, a, b = F.concat, F.concat(F.lit("defined("), "a", F.lit(")")), F.concat(F.lit("defined("), "b", F.lit(")"))
    form = F.col("l_suppkey") % 6
    header = (
        F.when(form == 0, cat(F.lit("#if !"), a)).when(form == 1, cat(F.lit("#if "), a, F.lit(" || "), b)).when(form == 2, F.lit("#if 1"))
        .when(form == 3, cat(F.lit("#if !("), a, F.lit(" || "), b, F.lit(")")))
        .when(form == 4, cat(F.lit("#if ("), a, F.lit(" && "), b, F.lit(") || "), a)).otherwise(cat(F.lit("#ifdef "), "a"))
    )
    lines = (
        F.when(F.col("rf") == "N", F.array(header, F.lit("code();"), F.lit("#endif")))
        .when(
            F.col("rf") == "A",
            F.array(
                cat(F.lit("#if "), "a", F.lit(" || "), "b"), F.lit("code();"),
                cat(F.lit("#elif "), "b"), F.lit("code();"), F.lit("#else"), F.lit("#endif"),
            ),
        )
        .otherwise(
            F.array(
                cat(F.lit("#ifndef "), "a"), F.lit("code();"), cat(F.lit("#define "), "b"),
                cat(F.lit("#if "), "b", F.lit(" && !"), "a"), F.lit("code();"), F.lit("#endif"), F.lit("#endif"),
            )
        )
    )
    li = li.withColumn("lines", lines).withColumn("n", F.size("lines").cast("bigint"))
    li = scan(
        li, ["file_id"], "l_linenumber", [Run("upto", "sum", F.col("n"))],
        ties=["l_partkey", "l_suppkey", "l_quantity"],
    )
    return li.select("file_id", (F.col("upto") - F.col("n")).alias("base"), F.posexplode("lines").alias("i", "txt")).select(
        "file_id", (F.col("base") + F.col("i") + 1).cast("bigint").alias("line_no"), "txt"
    )


def source_file(spark: SparkSession, sf: str) -> DataFrame:
    """(file_id, path)"""
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("file_id"), "o_custkey", (F.col("o_orderkey") % 5).alias("r")
    )
    customer = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    region = table(spark, sf, "region").select("r_regionkey", "r_name")
    key = F.col("file_id").cast("string")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(region, F.col("r") == F.col("r_regionkey"))
        .select(
            "file_id",
            F.when(
                F.col("file_id") % 4 == 0,
                F.concat(F.lit("arch/"), F.lower("r_name"), F.lit("/kernel/f"), key, F.lit(".c")),
            )
            .otherwise(F.concat(F.lit("drivers/"), F.lower("c_mktsegment"), F.lit("/f"), key, F.lit(".c")))
            .alias("path"),
        )
    )


def _model_index(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct symbol numbers first (40 at most), then one row per architecture."""
    idx = (
        table(spark, sf, "part").filter(F.col("p_partkey") % 10 != 7)
        .select((F.col("p_partkey") % 40).alias("i")).distinct()
    )
    region = table(spark, sf, "region").select(F.col("r_regionkey").alias("r"), F.col("r_name").alias("arch"))
    every = region.agg(F.collect_list(F.struct("r", "arch")).alias("regions"))
    return idx.join(every, F.lit(True)).select("i", F.explode("regions").alias("x")).select("i", "x.r", "x.arch")


def model_symbol(spark: SparkSession, sf: str) -> DataFrame:
    """(arch, symbol, type)"""
    return _model_index(spark, sf).select(
        "arch", _p(F.col("i")).alias("symbol"),
        F.when(F.col("i") % 3 == 0, "tristate").otherwise("boolean").alias("type"),
    )


def model_literal(spark: SparkSession, sf: str) -> DataFrame:
    """(arch, symbol, clause_no, lit_symbol, positive)"""
    i, r = F.col("i"), F.col("r")
    lit = F.array(
        F.struct(F.lit(1).alias("clause_no"), ((i * 3 + r + 1) % 40).alias("j"), F.lit(True).alias("positive")),
        F.struct(F.lit(1).alias("clause_no"), ((i * 5 + 2) % 40).alias("j"), F.lit(True).alias("positive")),
        F.when(
            i % 4 == 0,
            F.struct(F.lit(2).alias("clause_no"), ((i + 7) % 40).alias("j"), F.lit(False).alias("positive")),
        ),
    )
    return (
        _model_index(spark, sf)
        .select("arch", "i", F.explode(lit).alias("l"))
        .filter(F.col("l").isNotNull() & (F.col("l.j") != F.col("i")))
        .select("arch", _p(F.col("i")).alias("symbol"), "l.clause_no", _p(F.col("l.j")).alias("lit_symbol"), "l.positive")
    )


def model_meta(spark: SparkSession, sf: str) -> DataFrame:
    """(arch, key, value)"""
    r = table(spark, sf, "region")
    pairs = F.array(
        F.struct(F.lit("ALWAYS_ON").alias("key"), _p(F.col("r_regionkey")).alias("value")),
        F.struct(F.lit("ALWAYS_OFF").alias("key"), _p(F.col("r_regionkey") + 20).alias("value")),
    )
    return r.select(F.col("r_name").alias("arch"), F.explode(pairs).alias("m")).select("arch", "m.key", "m.value")


def config(spark: SparkSession, sf: str) -> DataFrame:
    """(config_id, symbol, value)"""
    rf = F.col("l_returnflag")
    return (
        table(spark, sf, "lineitem")
        .groupBy((F.col("l_orderkey") % 200).alias("config_id"), _p(F.col("l_partkey") % 40).alias("symbol"))
        .agg(F.min(F.when(rf == "A", "y").when(rf == "N", "n").otherwise("m")).alias("value"))
    )


def build(spark: SparkSession, sf: str) -> DataFrame:
    """(file_id, config_id): the configurations a file was built under, one per order line."""
    return (
        table(spark, sf, "lineitem")
        .select(F.col("l_orderkey").alias("file_id"), (F.col("l_partkey") % 200).alias("config_id"))
        .distinct()
    )


def tool_message(spark: SparkSession, sf: str) -> DataFrame:
    """(config_id, seq, line)"""
    e = F.col("event_id")
    s = lambda c: c.cast("string")
    return table(spark, sf, "events").select(
        (e % 12).alias("config_id"), e.alias("seq"),
        F.concat(
            F.lit("src/f"), s(F.col("user_id") % 20), F.lit(".c:"), s(e % 50), F.lit(":"), s(e % 7), F.lit(": "),
            F.when(F.col("event_type") == "error", "error: ").otherwise("warning: "),
            F.lit("bad "), "event_type", F.lit(" [-Wx]"),
        ).alias("line"),
    )


def trace_event(spark: SparkSession, sf: str) -> DataFrame:
    """(event_id, ts, func, addr, off, caller_addr)"""
    e, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf, "events").select(
        "event_id", "ts", F.col("event_type").alias("func"),
        (u * 1000 + e % 1000).alias("addr"), (e % 16).alias("off"),
        ((u * 7919 + e) % 500000).alias("caller_addr"),
    )


def module(spark: SparkSession, sf: str) -> DataFrame:
    """(name, base, size)"""
    return table(spark, sf, "supplier").select(
        F.col("s_name").alias("name"), (F.col("s_suppkey") * 5000).alias("base"),
        (F.lit(3000) + F.col("s_nationkey") * 10).alias("size"),
    )


def selection_literal(spark: SparkSession, sf: str) -> DataFrame:
    """(selection_id, symbol, value)"""
    k = F.col("l_partkey") % 8
    return (
        table(spark, sf, "lineitem")
        .select((F.col("l_orderkey") % 300).alias("selection_id"), _p(k).alias("symbol"),
                F.when(k % 3 == 0, "m").otherwise("y").alias("value"))
        .distinct()
    )


def selection_file(spark: SparkSession, sf: str) -> DataFrame:
    """(selection_id, file)"""
    return (
        table(spark, sf, "lineitem")
        .select((F.col("l_orderkey") % 300).alias("selection_id"),
                F.concat(F.lit("obj/f"), (F.col("l_suppkey") % 30).cast("string"), F.lit(".o")).alias("file"))
        .distinct()
    )


def document_line(spark: SparkSession, sf: str) -> DataFrame:
    """(file_id, line_no, txt) from free text, whole texts split at newlines."""
    return (
        table(spark, sf, "documents")
        .select(F.col("doc_id").alias("file_id"), F.posexplode(F.split("text", "\n")).alias("i", "txt"))
        .select("file_id", (F.col("i") + 1).cast("bigint").alias("line_no"), "txt")
    )


def list_item(spark: SparkSession, sf: str) -> DataFrame:
    """(list, item): symbols forced on (white) or off (black)."""
    return table(spark, sf, "nation").select(
        F.when(F.col("n_regionkey") % 2 == 0, "white").otherwise("black").alias("list"),
        _p(F.col("n_nationkey")).alias("item"),
    )


def worklist_line(spark: SparkSession, sf: str) -> DataFrame:
    """(line): paths as people type them, some of unknown files."""
    i, path = F.col("file_id") % 5, F.col("path")
    return source_file(spark, sf).select(
        F.when(i == 0, F.concat(F.lit("./"), path)).when(i == 1, F.regexp_replace(path, "/", "//"))
        .when(i == 2, F.concat(F.lit("x/../"), path)).when(i == 3, F.concat(F.lit("gone/"), path)).otherwise(path).alias("line")
    )


def location_line(spark: SparkSession, sf: str) -> DataFrame:
    """(line): ``path:line`` or ``path:line:col``, one per order line."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file_id"), "l_linenumber", "l_suppkey")
    col = F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit(":"), (F.col("l_suppkey") % 80).cast("string"))).otherwise("")
    return li.join(source_file(spark, sf), "file_id").select(
        F.concat("path", F.lit(":"), (F.col("l_linenumber") * 3).cast("string"), col).alias("line")
    )


def include_line(spark: SparkSession, sf: str) -> DataFrame:
    """(file_id, line_no, txt): every file includes the file with half its number."""
    files = source_file(spark, sf)
    target = files.select(F.col("file_id").alias("half"), F.col("path").alias("target"))
    asked = files.select("file_id", F.floor(F.col("file_id") / 2).cast("bigint").alias("half"))
    return asked.join(target, "half").select(
        "file_id", F.lit(1).cast("bigint").alias("line_no"), F.concat(F.lit('#include "'), "target", F.lit('"')).alias("txt")
    )


def partial_config(spark: SparkSession, sf: str) -> DataFrame:
    """(config_id, symbol, value): values somebody wanted for a configuration."""
    return (
        table(spark, sf, "lineitem")
        .groupBy((F.col("l_orderkey") % 200).alias("config_id"), _p(F.col("l_suppkey") % 40).alias("symbol"))
        .agg(F.min(F.when(F.col("l_linestatus") == "F", "y").otherwise("n")).alias("value"))
    )


def config_arch(spark: SparkSession, sf: str) -> DataFrame:
    """(config_id, arch)"""
    ids = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 200).alias("config_id")).distinct()
    region = table(spark, sf, "region").select(F.col("r_regionkey").cast("bigint").alias("_r"), F.col("r_name").alias("arch"))
    return ids.withColumn("_r", F.col("config_id") % 5).join(region, "_r").select("config_id", "arch")


def file_rule(spark: SparkSession, sf: str) -> DataFrame:
    """(file_id, symbol, positive): a file is built when all its literals hold."""
    k = F.col("o_orderkey")
    rule = F.array(
        F.struct((k % 40).alias("i"), F.lit(True).alias("positive")),
        F.struct(((k + 3) % 40).alias("i"), F.lit(False).alias("positive")),
    )
    return table(spark, sf, "orders").select(k.alias("file_id"), F.explode(rule).alias("r")).select(
        "file_id", _p(F.col("r.i")).alias("symbol"), "r.positive"
    )


def object_target(spark: SparkSession, sf: str) -> DataFrame:
    """(target): object files a build reports, some without a source."""
    stem = F.regexp_replace("path", r"\.c$", "")
    return source_file(spark, sf).select(
        F.concat(F.when(F.col("file_id") % 7 == 0, "gen/").otherwise(""), stem, F.lit(".o")).alias("target")
    )


def tree_file(spark: SparkSession, sf: str) -> DataFrame:
    """(path): files of the tree, some with an assembler twin or only that."""
    stem = F.regexp_replace("path", r"\.c$", "")
    i = F.col("file_id") % 3
    found = F.when(i == 0, F.array(F.lit(".c"), F.lit(".S"))).when(i == 1, F.array(F.lit(".S"))).otherwise(F.array(F.lit(".c")))
    return source_file(spark, sf).select(stem.alias("s"), F.explode(found).alias("x")).select(F.concat("s", "x").alias("path"))
