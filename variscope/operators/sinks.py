"""Text outputs as ordered line rows, and their writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from variscope.plans.scan import Run, scan
from variscope.plans.skew import lookup
from variscope.session import cut


def write_lines(rows: DataFrame, path: str, ids: list[str], order: list[str], column: str = "line") -> None:
    """Write line rows as text, one folder per id, in order inside of each file.

    Rows are range-partitioned by id and order, so one large document is spread over
    several files whose names sort in document order.
    """
    rows.repartitionByRange(*ids, *order).sortWithinPartitions(*ids, *order).select(*ids, F.col(column).alias("value")).write.partitionBy(
        *ids
    ).mode("overwrite").text(path)


def placed_lines(rows: DataFrame) -> DataFrame:
    """(name, line, place) of documents read (name, part, at, line): place counts the lines of a document from 1.

    Lines before a part are summed up from one row for each part, so a long document stays spread.
    """
    parts = cut(rows.groupBy("name", "part").agg(F.count(F.lit(1)).alias("_n")))
    parts = scan(parts, ["name"], "part", [Run("_upto", "sum", F.col("_n"))]).select("name", "part", (F.col("_upto") - F.col("_n")).alias("_before"))
    ordered = Window.partitionBy("name", "part").orderBy("at")
    numbered = rows.withColumn("_i", F.row_number().over(ordered).cast("bigint"))
    return lookup(numbered, parts, ["name", "part"], how="inner").select("name", "line", (F.col("_before") + F.col("_i")).alias("place"))


def write_reports(rows: DataFrame, path: str) -> None:
    """Defect reports by kind and suffix."""
    rows.write.partitionBy("kind", "suffix").mode("overwrite").parquet(path)


def model_text(model: DataFrame, always_on: DataFrame, keyword: str) -> DataFrame:
    """(arch, section, symbol, line): header, ALWAYS_ON lines, then one line per symbol.

    ``keyword`` starts lines of meta data; readers take the same one.
    """
    # The header lines of the format.
    blank = F.lit("")
    count = model.groupBy("arch").agg(F.count(F.lit(1)).alias("n"))
    head = count.select("arch", F.posexplode(F.array(
        F.concat(F.lit("I: Items-Count: "), F.col("n").cast("string")), F.lit("I: Format: <variable> [presence condition]"),
        F.lit(f"{keyword} SCHEMA_VERSION 1.1"),
    )).alias("section", "line")).select("arch", "section", blank.alias("symbol"), "line")
    on = always_on.groupBy("arch").agg(F.array_sort(F.collect_set("symbol")).alias("s")).select(
        "arch", F.lit(3).alias("section"), blank.alias("symbol"),
        F.concat(F.lit(f'{keyword} ALWAYS_ON "'), F.concat_ws('" "', "s"), F.lit('"')).alias("line"))
    body = model.select("arch", F.lit(4).alias("section"), "symbol",
                        F.when(F.col("formula") == "", F.col("symbol")).otherwise(F.concat("symbol", F.lit(' "'), "formula", F.lit('"'))).alias("line"))
    return head.unionByName(on).unionByName(body)


def clause_text(var: DataFrame, sym: DataFrame, meta: DataFrame, literal: DataFrame) -> DataFrame:
    """(model, section, pos, line): a clause file as ordered rows."""
    name = lambda word, a, b: F.concat_ws(" ", F.lit("c"), F.lit(word), a, F.col(b).cast("string"))
    head = meta.select("model", F.lit(0).alias("section"), F.xxhash64("key", "value").alias("pos"), name("meta_value", "key", "value").alias("line"))
    syms = sym.select("model", F.lit(1).alias("section"), F.xxhash64("name").alias("pos"), name("sym", "name", "type_code").alias("line"))
    vars_ = var.select("model", F.lit(2).alias("section"), F.col("id").alias("pos"), name("var", "name", "id").alias("line"))
    n_var = var.groupBy("model").agg(F.max("id").alias("v"))
    n_clause = literal.groupBy("model").agg(F.countDistinct("clause_id").alias("c"))
    size = n_var.join(n_clause, "model", "left").select("model", F.lit(3).alias("section"), F.lit(0).cast("bigint").alias("pos"), F.concat_ws(
        " ", F.lit("p cnf"), F.col("v").cast("string"), F.coalesce("c", F.lit(0)).cast("string")).alias("line"))
    number = F.when(F.col("positive"), F.col("var")).otherwise(-F.col("var"))
    body = literal.groupBy("model", "clause_id").agg(F.array_sort(F.collect_list(number)).alias("l")).select(
        "model", F.lit(4).alias("section"), F.col("clause_id").alias("pos"),
        F.concat(F.concat_ws(" ", F.transform("l", lambda x: x.cast("string"))), F.lit(" 0")).alias("line"))
    return head.unionByName(syms).unionByName(vars_).unionByName(size).unionByName(body)
