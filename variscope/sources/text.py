"""Readers of text formats. Functions named ``read_*`` take a path; the others take rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from variscope.functions import lines as L
from variscope.plans.scan import SEGMENT, Run, scan
from variscope.plans.skew import lookup
from variscope.session import cut
from variscope.sources.documents import read_documents

STEM = r"([^/]+?)(?:\.[^./]*)?$"


def numbered_lines(spark: SparkSession, path, glob: str | None = None) -> DataFrame:
    """(path, line_no, txt) of text files, large files read in many splits.

    A split knows its first byte; rows of a split keep their order in
    ``monotonically_increasing_id``. The line number is the offset inside the split plus
    the lines of the earlier splits of the file, so no file has to fit in one task.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().alias("_id"), F.col("value").alias("txt"),
    )
    raw = cut(raw)
    # One row per split; a file's splits are few compared with its lines.
    splits = raw.groupBy("path", "_at").agg(F.min("_id").alias("_low"), F.count(F.lit(1)).alias("_n"))
    splits = scan(cut(splits), ["path"], "_at", [Run("_upto", "sum", F.col("_n"))], width=1 << 40)
    placed = lookup(raw, splits, ["path", "_at"], how="inner")
    return placed.select(
        F.regexp_replace("path", "^file:/*", "/").alias("path"),
        (F.col("_upto") - F.col("_n") + F.col("_id") - F.col("_low") + 1).alias("line_no"), "txt",
    )


def read_source_lines(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """(files, lines) of a tree of ``.c``, ``.h`` and ``.S`` files.

    ``file_id`` is a hash of the path, so it stays the same from run to run.
    """
    rows = numbered_lines(spark, path, "*.{c,h,S}").withColumn("file_id", F.xxhash64("path"))
    files = rows.filter(F.col("line_no") == 1).select(
        "file_id", "path", L.file_variable(F.col("path")).alias("file_var"), L.arch_of(F.col("path")).alias("arch")
    )
    return files, rows.select("file_id", "line_no", "txt")


def _text(spark: SparkSession, path, glob: str | None = None) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path).select(
        F.regexp_extract(F.col("_metadata.file_path"), STEM, 1).alias("stem"), F.col("value").alias("line"),
        F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"),
    )


def _of_archs(spark: SparkSession, path: str, suffix: str, archs: list[str] | None) -> DataFrame:
    """(stem, line, at, id) of the documents with a suffix; other architectures' files are not opened."""
    return read_documents(spark, path, suffix, archs).select(F.col("name").alias("stem"), "line", F.col("part").alias("at"), F.col("at").alias("id"))


def read_model(spark: SparkSession, path: str, keyword: str, archs: list[str] | None = None) -> DataFrame:
    """(arch, symbol, formula): ``SYMBOL "formula"`` lines, the first line of a symbol wins.

    ``keyword`` is the word with which the files start lines of meta data; ``archs`` are those to read, else all.
    """
    rows = _of_archs(spark, path, ".model", archs).filter(~F.col("line").rlike(r"^(I:|\s*$|#)") & ~F.col("line").startswith(keyword))
    parsed = rows.select(
        F.col("stem").alias("arch"), F.regexp_extract("line", r"^(\S+)", 1).alias("symbol"),
        F.regexp_extract("line", r'^\S+\s+"(.*)"\s*$', 1).alias("formula"), "at", "id",
    )
    return parsed.groupBy("arch", "symbol").agg(F.min_by("formula", F.struct("at", "id")).alias("formula"))


def read_model_meta(spark: SparkSession, path: str, keyword: str, archs: list[str] | None = None) -> DataFrame:
    """(arch, key, value): every value of ``<keyword> key values...``, once per key."""
    rows = _of_archs(spark, path, ".model", archs).filter(F.col("line").startswith(f"{keyword} "))
    words = F.split(F.trim("line"), r"\s+")
    return rows.select(
        F.col("stem").alias("arch"), F.get(words, F.lit(1)).alias("key"), F.explode(F.slice(words, F.lit(3), F.size(words))).alias("value")
    ).select("arch", "key", F.regexp_replace("value", '^"|"$', "").alias("value")).distinct()


# Relations of the configuration dump that are read.
RELATIONS = ("Item", "HasPrompts", "Default", "ItemSelects", "Depends", "Choice", "ChoiceItem")


def relations(rows: DataFrame) -> DataFrame:
    """(arch, relation, item, args) from rows (arch, line) of a configuration dump."""
    fields = F.regexp_extract_all("line", F.lit(r'("(?:[^"]*)"|\S+)'), F.lit(1))
    bare = F.transform(fields, lambda f: F.regexp_replace(f, '^"|"$', ""))
    return rows.withColumn("f", bare).filter(F.get("f", F.lit(0)).isin(*RELATIONS)).select(
        "arch", F.get("f", F.lit(0)).alias("relation"), F.get("f", F.lit(1)).alias("item"), F.slice("f", F.lit(3), F.size("f")).alias("args")
    )


def read_relations(spark: SparkSession, path: str, archs: list[str] | None = None) -> DataFrame:
    dumps = _of_archs(spark, path, ".rsf", archs).unionByName(_of_archs(spark, path, ".fm", archs))
    return relations(dumps.select(F.col("stem").alias("arch"), "line"))


def symbol_types(rel: DataFrame) -> DataFrame:
    """(arch, symbol, type) from the Item rows of a dump."""
    return rel.filter(F.col("relation") == "Item").select("arch", F.col("item").alias("symbol"), F.get("args", F.lit(0)).alias("type"))


def read_symbol_types(spark: SparkSession, path: str, archs: list[str] | None = None) -> DataFrame:
    return symbol_types(read_relations(spark, path, archs))


def read_clauses(spark: SparkSession, path: str, archs: list[str] | None = None) -> dict[str, DataFrame]:
    """Variables, symbol types, meta values and literals of clause files.

    A clause ends at ``0`` wherever that stands; the clause number is the running count
    of zeros before a literal.
    """
    place = (F.col("at").cast("bigint") * (1 << 40) + F.col("id")).alias("line_no")  # part, then offset
    lines = cut(_of_archs(spark, path, ".cnf", archs).select(F.col("stem").alias("model"), F.col("line").alias("txt"), place))
    words = F.split(F.trim("txt"), r"\s+")
    notes = lines.filter(F.col("txt").startswith("c ")).select("model", words.alias("w"))
    var = notes.filter(F.get("w", F.lit(1)) == "var").select(
        "model", F.get("w", F.lit(2)).alias("name"), F.get("w", F.lit(3)).cast("bigint").alias("id"))
    sym = notes.filter(F.get("w", F.lit(1)) == "sym").select(
        "model", F.get("w", F.lit(2)).alias("name"), F.get("w", F.lit(3)).cast("int").alias("type_code"))
    meta = notes.filter(F.get("w", F.lit(1)) == "meta_value").select(
        "model", F.get("w", F.lit(2)).alias("key"), F.explode(F.slice("w", F.lit(4), F.size("w"))).alias("value"))
    numbers = lines.filter(~F.col("txt").rlike(r"^\s*([cp]\b|$)")).select(
        "model", "line_no", F.posexplode(words).alias("i", "n")
    ).select("model", "line_no", "i", F.col("n").cast("bigint").alias("n"))
    counted = scan(cut(numbers), ["model"], "line_no", [Run("zeros", "sum", (F.col("n") == 0).cast("bigint"))], ties=["i"])
    literal = counted.filter(F.col("n") != 0).select(
        "model", F.col("zeros").alias("clause_id"), F.abs("n").alias("var"), (F.col("n") > 0).alias("positive"))
    return {"var": var, "sym": sym, "meta": meta, "literal": literal}


def config_rows(rows: DataFrame) -> DataFrame:
    """(config_id, symbol, value) from rows (config_id, line)."""
    off = F.nullif(F.regexp_extract("line", r"^# (CONFIG_\S+) is not set", 1), F.lit(""))
    name = F.nullif(F.regexp_extract("line", r"^(CONFIG_[^=\s]+)=(.*)$", 1), F.lit(""))
    value = F.regexp_extract("line", r"^(CONFIG_[^=\s]+)=(.*)$", 2)
    return rows.select(
        "config_id", F.coalesce(name, off).alias("symbol"), F.when(name.isNotNull(), value).otherwise("n").alias("value")
    ).filter(F.col("symbol").isNotNull())


def read_configs(spark: SparkSession, path) -> DataFrame:
    return config_rows(_text(spark, path, "*config*").select(F.col("stem").alias("config_id"), "line"))


def read_list(spark: SparkSession, path) -> DataFrame:
    """(item): one per line, comments and blank lines dropped."""
    item = F.trim(F.regexp_replace("value", "#.*$", ""))
    return spark.read.text(path).select(item.alias("item")).filter(F.col("item") != "").distinct()


def worklist(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Paths of known files named by rows (line)."""
    asked = rows.select(L.normal_path(F.col("line")).alias("path")).distinct()
    return asked.join(files.select("path"), "path", "left_semi")


def read_worklist(spark: SparkSession, path, files: DataFrame) -> DataFrame:
    return worklist(spark.read.text(path).withColumnRenamed("value", "line"), files)


def locations(rows: DataFrame) -> DataFrame:
    """(path, line_no, col_no) from rows (line) of the form ``path:line[:col]``."""
    shape = r"^(.*?):(\d+)(?::(\d+))?$"
    part = lambda i: F.regexp_extract("line", shape, i)
    return rows.filter(F.col("line").rlike(shape)).select(
        part(1).alias("path"), part(2).cast("bigint").alias("line_no"), F.nullif(part(3), F.lit("")).cast("bigint").alias("col_no")
    )


def read_locations(spark: SparkSession, path) -> DataFrame:
    return locations(spark.read.text(path).withColumnRenamed("value", "line"))


def _hex(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("decimal(20,0)")


TRACE = r"^\s*(?:.*\s)?([A-Za-z_][\w.]*)\+0x([0-9a-fA-F]+)(?:/0x[0-9a-fA-F]+)?(?:\s+\[[^\]]*\])?\s+<([0-9a-fA-F]+)>.*<([0-9a-fA-F]+)>\s*$"


def trace_rows(rows: DataFrame) -> DataFrame:
    """(func, addr, caller_addr) from tracer text in rows (value).

    ``addr`` is the start of the function: the address shown minus the offset. Comments
    and lines without an offset are dropped.
    """
    part = lambda i: F.regexp_extract("value", TRACE, i)
    return rows.filter(~F.col("value").startswith("#") & F.col("value").rlike(TRACE)).select(
        part(1).alias("func"), (_hex(part(3)) - _hex(part(2))).cast("decimal(20,0)").alias("addr"), _hex(part(4)).alias("caller_addr")
    )


def read_trace(spark: SparkSession, path) -> DataFrame:
    return trace_rows(spark.read.text(path))


def module_rows(rows: DataFrame) -> DataFrame:
    shape = r"^(\S+)\s+(\d+)\s+\S+\s+\S+\s+\S+\s+0x([0-9a-fA-F]+)"
    part = lambda i: F.regexp_extract("value", shape, i)
    return rows.filter(F.col("value").rlike(shape)).select(
        part(1).alias("name"), _hex(part(3)).alias("base"), part(2).cast("bigint").alias("size")
    )


def read_modules(spark: SparkSession, path) -> DataFrame:
    return module_rows(spark.read.text(path))


def read_tool_messages(spark: SparkSession, path) -> DataFrame:
    """(config_id, seq, line): raw tool output, one file per configuration."""
    rows = numbered_lines(spark, path)
    return rows.select(F.regexp_extract("path", STEM, 1).alias("config_id"), F.col("line_no").alias("seq"), F.col("txt").alias("line"))


def read_model_dir(spark: SparkSession, path: str, keyword: str, archs: list[str] | None = None) -> dict[str, DataFrame]:
    """All models of a folder: architecture is the file stem, a ``.model`` beats a ``.cnf``."""
    model = read_model(spark, path, keyword, archs)
    clauses = read_clauses(spark, path, archs)
    modelled = model.select(F.col("arch").alias("model")).distinct()
    return {
        "model": model, "meta": read_model_meta(spark, path, keyword, archs),
        **{name: df.join(modelled, "model", "left_anti") for name, df in clauses.items()},
    }


def define_flags(rows: DataFrame) -> DataFrame:
    """``#define`` lines from rows (line) holding ``-DNAME=VALUE`` lists."""
    flag = F.explode(F.split(F.trim("line"), r"\s+"))
    return rows.select(flag.alias("f")).filter(F.col("f").startswith("-D")).select(
        F.regexp_extract("f", r"^-D([^=]+)", 1).alias("name"),
        F.coalesce(F.nullif(F.regexp_extract("f", r"^-D[^=]+=(.*)$", 1), F.lit("")), F.lit("1")).alias("value"),
    ).withColumn("line", F.concat_ws(" ", F.lit("#define"), "name", "value"))


def read_define_flags(spark: SparkSession, path) -> DataFrame:
    return define_flags(spark.read.text(path).withColumnRenamed("value", "line"))


def candidate_files(lines: DataFrame, files: DataFrame, shape: str = r"^#\s*if") -> DataFrame:
    """Files worth analysing: some line matches, and the path is not of tools or documents."""
    hits = lines.filter(F.col("txt").rlike(shape)).select("file_id").distinct()
    wanted = files.filter(~F.col("path").rlike(r"^(\./)?(tools|Documentation|scripts)"))
    return wanted.join(hits, "file_id", "left_semi").select("file_id", "path")
