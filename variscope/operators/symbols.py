"""Statistics of symbols in sources and build files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from variscope.functions import lines as L
from variscope.plans.skew import lookup
from variscope.session import cut

#: Registers of a sketch as a power of two, and four standard errors (1.04 / sqrt of the registers) of a merged one.
SKETCH_BITS = 12
SKETCH_ERROR = 4 * 1.04 / 2 ** (SKETCH_BITS / 2)
IN_BUILD_FILE = r"(?:^|[^A-Za-z0-9_])CONFIG_([A-Za-z0-9_]+)"


def symbol_stats(rewritten: DataFrame, file_models: DataFrame, types: DataFrame) -> DataFrame:
    """References and rewrites per file and symbol, and its state in the file's model.

    The first sighting of a symbol counts no rewrites, as later sightings are what the
    maximum is taken over.
    """
    item = L.expr_symbols(rewritten.select("file_id", "block_no", "expr"))
    name, dots = L.item_name(F.col("symbol"))
    seen = cut(item.select("file_id", "block_no", "symbol", name.alias("item"), dots.cast("bigint").alias("rewrites")).filter(
        F.col("item").isNotNull()
    ))
    place = F.struct("block_no", "symbol")
    first = seen.groupBy("file_id", "item").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("n_refs"))
    later = lookup(seen, first.select("file_id", "item", "_first"), ["file_id", "item"], how="inner")
    later = later.filter(place != F.col("_first")).groupBy("file_id", "item").agg(F.max("rewrites").alias("rewrites"))
    stats = first.select("file_id", "item", "n_refs").join(later, ["file_id", "item"], "left")
    stats = stats.join(file_models, "file_id", "left")
    known = types.select("arch", F.col("symbol").alias("item"), F.upper("type").alias("_type"))
    stats = lookup(stats, known, ["arch", "item"])
    present = F.col("_type").isNotNull()
    state = F.when(F.col("arch").isNull(), "NO_MODEL").when(present, "PRESENT").otherwise("MISSING")
    return stats.select(
        "file_id", F.col("item").alias("symbol"), "n_refs", F.coalesce("rewrites", F.lit(0)).cast("bigint").alias("n_rewrites"),
        state.alias("state"), F.when(present, F.col("_type")).otherwise(L.config_like(F.col("item"))).alias("detail"),
    )


def symbol_totals(stats: DataFrame) -> DataFrame:
    return stats.groupBy("symbol").agg(F.sum("n_refs").alias("n_refs"), F.sum("n_rewrites").alias("n_rewrites"))


def build_symbols(lines: DataFrame, arch: str | None = None) -> DataFrame:
    """Symbols named in build files; with ``arch`` other architectures' folders are left out."""
    rows = lines
    if arch is not None:
        rows = rows.filter(~F.col("path").rlike("^arch/") | F.col("path").startswith(f"arch/{arch}/"))
    return rows.select(F.explode(F.regexp_extract_all("txt", F.lit(IN_BUILD_FILE), F.lit(1))).alias("s")).select(
        F.concat(F.lit("CONFIG_"), "s").alias("symbol")
    ).distinct()


def build_symbols_by_dir(lines: DataFrame, model: DataFrame) -> DataFrame:
    """(dir, symbol): symbols per directory plus their ``_MODULE`` names known to a model."""
    named = lines.select(
        F.regexp_replace("path", "/[^/]*$", "").alias("dir"),
        F.explode(F.regexp_extract_all("txt", F.lit(IN_BUILD_FILE), F.lit(1))).alias("s"),
    ).select("dir", F.concat(F.lit("CONFIG_"), "s").alias("symbol")).distinct()
    modules = model.select(F.col("symbol").alias("_m")).filter(F.col("_m").endswith("_MODULE")).distinct()
    modules = modules.select(F.regexp_replace("_m", "_MODULE$", "").alias("symbol"), "_m")
    extra = lookup(named, modules, ["symbol"], how="inner").select("dir", F.col("_m").alias("symbol"))
    return named.unionByName(extra).distinct()


def symbol_union(symbols: DataFrame) -> DataFrame:
    """(symbol, n_archs) over the symbols named by each architecture."""
    return symbols.select("arch", "symbol").distinct().groupBy("symbol").agg(F.count(F.lit(1)).alias("n_archs"))


def symbol_union_approx(symbols: DataFrame) -> DataFrame:
    return symbols.agg(F.approx_count_distinct("symbol").alias("n_symbols"))


def symbol_sketches(symbols: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ``sketch``): a mergeable sketch of the distinct symbols of each key, 4 kB at most however many rows it saw.

    Null symbols count nothing; a null key is a key of its own.
    """
    return symbols.groupBy(*keys).agg(F.hll_sketch_agg("symbol", F.lit(SKETCH_BITS)).alias("sketch"))


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ``sketch``): sketches merged, without counting their symbols again."""
    return sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))


def sketched_counts(sketches: DataFrame) -> DataFrame:
    """``n_symbols`` in place of the sketch; off by at most ``SKETCH_ERROR`` of the count (four standard errors)."""
    return sketches.withColumn("n_symbols", F.hll_sketch_estimate("sketch")).drop("sketch")


def with_parents(rows: DataFrame, of: str = "dir") -> DataFrame:
    """Each row once for its directory and once for every directory above, the empty one at the top included."""
    parts = F.split(of, "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return rows.withColumn(of, F.explode(F.array_distinct(above)))


def symbols_below(named: DataFrame) -> DataFrame:
    """(dir, n_symbols): about how many symbols each directory and all below it name.

    Symbols are read once, for the directory that names them; upwards only sketches travel.
    """
    return sketched_counts(merge_sketches(with_parents(symbol_sketches(named, ["dir"])), ["dir"]))


def within_error(counted: DataFrame, exact: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_exact, near_exact): whether the sketched count is as near to the exact one as stated."""
    near = F.abs(F.col("n_symbols") - F.col("n_exact")) <= F.ceil(F.col("n_exact") * SKETCH_ERROR)
    return exact.join(counted, keys, "left").select(*keys, "n_exact", F.coalesce(near, F.lit(False)).alias("near_exact"))


def files_per_config(built: DataFrame) -> DataFrame:
    """Files built per selection; ``file`` without a source counts as unresolved."""
    return built.groupBy("selection_id").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum(F.col("source").isNull().cast("bigint")).alias("n_unresolved")
    )


def string_dependency_stats(relations: DataFrame) -> DataFrame:
    """Value comparisons (``A = "x"``, ``A != B``) in dependencies: symbols and count."""
    n = F.regexp_count("expr", F.lit(r"[^!<>=]=|!="))
    return (
        relations.filter(F.col("relation").isin("Depends", "Default", "ItemSelects"))
        .select("item", F.explode("args").alias("expr")).withColumn("n", n).filter(F.col("n") > 0)
        .groupBy("item").agg(F.sum("n").cast("bigint").alias("n_comparisons"))
    )
