"""Queries over presence-condition models: edges, closure, slices, missing symbols.

A model is a table (arch, symbol, formula); its size is that of a configuration
language, not of the source tree, while the starts asked for come from the sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from variscope.functions import lines as L
from variscope.plans.closure import reach
from variscope.plans.skew import lookup

ALWAYS_ON, ALWAYS_OFF = "ALWAYS_ON", "ALWAYS_OFF"


def with_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row."""
    return df.join(one_row, F.lit(True))


def formulas(symbols: DataFrame, literals: DataFrame) -> DataFrame:
    """Model text from literal rows: ``&&`` of parenthesised ``||`` groups, '' without any."""
    shown = F.concat(F.when(F.col("positive"), "").otherwise("!"), F.col("lit_symbol"))
    groups = literals.groupBy("arch", "symbol", "clause_no").agg(
        F.array_sort(F.collect_list(F.struct("lit_symbol", shown.alias("t")))).alias("g")
    )
    text = groups.select(
        "arch", "symbol", "clause_no",
        F.concat(F.lit("("), F.concat_ws(" || ", F.transform("g", lambda s: s["t"])), F.lit(")")).alias("t"),
    )
    joined = text.groupBy("arch", "symbol").agg(
        F.concat_ws(" && ", F.transform(F.array_sort(F.collect_list(F.struct("clause_no", "t"))), lambda s: s["t"])).alias("formula")
    )
    return symbols.select("arch", "symbol").join(joined, ["arch", "symbol"], "left").select(
        "arch", "symbol", F.coalesce("formula", F.lit("")).alias("formula")
    )


def model_edges(model: DataFrame) -> DataFrame:
    """(arch, src, dst): symbol and every symbol its formula mentions."""
    return model.select("arch", F.col("symbol").alias("src"), F.explode(L.symbols_of(F.col("formula"))).alias("dst"))


def related_symbols(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(arch, start, symbol): what each start reaches through formulas, itself included."""
    rows = starts.select("arch", F.col("symbol").alias("start"), "symbol")
    return reach(rows, edges, ["arch"], "symbol")


def related_listing(related: DataFrame, model: DataFrame) -> DataFrame:
    """Symbols a start reaches, without itself, ``!`` before those not in the model.

    One text per start; its length is bounded by the number of symbols of one model.
    """
    known = model.select("arch", "symbol", F.lit(True).alias("known"))
    shown = lookup(related, known, ["arch", "symbol"])
    others = shown.filter(F.col("start") != F.col("symbol")).groupBy("arch", "start").agg(
        F.array_sort(F.collect_list(F.struct("symbol", F.col("known").isNull().alias("m")))).alias("s")
    )
    text = F.concat_ws(" ", F.transform("s", lambda s: F.concat(F.when(s["m"], "!").otherwise(""), s["symbol"])))
    return related.select("arch", "start").distinct().join(
        others.select("arch", "start", text.alias("listing")), ["arch", "start"], "left"
    ).select("arch", "start", F.coalesce("listing", F.lit("")).alias("listing"))


def forced_symbols(meta: DataFrame, lists: DataFrame, archs: DataFrame) -> DataFrame:
    """(arch, symbol, on): meta values plus white and black list, for every model."""
    own = meta.filter(F.col("key").isin(ALWAYS_ON, ALWAYS_OFF)).select(
        "arch", F.col("value").alias("symbol"), (F.col("key") == ALWAYS_ON).alias("on")
    )
    every = archs.agg(F.collect_set("arch").alias("archs"))
    listed = with_row(lists.filter(F.col("list").isin("white", "black")), every).select(
        F.explode("archs").alias("arch"), F.col("item").alias("symbol"), (F.col("list") == "white").alias("on")
    )
    return own.unionByName(listed).distinct()


def forced_conflicts(forced: DataFrame) -> DataFrame:
    on = forced.filter("on").select("arch", "symbol")
    return on.intersect(forced.filter(~F.col("on")).select("arch", "symbol"))


def slice_symbols(starts: DataFrame, related: DataFrame) -> DataFrame:
    """Symbols reached from the symbols of each slice: ``starts`` has slice columns, arch, symbol."""
    ids = [c for c in starts.columns if c != "symbol"]
    hops = related.select("arch", F.col("start").alias("symbol"), F.col("symbol").alias("_to"))
    return lookup(starts, hops, ["arch", "symbol"], how="inner").select(*ids, F.col("_to").alias("symbol")).distinct()


def model_slice(
    reached: DataFrame, model: DataFrame, forced: DataFrame, ids: list[str], slices: DataFrame | None = None
) -> DataFrame:
    """Formula rows of a slice, with ``part``: implication, on, off.

    ``reached`` holds the slice columns ``ids`` (with arch) and the symbols reached; forced symbols
    are part of every slice of their model. ``slices`` lists all slices, those that reach no symbol included;
    without it they are the ones in ``reached``.
    """
    every = reached if slices is None else slices
    extra = lookup(every.select(*ids).distinct(), forced.select("arch", "symbol"), ["arch"], how="inner")
    symbols = reached.select(*ids, "symbol").unionByName(extra.select(*ids, "symbol")).distinct()
    found = lookup(symbols, model.select("arch", "symbol", "formula"), ["arch", "symbol"], how="inner")
    implied = found.filter(F.col("formula") != "").select(
        *ids, "symbol", F.lit("implication").alias("part"),
        F.concat(F.lit("("), "symbol", F.lit(" -> ("), "formula", F.lit("))")).alias("text"),
    )
    units = lookup(found.select(*ids, "symbol"), forced, ["arch", "symbol"], how="inner").select(
        *ids, "symbol", F.when(F.col("on"), "on").otherwise("off").alias("part"),
        F.concat(F.when(F.col("on"), "").otherwise("!"), "symbol").alias("text"),
    )
    return implied.unionByName(units)


def space_regex(archs: DataFrame, meta: DataFrame) -> DataFrame:
    """(arch, space): regular expression of the configuration space of each model."""
    own = meta.filter(F.col("key") == "CONFIGURATION_SPACE_REGEX").groupBy("arch").agg(F.min("value").alias("space"))
    return archs.select("arch").distinct().join(own, "arch", "left").select(
        "arch", F.coalesce("space", F.lit(L.SPACE_DEFAULT)).alias("space")
    )


def in_space(symbols: DataFrame, spaces: DataFrame) -> DataFrame:
    """Add ``in_space`` to rows with arch and symbol."""
    ids = [c for c in symbols.columns if c != "arch"]
    return lookup(symbols, spaces, ["arch"]).withColumn(
        "in_space", F.expr("symbol rlike concat('^(?:', space, ')$')")
    ).drop("space")


def missing_symbols(
    reached: DataFrame, model: DataFrame, spaces: DataFrame, ids: list[str], defines: DataFrame | None = None
) -> DataFrame:
    """Symbols of a slice the model does not know although they belong to its space."""
    base = F.regexp_replace("symbol", r"[.].*$", "")
    rows = reached.select(*ids, "symbol").join(model.select("arch", "symbol"), ["arch", "symbol"], "left_anti")
    rows = in_space(rows, spaces).filter(
        F.col("in_space") & (F.length("symbol") > 1) & ~F.col("symbol").startswith("__FREE__")
    )
    if defines is not None:
        local = defines.select("file_id", F.col("symbol").alias("_base")).distinct()
        rows = rows.withColumn("_base", base).join(local, ["file_id", "_base"], "left_anti")
    return rows.select(*ids, "symbol")


def clause_model_missing(starts: DataFrame, variables: DataFrame, spaces: DataFrame, ids: list[str]) -> DataFrame:
    """Missing symbols for clause models: no closure, ``FILE_`` names count as present."""
    rows = starts.filter(~F.col("symbol").startswith("FILE_"))
    return missing_symbols(rows, variables, spaces, ids)


def missing_constraint(missing: DataFrame, ids: list[str]) -> DataFrame:
    """``( ! ( a || b ) )`` per slice; bounded by the symbols of one configuration space."""
    return missing.groupBy(*ids).agg(
        F.concat(F.lit("( ! ( "), F.concat_ws(" || ", F.array_sort(F.collect_set("symbol"))), F.lit(" ) )")).alias("text")
    )


def symbol_precondition(slices: DataFrame, missing: DataFrame, ids: list[str]) -> DataFrame:
    """Conjuncts of a symbol's precondition as rows: the slice, then the missing part."""
    tail = missing_constraint(missing, ids).select(*ids, F.lit("").alias("symbol"), F.lit("missing").alias("part"), "text")
    return slices.unionByName(tail)


def leaf_symbols(edges: DataFrame, model: DataFrame) -> DataFrame:
    """Symbols no other symbol mentions; ``X_MODULE`` counts as ``X``."""
    fold = lambda c: F.regexp_replace(c, "_MODULE$", "")
    names = model.filter(~F.col("symbol").endswith("_MODULE")).select("arch", "symbol")
    used = edges.select("arch", fold("src").alias("src"), fold("dst").alias("symbol")).filter(F.col("src") != F.col("symbol"))
    return names.join(used.join(names.withColumnRenamed("symbol", "src"), ["arch", "src"], "left_semi"), ["arch", "symbol"], "left_anti").distinct()


def symbol_types(symbols: DataFrame, types: DataFrame) -> DataFrame:
    """Type of each symbol in upper case, MISSING, or #ERROR when not ``CONFIG_`` shaped."""
    shape = r"^CONFIG_[0-9A-Za-z_]+$"
    asked = symbols.withColumn("_plain", F.regexp_replace("symbol", "_MODULE$", ""))
    known = types.select("arch", F.col("symbol").alias("_plain"), F.upper("type").alias("_t"))
    spread = [c for c in symbols.columns]
    out = lookup(asked, known, ["arch", "_plain"])
    kind = F.when(~F.col("symbol").rlike(shape), "#ERROR").otherwise(F.coalesce("_t", F.lit("MISSING")))
    return out.select(*spread, kind.alias("type"), kind.isin("BOOLEAN", "TRISTATE").alias("is_bool_tristate"))


def model_complete(archs: DataFrame, model: DataFrame, meta: DataFrame) -> DataFrame:
    """False for an empty model and one marked CONFIGURATION_SPACE_INCOMPLETE."""
    n = model.groupBy("arch").agg(F.count(F.lit(1)).alias("n"))
    open_ended = meta.filter(F.col("key") == "CONFIGURATION_SPACE_INCOMPLETE").select("arch").distinct().withColumn("open", F.lit(True))
    return archs.select("arch").distinct().join(n, "arch", "left").join(open_ended, "arch", "left").select(
        "arch", (F.col("open").isNull() & (F.coalesce("n", F.lit(0)) > 0)).alias("complete")
    )


def arch_exclusion(archs: DataFrame, model: DataFrame) -> DataFrame:
    """Model with ``CONFIG_A`` excluding every other architecture, appended or new.

    The list of architectures is one short row; no pairs are formed.
    """
    name = F.concat(F.lit("CONFIG_"), F.upper("arch"))
    named = archs.select("arch").distinct()
    every = named.agg(F.array_sort(F.collect_set(name)).alias("_all"))
    rule = with_row(named, every).select(
        "arch", name.alias("symbol"),
        F.concat_ws(" && ", F.transform(F.array_remove("_all", name), lambda a: F.concat(F.lit("!"), a))).alias("_rule"),
    )
    return model.join(rule, ["arch", "symbol"], "full").select(
        "arch", "symbol", F.concat_ws(" && ", F.nullif("formula", F.lit("")), "_rule").alias("formula")
    )


def merge_model(model_lines: DataFrame, inference_lines: DataFrame) -> DataFrame:
    """Model lines plus inferred file rules plus the constants; noise lines dropped."""
    archs = model_lines.select("arch").distinct()
    constants = archs.select("arch", F.explode(F.array(*[F.lit(f"CONFIG_{v}") for v in "nym"])).alias("line"))
    both = model_lines.unionByName(inference_lines).filter(~F.col("line").rlike("^[EWI]: "))
    return both.unionByName(constants)


def main_model(archs: DataFrame, wanted: str = "x86") -> DataFrame:
    """The model used for files without an architecture: wanted, else x86, else first by name."""
    rank = F.when(F.col("arch") == wanted, 0).when(F.col("arch") == "x86", 1).otherwise(2)
    return archs.agg(F.min(F.struct(rank.alias("r"), "arch")).alias("m")).select(F.col("m.arch").alias("main_arch"))


def file_arch(files: DataFrame, archs: DataFrame) -> DataFrame:
    """Add ``specific_arch``: the model named by the path, where such a model is loaded."""
    known = archs.select("arch").distinct().select(F.lower("arch").alias("_dir"), F.col("arch").alias("specific_arch"))
    asked = files.withColumn("_dir", F.lower(L.arch_of(F.col("path"))))
    return lookup(asked, known, ["_dir"]).drop("_dir")


def subarch(arch: Column, prefer_32bit: bool = False) -> Column:
    """Preferred variant of architectures with a 32 and a 64 bit build."""
    return F.when(arch.isin("x86", "um"), "i386" if prefer_32bit else "x86_64").otherwise(arch)


def model_for_file(files: DataFrame, archs: DataFrame, wanted: str = "x86") -> DataFrame:
    """(file_id, arch): own model of architecture-specific files, else the main one."""
    return with_row(file_arch(files, archs), main_model(archs, wanted)).select(
        "file_id", F.coalesce("specific_arch", "main_arch").alias("arch")
    )
