"""Configurations: comparison, literals, folding of tristate variables, text rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from variscope.plans.skew import lookup

CONSTANTS = ("CONFIG_n", "CONFIG_y", "CONFIG_m")


def config_literals(config: DataFrame, types: DataFrame) -> DataFrame:
    """(…, var, val): truth values a configuration states, by type of symbol.

    Tristate ``m`` speaks of ``X_MODULE`` only, ``y`` of ``X`` only, ``n`` of both.
    Symbols without a boolean or tristate type state nothing. ``config`` has arch.
    """
    ids = [c for c in config.columns if c not in ("symbol", "value")]
    typed = lookup(config, types.select("arch", "symbol", "type"), ["arch", "symbol"], how="inner")
    lit = lambda var, val: F.struct(var.alias("var"), val.alias("val"))
    base, mod, v = F.col("symbol"), F.concat("symbol", F.lit("_MODULE")), F.col("value")
    tri = (
        F.when(v == "y", F.array(lit(base, F.lit(True))))
        .when(v == "m", F.array(lit(mod, F.lit(True))))
        .otherwise(F.array(lit(base, F.lit(False)), lit(mod, F.lit(False))))
    )
    rows = F.when(F.col("type") == "boolean", F.array(lit(base, v == "y"))).when(F.col("type") == "tristate", tri)
    return typed.select(*ids, F.explode(rows).alias("l")).select(*ids, "l.var", "l.val")


def assignment(config: DataFrame) -> DataFrame:
    """(config_id, var, val): what the preprocessor sees, regardless of types."""
    v = F.col("value")
    pair = F.array(
        F.struct(F.col("symbol").alias("var"), (v == "y").alias("val")),
        F.when(v == "m", F.struct(F.concat("symbol", F.lit("_MODULE")).alias("var"), F.lit(True).alias("val"))),
    )
    return config.select("config_id", F.explode(pair).alias("l")).filter(F.col("l").isNotNull()).select("config_id", "l.var", "l.val")


def config_conflicts(a: DataFrame, b: DataFrame, key: str = "config_id") -> DataFrame:
    """Symbols both configurations set, to different values."""
    other = b.select(key, "symbol", F.col("value").alias("other_value"))
    return a.join(other, [key, "symbol"]).filter(F.col("value") != F.col("other_value"))


def config_conflict(a: DataFrame, b: DataFrame, key: str = "config_id") -> DataFrame:
    """Yes or no per configuration."""
    hit = config_conflicts(a, b, key).select(key).distinct().withColumn("_hit", F.lit(True))
    return a.select(key).distinct().join(hit, key, "left").select(key, F.col("_hit").isNotNull().alias("conflict"))


def verify_expansion(partial: DataFrame, full: DataFrame, forced: DataFrame) -> DataFrame:
    """Wanted values a full configuration does not meet; wanted ``n`` and absent is met."""
    wanted = partial.filter(~F.col("symbol").isin(*CONSTANTS)).join(forced.select("symbol").distinct(), "symbol", "left_anti")
    found = full.select("config_id", "symbol", F.col("value").alias("found"))
    unmet = (F.col("found") != F.col("value")) | (F.col("found").isNull() & (F.col("value") != "n"))
    return wanted.join(found, ["config_id", "symbol"], "left").filter(unmet).select("config_id", "symbol", "value", "found")


def overlay(base: DataFrame, partial: DataFrame, add: bool = False) -> DataFrame:
    """Base without the symbols of the partial configuration, optionally with its values."""
    kept = base.join(partial.select("config_id", "symbol"), ["config_id", "symbol"], "left_anti")
    return kept.unionByName(partial) if add else kept


def selected_count(config: DataFrame) -> DataFrame:
    return config.groupBy("config_id").agg(F.count_if(F.col("value") != "n").alias("n_selected"))


def value_summary(config: DataFrame) -> DataFrame:
    out = config.groupBy("config_id").pivot("value", ["y", "m", "n"]).count()
    return out.select("config_id", *[F.coalesce(F.col(v), F.lit(0)).alias(f"n_{v}") for v in "ymn"])


def config_subarch(
    config: DataFrame,
    wide=("CONFIG_X86_64", "CONFIG_64BIT"),
    narrow=("CONFIG_X86_32",),
    names=("x86_64", "i386"),
) -> DataFrame:
    """Variant a configuration forces: 64 bit, 32 bit, and whether it forces both."""
    s, v = F.col("symbol"), F.col("value")
    forced64 = F.coalesce(F.bool_or(s.isin(*wide) & (v == "y")), F.lit(False))
    forced32 = F.coalesce(F.bool_or((s.isin(*wide) & (v == "n")) | (s.isin(*narrow) & (v == "y"))), F.lit(False))
    rows = config.groupBy("config_id").agg(forced64.alias("forced_64"), forced32.alias("forced_32"))
    sub = F.when(F.col("forced_32"), names[1]).when(F.col("forced_64"), names[0])
    return rows.select("config_id", sub.alias("subarch"), (F.col("forced_64") & F.col("forced_32")).alias("inconsistent"))


def fold_tristate(rows: DataFrame, missing: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, symbol, value, part): ``X`` and ``X_MODULE`` folded to y, m, n.

    A true ``X_MODULE`` makes X=m whatever X says. Missing symbols, choices and names
    outside of ``CONFIG_`` go to the part ``other``; block variables are dropped.
    ``missing`` holds ids and symbol.
    """
    var, val = F.col("var"), F.col("val")
    base = F.regexp_replace("var", "_MODULE$", "")
    gone = missing.select(*ids, F.col("symbol").alias("_s")).distinct()
    marked = rows.filter(~var.rlike(r"^B\d+$")).withColumn("_base", base)
    marked = lookup(marked, gone.withColumnRenamed("_s", "var").withColumn("_m1", F.lit(True)), [*ids, "var"])
    marked = lookup(marked, gone.withColumnRenamed("_s", "_base").withColumn("_m2", F.lit(True)), [*ids, "_base"])
    module = val & var.rlike("^CONFIG_.*_MODULE$")
    absent = F.col("_m1").isNotNull()
    plain = var.rlike("^CONFIG_.*[^.]$") & ~var.rlike("^CONFIG_CHOICE_")
    yn = F.when(val, "y").otherwise("n")
    module_gone = absent | F.col("_m2").isNotNull()
    state = marked.select(
        *ids,
        F.when(module, F.col("_base")).otherwise(var).alias("symbol"),
        F.when(module & ~module_gone, F.struct(F.lit(2).alias("p"), F.lit("m").alias("v")))
        .when(~module & plain & ~absent, F.struct(F.lit(1).alias("p"), yn.alias("v"))).alias("sel"),
        F.when(module & module_gone, "y").when(~module & ~(plain & ~absent), yn).alias("oth"),
    )
    folded = state.groupBy(*ids, "symbol").agg(F.max("sel").alias("sel"), F.max("oth").alias("oth"))
    return folded.select(
        *ids, "symbol", F.coalesce("sel.v", "oth").alias("value"),
        F.when(F.col("sel").isNotNull(), "selection").otherwise("other").alias("part"),
    )


def config_text(folded: DataFrame, ids: list[str]) -> DataFrame:
    """Rows of configuration text: ``SYM=v`` lines, then ``# other=v`` lines.

    One row per line with its sort key, not one text per configuration; write with
    ``sinks.write_lines``.
    """
    s = F.col("symbol")
    hidden = s.startswith("CONFIG_CHOICE_") | s.startswith("__FREE__") | s.isin("CONFIG_n", "CONFIG_y")
    other = F.col("part") == "other"
    return folded.filter(~(other & hidden)).select(
        *ids, F.when(other, 1).otherwise(0).alias("section"), "symbol",
        F.concat(F.when(other, "# ").otherwise(""), s, F.lit("="), "value").alias("line"),
    )


def config_flags(rows: DataFrame, spaces: DataFrame) -> DataFrame:
    """`` -DNAME=1`` per true symbol of the configuration space (rows with arch)."""
    from variscope.operators.models import in_space

    named = rows.filter("val").withColumnRenamed("var", "symbol").filter(
        ~F.col("symbol").rlike(r"^B\d+$") & ~F.col("symbol").endswith(".") & F.col("symbol").rlike("^[_a-zA-Z]")
    )
    ids = [c for c in rows.columns if c not in ("var", "val")]
    return in_space(named, spaces).filter("in_space").select(*ids, "symbol", F.concat(F.lit(" -D"), "symbol", F.lit("=1")).alias("flag"))


def assignment_text(rows: DataFrame, spaces: DataFrame | None = None) -> DataFrame:
    """``NAME=0|1`` per variable, all of them or only those of the space (rows with arch)."""
    from variscope.operators.models import in_space

    ids = [c for c in rows.columns if c not in ("var", "val")]
    named = rows.withColumnRenamed("var", "symbol")
    if spaces is not None:
        named = in_space(named, spaces).filter("in_space")
    return named.select(*ids, "symbol", F.concat("symbol", F.lit("="), F.col("val").cast("int").cast("string")).alias("line"))
