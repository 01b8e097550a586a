"""Build inference: which selections of symbols make the build compile a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from variscope.functions import lines as L
from variscope.plans.scan import SEGMENT, Run, scan
from variscope.plans.skew import lookup
from variscope.session import cut

# Suffixes of source files in the order they are tried.
SUFFIXES = (".c", ".S", ".s", ".l", ".y", ".ppm")


def fileset_diff(sets: DataFrame, base: DataFrame, width: int = SEGMENT) -> DataFrame:
    """(selection_id, file, change): files a selection adds to or removes from the base.

    A removed file is a gap in the numbered list of selections that have the file. Gaps
    are read off neighbouring rows, so absent pairs are written only where they are
    the answer.
    """
    base_files = base.select("file").distinct()
    added = sets.select("selection_id", "file").join(base_files, "file", "left_anti").withColumn("change", F.lit("added"))
    ids = cut(sets.select("selection_id").distinct().withColumn("_all", F.lit(0)))
    ids = cut(scan(ids, ["_all"], "selection_id", [Run("idx", "sum", F.lit(1).cast("bigint"))], width=width).drop("_all"))
    end = ids.agg((F.max("idx") + 1).alias("idx"))
    have = lookup(sets.join(base_files, "file", "left_semi"), ids, ["selection_id"], how="inner")
    marks = have.select("file", "idx").distinct().unionByName(base_files.join(end, F.lit(True)).select("file", "idx"))
    steps = scan(cut(marks), ["file"], "idx", [Run("_prev", "lag", F.col("idx"))], width=width)
    low = F.coalesce("_prev", F.lit(0)) + 1
    gaps = steps.filter(low < F.col("idx")).select("file", F.explode(F.sequence(low, F.col("idx") - 1)).alias("idx"))
    gone = lookup(gaps, ids, ["idx"], how="inner").select("selection_id", "file", F.lit("removed").alias("change"))
    return added.select("selection_id", "file", "change").unionByName(gone)


def value_domains(symbols: DataFrame, model: DataFrame) -> DataFrame:
    """(symbol, value): values to try besides the default n; ``m`` where ``X_MODULE`` is known."""
    modules = model.filter(F.col("symbol").endswith("_MODULE")).select(
        F.regexp_replace("symbol", "_MODULE$", "").alias("symbol"), F.lit(True).alias("_m")
    ).distinct()
    rows = symbols.select("symbol").distinct().join(modules, "symbol", "left")
    values = F.when(F.col("_m").isNotNull(), F.array(F.lit("y"), F.lit("m"))).otherwise(F.array(F.lit("y")))
    return rows.select("symbol", F.explode(values).alias("value"))


def selections(literals: DataFrame) -> DataFrame:
    """(selection_id, conj): a sorted array of conjuncts, each a sorted array of ``S=v``.

    Bounded by the symbols of one build directory.
    """
    term = F.array(F.concat("symbol", F.lit("="), "value"))
    return literals.groupBy("selection_id").agg(F.array_sort(F.collect_set(term)).alias("conj"))


def variations(base: DataFrame, visits: DataFrame, groups: DataFrame, domains: DataFrame) -> DataFrame:
    """(selection_id, grp, literals): values of a group's symbols to try on a selection.

    ``visits`` (selection_id, grp) says where each selection is extended. The product is
    built one symbol after the other along the group's positions (grp, pos, symbol). Variations contradicting the selection are dropped, values it already
    has are left out.
    """
    valued = groups.join(domains, "symbol")
    step = valued.select("grp", "pos", F.struct("symbol", "value").alias("l"))
    size = groups.groupBy("grp").agg(F.max("pos").alias("last"))
    longest = int(size.agg(F.max("last")).first()[0] or 0)
    current = step.filter(F.col("pos") == 1).select("grp", F.array("l").alias("lits"))
    done = current.join(size.filter(F.col("last") == 1), "grp", "left_semi")
    for pos in range(2, longest + 1):
        current = current.join(step.filter(F.col("pos") == pos).select("grp", "l"), "grp").select(
            "grp", F.concat("lits", F.array("l")).alias("lits")
        )
        done = done.unionByName(current.join(size.filter(F.col("last") == pos), "grp", "left_semi"))
    have = base.groupBy("selection_id").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "value"))).alias("_have"))
    rows = lookup(visits.distinct(), done, ["grp"], how="inner").join(have, "selection_id")
    against = F.exists("lits", lambda l: F.col("_have")[l["symbol"]].isNotNull() & (F.col("_have")[l["symbol"]] != l["value"]))
    left = F.filter("lits", lambda l: F.col("_have")[l["symbol"]].isNull())
    text = F.concat_ws(" && ", F.transform(left, lambda l: F.concat(l["symbol"], F.lit("="), l["value"])))
    return rows.filter(~against).select("selection_id", "grp", text.alias("literals")).distinct()


def subsumed_selections(rows: DataFrame) -> DataFrame:
    """Rows (file, conj) that stay: no shorter selection of the file is part of them.

    A part is found by its rarest conjunct, so selections meet only where they share
    that one; the empty selection is part of every other.
    """
    rows = cut(rows.select("file", "conj").distinct())
    terms = rows.select("file", "conj", F.explode("conj").alias("t"))
    often = terms.groupBy("file", "t").agg(F.count(F.lit(1)).alias("n"))
    anchor = lookup(terms, often, ["file", "t"], how="inner").groupBy("file", "conj").agg(
        F.min(F.struct("n", "t")).alias("a")
    ).select("file", F.col("conj").alias("small"), F.col("a.t").alias("t"))
    met = lookup(terms, anchor, ["file", "t"], how="inner")
    inside = (F.size("small") < F.size("conj")) & (F.size(F.array_except("small", "conj")) == 0)
    beaten = met.filter(inside).select("file", "conj").distinct()
    empty = rows.filter(F.size("conj") == 0).select("file")
    beaten = beaten.unionByName(rows.filter(F.size("conj") > 0).join(empty, "file", "left_semi").select("file", "conj")).distinct()
    return rows.join(beaten, ["file", "conj"], "left_anti")


def merge_round(rows: DataFrame) -> DataFrame:
    """One round of merging rows (file, conj): equal but for one conjunct become one.

    Each selection joins the first of its groups (by remaining conjuncts) that has more
    than one member; the differing conjuncts become alternatives.
    """
    opened = rows.select("file", "conj", F.explode("conj").alias("t")).withColumn(
        "rest", F.array_except("conj", F.array("t"))
    )
    n = opened.groupBy("file", "rest").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    choice = opened.join(n, ["file", "rest"]).groupBy("file", "conj").agg(F.min(F.struct("rest", "t")).alias("c"))
    merged = choice.groupBy("file", F.col("c.rest").alias("rest")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("c.t")))).alias("alt"), F.count(F.lit(1)).alias("n")
    ).filter(F.col("n") > 1).withColumn("merged", F.array_sort(F.array_append("rest", F.col("alt"))))
    moved = choice.select("file", "conj", F.col("c.rest").alias("rest")).join(merged.select("file", "rest", "merged"), ["file", "rest"])
    stay = rows.join(moved.select("file", "conj"), ["file", "conj"], "left_anti")
    return stay.select("file", "conj").unionByName(moved.select("file", F.col("merged").alias("conj")).distinct())


def merge_selections(rows: DataFrame) -> DataFrame:
    """Merge rounds until nothing changes; every changing round has fewer selections."""
    rows = cut(rows.select("file", "conj").distinct())
    n = rows.count()
    while True:
        rows = cut(merge_round(rows).distinct())
        now = rows.count()
        if now == n:
            return rows
        n = now


def conjunction_text(conj: Column) -> Column:
    """``A=y && (B=m || B=y)`` with sorted parts."""
    part = lambda alt: F.when(F.size(alt) == 1, alt[0]).otherwise(
        F.concat(F.lit("("), F.concat_ws(" || ", F.array_sort(alt)), F.lit(")"))
    )
    return F.concat_ws(" && ", F.array_sort(F.transform(F.filter(conj, lambda a: F.size(a) > 0), part)))


def as_symbols(text: Column) -> Column:
    """``=y`` left out and ``=m`` spelled ``_MODULE``."""
    return F.replace(F.replace(text, F.lit("=y"), F.lit("")), F.lit("=m"), F.lit("_MODULE"))


def selection_text(sel: DataFrame) -> DataFrame:
    plain = conjunction_text(F.col("conj"))
    return sel.select("selection_id", plain.alias("text"), as_symbols(plain).alias("condition"))


def file_rules(sel: DataFrame, files: DataFrame, base: DataFrame) -> DataFrame:
    """(file, condition): under which symbols the build compiles a file.

    ``base`` are the files compiled with nothing selected; they need no condition.
    """
    added = fileset_diff(files, base).filter(F.col("change") == "added").select("selection_id", "file")
    rows = lookup(added, sel, ["selection_id"], how="inner").select("file", "conj")
    kept = merge_selections(subsumed_selections(rows))
    one = kept.select("file", conjunction_text(F.col("conj")).alias("t"))
    all_text = one.groupBy("file").agg(F.array_sort(F.collect_set("t")).alias("ts"))
    joined = F.when(F.size("ts") == 1, F.col("ts")[0]).otherwise(
        F.concat(F.lit("(("), F.concat_ws(") || (", "ts"), F.lit("))"))
    )
    free = base.select("file", F.lit("").alias("condition")).distinct()
    return all_text.select("file", as_symbols(joined).alias("condition")).unionByName(free)


def rule_line(path: Column, condition: Column) -> Column:
    """``FILE_x "cond"``, or the bare name without a condition."""
    name = L.file_variable(path)
    return F.when(condition == "", name).otherwise(F.concat(name, F.lit(' "'), condition, F.lit('"')))


def target_sources(targets: DataFrame, files: DataFrame) -> DataFrame:
    """(target, source): first existing source by order of suffixes, null when unresolved."""
    ranks = F.create_map(*[x for i, s in enumerate(SUFFIXES) for x in (F.lit(s), F.lit(i))])
    suffix = F.regexp_extract("path", r"(\.[^./]+)$", 1)
    found = files.select("path", F.regexp_replace("path", r"\.[^./]+$", "").alias("_stem"), ranks[suffix].alias("_r")).filter(
        F.col("_r").isNotNull()
    ).groupBy("_stem").agg(F.min(F.struct("_r", "path")).alias("s"))
    asked = targets.select("target").distinct().withColumn("_stem", F.expr("left(target, length(target) - 2)"))
    return asked.join(found, "_stem", "left").select("target", F.col("s.path").alias("source"))


def file_state(asked: DataFrame, built: DataFrame) -> DataFrame:
    """(config_id, file, state): y, m, or n for files a build does not report."""
    state = built.select("config_id", "file", "state")
    return asked.join(state, ["config_id", "file"], "left").select("config_id", "file", F.coalesce("state", F.lit("n")).alias("state"))


def built_files(builds: DataFrame, rules: DataFrame, assignment: DataFrame) -> DataFrame:
    """(file_id, config_id): files whose literals all hold under a configuration."""
    on = assignment.filter("val").select("config_id", F.col("var").alias("symbol"), F.lit(True).alias("_on"))
    asked = lookup(rules, builds, ["file_id"], how="inner")
    valued = lookup(asked, on, ["config_id", "symbol"])
    return valued.groupBy("file_id", "config_id").agg(
        F.bool_and(F.col("_on").isNotNull() == F.col("positive")).alias("ok")
    ).filter("ok").select("file_id", "config_id")
