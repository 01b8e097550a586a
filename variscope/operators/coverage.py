"""Which blocks configurations reach, and which configurations to keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from variscope.functions import lines as L
from variscope.operators.blocks import innermost
from variscope.plans.scan import Run, crossing, scan
from variscope.plans.skew import lookup
from variscope.session import cut

TOP = -1  # block number of the file itself


def unsupported_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks whose condition is outside the literal subset; never guessed."""
    return blocks.filter((F.col("expr") != "") & ~L.supported(F.col("expr"))).select("file_id", "block_no", "chain_no")


def undecided_blocks(blocks: DataFrame) -> DataFrame:
    """(file_id, block_no): members of chains with an unsupported condition, and all blocks inside of these.

    Nothing is known of their activity, so reports of coverage leave them out.
    """
    shape = blocks.select("file_id", "block_no", "chain_no", "depth", "parent_no")
    level = cut(shape.join(unsupported_blocks(blocks).select("file_id", "chain_no").distinct(), ["file_id", "chain_no"], "left_semi").select("file_id", "block_no"))
    out = level
    while not level.isEmpty():
        above = level.withColumnRenamed("block_no", "parent_no")
        level = cut(shape.join(above, ["file_id", "parent_no"], "left_semi").select("file_id", "block_no"))
        out = out.unionByName(level)
    return out.distinct()


def decided(rows: DataFrame, undecided: DataFrame) -> DataFrame:
    """Rows of blocks whose activity is known."""
    return rows.join(undecided, ["file_id", "block_no"], "left_anti")


def enabled_blocks(blocks: DataFrame, builds: DataFrame, assignment: DataFrame) -> DataFrame:
    """(file_id, config_id, block_no): blocks active when a file is built under a configuration.

    A block is active when its own condition holds, no earlier chain member's does, and
    its parent is active; variables a configuration does not set are false. Chains with
    a condition outside the literal subset are left out (``unsupported_blocks`` lists
    them). The file itself counts as block -1.

    ``builds`` says which configurations a file is looked at under, so the work is
    blocks times configurations of the same file, never all times all.
    """
    groups = F.when(F.col("expr") == "", F.array().cast("array<array<struct<symbol:string,positive:boolean>>>")).otherwise(L.literal_groups(F.col("expr")))
    parsed = cut(blocks.select("file_id", "block_no", "chain_no", "depth", "parent_no", groups.alias("_g")))
    usable = parsed.join(parsed.filter(F.col("_g").isNull()).select("file_id", "chain_no").distinct(), ["file_id", "chain_no"], "left_anti")
    true_vars = assignment.filter("val").select("config_id", F.col("var").alias("symbol"), F.lit(True).alias("_on"))
    place = ["file_id", "config_id", "block_no"]

    open_ = usable.filter(~F.exists("_g", lambda g: F.size(g) == 0)).select("file_id", "block_no", F.posexplode("_g").alias("grp", "_l"))
    literals = open_.select("file_id", "block_no", "grp", F.explode("_l").alias("_l")).select("file_id", "block_no", "grp", "_l.*")
    literals = lookup(literals, builds, ["file_id"], how="inner")
    valued = lookup(literals, true_vars, ["config_id", "symbol"])
    holds = F.col("_on").isNotNull() == F.col("positive")
    groups = valued.groupBy(*place, "grp").agg(F.bool_or(holds).alias("g"))
    own = groups.groupBy(*place).agg(F.bool_and("g").alias("own")).filter("own").select(*place)
    free = usable.filter(F.size("_g") == 0).select("file_id", "block_no")
    own = own.unionByName(lookup(free, builds, ["file_id"], how="inner").select(*place))

    shape = usable.select("file_id", "block_no", "chain_no", "depth", "parent_no")
    won = lookup(own, shape, ["file_id", "block_no"], how="inner")
    won = won.groupBy("file_id", "config_id", "chain_no").agg(F.min(F.struct("block_no", "depth", "parent_no")).alias("w"))
    won = cut(won.select("file_id", "config_id", "w.block_no", "w.depth", "w.parent_no"))

    top = builds.select("file_id", "config_id", F.lit(TOP).cast("bigint").alias("block_no"))
    level = won.filter(F.col("depth") == 1).select(*place)
    out = top.unionByName(level)
    deepest = int(won.agg(F.max("depth")).first()[0] or 1)
    for depth in range(2, deepest + 1):
        above = level.withColumnRenamed("block_no", "parent_no")
        level = cut(won.filter(F.col("depth") == depth).join(above, ["file_id", "config_id", "parent_no"]).select(*place))
        out = out.unionByName(level)
    return out


def first_cover(enabled: DataFrame) -> DataFrame:
    """Configurations kept in order when they add a block the earlier ones lack."""
    return enabled.groupBy("file_id", "block_no").agg(F.min("config_id").alias("config_id")).select("file_id", "config_id").distinct()


def greedy_cover(enabled: DataFrame) -> DataFrame:
    """(file_id, config_id, pick): per file, again and again the configuration adding most.

    All files advance together; a round is one count, one choice per file and one anti
    join. Ties go to the smaller configuration id.
    """
    left = cut(enabled.select("file_id", "config_id", "block_no"))
    picks, pick = None, 0
    while not left.isEmpty():
        pick += 1
        gain = left.groupBy("file_id", "config_id").agg(F.count(F.lit(1)).alias("n"))
        best = gain.groupBy("file_id").agg(F.max(F.struct("n", (-F.col("config_id")).alias("neg"))).alias("b"))
        chosen = cut(best.select("file_id", (-F.col("b.neg")).alias("config_id"), F.col("b.n").alias("gain"), F.lit(pick).alias("pick")))
        covered = left.join(chosen.select("file_id", "config_id"), ["file_id", "config_id"], "left_semi").select("file_id", "block_no")
        left = cut(left.join(covered, ["file_id", "block_no"], "left_anti"))
        picks = chosen if picks is None else picks.unionByName(chosen)
    return picks


def block_list(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """All blocks with the file itself as block -1."""
    return blocks.select("file_id", "block_no").unionByName(files.select("file_id", F.lit(TOP).cast("bigint").alias("block_no")))


def coverage_ratio(enabled: DataFrame, all_blocks: DataFrame) -> DataFrame:
    covered = enabled.select("file_id", "block_no").distinct().withColumn("_c", F.lit(1))
    rows = all_blocks.join(covered, ["file_id", "block_no"], "left").groupBy("file_id").agg(
        F.count("_c").alias("n_covered"), F.count(F.lit(1)).alias("n_total")
    )
    return rows.withColumn("percent", F.floor(F.lit(100) * F.col("n_covered") / F.col("n_total")).cast("bigint"))


def added_blocks(enabled: DataFrame, width: int = 1 << 16) -> DataFrame:
    """New blocks per configuration in order of id, with the running total."""
    first = enabled.groupBy("file_id", "block_no").agg(F.min("config_id").alias("config_id"))
    added = first.groupBy("file_id", "config_id").agg(F.count(F.lit(1)).alias("n_added"))
    tried = enabled.select("file_id", "config_id").distinct()
    rows = tried.join(added, ["file_id", "config_id"], "left").withColumn("n_added", F.coalesce("n_added", F.lit(0)))
    far = crossing(enabled, ["file_id"], "config_id", width)
    return scan(rows, ["file_id"], "config_id", [Run("n_total", "sum", F.col("n_added"))], width=width, far=far)


def uncovered_blocks(enabled: DataFrame, all_blocks: DataFrame) -> DataFrame:
    return all_blocks.select("file_id", "block_no").join(enabled.select("file_id", "block_no"), ["file_id", "block_no"], "left_anti")


def line_coverage(enabled: DataFrame, line_counts: DataFrame) -> DataFrame:
    """Lines total and covered, and the same for lines inside blocks only."""
    covered = enabled.select("file_id", "block_no").distinct().withColumn("_c", F.lit(True))
    n, c, top = F.col("n_lines"), F.col("_c").isNotNull(), F.col("block_no") == TOP
    total = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    rows = line_counts.join(covered, ["file_id", "block_no"], "left").groupBy("file_id").agg(
        F.sum(n).alias("n_total"), total(c).alias("n_covered"), total(~top).alias("n_cond_total"), total(c & ~top).alias("_cc")
    )
    reached = enabled.filter(F.col("block_no") == TOP).select("file_id").distinct().withColumn("_top", F.lit(True))
    return rows.join(reached, "file_id", "left").select(
        "file_id", "n_total", "n_covered", "n_cond_total",
        F.when(F.col("_top").isNotNull(), F.col("_cc")).otherwise(0).cast("bigint").alias("n_cond_covered"),
    )


def common_assignment(solutions: DataFrame) -> DataFrame:
    """(file_id, symbol, val): symbols set in all solutions of a file, and equally."""
    n = solutions.select("file_id", "config_id").distinct().groupBy("file_id").agg(F.count(F.lit(1)).alias("_n"))
    same = solutions.groupBy("file_id", "symbol").agg(
        F.count(F.lit(1)).alias("n"), F.min("val").alias("val"), F.max("val").alias("_max")
    )
    return same.join(n, "file_id").filter((F.col("n") == F.col("_n")) & (F.col("val") == F.col("_max"))).select("file_id", "symbol", "val")


def differing_assignment(solutions: DataFrame) -> DataFrame:
    """The rest: variables in which the solutions of a file differ."""
    return solutions.join(common_assignment(solutions).select("file_id", "symbol"), ["file_id", "symbol"], "left_anti")


def distinct_solutions(solutions: DataFrame) -> DataFrame:
    """(file_id, config_id): equal assignments kept once, under the smallest id.

    The list collected per solution is bounded by the symbols of one file's headers.
    """
    text = F.concat_ws(",", F.array_sort(F.collect_list(F.concat("symbol", F.lit("="), F.col("val").cast("int").cast("string")))))
    hashed = solutions.groupBy("file_id", "config_id").agg(F.sha2(text, 256).alias("h"))
    return hashed.groupBy("file_id", "h").agg(F.min("config_id").alias("config_id")).select("file_id", "config_id")


def top_variable_files(solutions: DataFrame, files: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` files with most solutions, by path where equal."""
    counts = solutions.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_solutions"))
    return counts.join(files.select("file_id", "path"), "file_id").orderBy(F.desc("n_solutions"), "path").limit(n).select("path", "n_solutions")


def baseline_coverage(enabled: DataFrame, base_configs: DataFrame) -> DataFrame:
    """Blocks reached by standard configurations, by the others, and only by one side."""
    base = base_configs.select("config_id", F.lit(True).alias("_b"))
    marked = lookup(enabled, base, ["config_id"])
    per = marked.groupBy("file_id", "block_no").agg(
        F.bool_or(F.col("_b").isNotNull()).alias("b"), F.bool_or(F.col("_b").isNull()).alias("o")
    )
    return per.groupBy("file_id").agg(
        F.count_if("b").alias("n_base"), F.count_if("o").alias("n_other"),
        F.count_if(F.col("b") & ~F.col("o")).alias("n_only_base"), F.count_if(F.col("o") & ~F.col("b")).alias("n_only_other"),
    )


def coverage_conflicts(enabled: DataFrame, all_blocks: DataFrame, dead: DataFrame) -> DataFrame:
    """(file_id, block_no, conflict): dead yet covered, or covered yet unknown."""
    seen = enabled.select("file_id", "block_no").distinct()
    dead_hit = seen.intersect(dead.select("file_id", "block_no")).withColumn("conflict", F.lit("dead but covered"))
    unknown = seen.join(all_blocks, ["file_id", "block_no"], "left_anti").withColumn("conflict", F.lit("covered but unknown"))
    return dead_hit.unionByName(unknown)


def masked_source(lines: DataFrame, tree: DataFrame, enabled: DataFrame) -> DataFrame:
    """Lines of inactive blocks and conditional directives get a ``// `` in front.

    ``enabled`` holds the blocks of one configuration per file.
    """
    skip = lines.filter(F.col("txt").rlike(L.DIRECTIVE))
    kind = F.regexp_extract("txt", L.DIRECTIVE, 1)
    conditional = kind.isin(*L.CONDITIONAL)
    plain = lines.filter(~conditional)
    on = enabled.select("file_id", F.col("block_no").alias("inside_no"), F.lit(True).alias("_on"))
    placed = lookup(innermost(plain, tree), on, ["file_id", "inside_no"])
    shown = placed.select("file_id", "line_no", F.concat(F.when(F.col("_on").isNull(), "// ").otherwise(""), "txt").alias("txt"))
    marked = skip.filter(conditional).select("file_id", "line_no", F.concat(F.lit("// "), "txt").alias("txt"))
    return shown.unionByName(marked)


def loc_without_includes(lines: DataFrame) -> DataFrame:
    return lines.filter(~F.col("txt").rlike(r"^\s*#\s*include")).groupBy("file_id").agg(F.count(F.lit(1)).alias("n_lines"))


def observed_dead(blocks: DataFrame, builds: DataFrame, enabled: DataFrame, valid: DataFrame) -> DataFrame:
    """(file_id, block_no, state): never active, or active whenever its parent is.

    Only valid configurations count, and only files built under at least one.
    """
    good = builds.join(valid.filter("valid").select("config_id"), "config_id", "left_semi")
    on = enabled.join(good, ["file_id", "config_id"], "left_semi")
    hits = on.groupBy("file_id", "block_no").agg(F.count(F.lit(1)).alias("_n"))
    parents = hits.select("file_id", F.col("block_no").alias("_p"), F.col("_n").alias("_pn"))
    rows = blocks.join(good.select("file_id").distinct(), "file_id", "left_semi").withColumn(
        "_p", F.coalesce("parent_no", F.lit(TOP))
    )
    rows = rows.select("file_id", "block_no", "_p").join(hits, ["file_id", "block_no"], "left").join(parents, ["file_id", "_p"], "left")
    state = F.when(F.col("_n").isNull(), "never").when(F.col("_n") == F.col("_pn"), "always")
    return rows.select("file_id", "block_no", state.alias("state")).filter(F.col("state").isNotNull())


def coverage_report(enabled: DataFrame, unmet: DataFrame, selected: DataFrame, severities: DataFrame) -> DataFrame:
    """Per file and configuration: blocks covered, mismatches, selected, warnings, errors."""
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    covered = enabled.groupBy("file_id", "config_id").agg(F.count(F.lit(1)).alias("n_covered"))
    wrong = unmet.groupBy("config_id").agg(F.count(F.lit(1)).alias("n_mismatches"))
    per_config = selected.join(wrong, "config_id", "left").join(severities, "config_id", "left")
    return lookup(covered, per_config, ["config_id"]).select(
        "file_id", "config_id", "n_covered", *[zero(c) for c in ("n_mismatches", "n_selected", "n_warnings", "n_errors")]
    )


def file_solutions(file_uses: DataFrame, builds: DataFrame, assignment: DataFrame) -> DataFrame:
    """(file_id, config_id, symbol, val): values a file's symbols have in each of its builds."""
    true_vars = assignment.filter("val").select("config_id", F.col("var").alias("symbol"), F.lit(True).alias("_on"))
    rows = lookup(file_uses.select("file_id", "symbol"), builds, ["file_id"], how="inner")
    valued = lookup(rows, true_vars, ["config_id", "symbol"])
    return valued.select("file_id", "config_id", "symbol", F.col("_on").isNotNull().alias("val"))
