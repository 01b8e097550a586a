"""Structure of conditional blocks, derived by running values over the lines of a file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from variscope.functions import lines as L
from variscope.plans.scan import SEGMENT, Run, crossing, scan
from variscope.plans.skew import lookup
from variscope.session import cut

BLOCK_KEY = ["file_id", "block_no"]


def structure(lines: DataFrame, width: int = SEGMENT) -> DataFrame:
    """One row per conditional directive (block starts and ``endif``).

    depth 1 is the top level; ``chain_no`` is the block number of the chain's opener;
    ``parent_no`` is null at the top level; ``prev_no`` is null for openers;
    ``next_line`` is the line of the next directive of the chain.
    """
    dirs = L.directives(lines.select("file_id", "line_no", "txt"))
    dirs = dirs.filter(F.col("kind").isin(*L.CONDITIONAL))
    far = crossing(lines, ["file_id"], "line_no", width)
    opens = F.col("kind").isin(*L.OPENERS)
    starts = F.col("kind") != "endif"
    step = F.when(opens, 1).when(~starts, -1).otherwise(0)
    placed = scan(
        dirs, ["file_id"], "line_no",
        [
            Run("_sum", "sum", step.cast("bigint")),
            Run("_n", "sum", starts.cast("bigint")),
            Run("_after_start", "lag", starts),
        ],
        width=width, far=far,
    )
    placed = placed.select(
        "file_id", "line_no", "kind", "arg",
        (F.col("_sum") + F.when(starts, 0).otherwise(1)).alias("depth"),
        F.when(starts, F.col("_n") - 1).alias("block_no"),
        (opens & F.coalesce("_after_start", F.lit(False))).alias("_first_child"),
    )
    # An opener right after a block start is that block's first child; its siblings and
    # the rest of its chain sit at the same depth and inherit the parent.
    parent = F.when(F.col("_first_child"), F.col("block_no") - 1)
    tree = scan(
        placed, ["file_id", "depth"], "line_no",
        [
            Run("chain_no", "last", F.when(opens, F.col("block_no"))),
            Run("parent_no", "last", parent),
            Run("_prev", "lag", F.col("block_no")),
            Run("next_line", "lead", F.col("line_no")),
        ],
        width=width, far=far,
    )
    return tree.select(
        "file_id", "line_no", "kind", "arg", "depth", "block_no", "chain_no", "parent_no",
        F.when(~opens, F.col("_prev")).alias("prev_no"), "next_line",
    )


def block_tree(tree: DataFrame) -> DataFrame:
    """Blocks of ``structure``: kind, depth, chain, parent, expression and line range."""
    return tree.filter(F.col("block_no").isNotNull()).select(
        "file_id", "block_no", F.concat(F.lit("B"), F.col("block_no").cast("string")).alias("name"),
        "kind", "depth", "chain_no", "parent_no", "prev_no",
        L.expression(F.col("kind"), F.col("arg")).alias("expr"),
        F.col("line_no").alias("start_line"), F.col("next_line").alias("end_line"),
    )


def block_ranges(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """Name and line range per block; the file itself is ``B00`` with 0:0."""
    top = files.select("file_id", F.lit("B00").alias("name"), F.lit(0).cast("bigint").alias("start_line"),
                       F.lit(0).cast("bigint").alias("end_line"))
    return blocks.select("file_id", "name", "start_line", "end_line").unionByName(top)


def chain_position(blocks: DataFrame, width: int = SEGMENT) -> DataFrame:
    """Number of earlier members of the chain, as ``pos`` (0 for the opener)."""
    return scan(
        blocks, ["file_id", "chain_no"], "block_no", [Run("_p", "sum", F.lit(1).cast("bigint"))], width=width
    ).withColumn("pos", F.col("_p") - 1).drop("_p")


def chain_predecessors(blocks: DataFrame, width: int = SEGMENT) -> DataFrame:
    """Earlier members of the chain as a range: nearest, first, and how many.

    All members of a chain share one ``chain_no`` and depth, so the list "nearest first"
    is the chain read backwards from ``nearest_no`` to ``chain_no``. The range replaces
    a list per block, whose total length grows with the square of the chain.
    """
    return chain_position(blocks, width).select(
        "file_id", "block_no", F.col("prev_no").alias("nearest_no"),
        F.when(F.col("pos") > 0, F.col("chain_no")).alias("first_no"), F.col("pos").alias("n_earlier"),
    )


def chain_conflicts(blocks: DataFrame) -> DataFrame:
    """Blocks that exclude each other: one row per chain of two or more members.

    Every two members of a chain conflict, so the chain with its size is the whole
    relation; ``n_pairs`` counts it without writing the pairs out.
    """
    n = F.col("n_members")
    return (
        blocks.groupBy("file_id", "chain_no")
        .agg(F.count(F.lit(1)).alias("n_members"), F.max("block_no").alias("last_no"))
        .filter(n > 1)
        .withColumn("n_pairs", (n * (n - 1) / 2).cast("bigint"))
    )


def markers(tree: DataFrame) -> DataFrame:
    """Which block is open after each conditional directive (-1 = the file itself)."""
    inside = F.coalesce(F.when(F.col("kind") == "endif", F.col("parent_no")).otherwise(F.col("block_no")), F.lit(-1))
    return tree.select("file_id", "line_no", inside.alias("inside_no"))


def _positions(*tables: DataFrame) -> DataFrame:
    """(file_id, line_no) of all rows of some tables, in which ``crossing`` is found without working the rest out."""
    return reduce(DataFrame.unionByName, [t.select("file_id", "line_no") for t in tables])


def innermost(rows: DataFrame, tree: DataFrame, width: int = SEGMENT, far: DataFrame | str | None = "unknown") -> DataFrame:
    """Add ``inside_no`` to rows (file_id, line_no, ...) that are not conditional lines.

    ``far`` is the ``crossing`` of both tables, found here unless given.
    """
    columns = [c for c in rows.columns if c not in ("file_id", "line_no")]
    marks = markers(tree).withColumn("_mark", F.lit(True))
    for c in columns:
        marks = marks.withColumn(c, F.lit(None).cast(rows.schema[c].dataType))
    both = rows.withColumn("inside_no", F.lit(None).cast("bigint")).withColumn("_mark", F.lit(False))
    if isinstance(far, str):
        far = crossing(_positions(rows, tree), ["file_id"], "line_no", width)
    filled = scan(both.unionByName(marks), ["file_id"], "line_no", [Run("_in", "last", F.col("inside_no"))], width=width, far=far)
    return filled.filter(~F.col("_mark")).select(
        "file_id", "line_no", *columns, F.coalesce("_in", F.lit(-1)).alias("inside_no")
    )


def block_at(locations: DataFrame, tree: DataFrame, width: int = SEGMENT) -> DataFrame:
    """Shortest block strictly around a line; null outside of all blocks.

    On a directive line only the enclosing block counts, so such a line first shows the
    parent (tie 0), then the location (1), then the block that opens there (2).
    """
    parent = F.coalesce("parent_no", F.lit(-1))
    during = tree.select("file_id", "line_no", F.lit(0).alias("_tie"), parent.alias("_no"))
    after = markers(tree).select("file_id", "line_no", F.lit(2).alias("_tie"), F.col("inside_no").alias("_no"))
    asked = locations.select("file_id", "line_no").distinct().select(
        "file_id", "line_no", F.lit(1).alias("_tie"), F.lit(None).cast("bigint").alias("_no")
    )
    both = asked.unionByName(during).unionByName(after)
    far = crossing(_positions(locations, tree), ["file_id"], "line_no", width)
    filled = scan(both, ["file_id"], "line_no", [Run("_in", "last", F.col("_no"))], ties=["_tie"], width=width, far=far)
    return filled.filter(F.col("_tie") == 1).select(
        "file_id", "line_no", F.when(F.col("_in") >= 0, F.col("_in")).alias("block_no")
    )


def block_lines(lines: DataFrame, tree: DataFrame, width: int = SEGMENT) -> DataFrame:
    """Number of code lines whose innermost block is b (-1 = the file itself)."""
    code = lines.filter(~F.col("txt").rlike(L.DIRECTIVE)).select("file_id", "line_no")
    return innermost(code, tree, width).groupBy("file_id", F.col("inside_no").alias("block_no")).agg(
        F.count(F.lit(1)).alias("n_lines")
    )


def ancestors(blocks: DataFrame) -> DataFrame:
    """(file_id, block_no, anc_no, level): each block with itself and its enclosing blocks.

    One join per nesting level; nesting depth is a property of source text, not of
    the number of files.
    """
    parents = blocks.filter(F.col("parent_no").isNotNull()).select(
        "file_id", F.col("block_no").alias("anc_no"), F.col("parent_no").alias("_up")
    )
    rows = blocks.select(*BLOCK_KEY, F.col("block_no").alias("anc_no"), F.lit(0).alias("level"))
    deepest = blocks.agg(F.max("depth")).first()[0] or 1
    out, step = rows, rows
    for level in range(1, int(deepest)):
        step = lookup(step, parents, ["file_id", "anc_no"], how="inner").select(
            *BLOCK_KEY, F.col("_up").alias("anc_no"), F.lit(level).alias("level")
        )
        out = out.unionByName(step)
    return out


def config_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks of chains where a member's header, or one nested in it, mentions ``CONFIG_``."""
    hits = blocks.filter(F.col("expr").contains("CONFIG_")).select(*BLOCK_KEY)
    up = ancestors(blocks).join(hits, BLOCK_KEY).select("file_id", F.col("anc_no").alias("block_no")).distinct()
    chains = blocks.join(up, BLOCK_KEY).select("file_id", "chain_no").distinct()
    return lookup(blocks, chains, ["file_id", "chain_no"], how="inner")


def structure_listing(lines: DataFrame, tree: DataFrame) -> DataFrame:
    """Kind, expression, header line, footer line, parent and previous per block."""
    text = lines.select("file_id", "line_no", F.trim("txt").alias("txt"))
    header = text.withColumnRenamed("txt", "header").withColumnRenamed("line_no", "start_line")
    footer = text.withColumnRenamed("txt", "footer").withColumnRenamed("line_no", "end_line")
    return (
        block_tree(tree)
        .join(header, ["file_id", "start_line"])
        .join(footer, ["file_id", "end_line"], "left")
        .select("file_id", "name", "kind", "expr", "header", "footer", "parent_no", "prev_no")
    )


def decision_blocks(blocks: DataFrame, width: int = SEGMENT) -> DataFrame:
    """Blocks plus an empty ``else`` for each chain that has none, renumbered in line order."""
    last = blocks.groupBy("file_id", "chain_no").agg(
        F.max(F.struct("block_no", "depth", "parent_no", "end_line", "kind")).alias("l"),
        F.max((F.col("kind") == "else").cast("int")).alias("_has"),
    ).filter(F.col("_has") == 0)
    dummy = last.select(
        "file_id", F.col("l.depth").alias("depth"), F.lit("else").alias("kind"), F.lit("").alias("expr"),
        F.col("l.end_line").alias("start_line"), F.col("l.end_line").alias("end_line"), F.lit(True).alias("dummy"),
    )
    real = blocks.select("file_id", "depth", "kind", "expr", "start_line", "end_line", F.lit(False).alias("dummy"))
    lines = _positions(*[blocks.select("file_id", F.col(c).alias("line_no")) for c in ("start_line", "end_line")])
    numbered = scan(
        real.unionByName(dummy), ["file_id"], "start_line", [Run("_n", "sum", F.lit(1).cast("bigint"))],
        ties=["dummy"], width=width, far=crossing(lines, ["file_id"], "line_no", width),
    )
    return numbered.withColumn("block_no", F.col("_n") - 1).drop("_n")


def define_versions(lines: DataFrame, tree: DataFrame, width: int = SEGMENT) -> DataFrame:
    """k-th define or undef of a symbol in a file, and the block it sits in (-1 = file)."""
    dirs = L.directives(lines.select("file_id", "line_no", "txt")).filter(F.col("kind").isin("define", "undef"))
    named = dirs.select(
        "file_id", "line_no", (F.col("kind") == "undef").alias("is_undef"),
        F.regexp_extract("arg", r"^([A-Za-z_][A-Za-z0-9_]*)", 1).alias("symbol"),
    )
    far = crossing(_positions(lines, tree), ["file_id"], "line_no", width)
    placed = innermost(named, tree, width, far)
    return scan(placed, ["file_id", "symbol"], "line_no", [Run("version", "sum", F.lit(1).cast("bigint"))], width=width, far=far).select(
        "file_id", F.col("inside_no").alias("block_no"), "line_no", "symbol", "is_undef", "version"
    )


def symbol_versions(blocks: DataFrame, defines: DataFrame, width: int = SEGMENT) -> DataFrame:
    """(file_id, block_no, symbol, version): defines of the symbol above the block's start."""
    uses = blocks.select("file_id", "block_no", F.col("start_line").alias("line_no"),
                         F.explode(L.symbols_of(F.col("expr"))).alias("symbol"), F.lit(0).cast("bigint").alias("_d"))
    defs = defines.select("file_id", F.lit(None).cast("bigint").alias("block_no"), "line_no", "symbol",
                          F.lit(1).cast("bigint").alias("_d"))
    far = crossing(_positions(blocks.withColumnRenamed("start_line", "line_no"), defines), ["file_id"], "line_no", width)
    return scan(uses.unionByName(defs), ["file_id", "symbol"], "line_no", [Run("version", "sum", F.col("_d"))], width=width, far=far).filter(
        F.col("block_no").isNotNull()
    ).select("file_id", "block_no", "symbol", "version")


def rewrite_symbols(blocks: DataFrame, defines: DataFrame, width: int = SEGMENT) -> DataFrame:
    """Blocks whose expression carries one dot per earlier define of each symbol."""
    versions = symbol_versions(blocks, defines, width).filter(F.col("version") > 0)
    dots = versions.groupBy(*BLOCK_KEY).agg(
        F.map_from_entries(F.collect_list(F.struct("symbol", F.col("version").cast("int")))).alias("_v")
    )
    # Split the expression at symbol borders, add dots to the symbols, glue it again.
    pieces = F.regexp_extract_all("expr", F.lit(r"([A-Za-z_][A-Za-z0-9_]*|[^A-Za-z_]+)"), F.lit(1))
    dotted = F.transform(pieces, lambda p: F.concat(p, F.repeat(F.lit("."), F.coalesce(F.col("_v")[p], F.lit(0)))))
    return blocks.join(dots, BLOCK_KEY, "left").withColumn(
        "expr", F.when(F.col("_v").isNull(), F.col("expr")).otherwise(F.concat_ws("", dotted))
    ).drop("_v")


def block_defines(defines: DataFrame) -> DataFrame:
    """Symbols defined in each block with the line of the first define, one row each."""
    return defines.groupBy("file_id", "block_no", "symbol").agg(
        F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("n_defines")
    )


def directive_skeleton(lines: DataFrame, tree: DataFrame) -> DataFrame:
    """Directive lines in order, each block start followed by a mark ``B<n>``."""
    dirs = lines.filter(F.col("txt").rlike(L.DIRECTIVE)).select("file_id", "line_no", F.lit(0).alias("part"), "txt")
    marks = tree.filter(F.col("block_no").isNotNull()).select(
        "file_id", "line_no", F.lit(1).alias("part"), F.concat(F.lit("B"), F.col("block_no").cast("string")).alias("txt")
    )
    return dirs.unionByName(marks)


def include_guards(lines: DataFrame, tree: DataFrame) -> DataFrame:
    """Files framed by ``#ifndef G`` / ``#define G`` / ``#endif``, with G.

    Only the first two and the last directive of a file matter; they come from
    aggregates that shrink on the map side.
    """
    dirs = cut(L.directives(lines.select("file_id", "line_no", "txt")))
    row = F.struct("line_no", "kind", "arg")
    ends = dirs.groupBy("file_id").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    second = dirs.join(ends.select("file_id", F.col("first.line_no").alias("_l")), "file_id").filter(
        F.col("line_no") > F.col("_l")
    ).groupBy("file_id").agg(F.min(row).alias("second"))
    closing = tree.filter(F.col("block_no") == 0).select("file_id", F.col("next_line").alias("close_line"))
    guard = F.regexp_extract(F.col("first.arg"), r"^([A-Za-z_][A-Za-z0-9_]*)", 1)
    return (
        ends.join(second, "file_id").join(closing, "file_id")
        .filter(
            (F.col("first.kind") == "ifndef") & (F.col("second.kind") == "define") & (F.col("last.kind") == "endif")
            & (guard == F.regexp_extract(F.col("second.arg"), r"^([A-Za-z_][A-Za-z0-9_]*)", 1))
            & (F.col("close_line") == F.col("last.line_no"))
        )
        .select("file_id", guard.alias("guard"))
    )


def include_edges(lines: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst) file ids: a file includes another known file by its path."""
    target = F.regexp_extract("arg", r'^["<]([^">]+)[">]', 1)
    asked = L.directives(lines.select("file_id", "line_no", "txt")).filter(F.col("kind") == "include").select(
        F.col("file_id").alias("src"), target.alias("path"), "line_no"
    )
    known = files.select("path", F.col("file_id").alias("dst"))
    return lookup(asked, known, ["path"], how="inner").select("src", "dst").distinct()


def include_closure(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Every file with the files it reaches through includes, itself included."""
    from variscope.plans.closure import reach

    starts = files.select("file_id", F.col("file_id").alias("reached"))
    return reach(starts, edges, [], "reached")
