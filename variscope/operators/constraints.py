"""Conditions of blocks as text rows and as clause rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from variscope.functions import lines as L
from variscope.plans.closure import reach
from variscope.plans.skew import lookup
from variscope.session import cut

LITERAL = "struct<var:string,positive:boolean>"


def lit(var, positive):
    return F.struct(var.alias("var"), positive.alias("positive"))


def yes(var):
    return lit(var, F.lit(True))


def no(var):
    return lit(var, F.lit(False))


def block_var(number):
    return F.concat(F.lit("B"), number.cast("string"))


def block_constraint(blocks: DataFrame) -> DataFrame:
    """(file_id, block_no, text): ``( B <-> parent && expr && ( ! (prev..) ) )``.

    ``expr`` is taken as it stands, so hand in rewritten blocks. The names of earlier
    chain members are part of the text of each member, nearest first.
    """
    earlier = Window.partitionBy("file_id", "chain_no").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    named = blocks.withColumn("_prev", F.reverse(F.collect_list("name").over(earlier)))
    inner = F.concat_ws(
        " && ",
        F.when(F.col("parent_no").isNotNull(), block_var(F.col("parent_no"))),
        F.nullif("expr", F.lit("")),
        F.when(F.size("_prev") > 0, F.concat(F.lit("( ! ("), F.concat_ws(" || ", "_prev"), F.lit(") )"))),
    )
    return named.select("file_id", "block_no", F.concat(F.lit("( "), "name", F.lit(" <-> "), inner, F.lit(" )")).alias("text"))


def define_constraints(defines: DataFrame) -> DataFrame:
    """(file_id, block_no, symbol, version, part, text): what a define states.

    In its block the next version of the symbol is set (or not, for an undef); outside
    it equals the version before.
    """
    block = F.when(F.col("block_no") < 0, "B00").otherwise(block_var(F.col("block_no")))
    old = F.concat("symbol", F.repeat(F.lit("."), (F.col("version") - 1).cast("int")))
    new = F.concat(old, F.lit("."))
    inside = F.concat(F.lit("("), block, F.lit(" -> "), F.when(F.col("is_undef"), "!").otherwise(""), new, F.lit(")"))
    outside = F.concat(F.lit("(!"), block, F.lit(" -> ("), old, F.lit(" <-> "), new, F.lit("))"))
    return defines.select(
        "file_id", "block_no", "symbol", "version", F.posexplode(F.array(inside, outside)).alias("part", "text")
    )


def file_condition(blocks: DataFrame, defines: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, part, pos, text): all conjuncts of a file, each once, as ordered rows.

    ``files`` (file_id, path) adds the link of ``B00`` to the file's variable.
    """
    code = block_constraint(blocks).select("file_id", F.lit(0).alias("part"), F.col("block_no").alias("pos"), "text")
    defs = define_constraints(defines).groupBy("file_id", "text").agg(
        F.min(F.struct("version", F.col("part").alias("p"), "symbol")).alias("k")
    ).select("file_id", F.lit(1).alias("part"), F.col("k.version").alias("pos"), "text")
    top = files.select("file_id", F.lit(2).alias("part"), F.lit(0).cast("bigint").alias("pos"), F.lit("B00").alias("text"))
    link = files.select(
        "file_id", F.lit(3).alias("part"), F.lit(0).cast("bigint").alias("pos"),
        F.concat(F.lit("( B00 <-> "), L.file_variable(F.col("path")), F.lit(" )")).alias("text"),
    )
    return code.unionByName(defs).unionByName(top).unionByName(link)


def base_condition(
    condition: DataFrame, slices: DataFrame, missing: DataFrame, complete: DataFrame, forced: DataFrame, models: DataFrame
) -> DataFrame:
    """(file_id, part, text): what every configuration of a file has to meet.

    Conjuncts of the code, the model slice, missing symbols off for complete models, and
    forced symbols on or off. ``models`` is (file_id, arch).
    """
    off = missing.join(complete.filter("complete").select("arch"), "arch", "left_semi")
    every = lookup(models, forced, ["arch"], how="inner")
    negate = lambda cond: F.concat(F.when(cond, "").otherwise("!"), "symbol").alias("text")
    return (
        condition.select("file_id", F.lit("code").alias("part"), "text")
        .unionByName(slices.select("file_id", F.lit("slice").alias("part"), "text"))
        .unionByName(off.select("file_id", F.lit("missing").alias("part"), negate(F.lit(False))))
        .unionByName(every.select("file_id", F.lit("forced").alias("part"), negate(F.col("on"))))
    )


def closure_edges(blocks: DataFrame, defines: DataFrame | None) -> DataFrame:
    """(file_id, src, dst) between chain prefixes, each named by its last block.

    The prefix up to a block needs the prefix up to its parent, and the prefix up to
    each block that defines a symbol used by one of its members. A symbol counts from
    the first member that uses it.
    """
    up = blocks.filter(F.col("parent_no").isNotNull()).select("file_id", F.col("block_no").alias("src"), F.col("parent_no").alias("dst"))
    if defines is None:
        return up
    inner = defines.filter(F.col("block_no") >= 0).select("file_id", "symbol", F.col("block_no").alias("dst")).distinct()
    uses = blocks.select("file_id", "chain_no", "block_no", F.explode(L.symbols_of(F.col("expr"))).alias("symbol"))
    uses = uses.join(inner.select("file_id", "symbol").distinct(), ["file_id", "symbol"], "left_semi")
    first = uses.groupBy("file_id", "chain_no", "symbol").agg(F.min("block_no").alias("_from"))
    prefix = lookup(
        blocks.select("file_id", "chain_no", F.col("block_no").alias("src")), first, ["file_id", "chain_no"], how="inner"
    ).filter(F.col("src") >= F.col("_from"))
    over = lookup(prefix.select("file_id", "symbol", "src"), inner, ["file_id", "symbol"], how="inner")
    return up.unionByName(over.filter(F.col("dst") != F.col("src")).select("file_id", "src", "dst")).distinct()


def constraint_closure(blocks: DataFrame, defines: DataFrame | None = None) -> DataFrame:
    """(file_id, block_no, chain_no, upto_no): blocks needed to decide a block.

    A row stands for the members of a chain from its opener up to ``upto_no``; for every
    chain only the longest prefix is kept. ``members`` writes the blocks out.
    """
    starts = blocks.select("file_id", "block_no", F.col("block_no").alias("node"))
    rows = reach(starts, cut(closure_edges(blocks, defines)), ["file_id"], "node")
    chains = blocks.select("file_id", F.col("block_no").alias("node"), "chain_no")
    return lookup(rows, chains, ["file_id", "node"], how="inner").groupBy("file_id", "block_no", "chain_no").agg(
        F.max("node").alias("upto_no")
    )


def members(closure: DataFrame, blocks: DataFrame) -> DataFrame:
    """(file_id, block_no, member_no) of ``constraint_closure``."""
    chain = blocks.select("file_id", "chain_no", F.col("block_no").alias("member_no"))
    return lookup(closure, chain, ["file_id", "chain_no"], how="inner").filter(
        F.col("member_no") <= F.col("upto_no")
    ).select("file_id", "block_no", "member_no")


def _followed(blocks: DataFrame) -> DataFrame:
    """Blocks with ``_followed``: true where a later member of the chain names them, else null."""
    after = blocks.filter(F.col("prev_no").isNotNull()).select("file_id", F.col("prev_no").alias("block_no"), F.lit(True).alias("_followed"))
    return blocks.join(after, ["file_id", "block_no"], "left")


def block_clauses(blocks: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(file_id, block_no, lits): clauses of ``B <-> parent && expr && none of the earlier``.

    "Some member up to here is active" gets a variable ``T<n>`` in chains of three and
    more, so the clauses grow with the length of a chain and not with its square. The
    condition must be inside the literal subset (``unsupported`` blocks give no rows);
    a conjunction of disjunctions is negated by choosing one literal of every group.
    With ``only`` (file_id, block_no) just these blocks are looked at.
    """
    rows = _followed(blocks)
    if only is not None:
        rows = rows.join(only, ["file_id", "block_no"], "left_semi")
    groups = F.when(F.col("expr") == "", F.expr(f"cast(array() as array<array<struct<symbol:string,positive:boolean>>>)")).otherwise(
        L.literal_groups(F.col("expr"))
    )
    rows = rows.select("*", F.explode(F.array_compact(F.array(groups))).alias("_g"))
    b, parent = block_var(F.col("block_no")), block_var(F.col("parent_no"))
    opener_before = F.col("prev_no") == F.col("chain_no")
    prev = F.when(opener_before, block_var(F.col("prev_no"))).otherwise(F.concat(F.lit("T"), F.col("prev_no").cast("string")))
    taken = F.concat(F.lit("T"), F.col("block_no").cast("string"))
    has_parent, has_prev = F.col("parent_no").isNotNull(), F.col("prev_no").isNotNull()
    own_t = F.col("_followed").isNotNull() & has_prev

    empty = F.expr(f"cast(array() as array<array<{LITERAL}>>)")
    ways = F.aggregate(
        "_g", F.expr(f"cast(array(array()) as array<array<{LITERAL}>>)"),
        lambda done, g: F.flatten(
            F.transform(done, lambda d: F.transform(g, lambda l: F.array_append(d, lit(l["symbol"], ~l["positive"]))))
        ),
    )
    none = F.expr(f"cast(array() as array<{LITERAL}>)")
    back = F.concat(
        F.array(yes(b)), F.when(has_parent, F.array(no(parent))).otherwise(none), F.when(has_prev, F.array(yes(prev))).otherwise(none)
    )
    clauses = F.concat(
        F.when(has_parent, F.array(F.array(no(b), yes(parent)))).otherwise(empty),
        F.transform("_g", lambda g: F.concat(F.array(no(b)), F.transform(g, lambda l: lit(l["symbol"], l["positive"])))),
        F.when(has_prev, F.array(F.array(no(b), no(prev)))).otherwise(empty),
        F.transform(ways, lambda w: F.concat(back, w)),
        F.when(own_t, F.array(F.array(no(taken), yes(prev), yes(b)), F.array(yes(taken), no(prev)), F.array(yes(taken), no(b)))).otherwise(empty),
    )
    clean = F.array_distinct(F.transform(clauses, lambda c: F.sort_array(F.array_distinct(c))))
    return rows.select("file_id", "block_no", F.explode(clean).alias("lits"))


def define_clauses(defines: DataFrame) -> DataFrame:
    """(file_id, symbol, version, lits): ``define_constraints`` as clauses; ``B00`` is true."""
    block = block_var(F.col("block_no"))
    old = F.concat("symbol", F.repeat(F.lit("."), (F.col("version") - 1).cast("int")))
    new = F.concat(old, F.lit("."))
    sets = lit(new, ~F.col("is_undef"))
    inner = F.array(F.array(no(block), sets), F.array(yes(block), no(old), yes(new)), F.array(yes(block), yes(old), no(new)))
    clauses = F.when(F.col("block_no") < 0, F.array(F.array(sets))).otherwise(inner)
    return defines.select("file_id", "symbol", "version", F.explode(clauses).alias("lits")).withColumn("lits", F.array_sort("lits"))


def literal_rows(clauses: DataFrame) -> DataFrame:
    """One row per literal, the clause as text beside it."""
    text = F.concat_ws(" || ", F.transform("lits", lambda l: F.concat(F.when(l["positive"], "").otherwise("!"), l["var"])))
    ids = [c for c in clauses.columns if c != "lits"]
    return clauses.withColumn("clause", text).select(*ids, "clause", F.explode("lits").alias("l")).select(*ids, "clause", "l.var", "l.positive")


def closure_symbols(member_rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """(file_id, block_no, symbol): plain symbols of the conditions a block depends on."""
    uses = blocks.select("file_id", F.col("block_no").alias("member_no"), F.explode(L.symbols_of(F.col("expr"))).alias("s"))
    named = uses.select("file_id", "member_no", F.regexp_replace("s", "[.]+$", "").alias("symbol")).distinct()
    return lookup(member_rows, named, ["file_id", "member_no"], how="inner").select("file_id", "block_no", "symbol").distinct()


def closure_members(blocks: DataFrame, defines: DataFrame | None) -> DataFrame:
    """(file_id, block_no, member_no), written once: the blocks each block's activity depends on."""
    return cut(members(constraint_closure(blocks, defines), blocks))


def block_slices(
    blocks: DataFrame, rewritten: DataFrame, defines: DataFrame | None, member_rows: DataFrame | None = None, only: DataFrame | None = None
) -> DataFrame:
    """(file_id, block_no, lits): clauses a block's activity depends on.

    Its closure's blocks, and every define of a symbol one of them uses. ``rewritten``
    carries the versioned conditions; pass the blocks themselves to ignore defines.
    ``member_rows`` are the ``closure_members``; with ``only`` (file_id, block_no) just these slices are made.
    """
    member_rows = closure_members(blocks, defines) if member_rows is None else member_rows
    asked = None
    if only is not None:
        member_rows = cut(member_rows.join(only, ["file_id", "block_no"], "left_semi"))
        asked = member_rows.select("file_id", F.col("member_no").alias("block_no")).distinct()
    own = block_clauses(rewritten, asked).withColumnRenamed("block_no", "member_no")
    code = lookup(own, member_rows, ["file_id", "member_no"], how="inner").select("file_id", "block_no", "lits")
    if defines is None:
        return code
    used = closure_symbols(member_rows, rewritten)
    defs = lookup(define_clauses(defines), used, ["file_id", "symbol"], how="inner").select("file_id", "block_no", "lits")
    return code.unionByName(defs)


def slice_marks(rewritten: DataFrame, defines: DataFrame | None, member_rows: DataFrame, limit: int = 4096) -> DataFrame:
    """(file_id, block_no, mark), written once: slices of equal marks differ only by a shift of their block numbers.

    A mark is a hash of all that ``block_slices`` makes clauses of, with block numbers counted from the slice's own block.
    A slice of over ``limit`` such parts keeps a mark of its own, so it is never collected.
    """
    ids = ["file_id", "block_no"]
    told = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    from_own = lambda c: told(F.col(c) - F.col("block_no"))
    part = F.concat_ws("|", told(F.col("_followed")), from_own("chain_no"), from_own("parent_no"), from_own("prev_no"), "expr")
    parts = _followed(rewritten).select("file_id", F.col("block_no").alias("member_no"), part.alias("part"))
    rows = lookup(member_rows, parts, ["file_id", "member_no"], how="inner").select(
        *ids, F.concat_ws("|", (F.col("member_no") - F.col("block_no")).cast("string"), "part").alias("part"))
    # Blocks without a chain, such as an else of its own, are no members, not even their own.
    loose = rewritten.filter(F.col("chain_no").isNull())
    rows = rows.unionByName(loose.select(*ids, F.concat_ws("|", F.lit("own"), from_own("parent_no")).alias("part")))
    if defines is not None:
        used = closure_symbols(member_rows, rewritten)
        places = defines.select("file_id", "symbol", "version", "is_undef", F.col("block_no").alias("_at"))
        at = F.when(F.col("_at") < 0, "top").otherwise((F.col("_at") - F.col("block_no")).cast("string"))
        text = F.concat_ws("|", F.lit("define"), told(F.col("is_undef")), told(F.col("version")), at, "symbol")
        rows = rows.unionByName(lookup(used, places, ["file_id", "symbol"], how="inner").select(*ids, text.alias("part")))
    rows = cut(rows)
    large = cut(rows.groupBy(*ids).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).select(*ids))
    own = large.select(*ids, F.concat_ws(":", *ids).alias("mark"))
    small = rows if large.isEmpty() else rows.join(large, ids, "left_anti")
    text = F.concat_ws("\n", F.sort_array(F.collect_set("part")))
    return cut(small.groupBy(*ids).agg(F.sha2(text, 256).alias("mark")).unionByName(own))


def one_of_each(marks: DataFrame) -> DataFrame:
    """(mark, file_id, block_no), written once: one slice of each mark."""
    first = marks.groupBy("mark").agg(F.min(F.struct("file_id", "block_no")).alias("k"))
    return cut(first.select("mark", "k.file_id", "k.block_no"))


def block_precondition(
    blocks: DataFrame, defines: DataFrame, files: DataFrame, file_models: DataFrame, related: DataFrame,
    model: DataFrame, forced: DataFrame, spaces: DataFrame, complete: DataFrame,
) -> DataFrame:
    """(file_id, block_no, part, text): conjuncts of a block's precondition, one row each.

    ``blocks`` are rewritten blocks. Parts: name, code, define, top, file, slice, missing.
    """
    from variscope.operators import models as M

    member_rows = cut(members(constraint_closure(blocks, defines), blocks))
    used = cut(closure_symbols(member_rows, blocks))
    texts = block_constraint(blocks).withColumnRenamed("block_no", "member_no")
    code = lookup(texts, member_rows, ["file_id", "member_no"], how="inner").select(
        "file_id", "block_no", F.lit("code").alias("part"), "text")
    define_text = define_constraints(defines).select("file_id", "symbol", "text")
    defs = lookup(define_text, used, ["file_id", "symbol"], how="inner").select(
        "file_id", "block_no", F.lit("define").alias("part"), "text").distinct()
    linked = blocks.select("file_id", "block_no", "name").join(files.select("file_id", "path"), "file_id")
    fixed = linked.select("file_id", "block_no", F.explode(F.array(
        F.struct(F.lit("name").alias("part"), F.col("name").alias("text")),
        F.struct(F.lit("top").alias("part"), F.lit("B00").alias("text")),
        F.struct(F.lit("file").alias("part"), F.concat(F.lit("( B00 <-> "), L.file_variable(F.col("path")), F.lit(" )")).alias("text")),
    )).alias("x")).select("file_id", "block_no", "x.part", "x.text")
    ids = ["file_id", "block_no", "arch"]
    starts = lookup(used, file_models, ["file_id"], how="inner").select(*ids, "symbol")
    reached = cut(M.slice_symbols(starts, related))
    every = lookup(blocks.select("file_id", "block_no"), file_models, ["file_id"], how="inner").select(*ids)
    slices = M.model_slice(reached, model, forced, ids, every).select("file_id", "block_no", F.lit("slice").alias("part"), "text")
    gone = M.missing_symbols(reached, model, spaces, ids, defines).join(complete.filter("complete").select("arch"), "arch", "left_semi")
    missing = M.missing_constraint(gone, ids).select("file_id", "block_no", F.lit("missing").alias("part"), "text")
    return fixed.unionByName(code).unionByName(defs).unionByName(slices).unionByName(missing)
