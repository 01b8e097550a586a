"""Evaluation of clause rows: configurations, unit consequences, exhaustive slices."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from variscope.functions.lines import once
from variscope.operators import search
from variscope.operators.constraints import lit, no, yes
from variscope.plans.components import components
from variscope.plans.scan import Run, scan
from variscope.plans.skew import lookup
from variscope.session import cut

MAX_VARS = 12


def model_clauses(literals: DataFrame, forced: DataFrame) -> DataFrame:
    """(arch, owner, lits): ``S -> (formula)`` per group of literals, and forced units.

    ``owner`` is the symbol whose presence in a slice brings the clause along.
    """
    group = literals.groupBy("arch", "symbol", "clause_no").agg(F.collect_set(lit(F.col("lit_symbol"), F.col("positive"))).alias("g"))
    implied = group.select("arch", F.col("symbol").alias("owner"), F.array_sort(F.array_append("g", no(F.col("symbol")))).alias("lits"))
    unit = forced.select("arch", F.col("symbol").alias("owner"), F.array(lit(F.col("symbol"), F.col("on"))).alias("lits"))
    return implied.unionByName(unit)


def tristate_clauses(types: DataFrame) -> DataFrame:
    """(arch, owner, lits): a tristate symbol is built in or a module, never both."""
    tri = types.filter(F.col("type") == "tristate")
    pair = F.array(no(F.col("symbol")), no(F.concat("symbol", F.lit("_MODULE"))))
    return tri.select("arch", F.col("symbol").alias("owner"), pair.alias("lits"))


# --- complete and partial configurations -------------------------------------------


def clause_violations(clauses: DataFrame, config: DataFrame, configs: DataFrame, unmentioned: str = "free") -> DataFrame:
    """(config_id, arch, clause): clauses a configuration breaks.

    ``clauses`` is (arch, clause, var, positive), ``config`` (config_id, arch, var, val),
    ``configs`` (config_id, arch). With ``unmentioned='free'`` a clause is broken when it
    mentions only stated variables and none of its literals holds; with ``'false'`` what
    is not stated is false. Only clauses sharing a variable with the configuration are
    looked at; those of positive literals alone can be broken without that and are
    added for ``'false'``.
    """
    shape = clauses.groupBy("arch", "clause").agg(F.count(F.lit(1)).alias("_n"), F.count_if(~F.col("positive")).alias("_neg"))
    met = lookup(config, clauses, ["arch", "var"], how="inner")
    per = met.groupBy("config_id", "arch", "clause").agg(
        F.bool_or(F.col("val") == F.col("positive")).alias("ok"), F.count(F.lit(1)).alias("m"), F.count_if(~F.col("positive")).alias("mneg")
    )
    per = lookup(per, shape, ["arch", "clause"], how="inner")
    place = ["config_id", "arch", "clause"]
    if unmentioned == "free":
        return per.filter(~F.col("ok") & (F.col("m") == F.col("_n"))).select(*place)
    broken = per.filter(~F.col("ok") & (F.col("mneg") == F.col("_neg"))).select(*place)
    positive = shape.filter(F.col("_neg") == 0).select("arch", "clause")
    untouched = lookup(configs, positive, ["arch"], how="inner").select(*place)
    return broken.unionByName(untouched.join(per.select(*place), place, "left_anti"))


def config_valid(configs: DataFrame, violations: DataFrame) -> DataFrame:
    """(config_id, n_broken, valid)"""
    n = violations.groupBy("config_id").agg(F.count(F.lit(1)).alias("n"))
    return configs.select("config_id").distinct().join(n, "config_id", "left").select(
        "config_id", F.coalesce("n", F.lit(0)).alias("n_broken"), F.col("n").isNull().alias("valid")
    )


def failed_symbols(clauses: DataFrame, config: DataFrame, violations: DataFrame) -> DataFrame:
    """(config_id, var): stated variables occurring in broken clauses."""
    named = lookup(violations, clauses.select("arch", "clause", "var"), ["arch", "clause"], how="inner")
    return named.select("config_id", "arch", "var").distinct().join(config.select("config_id", "arch", "var"), ["config_id", "arch", "var"], "left_semi").select("config_id", "var")


# --- slices: rows (sid, lits) ------------------------------------------------------


def forced_literals(slices: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(open clauses, forced (sid, var, val), conflicting sids) after unit consequences.

    Each round takes the clauses of one literal, drops what they satisfy and the literals
    they falsify. Slices without such clauses leave the loop. The facts of a slice travel
    as one map, bounded by the variables of the slice.
    """
    active = cut(slices.select("sid", "lits").distinct())
    done, facts, conflicts = [], [], []
    while True:
        unit = active.filter(F.size("lits") == 1).select("sid", F.col("lits")[0]["var"].alias("var"), F.col("lits")[0]["positive"].alias("val"))
        fact = cut(unit.groupBy("sid", "var").agg(F.min("val").alias("val"), (F.min("val") != F.max("val")).alias("clash")))
        facts.append(fact.select("sid", "var", "val"))
        conflicts.append(fact.filter("clash").select("sid"))
        known = fact.groupBy("sid").agg(F.map_from_entries(F.collect_list(F.struct("var", "val"))).alias("m"), F.bool_or("clash").alias("clash"))
        joined = lookup(active, known, ["sid"])
        rest = F.filter("lits", lambda l: F.col("m")[l["var"]].isNull())
        holds = F.exists("lits", lambda l: F.col("m")[l["var"]] == l["positive"])
        step = cut(
            joined.filter(F.col("m").isNull() | (~F.col("clash") & ~F.coalesce(holds, F.lit(False)))).select(
                "sid", F.when(F.col("m").isNull(), F.col("lits")).otherwise(rest).alias("lits"), F.col("m").isNull().alias("idle")
            )
        )
        done.append(step.filter("idle").select("sid", "lits"))
        empty = step.filter(F.size("lits") == 0).select("sid").distinct()
        conflicts.append(empty)
        active = step.filter(~F.col("idle")).join(empty, "sid", "left_anti").select("sid", "lits").distinct()
        active = cut(active)
        if active.isEmpty():
            break
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    bad = cut(union(conflicts).distinct())
    return cut(union(done).join(bad, "sid", "left_anti")), cut(union(facts)), bad


def drop_pure(clauses: DataFrame) -> DataFrame:
    """Clauses left when variables seen in one polarity only are set that way."""
    rows = clauses
    while True:
        seen = rows.select("sid", F.explode("lits").alias("l")).groupBy("sid", F.col("l.var").alias("var")).agg(
            F.min("l.positive").alias("lo"), F.max("l.positive").alias("hi")
        )
        pure = seen.filter(F.col("lo") == F.col("hi")).groupBy("sid").agg(F.collect_set("var").alias("p"))
        marked = lookup(rows, pure, ["sid"])
        gone = F.coalesce(F.exists("lits", lambda l: F.array_contains("p", l["var"])), F.lit(False))
        marked = cut(marked.select("sid", "lits", gone.alias("gone")))
        if marked.filter("gone").isEmpty():
            return rows
        rows = cut(marked.filter(~F.col("gone")).select("sid", "lits"))


WORD = 62  # variables of a slice that fit one integer as bits


def masks(clauses: DataFrame, k: int = WORD) -> tuple[DataFrame, DataFrame]:
    """((sid, vars, masks) of slices with at most k variables, sids of larger ones).

    Variable i of the sorted list is bit i; a clause is the pair of its positive and
    negative bits. Larger slices are told apart by counting, before anything is
    collected.
    """
    variables = clauses.select("sid", F.explode("lits").alias("l")).select("sid", F.col("l.var").alias("var")).distinct()
    n = cut(variables.groupBy("sid").agg(F.count(F.lit(1)).alias("n")))
    small = n.filter(F.col("n") <= k).select("sid")
    names = variables.join(small, "sid", "left_semi").groupBy("sid").agg(F.array_sort(F.collect_set("var")).alias("vars"))
    rows = lookup(clauses, names, ["sid"], how="inner")

    def mask(positive):
        held = F.array_distinct(F.filter("lits", lambda l: l["positive"] == F.lit(positive)))
        return F.aggregate(held, F.lit(0).cast("bigint"), lambda a, l: a.bitwiseOR(_bit(F.array_position("vars", l["var"]) - 1)))

    coded = rows.select("sid", "vars", F.struct(mask(True).alias("pos"), mask(False).alias("neg")).alias("m")).distinct()
    return coded.groupBy("sid", "vars").agg(F.collect_list("m").alias("masks")), n.filter(F.col("n") > k).select("sid")


def _bit(i):
    return F.pow(F.lit(2), i).cast("bigint")


def _satisfied(m, t, f):
    return m["pos"].bitwiseAND(t).bitwiseOR(m["neg"].bitwiseAND(f)) != 0


def _open_bits(m, s):
    known = F.bitwise_not(s["t"].bitwiseOR(s["f"]))
    return m["pos"].bitwiseAND(known), m["neg"].bitwiseAND(known)


def _state(t, f, bad, before_t, before_f):
    return F.struct(t.alias("t"), f.alias("f"), bad.alias("bad"), before_t.alias("before_t"), before_f.alias("before_f"))


def _unit(s, m):
    """One clause: a single open literal becomes true, none left is a conflict."""
    pos, neg = _open_bits(m, s)
    n = F.bit_count(pos) + F.bit_count(neg)
    keep = lambda t, f, bad: _state(t, f, bad, s["before_t"], s["before_f"])
    return (
        F.when(s["bad"] | _satisfied(m, s["t"], s["f"]) | (n > 1), s)
        .when(n == 0, keep(s["t"], s["f"], F.lit(True)))
        .otherwise(keep(s["t"].bitwiseOR(pos), s["f"].bitwiseOR(neg), F.lit(False)))
    )


def _closed(column, rounds, start):
    """Unit consequences of the clauses in ``column`` until a pass changes nothing."""
    def one_pass(s, _):
        still = s["bad"] | ((s["t"] == s["before_t"]) & (s["f"] == s["before_f"]))
        return F.when(still, s).otherwise(
            F.aggregate(column, _state(s["t"], s["f"], s["bad"], s["t"], s["f"]), _unit)
        )

    return F.aggregate(F.sequence(F.lit(0), rounds), start, one_pass)


def _fresh():
    zero, unset = F.lit(0).cast("bigint"), F.lit(-1).cast("bigint")
    return _state(zero, zero, F.lit(False), unset, unset)


def consequences(coded: DataFrame) -> DataFrame:
    """Add ``s`` (t, f, bad): bits forced true and false, and whether they conflict.

    Rows are few and costly here, so they are spread by number and not by size.
    """
    parts = 4 * int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return coded.repartition(parts, "sid").withColumn("s", _closed("masks", F.size("vars"), _fresh()))


def with_open(known: DataFrame) -> DataFrame:
    """Add ``bits`` (positions of undecided variables in open clauses) and ``open``.

    ``open`` are the clauses left, over the undecided variables numbered anew from 0.
    """
    left = F.filter("masks", lambda m: ~_satisfied(m, F.col("s.t"), F.col("s.f")))
    rest = F.bitwise_not(F.col("s.t").bitwiseOR(F.col("s.f")))
    known = known.withColumn("_left", F.transform(left, lambda m: F.struct(
        m["pos"].bitwiseAND(rest).alias("pos"), m["neg"].bitwiseAND(rest).alias("neg"))))
    zero = F.lit(0).cast("bigint")
    used = F.aggregate("_left", zero, lambda a, m: a.bitwiseOR(m["pos"]).bitwiseOR(m["neg"]))
    known = known.withColumn("_used", used)
    known = known.withColumn("bits", F.filter(F.sequence(F.lit(0), F.size("vars") - 1), lambda i: F.col("_used").bitwiseAND(_bit(i)) != 0))

    def packed(x):
        return F.aggregate(
            F.transform("bits", lambda b, i: F.when(x.bitwiseAND(_bit(b)) != 0, _bit(i)).otherwise(zero)), zero, lambda a, v: a.bitwiseOR(v)
        )

    return known.withColumn(
        "open", F.transform("_left", lambda m: F.struct(packed(m["pos"]).alias("pos"), packed(m["neg"]).alias("neg")))
    ).drop("_left", "_used")


def _holds_under(a):
    return lambda m: _satisfied(m, a, F.bitwise_not(a))


def enumerate_assignments(slices: DataFrame, k: int = MAX_VARS) -> DataFrame:
    """(sid, mask) for all 2^n assignments of (sid, vars); null mask when n > k."""
    n = F.size("vars")
    return slices.select("sid", "vars", F.explode_outer(F.when(n <= k, _all_masks(n))).alias("mask"))


def _all_masks(n):
    return F.sequence(F.lit(0).cast("bigint"), _bit(n) - 1)


BATCHED = 2048  # variables up to which a slice is decided without relational rounds first


def satisfiable_slices(slices: DataFrame) -> DataFrame:
    """(sid, verdict): yes or no.

    Slices of up to ``BATCHED`` variables are decided in Arrow batches by an exact search.
    Larger slices take the relational rounds first; what is left is split into parts
    that share no variable, and a slice says yes when all its parts do.
    """
    coded, large = numbered(slices)
    small = _decided(coded)
    big = cut(slices.join(large, "sid", "left_semi"))
    if big.isEmpty():
        return small
    open_clauses, _, bad = forced_literals(big)
    parts = cut(independent_parts(drop_pure(open_clauses)))
    told = _decided(numbered(parts.select(F.col("part").alias("sid"), "lits"), None)[0]).withColumnRenamed("sid", "part")
    failed = parts.select("sid", "part").distinct().join(told.filter("verdict = 'no'"), "part", "left_semi").select("sid")
    stuck = bad.unionByName(failed).distinct().withColumn("verdict", F.lit("no"))
    rest = large.join(stuck, "sid", "left").select("sid", F.coalesce("verdict", F.lit("yes")).alias("verdict"))
    return small.unionByName(rest)


def independent_parts(clauses: DataFrame) -> DataFrame:
    """(sid, part, lits): parts of a slice share no variable."""
    node = lambda l: F.to_json(F.struct("sid", l["var"].alias("var")))
    links = clauses.select(F.explode(F.transform("lits", lambda l: F.struct(node(l).alias("a"), node(F.col("lits")[0]).alias("b")))).alias("l"))
    groups = components(links.select("l.*").distinct())
    first = clauses.select("sid", "lits", node(F.col("lits")[0]).alias("id"))
    return lookup(first, groups, ["id"], how="inner").select("sid", F.col("component").alias("part"), "lits")


def numbered(clauses: DataFrame, limit: int | None = 0) -> tuple[DataFrame, DataFrame]:
    """((sid, vars, clauses) up to ``limit`` variables, sids of larger slices).

    The limit is ``BATCHED`` unless given; None is none.

    A clause is a list of numbers: the position of a variable in ``vars`` from 1, negative
    for a negated literal.
    """
    limit = BATCHED if limit == 0 else 2**62 if limit is None else limit
    variables = clauses.select("sid", F.explode("lits").alias("l")).select("sid", F.col("l.var").alias("var")).distinct()
    n = cut(variables.groupBy("sid").agg(F.count(F.lit(1)).alias("n")))
    names = variables.join(n.filter(F.col("n") <= limit).select("sid"), "sid", "left_semi").groupBy("sid").agg(
        F.array_sort(F.collect_set("var")).alias("vars")
    )
    rows = lookup(clauses, names, ["sid"], how="inner")
    number = F.transform(
        "lits", lambda l: F.array_position("vars", l["var"]).cast("int") * F.when(l["positive"], 1).otherwise(-1)
    )
    coded = rows.select("sid", "vars", number.alias("c")).distinct().groupBy("sid", "vars").agg(F.collect_list("c").alias("clauses"))
    return coded, n.filter(F.col("n") > limit).select("sid")


def _decided(coded: DataFrame) -> DataFrame:
    parts = 4 * int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def batches(frames):
        for pdf in frames:
            pdf["verdict"] = ["yes" if search.satisfiable(c) else "no" for c in pdf["clauses"]]
            yield pdf[["sid", "verdict"]]

    return coded.select("sid", "clauses").repartition(parts, "sid").mapInPandas(batches, "sid string, verdict string")


def extreme_assignment(slices: DataFrame, most: bool = False, k: int = MAX_VARS) -> DataFrame:
    """(sid, var, val): the satisfying assignment with fewest (or most) true variables.

    Ties go to the smaller (larger) mask over the sorted variables. Variables in no open
    clause take the wanted value. Slices without a solution give no rows. Up to k undecided
    variables all masks are tried, beyond that an exact search finds the same assignment.
    """
    names = slices.select("sid", F.explode("lits").alias("l")).select("sid", F.col("l.var").alias("var")).distinct()
    coded, large = masks(slices, WORD)
    known = cut(with_open(consequences(coded).filter(~F.col("s.bad"))))
    rows = _extreme(known, most, k)
    large = cut(large.unionByName(known.filter(F.size("bits") > k).select("sid")))
    big = cut(slices.join(large, "sid", "left_semi"))
    if big.isEmpty():
        return rows
    open_clauses, facts, bad = forced_literals(big)
    recoded, _ = numbered(open_clauses, None)
    found = cut(_searched(recoded, most))
    stuck = bad.unionByName(recoded.select("sid").join(found.select("sid").distinct(), "sid", "left_anti"))
    wide = names.join(large, "sid", "left_semi").join(stuck, "sid", "left_anti").join(facts, ["sid", "var"], "left").join(
        found.withColumnRenamed("val", "chosen"), ["sid", "var"], "left"
    )
    return rows.unionByName(wide.select("sid", "var", F.coalesce("val", "chosen", F.lit(most)).alias("val")))


def _searched(coded: DataFrame, most: bool) -> DataFrame:
    """(sid, var, val) of the variables in numbered clauses; no rows without a solution."""
    parts = 4 * int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def batches(frames):
        for pdf in frames:
            for sid, names, clauses in zip(pdf["sid"], pdf["vars"], pdf["clauses"], strict=True):
                on = search.fewest_true(clauses, most)
                if on is not None:
                    yield pd.DataFrame({"sid": sid, "var": list(names), "val": [i + 1 in on for i in range(len(names))]})

    return coded.repartition(parts, "sid").mapInPandas(batches, "sid string, var string, val boolean")


def _extreme(known: DataFrame, most: bool, k: int) -> DataFrame:
    small = known.filter(F.size("bits") <= k)
    fits = F.filter(_all_masks(F.size("bits")), lambda a: F.forall("open", _holds_under(a)))
    ranked = F.transform(fits, lambda a: F.struct(F.bit_count(a).alias("n"), a.alias("m")))
    best = cut(small.withColumn("b", F.array_max(ranked) if most else F.array_min(ranked)).filter(F.col("b").isNotNull()))
    rows = best.select("sid", "s", "bits", "b", F.posexplode("vars").alias("i", "var"))
    at = F.array_position("bits", F.col("i"))
    chosen = F.col("b.m").bitwiseAND(_bit(at - 1)) != 0
    has = lambda mask: F.col(mask).bitwiseAND(_bit(F.col("i"))) != 0
    return rows.select("sid", "var", F.when(has("s.t"), True).when(has("s.f"), False).when(at > 0, chosen).otherwise(most).alias("val"))


def least_assignment(slices: DataFrame, k: int = MAX_VARS) -> DataFrame:
    return extreme_assignment(slices, False, k)


def most_assignment(slices: DataFrame, k: int = MAX_VARS) -> DataFrame:
    return extreme_assignment(slices, True, k)


# --- equal slices are decided once -------------------------------------------------


def named_apart(slices: DataFrame, ids: list[str]) -> DataFrame:
    """Slice clauses with block numbers replaced by their rank inside the slice.

    Two blocks of different files with the same conditions then have equal clauses.
    """
    numbers = slices.select(*ids, F.explode("lits").alias("l")).select(*ids, F.regexp_extract("l.var", r"^[BT](\d+)$", 1).alias("n"))
    numbers = numbers.filter(F.col("n") != "").select(*ids, F.col("n").cast("bigint").alias("n")).distinct()
    order = numbers.groupBy(*ids).agg(F.array_sort(F.collect_set("n")).alias("_order"))
    rows = slices.join(order, ids, "left")

    def rename(l):
        number = F.nullif(F.regexp_extract(l["var"], r"^[BT](\d+)$", 1), F.lit("")).cast("bigint")
        rank = F.array_position("_order", number)
        return F.struct(
            F.when(number.isNull(), l["var"]).otherwise(F.concat(F.left(l["var"], F.lit(1)), rank.cast("string"))).alias("var"),
            l["positive"].alias("positive"),
        )

    return rows.select(*ids, F.array_sort(F.transform("lits", rename)).alias("lits"))


def _texts(clauses):
    """One text for each clause; clauses are lists of literals."""
    return F.transform(clauses, lambda c: F.concat_ws("|", F.transform(c, lambda l: F.concat(F.when(l["positive"], "").otherwise("!"), l["var"]))))


def _gathered(slices: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, clauses): ``named_apart`` in one shuffle, for slices that may be collected."""
    own = lambda l: l["var"].startswith("B") | l["var"].startswith("T")
    number = lambda l: F.when(own(l), F.nullif(F.regexp_extract(l["var"], r"^[BT](\d+)$", 1), F.lit("")).cast("bigint"))
    marked = F.transform("lits", lambda l: F.struct(number(l).alias("n"), l["var"].alias("var"), l["positive"].alias("positive")))
    lists = slices.select(*ids, marked.alias("_c")).groupBy(*ids).agg(F.collect_list("_c").alias("_c"))
    numbers = F.sort_array(F.array_distinct(F.filter(F.transform(F.flatten("_c"), lambda l: l["n"]), lambda n: n.isNotNull())))

    def named(order):
        var = lambda l: F.when(l["n"].isNull(), l["var"]).otherwise(F.concat(F.left(l["var"], F.lit(1)), F.array_position(order, l["n"]).cast("string")))
        return F.transform("_c", lambda c: F.sort_array(F.transform(c, lambda l: F.struct(var(l).alias("var"), l["positive"].alias("positive")))))

    return lists.select(*ids, F.array_distinct(once(numbers, named)).alias("clauses"))


def merge_equal(slices: DataFrame, ids: list[str], limit: int = 4096) -> tuple[DataFrame, DataFrame]:
    """((ids, sid), (sid, lits)): equal slices share one ``sid``.

    A slice of up to ``limit`` clauses gets a hash of its sorted clauses; a larger one
    keeps a ``sid`` of its own, so it is decided without being collected. Clauses are counted before anything is collected.
    """
    slices = cut(slices.select(*ids, "lits").dropna(subset=ids))
    large = cut(slices.groupBy(*ids).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).select(*ids))
    if large.isEmpty():
        return _merge_small(slices, ids)
    keys, merged = _merge_small(slices.join(large, ids, "left_anti"), ids)
    # Clauses that come more than once count once, so some of these may be small as well.
    text = F.concat_ws("|", F.transform("lits", lambda l: F.concat(F.when(l["positive"], "").otherwise("!"), l["var"])))
    rows = cut(named_apart(slices.join(large, ids, "left_semi"), ids).withColumn("_t", text).distinct())
    n = rows.groupBy(*ids).agg(F.count(F.lit(1)).alias("_n"))
    own = F.concat_ws(":", *[F.col(c).cast("string") for c in ids])
    small = rows.join(n.filter(F.col("_n") <= limit).select(*ids), ids, "left_semi")
    hashed = small.groupBy(*ids).agg(F.sha2(F.concat_ws(";", F.array_sort(F.collect_set("_t"))), 256).alias("sid"))
    more = cut(hashed.unionByName(n.filter(F.col("_n") > limit).select(*ids, own.alias("sid"))))
    fresh = more.join(merged.select("sid").distinct(), "sid", "left_anti")
    return keys.unionByName(more), merged.unionByName(rows.join(_shown(fresh, ids), ids).select("sid", "lits"))


def _merge_small(slices: DataFrame, ids: list[str]) -> tuple[DataFrame, DataFrame]:
    sid = F.sha2(F.concat_ws(";", F.sort_array(F.array_distinct(_texts("clauses")))), 256)
    keys = cut(_gathered(slices, ids).select(*ids, sid.alias("sid")))
    one = lookup(slices, cut(_shown(keys, ids)), ids, how="inner").select("sid", "lits")
    return keys, cut(_gathered(one, ["sid"]).select("sid", F.explode("clauses").alias("lits")))


def _shown(keys: DataFrame, ids: list[str]) -> DataFrame:
    """One of the slices of each ``sid``."""
    return keys.groupBy("sid").agg(F.min(F.struct(*ids)).alias("k")).select("sid", *[F.col("k")[c].alias(c) for c in ids])


# --- clause files --------------------------------------------------------------------


def merge_clause_models(var_a: DataFrame, lit_a: DataFrame, var_b: DataFrame, lit_b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add the clauses of b to a; variables match by name, new ones are numbered on.

    ``var`` tables are (name, id), ``lit`` tables (clause_id, var, positive).
    """
    top = var_a.agg(F.max("id").alias("_top"))
    last = lit_a.agg((F.max("clause_id") + 1).alias("_last"))
    fresh = var_b.join(var_a.select("name"), "name", "left_anti").withColumn("_all", F.lit(0))
    fresh = scan(cut(fresh), ["_all"], "id", [Run("_n", "sum", F.lit(1).cast("bigint"))])
    fresh = fresh.join(top, F.lit(True)).select("name", (F.coalesce("_top", F.lit(0)) + F.col("_n")).alias("id"))
    variables = cut(var_a.select("name", "id").unionByName(fresh))
    renumber = var_b.select("name", F.col("id").alias("var")).join(variables, "name")
    moved = lookup(lit_b, renumber.select("var", "id"), ["var"], how="inner").join(last, F.lit(True)).select(
        (F.col("clause_id") + F.coalesce("_last", F.lit(0))).alias("clause_id"), F.col("id").alias("var"), "positive"
    )
    return variables, lit_a.select("clause_id", "var", "positive").unionByName(moved)
