"""Translation of a configuration dump into model formulas.

Tables: relation (arch, relation, item, args). Expressions are rewritten when they are one
level of ``&&`` over ``||`` groups or the other way round; others, and those with a term that has no
translation, give a null text. Rules with such an expression are left out and listed by ``unsupported_rules``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from variscope.session import cut

# Type words of a dump and their codes.
TYPE_CODES = {"boolean": 1, "tristate": 2, "integer": 3, "hex": 4, "string": 5}
OPTION_TYPES = tuple(TYPE_CODES)
_TERM = r"!?\s*[A-Za-z0-9_]+(\s*(=|!=)\s*[A-Za-z0-9_]+)?"
_PART = lambda op: rf"({_TERM}|\(\s*{_TERM}(\s*{op}\s*{_TERM})*\s*\))"
AND_SHAPE = rf"^\s*{_PART(r'\|\|')}(\s*&&\s*{_PART(r'\|\|')})*\s*$"
OR_SHAPE = rf"^\s*{_PART('&&')}(\s*\|\|\s*{_PART('&&')})*\s*$"


def option_symbols(rel: DataFrame) -> DataFrame:
    """(arch, option, symbol, kind, tristate): symbols of options, choices and their metas.

    kind is option, choice or meta; tristate options also give the ``_MODULE`` symbol.
    """
    kind = F.lower(F.get("args", F.lit(0)))
    items = rel.filter((F.col("relation") == "Item") & kind.isin(*OPTION_TYPES)).select(
        "arch", F.col("item").alias("option"), F.lit("option").alias("kind"), (kind == "tristate").alias("tristate"))
    choice = rel.filter((F.col("relation") == "Choice") & (F.size("args") > 1)).select(
        "arch", F.col("item").alias("option"), F.lit("choice").alias("kind"), (F.get("args", F.lit(1)) == "tristate").alias("tristate"))
    meta = choice.filter("tristate").select(
        "arch", F.concat("option", F.lit("_META")).alias("option"), F.lit("meta").alias("kind"), F.lit(False).alias("tristate"))
    rows = items.unionByName(choice).unionByName(meta).distinct()
    name = F.concat(F.lit("CONFIG_"), "option")
    both = F.when(F.col("tristate"), F.array(name, F.concat(name, F.lit("_MODULE")))).otherwise(F.array(name))
    return rows.select("arch", "option", F.explode(both).alias("symbol"), "kind", "tristate")


def option_dependencies(rel: DataFrame) -> DataFrame:
    """(arch, option, expr): several Depends rows of an option joined by or."""
    rows = rel.filter(F.col("relation") == "Depends").select("arch", F.col("item").alias("option"), F.get("args", F.lit(0)).alias("e"))
    all_e = F.array_sort(F.collect_list("e"))
    joined = F.when(F.size("es") > 1, F.concat(F.lit("("), F.concat_ws(") || (", "es"), F.lit(")"))).otherwise(F.col("es")[0])
    return rows.groupBy("arch", "option").agg(all_e.alias("es")).select("arch", "option", joined.alias("expr"))


def tristate_rules(symbols: DataFrame) -> DataFrame:
    """(arch, symbol, rank, text): built in and module exclude each other."""
    tri = symbols.filter("tristate").select("arch", "option").distinct()
    y, m = F.concat(F.lit("CONFIG_"), "option"), F.concat(F.lit("CONFIG_"), "option", F.lit("_MODULE"))
    row = lambda s, rank, text: F.struct(s.alias("symbol"), F.lit(rank).alias("rank"), text.alias("text"))
    rules = F.array(row(y, 1, F.concat(F.lit("!"), m)), row(m, 1, F.concat(F.lit("!"), y)), row(m, 2, F.lit("CONFIG_MODULES")))
    return tri.select("arch", F.explode(rules).alias("r")).select("arch", "r.*")


def drop_choice_terms(terms: Column) -> Column:
    """Terms naming a choice are left out of an array of terms."""
    return F.filter(terms, lambda x: ~F.regexp_replace(x, "^!", "").startswith("CHOICE_"))


def literal_text(name: Column, op: Column, value: Column, tristate: Column, module: Column, options: Column) -> Column:
    """A term over X and X_MODULE; null for comparisons of anything but ``options`` with y, m, n or each other.

    ``module`` is the reading: true where "built as a module" also counts. A plain
    tristate term means "not n" then, and "y" otherwise; ``m`` alone is free, or false.
    """
    y = F.concat(F.lit("CONFIG_"), name)
    m = F.concat(y, F.lit("_MODULE"))
    y2 = F.concat(F.lit("CONFIG_"), value)
    m2 = F.concat(y2, F.lit("_MODULE"))
    both = lambda a, b: F.concat(F.lit("("), a, F.lit(" && "), b, F.lit(")"))
    any_group = lambda *parts: F.concat(F.lit("("), F.concat_ws(" || ", *parts), F.lit(")"))
    no = lambda c: F.concat(F.lit("!"), c)
    any_of = F.concat(F.lit("("), m, F.lit(" || "), y, F.lit(")"))
    none_of = F.concat(F.lit("("), no(m), F.lit(" && "), no(y), F.lit(")"))
    return (
        F.when((op != "") & (op != "!") & name.isin("y", "m", "n"), F.lit(None))
        .when((name == "m") & (op == ""), F.when(module, "__FREE__").otherwise("(__FREE__ && !__FREE__)"))
        .when((op == "") & tristate & module, any_of).when(op == "", y)
        .when((op == "!") & tristate & ~module, none_of).when(op == "!", no(y))
        .when((op == "=") & (value == "y"), y).when((op == "=") & (value == "m"), m).when((op == "=") & (value == "n"), none_of)
        .when((op == "!=") & (value == "y"), no(y)).when((op == "!=") & (value == "m"), no(m)).when((op == "!=") & (value == "n"), any_of)
        .when((op == "=") & options, any_group(both(y, y2), both(m, m2), both(both(no(y), no(y2)), both(no(m), no(m2)))))
        .when((op == "!=") & options, any_group(both(y, no(y2)), both(m, no(m2)), both(no(y), y2), both(no(m), m2)))
    )


def literal_values(exprs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Expressions (arch, id, expr, module) rewritten to configuration symbols as ``text``."""
    bare = F.regexp_replace("expr", r"[()\s]", "")
    by_and = F.col("expr").rlike(AND_SHAPE)
    outer = F.when(by_and, F.split(bare, "&&")).when(F.col("expr").rlike(OR_SHAPE), F.split(bare, r"\|\|"))
    inner = lambda g: F.when(by_and, F.split(g, r"\|\|")).otherwise(F.split(g, "&&"))
    groups = F.filter(F.transform(outer, lambda g: drop_choice_terms(inner(g))), lambda g: F.size(g) > 0)
    ids = [c for c in exprs.columns if c not in ("expr", "module")]
    parsed = exprs.withColumn("_and", by_and).withColumn("_g", groups)
    terms = parsed.select(*ids, "module", "_and", F.posexplode("_g").alias("grp", "g")).select(
        *ids, "module", "_and", "grp", F.posexplode("g").alias("pos", "t")
    )
    shape = r"^(!?)([A-Za-z0-9_]+)(=|!=)?([A-Za-z0-9_]*)$"
    part = lambda i: F.regexp_extract("t", shape, i)
    tri = symbols.filter("tristate").select("arch", F.col("option").alias("name"), F.lit(True).alias("_tri")).distinct()
    named = terms.withColumn("name", part(2)).withColumn("op", F.concat(part(1), part(3))).withColumn("value", part(4))
    # y, m and n may stand on the left of a comparison as well.
    turned = F.col("name").isin("y", "m", "n") & (F.col("value") != "")
    named = named.withColumn("_turned", turned).withColumn("_name", F.col("name")).withColumn("name", F.when(F.col("_turned"), F.col("value")).otherwise(F.col("name")))
    named = named.withColumn("value", F.when(F.col("_turned"), F.col("_name")).otherwise(F.col("value"))).drop("_turned", "_name")
    known = symbols.filter("kind = 'option'").select("arch", F.col("option"), F.lit(True).alias("_known")).distinct()
    named = named.join(tri, ["arch", "name"], "left")
    for side in ("name", "value"):
        named = named.join(known.select("arch", F.col("option").alias(side), F.col("_known").alias(f"_{side}")), ["arch", side], "left")
    options = F.col("_name").isNotNull() & F.col("_value").isNotNull()
    text = literal_text(F.col("name"), F.col("op"), F.col("value"), F.col("_tri").isNotNull(), F.col("module"), options)
    # concat_ws leaves nulls out, so one null makes the whole null first.
    told = lambda parts, x: F.when(F.forall(parts, lambda p: p.isNotNull()), x)
    glue = lambda parts, op: told(parts, F.when(F.size(parts) == 1, parts[0]).otherwise(F.concat(F.lit("("), F.concat_ws(op, parts), F.lit(")"))))
    ordered = lambda key: F.transform(F.array_sort(F.collect_list(F.struct(key, "x"))), lambda s: s["x"])
    grouped = named.withColumn("x", text).groupBy(*ids, "module", "_and", "grp").agg(ordered("pos").alias("xs")).select(
        *ids, "module", "_and", "grp", F.when(F.col("_and"), glue(F.col("xs"), " || ")).otherwise(glue(F.col("xs"), " && ")).alias("x"))
    done = grouped.groupBy(*ids, "module", "_and").agg(ordered("grp").alias("xs")).select(
        *ids, "module", F.when(F.col("_and"), glue(F.col("xs"), " && ")).otherwise(glue(F.col("xs"), " || ")).alias("text"))
    # Without any term but those of choices the text is empty, which means true.
    return parsed.select(*ids, "module", F.when(F.size("_g") == 0, "").alias("_ok")).join(done, [*ids, "module"], "left").select(
        *ids, "module", F.coalesce("text", "_ok").alias("text"))


def _dependencies(rel: DataFrame, symbols: DataFrame) -> DataFrame:
    """(arch, symbol, expr, text) of every dependency; text is null without a translation."""
    deps = option_dependencies(rel).join(symbols, ["arch", "option"]).filter(F.col("kind") != "meta")
    module = F.col("symbol").endswith("_MODULE") | ~F.col("tristate")
    asked = deps.select("arch", "symbol", "expr", module.alias("module"))
    return asked.select("arch", "symbol", "expr").join(literal_values(asked, symbols).drop("module"), ["arch", "symbol"])


def dependency_rules(rel: DataFrame, symbols: DataFrame) -> DataFrame:
    """(arch, symbol, rank, text): the dependency of an option, for both of its symbols."""
    rows = _dependencies(rel, symbols).filter(F.coalesce("text", F.lit("")) != "")
    return rows.select("arch", "symbol", F.lit(0).alias("rank"), "text")


def choice_rules(rel: DataFrame, symbols: DataFrame) -> DataFrame:
    """(arch, symbol, rank, text): an item needs its choice, a choice has exactly one item.

    An optional choice may have none; a tristate choice built as a module has no item
    built in. The text names every item once per alternative, as written by hand.
    """
    info = rel.filter((F.col("relation") == "Choice") & (F.size("args") > 1)).select(
        "arch", F.col("item").alias("choice"), (F.get("args", F.lit(0)) == "required").alias("required"), (F.get("args", F.lit(1)) == "tristate").alias("ctri"))
    known = symbols.filter("kind = 'option'").select("arch", "option", "tristate").distinct()
    items = rel.filter(F.col("relation") == "ChoiceItem").select("arch", F.col("item").alias("option"), F.get("args", F.lit(0)).alias("choice"))
    items = items.join(known, ["arch", "option"]).join(info, ["arch", "choice"])
    cfg = lambda c: F.concat(F.lit("CONFIG_"), c)
    mod = lambda c: F.concat(F.lit("CONFIG_"), c, F.lit("_MODULE"))
    row = lambda symbol, text, rank: F.struct(symbol.alias("symbol"), F.lit(rank).alias("rank"), text.alias("text"))
    of_item = items.select("arch", F.explode(F.array(
        row(cfg("option"), cfg("choice"), 3),
        F.when(F.col("ctri"), row(mod("choice"), F.concat(F.lit("!"), cfg("option")), 4)),
        F.when(F.col("ctri") & F.col("tristate"), row(mod("option"), mod("choice"), 3)),
    )).alias("r")).filter("r is not null").select("arch", "r.*")
    metas = info.filter("ctri").select("arch", F.explode(F.array(
        row(cfg("choice"), F.concat(cfg("choice"), F.lit("_META")), 3), row(mod("choice"), F.concat(cfg("choice"), F.lit("_META")), 3)
    )).alias("r")).select("arch", "r.*")
    owned = items.groupBy("arch", "choice").agg(F.array_sort(F.collect_set(cfg("option"))).alias("own"), F.first("required").alias("required"))
    pick = F.concat(F.col("own"), F.when(F.col("required"), F.expr("cast(array() as array<string>)")).otherwise(F.array(F.lit(""))))
    one = F.transform(pick, lambda p: F.concat_ws(" && ", F.transform("own", lambda o: F.when(o == p, o).otherwise(F.concat(F.lit("!"), o)))))
    exact = owned.select("arch", cfg("choice").alias("symbol"), F.lit(5).alias("rank"),
                         F.concat(F.lit("(("), F.concat_ws(") || (", one), F.lit("))")).alias("text"))
    return of_item.unionByName(metas).unionByName(exact)


def _prompts(rel: DataFrame) -> DataFrame:
    return rel.filter(F.col("relation") == "HasPrompts").groupBy("arch", F.col("item").alias("option")).agg(
        F.max(F.get("args", F.lit(0)).cast("int")).alias("prompts"))


def _defaults(rel: DataFrame, symbols: DataFrame) -> DataFrame:
    """(arch, symbol, expr, text, always_on) of every default; text is null without a translation."""
    plain = symbols.filter("kind = 'option' and not tristate").select("arch", "option", "symbol")
    hidden = plain.join(_prompts(rel).filter("prompts = 0"), ["arch", "option"]).select("arch", "option", "symbol")
    needs = option_dependencies(rel).select("arch", "option", F.lit(True).alias("dep"))
    rows = rel.filter((F.col("relation") == "Default") & (F.size("args") == 2)).select(
        "arch", F.col("item").alias("option"), F.get("args", F.lit(0)).alias("state"), F.get("args", F.lit(1)).alias("cond"))
    rows = rows.join(hidden, ["arch", "option"]).join(needs, ["arch", "option"], "left")
    yy = (F.col("state") == "y") & (F.col("cond") == "y")
    free = yy & F.col("dep").isNull()
    expr = (
        F.when(F.col("state") == "y", F.col("cond")).when(F.col("cond") == "y", F.col("state"))
        .when((F.length("state") > 1) & (F.length("cond") > 1), F.concat(F.lit("("), "state", F.lit(") && ("), "cond", F.lit(")")))
    )
    always = rows.filter(free).select("arch", "symbol", F.lit("y").alias("expr"), F.lit("__FREE__").alias("text"), F.lit(True).alias("always_on"))
    asked = rows.filter(~free).select("arch", "symbol", expr.alias("expr"), expr.alias("key"), F.lit(True).alias("module")).filter("expr is not null")
    told = literal_values(asked.distinct(), symbols).select("arch", "symbol", F.col("key").alias("expr"), "text", F.lit(False).alias("always_on"))
    return always.unionByName(told).distinct()


def default_rules(rel: DataFrame, symbols: DataFrame) -> DataFrame:
    """(arch, symbol, text, always_on): what may switch on an option without a prompt."""
    return _defaults(rel, symbols).filter("text is not null").select("arch", "symbol", "text", "always_on").distinct()


def _selects(rel: DataFrame, symbols: DataFrame) -> DataFrame:
    """Selections (arch, symbol, tsym, hidden, cond, when); ``when`` is null for y and without a translation."""
    plain = symbols.filter("kind = 'option' and not tristate").select("arch", F.col("option").alias("target"), F.col("symbol").alias("tsym"))
    who = symbols.filter("kind = 'option'").select("arch", F.col("option"), "symbol")
    hidden = _prompts(rel).filter("prompts = 0").select("arch", F.col("option").alias("target"), F.lit(True).alias("hidden"))
    rows = rel.filter((F.col("relation") == "ItemSelects") & (F.size("args") == 2)).select(
        "arch", F.col("item").alias("option"), F.get("args", F.lit(0)).alias("target"), F.get("args", F.lit(1)).alias("cond"))
    rows = rows.join(plain, ["arch", "target"]).join(who, ["arch", "option"]).join(hidden, ["arch", "target"], "left")
    asked = rows.filter("cond <> 'y'").select("arch", "cond", F.col("cond").alias("expr"), F.lit(True).alias("module")).distinct()
    told = literal_values(asked, symbols).select("arch", "cond", F.col("text").alias("when"))
    return rows.join(told, ["arch", "cond"], "left")


def select_rules(rel: DataFrame, symbols: DataFrame) -> DataFrame:
    """(arch, symbol, text, part): A selects B: a rule on A, and A as a reason for a hidden B."""
    rows = _selects(rel, symbols)
    # An empty condition had only terms of choices, which count as true.
    implied = F.when((F.col("cond") == "y") | (F.col("when") == ""), F.col("tsym")).otherwise(
        F.concat(F.lit("(("), "when", F.lit(") -> "), "tsym", F.lit(")")))
    rule = rows.select("arch", "symbol", implied.alias("text"), F.lit("rule").alias("part")).filter("text is not null")
    back = rows.filter("hidden").select("arch", F.col("tsym").alias("symbol"), F.col("symbol").alias("text"), F.lit("select").alias("part"))
    return rule.unionByName(back).distinct()


def unsupported_rules(rel: DataFrame, symbols: DataFrame) -> DataFrame:
    """(arch, symbol, rule, expr): dependencies, defaults and selections that no rule is made of.

    Of a hidden option with such a default, ``assemble_model`` leaves out all reasons: the others alone
    would say too much.
    """
    listed = lambda df, rule, expr: df.select("arch", "symbol", F.lit(rule).alias("rule"), F.col(expr).alias("expr"))
    return (
        listed(_dependencies(rel, symbols).filter("text is null"), "dependency", "expr")
        .unionByName(listed(_defaults(rel, symbols).filter("text is null"), "default", "expr"))
        .unionByName(listed(_selects(rel, symbols).filter((F.col("cond") != "y") & F.col("when").isNull()), "select", "cond")).distinct()
    )


def unsupported_counts(unsupported: DataFrame) -> DataFrame:
    """(arch, rule, n)"""
    return unsupported.groupBy("arch", "rule").agg(F.count(F.lit(1)).alias("n"))


def assemble_model(rel: DataFrame) -> DataFrame:
    """(arch, symbol, formula): dependency, rules, then the reasons for hidden options."""
    symbols = cut(option_symbols(rel))
    selects = cut(select_rules(rel, symbols))
    defaults = cut(_defaults(rel, symbols))
    reasons = defaults.filter("text is not null").select("arch", "symbol", "text").unionByName(
        selects.filter("part = 'select'").select("arch", "symbol", "text"))
    lost = defaults.filter("text is null").select("arch", "symbol")
    reasons = reasons.join(lost, ["arch", "symbol"], "left_anti").groupBy("arch", "symbol").agg(F.array_sort(F.collect_set("text")).alias("t")).select(
        "arch", "symbol", F.lit(9).alias("rank"), F.concat(F.lit("("), F.concat_ws(" || ", "t"), F.lit(")")).alias("text"))
    parts = (
        dependency_rules(rel, symbols).unionByName(tristate_rules(symbols)).unionByName(choice_rules(rel, symbols))
        .unionByName(selects.filter("part = 'rule'").select("arch", "symbol", F.lit(6).alias("rank"), "text")).unionByName(reasons)
    )
    texts = parts.groupBy("arch", "symbol").agg(F.array_sort(F.collect_set(F.struct("rank", "text"))).alias("p")).select(
        "arch", "symbol", F.concat_ws(" && ", F.transform("p", lambda s: s["text"])).alias("formula"))
    return symbols.select("arch", "symbol").distinct().join(texts, ["arch", "symbol"], "left").select(
        "arch", "symbol", F.coalesce("formula", F.lit("")).alias("formula"))


def type_codes(rel: DataFrame) -> DataFrame:
    """(arch, symbol, type_code); any other word is 6."""
    codes = F.create_map(*[x for k, v in TYPE_CODES.items() for x in (F.lit(k), F.lit(v))])
    return rel.filter(F.col("relation") == "Item").select(
        "arch", F.col("item").alias("symbol"), F.coalesce(codes[F.get("args", F.lit(0))], F.lit(6)).alias("type_code"))
