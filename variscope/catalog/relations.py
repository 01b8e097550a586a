"""Named queries: configuration dumps, text outputs, streams."""

from pyspark.sql import functions as F

from variscope.catalog.base import query, view
from variscope.operators import clauses as E, relations as T, sinks as K, symbols as Y, traces as R
from variscope.session import shared_table
from variscope.sources import projections as P
from variscope.streaming import traces as ST


def relation(t):
    """(arch, relation, item, args): every part is an option of one dump."""
    k = F.col("p_partkey")
    name = lambda c: F.concat(F.lit("P"), c.cast("string"))
    row = lambda r, item, *args: F.struct(F.lit(r).alias("relation"), item.alias("item"), F.array(*args).alias("args"))
    kind = F.when(k % 3 == 0, "tristate").when(k % 7 == 0, "string").otherwise("boolean")
    rows = F.array(
        row("Item", name(k), kind),
        row("HasPrompts", name(k), (k % 2).cast("string")),
        F.when(k % 4 != 0, row("Depends", name(k), F.concat(name(k + 1), F.lit(" && !"), name(k + 2)))),
        F.when(k % 8 == 1, row("Depends", name(k), name(k + 3))),
        F.when(k % 5 == 0, row("Default", name(k), F.lit("y"), F.when(k % 2 == 0, F.lit("y")).otherwise(name(k + 1)))),
        F.when(k % 6 == 0, row("ItemSelects", name(k), name(k + 2), F.when(k % 4 == 0, F.lit("y")).otherwise(F.concat(name(k + 1), F.lit("=y"))))),
        F.when(k % 10 == 0, row("Choice", F.concat(F.lit("CHOICE_"), (k / 10).cast("bigint").cast("string")), F.when(k % 20 == 0, "required").otherwise("optional"), F.when(k % 30 == 0, "tristate").otherwise("boolean"))),
        F.when(k % 10 > 6, row("ChoiceItem", name(k), F.concat(F.lit("CHOICE_"), (k / 10).cast("bigint").cast("string")))),
    )
    return t._keep("relation", lambda: t.raw("part").select(F.lit("part").alias("arch"), F.explode(rows).alias("r")).filter("r is not null").select("arch", "r.*"))


def symbols(t):
    return T.option_symbols(relation(t))


view("v_option", """
select 'P' || p_partkey as option, 'option' kind, p_partkey % 3 = 0 tristate from part
union all select 'CHOICE_' || (p_partkey // 10), 'choice', p_partkey % 30 = 0 from part where p_partkey % 10 = 0
union all select 'CHOICE_' || (p_partkey // 10) || '_META', 'meta', false from part where p_partkey % 30 = 0""")


@query("option_symbols", """
select 'part' arch, option, 'CONFIG_' || option symbol, kind, tristate from v_option
union all select 'part', option, 'CONFIG_' || option || '_MODULE', kind, tristate from v_option where tristate""")
def _(t):
    return symbols(t)


@query("option_dependencies", """
with d as (select 'P' || p_partkey as option, 'P' || (p_partkey + 1) || ' && !P' || (p_partkey + 2) e from part where p_partkey % 4 <> 0
  union all select 'P' || p_partkey, 'P' || (p_partkey + 3) from part where p_partkey % 8 = 1)
select 'part' arch, option, case when count(*) > 1 then '(' || string_agg(e, ') || (' order by e) || ')' else max(e) end expr from d group by option""")
def _(t):
    return T.option_dependencies(relation(t))


@query("tristate_rules", """
select 'part' arch, 'CONFIG_' || option symbol, 1 rank, '!CONFIG_' || option || '_MODULE' as text from v_option where tristate
union all select 'part', 'CONFIG_' || option || '_MODULE', 1, '!CONFIG_' || option from v_option where tristate
union all select 'part', 'CONFIG_' || option || '_MODULE', 2, 'CONFIG_MODULES' from v_option where tristate""")
def _(t):
    return T.tristate_rules(symbols(t))


@query("type_codes", """
select 'part' arch, 'P' || p_partkey symbol, case when p_partkey % 3 = 0 then 2 when p_partkey % 7 = 0 then 5 else 1 end type_code from part""")
def _(t):
    return T.type_codes(relation(t))


@query("literal_values")
def _(t):
    both = T.option_dependencies(relation(t)).withColumn("module", F.explode(F.array(F.lit(True), F.lit(False))))
    return T.literal_values(both, symbols(t))


@query("drop_choice_terms")
def _(t):
    terms = F.split(F.regexp_replace("expr", r"[()\s]", ""), r"&&|\|\|")
    return T.option_dependencies(relation(t)).select("arch", "option", F.concat_ws(" ", T.drop_choice_terms(terms)).alias("terms"))


@query("choice_rules")
def _(t):
    return T.choice_rules(relation(t), symbols(t))


@query("default_rules")
def _(t):
    return T.default_rules(relation(t), symbols(t))


@query("select_rules")
def _(t):
    return T.select_rules(relation(t), symbols(t))


@query("unsupported_rules")
def _(t):
    return T.unsupported_rules(relation(t), symbols(t))


@query("unsupported_rule_counts")
def _(t):
    return T.unsupported_counts(T.unsupported_rules(relation(t), symbols(t)))


@query("assemble_model")
def _(t):
    return T.assemble_model(relation(t))


@query("string_dependency_stats", """
select 'P' || p_partkey item, 1::bigint n_comparisons from part where p_partkey % 6 = 0 and p_partkey % 4 <> 0""")
def _(t):
    return Y.string_dependency_stats(relation(t))


@query("model_text", """
select arch, 0 section, '' symbol, 'I: Items-Count: ' || count(*) line from v_model group by arch
union all select distinct arch, 1, '', 'I: Format: <variable> [presence condition]' from v_model
union all select distinct arch, 2, '', 'META SCHEMA_VERSION 1.1' from v_model
union all select arch, 3, '', 'META ALWAYS_ON "' || string_agg(symbol, '" "' order by symbol) || '"' from v_forced where is_on group by arch
union all select arch, 4, symbol, case when formula = '' then symbol else symbol || ' "' || formula || '"' end from v_model""")
def _(t):
    return K.model_text(t.model, t.forced.filter("on"), "META")


def clause_tables(t):
    """Variables and literals of every architecture's clauses, numbered by symbol."""
    number = F.regexp_extract("symbol", r"(\d+)$", 1).cast("bigint")
    var = t.model_symbol.select(F.col("arch").alias("model"), F.col("symbol").alias("name"), (number + 1).alias("id"))
    lit = t.model_literal.withColumnRenamed("arch", "model")
    head = lit.select("model", "symbol", "clause_no", F.col("symbol").alias("name"), F.lit(False).alias("positive"))
    both = lit.select("model", "symbol", "clause_no", F.col("lit_symbol").alias("name"), "positive").unionByName(head).distinct()
    return var, both.join(var, ["model", "name"]).select("model", (number * 2 + F.col("clause_no") - 1).alias("clause_id"), F.col("id").alias("var"), "positive")


def of_arch(tables, arch):
    return [df.filter(F.col("model") == arch).drop("model") for df in tables]


@query("clause_text", r"""
with va as (select arch, symbol as name, cast(regexp_extract(symbol, '(\d+)$', 1) as bigint) + 1 id, type from v_model_symbol),
l as (select arch, symbol, clause_no, lit_symbol as name, positive from v_model_literal union select arch, symbol, clause_no, symbol, false from v_model_literal),
n as (select l.arch, cast(regexp_extract(l.symbol, '(\d+)$', 1) as bigint) * 2 + l.clause_no - 1 cid, case when positive then v.id else -v.id end num
  from l join va v on v.arch = l.arch and v.name = l.name)
select arch as model, 0 section, 'c meta_value ' || key || ' ' || value line from v_model_meta
union all select arch, 1, 'c sym ' || name || ' ' || case when type = 'tristate' then 2 else 1 end from va
union all select arch, 2, 'c var ' || name || ' ' || id from va
union all select v.arch, 3, 'p cnf ' || v.m || ' ' || coalesce(c.c, 0) from (select arch, max(id) m from va group by arch) v
  left join (select arch, count(distinct cid) c from n group by arch) c using (arch)
union all select arch, 4, string_agg(num::varchar, ' ' order by num) || ' 0' from n group by arch, cid""")
def _(t):
    var, lit = clause_tables(t)
    sym = t.model_symbol.select(F.col("arch").alias("model"), F.col("symbol").alias("name"), F.when(F.col("type") == "tristate", 2).otherwise(1).alias("type_code"))
    meta = t.model_meta.select(F.col("arch").alias("model"), "key", "value")
    return K.clause_text(var, sym, meta, lit).drop("pos")


@query("merge_clause_models", """
with v as (select arch, symbol, type, cast(regexp_extract(symbol, '(\\d+)$', 1) as bigint) i from v_model_symbol),
va as (select symbol as name, i + 1 id from v where arch = 'ASIA'),
vb as (select case when type = 'tristate' then symbol || '_MODULE' else symbol end as name, i + 1 id from v where arch = 'EUROPE')
select name, id from va union all select name, (select max(id) from va) + row_number() over (order by id) from vb where name not in (select name from va)""")
def _(t):
    tables = clause_tables(t)
    (va, la), (vb, lb) = of_arch(tables, "ASIA"), of_arch(tables, "EUROPE")
    tri = t.model_symbol.filter("arch = 'EUROPE' and type = 'tristate'").select(F.col("symbol").alias("name"), F.lit("_MODULE").alias("_s"))
    vb = vb.join(tri, "name", "left").select(F.concat("name", F.coalesce("_s", F.lit(""))).alias("name"), "id")
    return E.merge_clause_models(va, la, vb, lb)[0]


@query("trace_first_seen_stream", "select distinct addr from v_address")
def _(t):
    events = stream_of(t)
    return ST.run_to_table(ST.first_seen(events)).select("addr").distinct()


def stream_of(t):
    """The events file as a stream of trace events."""
    path, schema = shared_table(t.spark, t.key("trace_files"), lambda: t.trace_event.repartitionByRange(4, "event_id"))
    return ST.event_stream(t.spark, path, schema)


@query("trace_growth_stream")
def _(t):
    return ST.run_to_table(ST.growth(stream_of(t)))
