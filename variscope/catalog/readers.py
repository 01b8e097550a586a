"""Named queries: text formats written as line documents and read back."""

import uuid

from pyspark.sql import functions as F

from variscope.catalog.base import query, view
from variscope.catalog.clauses import observed_defects
from variscope.catalog.relations import clause_tables, relation
from variscope.operators import defects as D, sinks as K, traces as R
from variscope.session import scratch_dir
from variscope.sources import documents as W, text as S

#: Word that starts lines of meta data in the written models.
KEYWORD = "META"


def folder(t, name, make):
    """Folder of documents that ``make`` writes into, once for each application and input."""
    kept = t.__dict__.setdefault("_folders", {})
    if name not in kept:
        path = f"{scratch_dir(t.spark)}/{name}-{uuid.uuid4().hex}"
        make(path)
        kept[name] = path
    return kept[name]


def models(t):
    rows = K.model_text(t.model, t.forced.filter("on"), KEYWORD)
    return folder(t, "models", lambda path: W.write_documents(rows, path, "arch", ["section", "symbol"], suffix=".model"))


def clause_rows(t):
    var, lit = clause_tables(t)
    sym = t.model_symbol.select(F.col("arch").alias("model"), F.col("symbol").alias("name"), F.when(F.col("type") == "tristate", 2).otherwise(1).alias("type_code"))
    return K.clause_text(var, sym, t.model_meta.select(F.col("arch").alias("model"), "key", "value"), lit)


def clause_files(t):
    return folder(t, "clauses", lambda path: W.write_documents(clause_rows(t), path, "model", ["section", "pos", "line"], suffix=".cnf"))


@query("read_model", "select arch, symbol, formula from v_model")
def _(t):
    return S.read_model(t.spark, models(t), KEYWORD)


@query("read_model_of_arch", "select arch, symbol, formula from v_model where arch in ('ASIA', 'EUROPE')")
def _(t):
    return S.read_model(t.spark, models(t), KEYWORD, archs=["ASIA", "EUROPE"])


@query("read_model_meta", """
select arch, 'ALWAYS_ON' as key, symbol as value from v_forced where is_on
union all select distinct arch, 'SCHEMA_VERSION', '1.1' from v_model""")
def _(t):
    return S.read_model_meta(t.spark, models(t), KEYWORD)


view("v_clause_number", r"""
select model, clause_id, var, positive from (
  select l.arch as model, dense_rank() over (partition by l.arch order by cast(regexp_extract(l.symbol, '(\d+)$', 1) as bigint) * 2 + l.clause_no) - 1 clause_id,
    cast(regexp_extract(l.name, '(\d+)$', 1) as bigint) + 1 var, l.positive
  from (select arch, symbol, clause_no, lit_symbol as name, positive from v_model_literal union select arch, symbol, clause_no, symbol, false from v_model_literal) l
  join v_model_symbol v on v.arch = l.arch and v.symbol = l.name)""")


@query("read_clauses", "select model, clause_id, var, positive from v_clause_number")
def _(t):
    return S.read_clauses(t.spark, clause_files(t))["literal"]


@query("read_clause_names", r"""
select arch as model, 'var' kind, symbol as name, cast(regexp_extract(symbol, '(\d+)$', 1) as bigint) + 1 number from v_model_symbol
union all select arch, 'sym', symbol, case when type = 'tristate' then 2 else 1 end from v_model_symbol
union all select arch, 'meta ' || key, value, null from v_model_meta""")
def _(t):
    found = S.read_clauses(t.spark, clause_files(t))
    named = lambda df, kind, number: df.select("model", F.lit(kind).alias("kind"), "name", F.col(number).cast("bigint").alias("number"))
    meta = found["meta"].select("model", F.concat(F.lit("meta "), "key").alias("kind"), F.col("value").alias("name"), F.lit(None).cast("bigint").alias("number"))
    return named(found["var"], "var", "id").unionByName(named(found["sym"], "sym", "type_code")).unionByName(meta)


@query("read_model_dir", """
select arch, 'model' kind, symbol as name from v_model where arch < 'B'
union all select arch, 'var', symbol from v_model_symbol where arch >= 'B'""")
def _(t):
    """Models of some architectures beside clause files of all: a model beats clauses."""

    def write(path):
        some = K.model_text(t.model, t.forced.filter("on"), KEYWORD).filter("arch < 'B'")
        W.write_documents(some, path, "arch", ["section", "symbol"], suffix=".model")
        W.write_documents(clause_rows(t), path, "model", ["section", "pos", "line"], suffix=".cnf")

    found = S.read_model_dir(t.spark, folder(t, "model_dir", write), KEYWORD)
    model = found["model"].select("arch", F.lit("model").alias("kind"), F.col("symbol").alias("name"))
    return model.unionByName(found["var"].select(F.col("model").alias("arch"), F.lit("var").alias("kind"), "name"))


view("v_relation", """
select relation, item, args from (
  select 'Item' relation, 'P' || p_partkey item, case when p_partkey % 3 = 0 then 'tristate' when p_partkey % 7 = 0 then 'string' else 'boolean' end args from part
  union all select 'HasPrompts', 'P' || p_partkey, (p_partkey % 2)::varchar from part
  union all select 'Depends', 'P' || p_partkey, 'P' || (p_partkey + 1) || ' && !P' || (p_partkey + 2) from part where p_partkey % 4 <> 0
  union all select 'Depends', 'P' || p_partkey, 'P' || (p_partkey + 3) from part where p_partkey % 8 = 1
  union all select 'Default', 'P' || p_partkey, 'y|' || case when p_partkey % 2 = 0 then 'y' else 'P' || (p_partkey + 1) end from part where p_partkey % 5 = 0
  union all select 'ItemSelects', 'P' || p_partkey, 'P' || (p_partkey + 2) || '|' || case when p_partkey % 4 = 0 then 'y' else 'P' || (p_partkey + 1) || '=y' end from part where p_partkey % 6 = 0
  union all select 'Choice', 'CHOICE_' || (p_partkey // 10), case when p_partkey % 20 = 0 then 'required' else 'optional' end || '|' || case when p_partkey % 30 = 0 then 'tristate' else 'boolean' end from part where p_partkey % 10 = 0
  union all select 'ChoiceItem', 'P' || p_partkey, 'CHOICE_' || (p_partkey // 10) from part where p_partkey % 10 > 6)""")


def dumps(t):
    """The relations as dump files, with lines of a kind that readers drop."""
    quoted = F.transform("args", lambda a: F.concat(F.lit('"'), a, F.lit('"')))
    line = F.concat_ws("\t", "relation", "item", F.concat_ws("\t", quoted))
    noise = F.concat_ws("\t", F.lit("Definition"), "item", F.lit('"Kconfig:1"'))
    rows = relation(t).select("arch", F.explode(F.array(line, noise)).alias("line"))
    return folder(t, "dumps", lambda path: W.write_documents(rows, path, "arch", ["line"], suffix=".rsf"))


@query("read_relations", "select 'part' arch, relation, item, args from v_relation")
def _(t):
    return S.read_relations(t.spark, dumps(t)).withColumn("args", F.concat_ws("|", "args"))


@query("read_symbol_types", "select 'part' arch, item as symbol, args as type from v_relation where relation = 'Item'")
def _(t):
    return S.read_symbol_types(t.spark, dumps(t))


@query("write_defects_documents", """
with n as (select name, header, kind || '.' || suffix as report from (
  select s.path || '.B' || d.block_no || '.' || d.kind || '.' || case when d.is_global then 'globally' else d.arch end || '.' || d.suffix as name,
    '#B' || d.block_no || ':' || s.path || ':' || b.start_line || ':0:' || s.path || ':' || b.end_line || ':0:' header, d.suffix, d.kind
  from v_defect d join v_source_file s using (file_id) join v_block b using (file_id, block_no)))
select report, name || ' ' || header as line, row_number() over (partition by report order by name) place from n""")
def _(t):
    """Reports written by kind and suffix and read back: every line, at its place in the document."""
    rows = D.write_defects_rows(observed_defects(t), t.blocks, t.source_file).select(
        F.concat_ws(".", "kind", "suffix").alias("report"), "name", F.concat_ws(" ", "name", "header").alias("line"))
    path = folder(t, "reports", lambda p: W.write_documents(rows, p, "report", ["name"]))
    return K.placed_lines(W.read_documents(t.spark, path)).select(F.col("name").alias("report"), "line", "place")


@query("write_addresses_by_module", """
select coalesce(module, 'unknown') as module, case when module is null then addr else module_off end::varchar as line,
  row_number() over (partition by coalesce(module, 'unknown') order by addr) place from v_offset""")
def _(t):
    """Addresses written to a document for each module and read back, in address order."""
    rows = R.module_lines(R.module_offsets(t.addresses, t.module))
    path = folder(t, "by_module", lambda p: W.write_documents(rows, p, "module", ["addr"], suffix=".addr"))
    return K.placed_lines(W.read_documents(t.spark, path, ".addr")).select(F.col("name").alias("module"), "line", "place")
