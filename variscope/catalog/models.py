"""Named queries: models, files and symbols."""

from pyspark.sql import functions as F

from variscope.catalog.base import query
from variscope.functions import lines as L
from variscope.operators import models as M, symbols as Y
from variscope.sources import text as S


@query("model_edges", "select arch, src, dst from v_edge")
def _(t):
    return t.edges


@query("related_symbols", "select arch, start, symbol from v_related")
def _(t):
    return t.related


@query("related_listing", """
select r.arch, r.start, coalesce(string_agg(case when m.symbol is null then '!' else '' end || r.symbol, ' ' order by r.symbol)
  filter (where r.symbol <> r.start), '') listing
from v_related r left join v_model m on m.arch = r.arch and m.symbol = r.symbol group by r.arch, r.start""")
def _(t):
    return M.related_listing(t.related, t.model)


SLICE = """
select x.arch, x.start, x.symbol, 'implication' part, '(' || x.symbol || ' -> (' || m.formula || '))' as text
from s x join v_model m on m.arch = x.arch and m.symbol = x.symbol where m.formula <> ''
union all select x.arch, x.start, x.symbol, case when f.is_on then 'on' else 'off' end, case when f.is_on then '' else '!' end || x.symbol
from s x join v_model m on m.arch = x.arch and m.symbol = x.symbol join v_forced f on f.arch = x.arch and f.symbol = x.symbol"""
SLICE_BASE = """with s as (select arch, start, symbol from v_related union
  select r.arch, r.start, f.symbol from (select distinct arch, start from v_related) r join v_forced f on f.arch = r.arch)"""


def slices(t):
    return M.model_slice(t.related, t.model, t.forced, ["arch", "start"])


@query("model_slice", SLICE_BASE + SLICE)
def _(t):
    return slices(t)


@query("symbol_precondition", SLICE_BASE + SLICE + """
union all select r.arch, r.start, '', 'missing', '( ! ( ' || string_agg(distinct r.symbol, ' || ' order by r.symbol) || ' ) )'
from v_related r where r.symbol like 'CONFIG__%' and not exists (select 1 from v_model m where m.arch = r.arch and m.symbol = r.symbol)
group by r.arch, r.start""")
def _(t):
    ids = ["arch", "start"]
    missing = M.missing_symbols(t.related, t.model, t.spaces, ids)
    return M.symbol_precondition(slices(t), missing, ids)


@query("missing_symbols", "select file_id, arch, symbol from v_file_missing")
def _(t):
    return M.missing_symbols(t.file_slice, t.model, t.spaces, ["file_id", "arch"], t.defines)


@query("missing_constraint", """
select file_id, arch, '( ! ( ' || string_agg(symbol, ' || ' order by symbol) || ' ) )' as text from v_file_missing group by file_id, arch""")
def _(t):
    ids = ["file_id", "arch"]
    return M.missing_constraint(M.missing_symbols(t.file_slice, t.model, t.spaces, ids, t.defines), ids)


@query("clause_model_missing", """
select u.file_id, u.arch, u.symbol from v_file_use u where u.symbol like 'CONFIG__%'
and not exists (select 1 from v_model_symbol m where m.arch = u.arch and m.symbol = u.symbol)""")
def _(t):
    return M.clause_model_missing(t.file_uses, t.model_symbol, t.spaces, ["file_id", "arch"])


@query("leaf_symbols", """
select arch, symbol from v_model m where not exists (select 1 from v_edge e where e.arch = m.arch and e.dst = m.symbol and e.src <> e.dst)""")
def _(t):
    return M.leaf_symbols(t.edges, t.model)


@query("symbol_types", """
select u.file_id, u.arch, u.symbol, coalesce(upper(s.type), 'MISSING') as type, s.type is not null is_bool_tristate
from v_file_use u left join v_model_symbol s on s.arch = u.arch and s.symbol = u.symbol""")
def _(t):
    return M.symbol_types(t.file_uses.select("file_id", "arch", "symbol"), t.model_symbol)


@query("model_complete", "select distinct arch, true complete from v_model")
def _(t):
    return M.model_complete(t.archs, t.model, t.model_meta)


@query("forced_symbols", 'select arch, symbol, is_on as "on" from v_forced')
def _(t):
    return t.forced


@query("forced_conflicts", "select arch, symbol from v_forced where is_on intersect select arch, symbol from v_forced where not is_on")
def _(t):
    return M.forced_conflicts(t.forced)


@query("arch_exclusion", """
with a as (select distinct arch, 'CONFIG_' || upper(arch) symbol from v_model),
r as (select x.arch, x.symbol, string_agg('!' || y.symbol, ' && ' order by y.symbol) rule from a x join a y on x.arch <> y.arch group by all)
select coalesce(m.arch, r.arch) arch, coalesce(m.symbol, r.symbol) symbol, concat_ws(' && ', nullif(m.formula, ''), r.rule) formula
from v_model m full join r on m.arch = r.arch and m.symbol = r.symbol""")
def _(t):
    return M.arch_exclusion(t.archs, t.model)


@query("merge_model", """
select arch, symbol || ' "' || formula || '"' line from v_model
union all select a.arch, 'FILE_' || translate(path, '/-+:,', '_____') || ' "CONFIG_P' || (file_id % 40) || '"' from v_source_file join v_file_arch a using (file_id)
  where file_id % 10 <> 0
union all select distinct arch, unnest(['CONFIG_n', 'CONFIG_y', 'CONFIG_m']) from v_model""")
def _(t):
    model_lines = t.model.select("arch", F.concat("symbol", F.lit(' "'), "formula", F.lit('"')).alias("line"))
    rule = F.concat(L.file_variable(F.col("path")), F.lit(' "CONFIG_P'), (F.col("file_id") % 40).cast("string"), F.lit('"'))
    noise = F.concat(F.element_at(F.array(F.lit("E: "), F.lit("W: "), F.lit("I: ")), (F.col("file_id") % 3 + 1).cast("int")), "path")
    inferred = t.source_file.join(t.file_models, "file_id").select(
        "arch", F.when(F.col("file_id") % 10 == 0, noise).otherwise(rule).alias("line")
    )
    return M.merge_model(model_lines, inferred)


@query("main_model", "select min(arch) main_arch from v_model")
def _(t):
    return M.main_model(t.archs)


@query("model_for_file", "select file_id, arch from v_file_arch")
def _(t):
    return M.model_for_file(t.source_file, t.archs)


@query("file_variable", "select file_id, 'FILE_' || translate(path, '/-+:,', '_____') file_var from v_source_file")
def _(t):
    return t.source_file.select("file_id", L.file_variable(F.col("path")).alias("file_var"))


@query("file_arch", """
select f.file_id, a.specific_arch, case when a.specific_arch in ('x86', 'um') then 'x86_64' else a.specific_arch end subarch
from v_source_file f join v_file_arch a using (file_id)""")
def _(t):
    return M.file_arch(t.source_file, t.archs).select("file_id", "specific_arch", M.subarch(F.col("specific_arch")).alias("subarch"))


@query("in_space", """
select file_id, arch, symbol, regexp_full_match(symbol, 'CONFIG_[^ ]+') in_space from v_file_use""")
def _(t):
    return M.in_space(t.file_uses.select("file_id", "arch", "symbol"), t.spaces)


@query("config_like", """
select distinct symbol, case when symbol like 'CONFIG__%' then 'CONFIG_LIKE' else 'NOT_CONFIG_LIKE' end likeness from v_use""")
def _(t):
    return t.file_uses.select("symbol").distinct().withColumn("likeness", L.config_like(F.col("symbol")))


@query("item_name", """
select file_id, block_no, symbol || repeat('.', version::bigint) symbol, symbol item, version::bigint n_rewrites from v_use_version""")
def _(t):
    rows = L.expr_symbols(t.rewritten.select("file_id", "block_no", "expr"))
    name, dots = L.item_name(F.col("symbol"))
    return rows.withColumn("item", name).withColumn("n_rewrites", dots.cast("bigint"))


STATS = """
with o as (select *, row_number() over (partition by file_id, symbol order by block_no) i from v_use_version),
st as (select o.file_id, o.symbol, count(*) n_refs, coalesce(max(version) filter (where i > 1), 0)::bigint n_rewrites,
  case when max(s.type) is null then 'MISSING' else 'PRESENT' end state,
  coalesce(upper(max(s.type)), case when o.symbol like 'CONFIG__%' then 'CONFIG_LIKE' else 'NOT_CONFIG_LIKE' end) detail
from o join v_file_arch a using (file_id) left join v_model_symbol s on s.arch = a.arch and s.symbol = o.symbol
group by o.file_id, o.symbol)
"""


def stats(t):
    return t._keep("symbol_stats", lambda: Y.symbol_stats(t.rewritten, t.file_models, t.model_symbol))


@query("symbol_stats", STATS + "select * from st")
def _(t):
    return stats(t)


@query("symbol_totals", STATS + "select symbol, sum(n_refs)::bigint n_refs, sum(n_rewrites)::bigint n_rewrites from st group by symbol")
def _(t):
    return Y.symbol_totals(stats(t))


def build_lines(t):
    return t.lines.join(t.source_file, "file_id")


@query("build_symbols", r"""
select distinct 'CONFIG_' || unnest(regexp_extract_all(txt, '(?:^|[^A-Za-z0-9_])CONFIG_([A-Za-z0-9_]+)', 1)) symbol
from v_source_line join v_source_file using (file_id) where path not like 'arch/%' or path like 'arch/asia/%'""")
def _(t):
    return Y.build_symbols(build_lines(t), "asia")


@query("build_symbols_by_dir", r"""
with n as (select distinct regexp_replace(path, '/[^/]*$', '') dir,
  'CONFIG_' || unnest(regexp_extract_all(txt, '(?:^|[^A-Za-z0-9_])CONFIG_([A-Za-z0-9_]+)', 1)) symbol
  from v_source_line join v_source_file using (file_id))
select dir, symbol from n union select dir, symbol || '_MODULE' from n where symbol in (select symbol from v_model_symbol where type = 'tristate')""")
def _(t):
    tristate = t.model_symbol.filter(F.col("type") == "tristate").select(F.concat("symbol", F.lit("_MODULE")).alias("symbol"))
    return Y.build_symbols_by_dir(build_lines(t), t.model_symbol.select("symbol").unionByName(tristate))


@query("symbol_union", "select symbol, count(distinct arch) n_archs from v_file_use group by symbol")
def _(t):
    return Y.symbol_union(t.file_uses)


@query("symbol_union_approx")
def _(t):
    return Y.symbol_union_approx(t.file_uses)


@query("symbols_by_arch_sketch", """
select arch, count(distinct symbol) n_exact, true as near_exact from v_file_use group by arch
union all select '', count(distinct symbol), true from v_file_use""")
def _(t):
    each = Y.symbol_sketches(t.file_uses, ["arch"])
    all_of_them = Y.merge_sketches(each.withColumn("arch", F.lit("")), ["arch"])
    uses = t.file_uses.select("arch", "symbol")
    exact = uses.unionByName(uses.withColumn("arch", F.lit(""))).groupBy("arch").agg(F.count_distinct("symbol").alias("n_exact"))
    return Y.within_error(Y.sketched_counts(each.unionByName(all_of_them)), exact, ["arch"])


@query("symbols_by_tree_sketch", r"""
with n as (select distinct string_split(regexp_replace(path, '/[^/]*$', ''), '/') p,
  unnest(regexp_extract_all(txt, '(?:^|[^A-Za-z0-9_])CONFIG_([A-Za-z0-9_]+)', 1)) symbol
  from v_source_line join v_source_file using (file_id)),
d as (select p, symbol, unnest(range(0, len(p) + 1)) i from n)
select array_to_string(p[1:i], '/') dir, count(distinct symbol) n_exact, true as near_exact from d group by 1""")
def _(t):
    named = Y.build_symbols_by_dir(build_lines(t), t.model_symbol.select("symbol").where("false"))
    exact = Y.with_parents(named).groupBy("dir").agg(F.count_distinct("symbol").alias("n_exact"))
    return Y.within_error(Y.symbols_below(named), exact, ["dir"])


@query("read_worklist", "select path from v_source_file where file_id % 5 <> 3")
def _(t):
    return S.worklist(t.worklist_line, t.source_file)


@query("read_locations", r"""
select regexp_extract(line, '^(.*?):(\d+)(?::(\d+))?$', 1) path, cast(regexp_extract(line, '^(.*?):(\d+)(?::(\d+))?$', 2) as bigint) line_no,
  cast(nullif(regexp_extract(line, '^(.*?):(\d+)(?::(\d+))?$', 3), '') as bigint) col_no from v_location_line""")
def _(t):
    return S.locations(t.location_line)


@query("candidate_files", r"""
select file_id, path from v_source_file where not regexp_matches(path, '^(tools|Documentation|scripts)')
and file_id in (select file_id from v_source_line where regexp_matches(txt, '^#\s*if'))""")
def _(t):
    return S.candidate_files(t.lines, t.source_file)


@query("candidate_else_files", r"""
select file_id, path from v_source_file where not regexp_matches(path, '^(tools|Documentation|scripts)')
and file_id in (select file_id from v_source_line where regexp_matches(txt, '^#else'))""")
def _(t):
    return S.candidate_files(t.lines, t.source_file, "^#else")
