"""Named queries: tool messages, traces, build inference."""

from pyspark.sql import functions as F

from variscope.catalog.base import query
from variscope.functions import lines as L
from variscope.operators import inference as I, messages as X, symbols as Y, traces as R


@query("strip_message_noise", r"""
select config_id, seq, regexp_replace(regexp_replace(line, '\s*\[(-W[^\[]+|enabled by default)\]$', ''), '(:\d+):\d+: ', '\1: ') line from v_tool_message""")
def _(t):
    return X.strip_message_noise(t.tool_message)


@query("merge_prefixed", "select config_id, seq, line from v_message")
def _(t):
    return X.merge_prefixed(X.strip_message_noise(t.tool_message))


@query("parse_message", "select config_id, seq, location, severity, text from v_parsed")
def _(t):
    return t.parsed


@query("group_messages", """
select p.location, p.severity, p.text, p.config_id, n_configs from (select distinct location, severity, text, config_id from v_parsed) p
join (select location, severity, text, count(distinct config_id) n_configs from v_parsed group by all) using (location, severity, text)""")
def _(t):
    return X.group_messages(t.parsed)


@query("dedupe_by_location", """
select config_id, location, seq, severity, text from (select *, row_number() over (partition by config_id, location order by seq) i from v_parsed) where i = 1""")
def _(t):
    return X.dedupe_by_location(t.parsed)


@query("own_file_messages", """
select config_id, seq, location, severity, text from v_parsed where location like '%src/f' || config_id || '.c%'""")
def _(t):
    files = t.parsed.select("config_id").distinct().withColumn("file", F.concat(F.lit("src/f"), F.col("config_id").cast("string"), F.lit(".c")))
    return X.own_file_messages(t.parsed, files)


@query("severity_counts", """
select config_id, count(*) filter (where severity = 'warning') n_warnings, count(*) filter (where severity = 'error') n_errors from v_parsed group by config_id""")
def _(t):
    return X.severity_counts(t.parsed)


@query("variant_messages", """
with g as (select location, severity, text, count(distinct config_id) n_configs, bool_or(config_id = 0) ref from v_parsed group by all)
select distinct p.location, p.severity, p.text, p.config_id, g.n_configs from v_parsed p join g using (location, severity, text)
where g.n_configs < (select count(distinct config_id) from v_parsed) and not g.ref""")
def _(t):
    ids = t.parsed.select("config_id").distinct()
    return X.variant_messages(X.group_messages(t.parsed), ids.agg(F.count(F.lit(1)).alias("n")), ids.filter("config_id = 0"))


@query("message_report", "select distinct config_id, line from v_message")
def _(t):
    return X.message_report(t.messages)


@query("trace_addresses", "select event_id, ts, part, addr from v_address")
def _(t):
    return t.addresses


@query("first_seen", """
select addr, event_id, part, ts from (select *, row_number() over (partition by addr order by event_id, part) i from v_address) where i = 1""")
def _(t):
    return R.first_seen(t.addresses)


@query("module_offsets", "select addr, module, module_off from v_offset")
def _(t):
    return R.module_offsets(t.addresses, t.module)


@query("seen_functions", "select func, min(event_id) event_id from v_trace_event where func <> 'error' group by func")
def _(t):
    ignored = t.trace_event.select("func").distinct().filter("func = 'error'")
    return R.seen_functions(t.trace_event, ignored)


@query("symbol_at", """
select a.addr, f.name, f.base as start from (select distinct addr from v_address) a asof left join v_module f on a.addr >= f.base""")
def _(t):
    return R.symbol_at(t.addresses, t.module.select("name", F.col("base").alias("start")))


@query("split_by_module", "select coalesce(module, 'unknown') as module, count(*) n_addrs from v_offset group by all")
def _(t):
    return R.split_by_module(R.module_offsets(t.addresses, t.module))


def paths(t):
    return t.source_file.select(F.concat(F.lit("/usr/src/"), "path").alias("path"), F.col("file_id").alias("seq"))


@query("common_prefix", "select case when bool_and(path like 'arch/%') then '/usr/src/arch/' when bool_and(path like 'drivers/%') then '/usr/src/drivers/' else '/usr/src/' end prefix from v_source_file where file_id in (select file_id from v_source_file order by file_id limit 100)")
def _(t):
    return R.common_prefix(paths(t), 100)


@query("relative_paths", "select './' || path path from v_source_file")
def _(t):
    return R.relative_paths(paths(t), R.common_prefix(paths(t), 100))


@query("drop_ignored", "select path from v_source_file where not regexp_matches(path, 'f[0-9]*7[.]c|asia')")
def _(t):
    rules = t.raw("region").select(F.when(F.col("r_regionkey") == 0, "f[0-9]*7[.]c").otherwise("a s i a").alias("pattern"))
    return R.drop_ignored(t.source_file.select("path"), rules)


@query("existing_only", r"""
with l as (select regexp_extract(line, '^(.*?):', 1) path, line from v_location_line)
select line, path in (select regexp_replace(path, '\.c$', '.c') from v_source_file where file_id % 3 <> 1) known from l""")
def _(t):
    rows = t.location_line.select(F.regexp_extract("line", "^(.*?):", 1).alias("path"), "line")
    known, gone = R.existing_only(rows, t.tree_file)
    return known.select("line", F.lit(True).alias("known")).unionByName(gone.select("line", F.lit(False).alias("known")))


WINDOW = "%Y-%m-%d %H:%M:%S"
start = lambda: F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start")


@query("trace_growth", f"""
select strftime(time_bucket(interval 1 hour, ts), '{WINDOW}') as start, count(*) n_new from (select addr, min(ts) ts from v_address group by addr) group by 1""")
def _(t):
    return R.trace_growth(t.addresses).select(start(), "n_new")


@query("trace_growth_sliding", f"""
select strftime(time_bucket(interval 1 hour, ts) - k * interval 1 hour, '{WINDOW}') as start, count(*) n_new
from (select addr, min(ts) ts from v_address group by addr) cross join (select unnest([0, 1]) k) group by 1""")
def _(t):
    return R.trace_growth(t.addresses, "2 hours", "1 hour").select(start(), "n_new")


@query("trace_settled", f"""
with g as (select time_bucket(interval 1 hour, ts) s, count(*) n from (select addr, min(ts) ts from v_address group by addr) group by 1)
select strftime(s, '{WINDOW}') as start, n < (select avg(n) from g) settled from g""")
def _(t):
    return R.grown_out(R.trace_growth(t.addresses)).select(start(), "settled")


@query("trace_summary", """
select (select count(distinct event_id) from v_address) n_lines, (select count(distinct addr) from v_address) n_addrs,
  (select count(distinct module) from v_offset) n_modules, (select count(distinct event_id) < 1000 from v_address) short""")
def _(t):
    return R.trace_summary(t.addresses, R.module_offsets(t.addresses, t.module))


@query("late_events", """
select event_id, ts from (select event_id, ts, max(ts) over (order by event_id rows between unbounded preceding and 1 preceding) m from v_trace_event)
where ts < m - interval 10 minutes""")
def _(t):
    return R.late_events(t.trace_event).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def base_files(t):
    return t.selection_file.filter(F.col("selection_id") == 0).select("file")


@query("fileset_diff", """
with b as (select file from v_selection_file where selection_id = 0)
select selection_id, file, 'added' change from v_selection_file where file not in (select file from b)
union all select s.selection_id, b.file, 'removed' from (select distinct selection_id from v_selection_file) s cross join b
where not exists (select 1 from v_selection_file f where f.selection_id = s.selection_id and f.file = b.file)""")
def _(t):
    return I.fileset_diff(t.selection_file, base_files(t))


def domain_model(t):
    tri = t.model_symbol.filter("type = 'tristate'").select(F.concat("symbol", F.lit("_MODULE")).alias("symbol"))
    return t.model_symbol.select("symbol").unionByName(tri)


@query("value_domains", """
select distinct symbol, unnest(case when symbol in (select symbol from v_model_symbol where type = 'tristate') then ['y', 'm'] else ['y'] end) as value from v_use""")
def _(t):
    return I.value_domains(t.file_uses, domain_model(t))


DOMAIN = """d as (select distinct symbol, unnest(case when symbol in (select symbol from v_model_symbol where type = 'tristate') then ['y', 'm'] else ['y'] end) as value
  from v_selection_literal)"""


@query("variations", f"""
with {DOMAIN},
v as (select distinct l_orderkey % 300 selection_id, l_suppkey % 4 grp from lineitem),
c as (select v.selection_id, v.grp, a.symbol sa, a.value va, b.symbol sb, b.value vb from v
  join d a on a.symbol = concat('CONFIG_P', cast(2 * v.grp as varchar)) join d b on b.symbol = concat('CONFIG_P', cast(2 * v.grp + 1 as varchar)))
select distinct c.selection_id, c.grp, concat_ws(' && ', case when x.value is null then sa || '=' || va end, case when y.value is null then sb || '=' || vb end) literals
from c left join v_selection_literal x on x.selection_id = c.selection_id and x.symbol = sa
left join v_selection_literal y on y.selection_id = c.selection_id and y.symbol = sb
where coalesce(x.value, va) = va and coalesce(y.value, vb) = vb
and c.selection_id in (select selection_id from v_selection_literal)""")
def _(t):
    li = t.raw("lineitem")
    visits = li.select((F.col("l_orderkey") % 300).alias("selection_id"), (F.col("l_suppkey") % 4).alias("grp"))
    symbols = t.selection_literal.select("symbol").distinct()
    number = F.regexp_extract("symbol", r"(\d+)$", 1).cast("bigint")
    groups = symbols.select(F.floor(number / 2).alias("grp"), (number % 2 + 1).alias("pos"), "symbol")
    return I.variations(t.selection_literal, visits, groups, I.value_domains(symbols, domain_model(t)))


SEL = """s as (select selection_id, list_sort(list(symbol || '=' || value)) c from v_selection_literal group by selection_id),
r as (select distinct f.file, s.c from v_selection_file f join s using (selection_id)),
k as (select file, c from r a where not exists (select 1 from r b where b.file = a.file and len(b.c) < len(a.c) and list_has_all(a.c, b.c)))"""


def file_selections(t):
    sel = I.selections(t.selection_literal)
    return t.selection_file.join(sel, "selection_id").select("file", "conj")


flat = lambda: F.concat_ws(",", F.flatten("conj")).alias("conj")


@query("subsumed_selections", f"with {SEL} select file, array_to_string(c, ',') conj from k")
def _(t):
    return I.subsumed_selections(file_selections(t)).select("file", flat())


MERGE = f"""with {SEL},
o as (select file, c, unnest(c) term from r),
p as (select file, c, term, list_filter(c, lambda x: x <> term) rest from o),
n as (select file, rest from p group by file, rest having count(*) > 1),
ch as (select file, c, min(struct_pack(rest := array_to_string(rest, ' '), term := term)) m from p join n using (file, rest) group by file, c)
"""


@query("selection_text", f"""
with {SEL} select selection_id, array_to_string(c, ' && ') as text, replace(replace(array_to_string(c, ' && '), '=y', ''), '=m', '_MODULE') condition from s""")
def _(t):
    return I.selection_text(I.selections(t.selection_literal))


@query("merge_selections")
def _(t):
    return I.merge_selections(file_selections(t)).select("file", I.conjunction_text(F.col("conj")).alias("text"))


@query("file_rules")
def _(t):
    rules = I.file_rules(I.selections(t.selection_literal), t.selection_file, base_files(t))
    return rules.select("file", "condition", I.rule_line(F.col("file"), F.col("condition")).alias("line"))


TREE = """f as (select regexp_replace(path, '\\.c$', '') stem, file_id % 3 i, path from v_source_file),
tf as (select stem || x path, stem, x from (select stem, unnest(case i when 0 then ['.c', '.S'] when 1 then ['.S'] else ['.c'] end) x from f))"""
TARGETS = f"""{TREE},
tg as (select case when file_id % 7 = 0 then 'gen/' else '' end || regexp_replace(path, '\\.c$', '') || '.o' target from v_source_file),
ts as (select target, min_by(tf.path, case x when '.c' then 0 else 1 end) source from tg left join tf on tf.stem = left(target, length(target) - 2) group by target)"""


@query("target_sources", f"with {TARGETS} select target, source from ts")
def _(t):
    return I.target_sources(t.object_target, t.tree_file)


def built(t):
    """Files a selection compiles; an odd selection builds modules."""
    state = F.when(F.col("selection_id") % 2 == 1, "m").otherwise("y")
    return t.selection_file.select(F.col("selection_id").alias("config_id"), "file", state.alias("state"))


@query("file_state", """
select distinct l_orderkey % 300 config_id, 'obj/f' || (l_partkey % 40) || '.o' as file,
  coalesce((select case when selection_id % 2 = 1 then 'm' else 'y' end from v_selection_file f where f.selection_id = l_orderkey % 300 and f.file = 'obj/f' || (l_partkey % 40) || '.o'), 'n') state
from lineitem""")
def _(t):
    asked = t.raw("lineitem").select(
        (F.col("l_orderkey") % 300).alias("config_id"),
        F.concat(F.lit("obj/f"), (F.col("l_partkey") % 40).cast("string"), F.lit(".o")).alias("file"),
    ).distinct()
    return I.file_state(asked, built(t))


@query("built_files", """
with t as (select config_id, var from v_assignment where val)
select b.file_id, b.config_id from v_build b join orders on o_orderkey = b.file_id
where exists (select 1 from t where t.config_id = b.config_id and t.var = concat('CONFIG_P', cast(b.file_id % 40 as varchar)))
and not exists (select 1 from t where t.config_id = b.config_id and t.var = concat('CONFIG_P', cast((b.file_id + 3) % 40 as varchar)))""")
def _(t):
    return I.built_files(t.builds, t.file_rule, t.assignment)


@query("files_per_config", f"""
with {TARGETS}, s as (select l_orderkey % 300 selection_id, l_orderkey file_id from lineitem group by all)
select selection_id, count(*) n_files, count(*) filter (where source is null) n_unresolved
from s join v_source_file using (file_id) join ts on ts.target = case when file_id % 7 = 0 then 'gen/' else '' end || regexp_replace(path, '\\.c$', '') || '.o'
group by selection_id""")
def _(t):
    sel = t.raw("lineitem").select((F.col("l_orderkey") % 300).alias("selection_id"), F.col("l_orderkey").alias("file_id")).distinct()
    target = F.concat(F.when(F.col("file_id") % 7 == 0, "gen/").otherwise(""), F.regexp_replace("path", r"\.c$", ""), F.lit(".o"))
    listed = sel.join(t.source_file, "file_id").select("selection_id", target.alias("target"))
    return Y.files_per_config(listed.join(I.target_sources(t.object_target, t.tree_file), "target"))
