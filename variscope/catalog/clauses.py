"""Named queries: constraints, clauses, defects."""

from pyspark.sql import functions as F

from variscope.catalog.base import query
from variscope.functions import lines as L
from variscope.operators import clauses as E, constraints as C, coverage as V, defects as D, models as M


@query("block_constraint", """
with p as (select b.file_id, b.block_no, string_agg(p.name, ' || ' order by p.block_no desc) prevs
  from v_block b join v_block p on p.file_id = b.file_id and p.chain_no = b.chain_no and p.block_no < b.block_no group by all)
select b.file_id, b.block_no, '( ' || b.name || ' <-> ' || concat_ws(' && ', 'B' || b.parent_no, nullif(b.expr, ''), '( ! (' || p.prevs || ') )') || ' )' as text
from v_block b left join p using (file_id, block_no)""")
def _(t):
    return C.block_constraint(t.blocks)


DEFINE_TEXT = """
with d as (select *, case when block_no < 0 then 'B00' else 'B' || block_no end bv, symbol || repeat('.', version - 1) o, symbol || repeat('.', version) n from v_define)
select file_id, block_no, symbol, version, 0 part, '(' || bv || ' -> ' || case when is_undef then '!' else '' end || n || ')' as text from d
union all select file_id, block_no, symbol, version, 1, '(!' || bv || ' -> (' || o || ' <-> ' || n || '))' from d"""


@query("define_constraints", DEFINE_TEXT)
def _(t):
    return C.define_constraints(t.defines)


@query("file_condition", f"""
with b as (select file_id, count(*) n from v_block group by file_id),
d as (select file_id, count(distinct text) n from ({DEFINE_TEXT}) group by file_id)
select file_id, b.n + coalesce(d.n, 0) + 2 n_conjuncts from b left join d using (file_id)""")
def _(t):
    files = t.source_file.join(t.line_files, "file_id", "left_semi")
    return C.file_condition(t.rewritten, t.defines, files).groupBy("file_id").agg(F.count(F.lit(1)).alias("n_conjuncts"))


@query("constraint_closure", """
select c.file_id, c.block_no, b.chain_no, max(c.member_no) upto_no from v_closure c
join v_block b on b.file_id = c.file_id and b.block_no = c.member_no group by all""")
def _(t):
    return C.constraint_closure(t.blocks, t.defines)


@query("block_clauses", "select file_id, block_no, var, positive, count(*) n from v_block_clause_lit group by all")
def _(t):
    rows = C.literal_rows(C.block_clauses(t.blocks))
    return rows.groupBy("file_id", "block_no", "var", "positive").agg(F.count(F.lit(1)).alias("n"))


@query("define_clauses", """
with d as (select *, 'B' || block_no bv, symbol || repeat('.', version - 1) o, symbol || repeat('.', version) n from v_define)
select file_id, symbol, version, n var, not is_undef positive from d where block_no < 0
union all select file_id, symbol, version, unnest([bv, n, bv, o, n, bv, o, n]), unnest([false, not is_undef, true, false, true, true, true, false])
from d where block_no >= 0""")
def _(t):
    return C.literal_rows(C.define_clauses(t.defines)).drop("clause")


def meta_forced(t):
    on = F.col("key") == "ALWAYS_ON"
    return t.model_meta.select("arch", F.col("value").alias("symbol"), on.alias("on"))


def model_rows(t):
    return E.model_clauses(t.model_literal, meta_forced(t))


def model_literals(t):
    """(arch, clause, var, positive) with the clause text as its name."""
    return t._keep("model_literals", lambda: C.literal_rows(model_rows(t)).select("arch", "clause", "var", "positive").distinct())


@query("model_clauses", """
select arch, var, positive, count(*) n from v_model_clause group by all""")
def _(t):
    rows = C.literal_rows(model_rows(t))
    return rows.groupBy("arch", "var", "positive").agg(F.count(F.lit(1)).alias("n"))


def stated(t):
    from variscope.operators.configs import config_literals

    return t._keep("stated", lambda: config_literals(t.config.join(t.config_arch, "config_id"), t.model_symbol))


def violations(t, reading):
    return E.clause_violations(model_literals(t), stated(t), t.config_arch, reading)


VIOLATED = """
with mc as (select distinct arch, clause, var, positive from v_model_clause),
sig as (select arch, clause, string_agg(case when positive then '' else '!' end || var, ' ' order by var) sig from mc group by arch, clause),
keep as (select arch, sig, min(clause) clause from sig group by arch, sig),
c as (select mc.* from mc join keep using (arch, clause)),
st as (select a.config_id, a.arch, c.clause, count(*) n, count(l.val) m, bool_or(coalesce(l.val = c.positive, false)) ok_free, bool_or(coalesce(l.val, false) = c.positive) ok_false
  from v_config_arch a join c on c.arch = a.arch left join v_config_literal l on l.config_id = a.config_id and l.arch = a.arch and l.var = c.var group by all)
"""


@query("clause_violations", VIOLATED + "select config_id, arch, count(*) n from st where not ok_free and m = n group by all")
def _(t):
    return violations(t, "free").groupBy("config_id", "arch").agg(F.count(F.lit(1)).alias("n"))


@query("clause_violations_complete", VIOLATED + "select config_id, arch, count(*) n from st where not ok_false group by all")
def _(t):
    return violations(t, "false").groupBy("config_id", "arch").agg(F.count(F.lit(1)).alias("n"))


@query("config_valid", VIOLATED + """
select config_id, count(*) filter (where not ok_free and m = n) n_broken, count(*) filter (where not ok_free and m = n) = 0 as valid from st group by config_id""")
def _(t):
    return E.config_valid(t.config_arch, violations(t, "free"))


@query("failed_symbols", VIOLATED + """
select distinct st.config_id, c.var from st join c on c.arch = st.arch and c.clause = st.clause
join v_config_literal l on l.config_id = st.config_id and l.arch = c.arch and l.var = c.var where not ok_free and m = n""")
def _(t):
    return E.failed_symbols(model_literals(t), stated(t), violations(t, "free"))


def header_sets(t):
    """Distinct symbol sets of block headers as slices."""
    names = F.array_sort(L.symbols_of(F.col("expr")))
    sets = t.blocks.filter("expr <> ''").select(names.alias("vars")).filter(F.size("vars") > 0).distinct()
    return sets.withColumn("sid", F.concat_ws(",", "vars"))


@query("enumerate_assignments", """
with s as (select distinct list_sort(list(symbol)) vars from v_use group by file_id, block_no)
select array_to_string(vars, ',') sid, unnest(range(1 << len(vars)::int)) mask from s""")
def _(t):
    return E.enumerate_assignments(header_sets(t)).select("sid", "mask")


def code_slices(t):
    """(sid, lits), and the key of each block: slices of the code without defines."""
    ids = ["file_id", "block_no"]
    member_rows = C.closure_members(t.blocks, None)
    marks = C.slice_marks(t.blocks, None, member_rows)
    shown = C.one_of_each(marks)
    claim = shown.select(*ids, F.array(C.yes(C.block_var(F.col("block_no")))).alias("lits"))
    slices = C.block_slices(t.blocks, t.blocks, None, member_rows, shown.select(*ids)).unionByName(claim)
    keys, merged = E.merge_equal(slices, ids)
    told = shown.join(keys, ids).select("mark", "sid")
    return marks.join(told, "mark").select(*ids, "sid"), merged


def kept_slices(t):
    made = []

    def part(i):
        if not made:
            made.extend(code_slices(t))
        return made[i]

    return t._keep("slice_keys", lambda: part(0)), t._keep("slice_clauses", lambda: part(1))


@query("satisfiable_slices", """
select b.file_id, b.block_no, case when m.file_id is null then 'no' else 'yes' end verdict from v_block b
left join (select distinct file_id, block_no from v_slice_model) m using (file_id, block_no)""")
def _(t):
    keys, merged = kept_slices(t)
    return keys.join(E.satisfiable_slices(merged), "sid").select("file_id", "block_no", "verdict")


def extreme_sql(order: str) -> str:
    return f"""
with b as (select file_id, block_no, mask from (select *, row_number() over (partition by file_id, block_no order by {order}) i from v_slice_model) where i = 1)
select file_id, block_no, count(*) n_vars, count(*) filter (where (mask >> bit::int) & 1 = 1) n_true,
  coalesce(string_agg(var, ',' order by var) filter (where (mask >> bit::int) & 1 = 1 and var like 'CONFIG%'), '') symbols
from b join v_slice_var using (file_id, block_no) group by file_id, block_no"""


def extreme(t, most):
    keys, merged = kept_slices(t)
    rows = E.extreme_assignment(merged, most)
    on = F.col("val") & F.col("var").startswith("CONFIG")
    per = rows.groupBy("sid").agg(
        F.count(F.lit(1)).alias("n_vars"), F.count_if("val").alias("n_true"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(on, F.col("var"))))).alias("symbols"),
    )
    return keys.join(per, "sid").select("file_id", "block_no", "n_vars", "n_true", "symbols")


@query("least_assignment", extreme_sql("bit_count(mask), mask"))
def _(t):
    return extreme(t, False)


@query("most_assignment", extreme_sql("bit_count(mask) desc, mask desc"))
def _(t):
    return extreme(t, True)


def forced_sql(rounds: int) -> str:
    """Unit consequences spelled out for a fixed number of rounds; conflicting slices left out."""
    parts = ["u0 as materialized (select file_id, block_no, var, true val from v_slice_lit where clause = 'B' || block_no)"]
    for i in range(rounds):
        parts.append(
            f"u{i + 1} as materialized (select distinct file_id, block_no, var, val from u{i} union select file_id, block_no, var, positive from ("
            f"select l.file_id, l.block_no, l.clause, l.var, l.positive, "
            f"bool_or(u.val is not null and u.val = l.positive) over w sat, sum(case when u.val is null then 1 else 0 end) over w free, u.val is null is_free "
            f"from v_slice_lit l left join u{i} u using (file_id, block_no, var) window w as (partition by l.file_id, l.block_no, l.clause)) "
            f"where not sat and free = 1 and is_free)"
        )
    last = f"u{rounds}"
    return "with " + ",\n".join(parts) + f""",
broken as (select distinct file_id, block_no from (select l.file_id, l.block_no, l.clause, bool_or(u.val is null or u.val = l.positive) ok
  from v_slice_lit l left join {last} u using (file_id, block_no, var) group by all) where not ok
  union select file_id, block_no from {last} group by file_id, block_no, var having count(*) > 1)
select file_id, block_no, count(*) n_forced, false conflict from {last} where (file_id, block_no) not in (select (file_id, block_no) from broken) group by all
union all select file_id, block_no, null, true from broken"""


@query("forced_literals", forced_sql(8))
def _(t):
    keys, merged = kept_slices(t)
    _, facts, bad = E.forced_literals(merged)
    n = facts.join(bad, "sid", "left_anti").groupBy("sid").agg(F.count(F.lit(1)).alias("n_forced"))
    rows = keys.join(n, "sid", "left").join(bad.withColumn("_b", F.lit(True)), "sid", "left")
    return rows.select("file_id", "block_no", "n_forced", F.col("_b").isNotNull().alias("conflict"))


@query("observed_dead", "select file_id, block_no, state from v_observed")
def _(t):
    valid = t.builds.select("config_id").distinct().withColumn("valid", F.lit(True))
    return t._keep("observed", lambda: V.observed_dead(V.decided(t.blocks, t.undecided), t.builds, t.enabled, valid))


def observed_defects(t):
    """Observed dead and always-on blocks in the shape of a defect table."""

    def build():
        valid = t.builds.select("config_id").distinct().withColumn("valid", F.lit(True))
        seen = V.observed_dead(V.decided(t.blocks, t.undecided), t.builds, t.enabled, valid)
        kinds = t.blocks.select("file_id", "block_no", F.when(F.col("kind") == "else", "missing").otherwise("kconfig").alias("kind"))
        arch = M.file_arch(t.source_file, t.archs).select("file_id", F.col("specific_arch").isNotNull().alias("is_global"))
        suffix = F.when(F.col("state") == "never", "dead").otherwise("undead").alias("suffix")
        return seen.select("file_id", "block_no", suffix).join(kinds, ["file_id", "block_no"]).join(t.file_models, "file_id").join(arch, "file_id")

    return t._keep("observed_defects", build)


NAMES = """select s.path || '.B' || d.block_no || '.' || d.kind || '.' || case when d.is_global then 'globally' else d.arch end || '.' || d.suffix as name,
  '#B' || d.block_no || ':' || s.path || ':' || b.start_line || ':0:' || s.path || ':' || b.end_line || ':0:' header, d.suffix, d.kind
from v_defect d join v_source_file s using (file_id) join v_block b using (file_id, block_no)"""


@query("write_defects", NAMES)
def _(t):
    return D.write_defects_rows(observed_defects(t), t.blocks, t.source_file)


@query("defect_name", f"select name from ({NAMES})")
def _(t):
    return D.write_defects_rows(observed_defects(t), t.blocks, t.source_file).select("name")


@query("defect_summary", """
select kind, suffix, case when is_global then 'globally' else arch end scope, count(*) n, count(*) filter (where is_global)::bigint n_global,
  grouping(kind, suffix, case when is_global then 'globally' else arch end)::bigint as level
from v_defect group by cube(kind, suffix, case when is_global then 'globally' else arch end)""")
def _(t):
    return D.defect_summary(observed_defects(t))


@query("defects_by_directory", """
select dir, count(*)::bigint n from (select unnest(list_transform(range(1, len(string_split(path, '/'))::int), lambda k: array_to_string(string_split(path, '/')[1:k], '/'))) dir
  from v_defect join v_source_file using (file_id)) group by dir""")
def _(t):
    return D.defects_by_directory(observed_defects(t), t.source_file)


@query("defect_tree_json", """
with r as (select s.path, d.block_no, string_split(s.path, '/') p, string_split(s.path, '/')[1] top,
    '{"start_line":' || b.start_line || ',"end_line":' || b.end_line || ',"kind":"' || d.kind || '","suffix":"' || d.suffix || '"}' entry
  from v_defect d join v_source_file s using (file_id) join v_block b using (file_id, block_no)),
w as (select *, lag(p) over o before, lead(p) over o after from r window o as (partition by top order by path, block_no)),
n as (select *, len(p) depth,
    coalesce(len(list_filter(range(1, len(p) + 1), lambda i: before[1:i] = p[1:i])), 0) same_before,
    coalesce(len(list_filter(range(1, len(p) + 1), lambda i: after[1:i] = p[1:i])), 0) same_after from w)
select top, path, block_no,
  case when before is null then '' else ',' end
  || coalesce(array_to_string(list_transform(range(same_before + 1, depth + 1),
    lambda i: case when i = 1 then '{' else '"' || p[i] || '":' || case when i = depth then '[' else '{' end end), ''), '')
  || entry || case when same_after < depth then ']' else '' end || repeat('}', greatest(depth - 1 - same_after, 0)::int) piece
from n""")
def _(t):
    return D.defect_tree_json(observed_defects(t), t.blocks, t.source_file)


@query("coverage_conflicts", """
select file_id, block_no, 'dead but covered' conflict from v_defect where suffix = 'undead' and (file_id, block_no) in (select (file_id, block_no) from v_enabled)""")
def _(t):
    return V.coverage_conflicts(t.enabled, t.all_blocks, observed_defects(t).filter("suffix = 'undead'"))


@query("no_kconfig_blocks", """
with h as (select distinct file_id, block_no from v_defect), s as (select distinct file_id, block_no from v_use where regexp_full_match(symbol, 'CONFIG_P[0-9]')),
o as (select b.file_id, b.block_no, b.chain_no, b.kind, h.file_id is not null hit, h.file_id is not null and s.file_id is null own
  from v_block b left join h using (file_id, block_no) left join s using (file_id, block_no))
select file_id, block_no from o where own and kind <> 'else'
union all select file_id, block_no from o where hit and kind = 'else' and not exists (
  select 1 from o p where p.file_id = o.file_id and p.chain_no = o.chain_no and p.kind <> 'else' and not p.own)""")
def _(t):
    spaces = t.archs.withColumn("space", F.lit("CONFIG_P[0-9]"))
    return D.no_kconfig_blocks(observed_defects(t), t.blocks, t.file_models, spaces)


def defects(t, only=None):
    """Defects under the file's own model; with ``only`` those claims under every model."""

    def build():
        complete = M.model_complete(t.archs, t.model, t.model_meta)
        return D.block_defects(
            t.blocks, t.rewritten, t.defines, t.file_models, t.related, t.model, model_rows(t), meta_forced(t), t.spaces, complete,
            only=only,
        )

    return t._keep("defects" if only is None else "defects_everywhere", build)


@query("dead_blocks")
def _(t):
    return D.dead_blocks(defects(t))


@query("undead_blocks")
def _(t):
    return D.undead_blocks(defects(t))


@query("code_dead_blocks", """
select file_id, block_no from v_block except select file_id, block_no from v_slice_model""")
def _(t):
    keys, merged = kept_slices(t)
    return keys.join(E.satisfiable_slices(merged).filter("verdict = 'no'"), "sid").select("file_id", "block_no")


@query("defect_scope")
def _(t):
    told = defects(t).filter(F.col("block_no") >= 0)
    nk = D.no_kconfig_blocks(told, t.rewritten, t.file_models, t.spaces)
    specific = M.file_arch(t.source_file, t.archs).filter(F.col("specific_arch").isNotNull()).select("file_id")
    wide = told.filter(F.col("kind").isin("kconfig", "missing")).join(specific, "file_id", "left_anti").select(*D.IDS)
    return D.defect_scope(D.cross_check(told, defects(t, wide), t.file_models, specific, nk, t.archs))


@query("base_condition", f"""
with b as (select file_id, count(*) n from v_block group by file_id),
d as (select file_id, count(distinct text) n from ({DEFINE_TEXT}) group by file_id),
f as (select file_id, arch from v_file_arch join b using (file_id))
select b.file_id, 'code' part, b.n + coalesce(d.n, 0) + 2 n from b left join d using (file_id)
union all select file_id, 'missing', count(*) from v_file_missing group by file_id
union all select file_id, 'forced', count(*) from f join v_model_meta using (arch) group by file_id
union all select file_id, 'slice', sum(n)::bigint from (
  select s.file_id, s.arch, s.symbol, (m.formula <> '')::int + (select count(*) from v_model_meta k where k.arch = s.arch and k.value = s.symbol) n
  from (select file_id, arch, symbol from v_file_slice union select f.file_id, f.arch, k.value from f join v_model_meta k using (arch)) s
  join v_model m on m.arch = s.arch and m.symbol = s.symbol) group by file_id having sum(n) > 0""")
def _(t):
    files = t.source_file.join(t.line_files, "file_id", "left_semi")
    ids = ["file_id", "arch"]
    own = t.file_models.join(t.line_files, "file_id", "left_semi").select(*ids)
    rows = C.base_condition(
        C.file_condition(t.rewritten, t.defines, files),
        M.model_slice(t.file_slice, t.model, meta_forced(t), ids, own),
        M.missing_symbols(t.file_slice, t.model, t.spaces, ids, t.defines),
        M.model_complete(t.archs, t.model, t.model_meta), meta_forced(t), own,
    )
    return rows.groupBy("file_id", "part").agg(F.count(F.lit(1)).alias("n"))
