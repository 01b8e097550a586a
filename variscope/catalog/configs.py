"""Named queries: configurations and coverage."""

from pyspark.sql import functions as F

from variscope.catalog.base import query
from variscope.operators import blocks as B, configs as C, coverage as V, messages as X, models as M


@query("include_edges", "select distinct src, dst from v_include")
def _(t):
    return B.include_edges(t.include_line, t.source_file)


@query("include_closure", """
with r as (select file_id, file_id reached from v_source_file union select r.file_id, i.dst from r join v_include i on i.src = r.reached)
select file_id, reached from r""".replace("with r as", "with recursive r as"))
def _(t):
    return B.include_closure(t.source_file, B.include_edges(t.include_line, t.source_file))


@query("config_literals", "select config_id, arch, var, val from v_config_literal")
def _(t):
    return C.config_literals(t.config.join(t.config_arch, "config_id"), t.model_symbol)


@query("config_conflicts", """
select a.config_id, a.symbol, a.value, b.value other_value from v_config a join v_partial_config b using (config_id, symbol) where a.value <> b.value""")
def _(t):
    return C.config_conflicts(t.config, t.partial_config)


@query("config_conflict", """
select config_id, bool_or(coalesce(a.value <> b.value, false)) conflict from v_config a left join v_partial_config b using (config_id, symbol) group by config_id""")
def _(t):
    return C.config_conflict(t.config, t.partial_config)


@query("verify_expansion", """
select p.config_id, p.symbol, p.value, c.value as found from v_partial_config p left join v_config c using (config_id, symbol)
where p.symbol not in (select symbol from v_forced where is_on) and (c.value <> p.value or (c.value is null and p.value <> 'n'))""")
def _(t):
    return C.verify_expansion(t.partial_config, t.config, t.forced.filter("on"))


@query("overlay", """
select config_id, symbol, value from v_config where (config_id, symbol) not in (select (config_id, symbol) from v_partial_config)
union all select config_id, symbol, value from v_partial_config""")
def _(t):
    return C.overlay(t.config, t.partial_config, add=True)


@query("selected_count", "select config_id, count(*) filter (where value <> 'n') n_selected from v_config group by config_id")
def _(t):
    return C.selected_count(t.config)


@query("value_summary", """
select config_id, count(*) filter (where value = 'y') n_y, count(*) filter (where value = 'm') n_m, count(*) filter (where value = 'n') n_n
from v_config group by config_id""")
def _(t):
    return C.value_summary(t.config)


@query("config_subarch", """
with f as (select config_id, bool_or(symbol in ('CONFIG_P1', 'CONFIG_P2') and value = 'y') w,
  bool_or((symbol in ('CONFIG_P1', 'CONFIG_P2') and value = 'n') or (symbol = 'CONFIG_P3' and value = 'y')) s from v_config group by config_id)
select config_id, case when s then 'i386' when w then 'x86_64' end subarch, w and s inconsistent from f""")
def _(t):
    return C.config_subarch(t.config, ("CONFIG_P1", "CONFIG_P2"), ("CONFIG_P3",))


def folded(t):
    rows = t.assignment.join(t.config_arch, "config_id")
    missing = M.missing_symbols(
        rows.select("config_id", "arch", F.regexp_replace("var", "_MODULE$", "").alias("symbol")).distinct(),
        t.model, t.spaces, ["config_id", "arch"],
    )
    return C.fold_tristate(rows, missing, ["config_id", "arch"])


FOLDED = """
with f as (select config_id, arch, symbol, value, case when m.symbol is null then 'other' else 'selection' end part
  from (select config_id, arch, symbol, case when value = 'm' and symbol not in (select m.symbol from v_model m where m.arch = a.arch) then 'y' else value end as value
    from v_config join v_config_arch a using (config_id)) c left join v_model m using (arch, symbol))
"""


@query("fold_tristate", FOLDED + "select config_id, arch, symbol, value, part from f")
def _(t):
    return folded(t)


@query("config_text", FOLDED + """
select config_id, arch, case part when 'other' then 1 else 0 end section, symbol,
  case part when 'other' then '# ' else '' end || symbol || '=' || value line from f""")
def _(t):
    return C.config_text(folded(t), ["config_id", "arch"])


@query("config_flags", """
select config_id, arch, var symbol, ' -D' || var || '=1' flag from v_assignment join v_config_arch using (config_id) where val""")
def _(t):
    return C.config_flags(t.assignment.join(t.config_arch, "config_id"), t.spaces)


@query("assignment_text", """
select config_id, arch, var symbol, var || '=' || val::int line from v_assignment join v_config_arch using (config_id)""")
def _(t):
    return C.assignment_text(t.assignment.join(t.config_arch, "config_id"), t.spaces)


@query("enabled_blocks", "select file_id, config_id, block_no from v_enabled")
def _(t):
    return t.enabled


@query("first_cover", """
select distinct file_id, config_id from (select file_id, block_no, min(config_id) config_id from v_enabled group by all)""")
def _(t):
    return V.first_cover(t.enabled)


def greedy_sql(rounds: int) -> str:
    """Greedy choice spelled out for a fixed number of rounds."""
    parts = ["l0 as materialized (select * from v_enabled)"]
    for i in range(rounds):
        parts.append(
            f"c{i} as materialized (select file_id, config_id, gain, {i + 1} pick from (select *, row_number() over "
            f"(partition by file_id order by gain desc, config_id) r from (select file_id, config_id, count(*) gain from l{i} group by all)) where r = 1)"
        )
        parts.append(
            f"l{i + 1} as materialized (select l.* from l{i} l where not exists (select 1 from l{i} k join c{i} c using (file_id, config_id) "
            f"where k.file_id = l.file_id and k.block_no = l.block_no))"
        )
    union = " union all ".join(f"select * from c{i}" for i in range(rounds))
    return "with " + ",\n".join(parts) + "\n" + union


@query("greedy_cover", greedy_sql(10))
def _(t):
    return V.greedy_cover(t.enabled)


@query("coverage_ratio", """
select a.file_id, count(e.block_no) n_covered, count(*) n_total, 100 * count(e.block_no) // count(*) percent
from v_all_block a left join (select distinct file_id, block_no from v_enabled) e using (file_id, block_no) group by a.file_id""")
def _(t):
    return V.coverage_ratio(t.enabled, t.all_blocks)


@query("added_blocks", """
with f as (select file_id, block_no, min(config_id) config_id from v_enabled group by all),
n as (select b.file_id, b.config_id, count(f.block_no) n_added from v_build b left join f using (file_id, config_id) group by all)
select file_id, config_id, n_added, (sum(n_added) over (partition by file_id order by config_id))::bigint n_total from n""")
def _(t):
    return V.added_blocks(t.enabled)


@query("uncovered_blocks", "select file_id, block_no from v_all_block except select file_id, block_no from v_enabled")
def _(t):
    return V.uncovered_blocks(t.enabled, t.all_blocks)


@query("uncovered_config_blocks", """
select b.file_id, b.block_no from v_block b where exists (select 1 from v_block m join v_block h on h.file_id = m.file_id
  and h.start_line >= m.start_line and h.start_line < m.end_line where m.file_id = b.file_id and m.chain_no = b.chain_no and h.expr like '%CONFIG_%')
  and (b.file_id, b.block_no) not in (select (file_id, block_no) from v_unsupported)
except select file_id, block_no from v_enabled""")
def _(t):
    return V.uncovered_blocks(t.enabled, V.decided(B.config_blocks(t.blocks), t.undecided))


@query("line_coverage", """
select n.file_id, sum(n_lines)::bigint n_total, coalesce(sum(n_lines) filter (where e.block_no is not null), 0)::bigint n_covered,
  coalesce(sum(n_lines) filter (where n.block_no >= 0), 0)::bigint n_cond_total,
  coalesce(sum(n_lines) filter (where n.block_no >= 0 and e.block_no is not null), 0)::bigint n_cond_covered
from v_line_count n left join (select distinct file_id, block_no from v_enabled) e using (file_id, block_no)
where (n.file_id, n.block_no) not in (select (file_id, block_no) from v_unsupported) group by n.file_id""")
def _(t):
    return V.line_coverage(t.enabled, V.decided(B.block_lines(t.lines, t.tree), t.undecided))


@query("common_assignment", """
select file_id, symbol, bool_and(val) val from v_solution group by file_id, symbol having min(val) = max(val)""")
def _(t):
    return V.common_assignment(t.solutions)


@query("differing_assignment", """
select file_id, config_id, symbol, val from v_solution where (file_id, symbol) in (select (file_id, symbol) from v_solution group by file_id, symbol having min(val) <> max(val))""")
def _(t):
    return V.differing_assignment(t.solutions)


@query("distinct_solutions", """
select file_id, min(config_id) config_id from (select file_id, config_id, string_agg(symbol || val::int, ',' order by symbol) s from v_solution group by all) group by file_id, s""")
def _(t):
    return V.distinct_solutions(t.solutions)


@query("top_variable_files", """
with d as (select file_id, min(config_id) c from (select file_id, config_id, string_agg(symbol || val::int, ',' order by symbol) s from v_solution group by all) group by file_id, s)
select path, count(*) n_solutions from d join v_source_file using (file_id) group by path order by n_solutions desc, path limit 50""")
def _(t):
    return V.top_variable_files(V.distinct_solutions(t.solutions), t.source_file)


@query("baseline_coverage", """
with p as (select file_id, block_no, bool_or(config_id < 20) b, bool_or(config_id >= 20) o from v_enabled group by all)
select file_id, count(*) filter (where b) n_base, count(*) filter (where o) n_other, count(*) filter (where b and not o) n_only_base,
  count(*) filter (where o and not b) n_only_other from p group by file_id""")
def _(t):
    return V.baseline_coverage(t.enabled, t.builds.select("config_id").distinct().filter("config_id < 20"))


@query("masked_source", """
with f as (select file_id, min(config_id) config_id from v_build group by file_id),
e as (select e.file_id, e.block_no from v_enabled e join f using (file_id, config_id))
select l.file_id, l.line_no, case when e.block_no is null then '// ' else '' end || l.txt txt from v_line_inside l left join e using (file_id, block_no)
union all select file_id, line_no, '// ' || txt from v_source_line where regexp_matches(txt, '^#(if|elif|else|endif)')""")
def _(t):
    one = t.builds.groupBy("file_id").agg(F.min("config_id").alias("config_id"))
    return V.masked_source(t.lines, t.tree, t.enabled.join(one, ["file_id", "config_id"], "left_semi"))


@query("loc_without_includes", "select file_id, count(*) n_lines from v_source_line where txt not like '#include%' group by file_id")
def _(t):
    return V.loc_without_includes(t.lines)


UNMET = """select p.config_id, p.symbol from v_partial_config p left join v_config c using (config_id, symbol)
  where p.symbol not in (select symbol from v_forced where is_on) and (c.value <> p.value or (c.value is null and p.value <> 'n'))"""


@query("coverage_report", f"""
with u as (select config_id, count(*) n from ({UNMET}) group by config_id),
s as (select config_id, count(*) filter (where value <> 'n') n from v_config group by config_id),
m as (select config_id, count(*) filter (where severity = 'warning') w, count(*) filter (where severity = 'error') e from v_parsed group by config_id)
select e.file_id, e.config_id, count(*) n_covered, coalesce(max(u.n), 0) n_mismatches, coalesce(max(s.n), 0) n_selected,
  coalesce(max(m.w), 0) n_warnings, coalesce(max(m.e), 0) n_errors
from v_enabled e left join s using (config_id) left join u using (config_id) left join m using (config_id) group by e.file_id, e.config_id""")
def _(t):
    unmet = C.verify_expansion(t.partial_config, t.config, t.forced.filter("on"))
    return V.coverage_report(t.enabled, unmet, C.selected_count(t.config), X.severity_counts(t.parsed))
