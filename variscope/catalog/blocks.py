"""Named queries: line projections and block structure."""

from pyspark.sql import functions as F

from variscope.catalog.base import query
from variscope.functions import lines as L, texts as X
from variscope.operators import blocks as B, coverage as V

big = lambda c: F.col(c).cast("bigint").alias(c)


@query("directives", "select file_id, line_no, kind, arg from v_directive")
def _(t):
    return L.directives(t.lines).select("file_id", "line_no", "kind", "arg")


@query("block_tree", "select file_id, block_no, kind, depth::bigint depth, chain_no, start_line, end_line from v_block")
def _(t):
    return t.blocks.select("file_id", "block_no", "kind", "depth", "chain_no", "start_line", "end_line")


@query("block_parent", "select file_id, block_no, parent_no from v_block")
def _(t):
    return t.blocks.select("file_id", "block_no", "parent_no")


@query("block_prev", "select file_id, block_no, prev_no from v_block")
def _(t):
    return t.blocks.select("file_id", "block_no", "prev_no")


@query("block_ranges", """
select file_id, name, start_line, end_line from v_block
union all select distinct file_id, 'B00', 0::bigint, 0::bigint from v_source_line""")
def _(t):
    return B.block_ranges(t.blocks, t.line_files)


@query("chain_predecessors", """
select b.file_id, b.block_no, max(p.block_no) nearest_no, min(p.block_no) first_no, count(p.block_no) n_earlier
from v_block b left join v_block p on p.file_id = b.file_id and p.chain_no = b.chain_no and p.block_no < b.block_no
group by b.file_id, b.block_no""")
def _(t):
    return B.chain_predecessors(t.blocks)


@query("chain_conflicts", """
select a.file_id, a.chain_no, (select count(*) from v_block m where m.file_id = a.file_id and m.chain_no = a.chain_no) n_members,
  max(b.block_no) last_no, count(*) n_pairs
from v_block a join v_block b on a.file_id = b.file_id and a.chain_no = b.chain_no and a.block_no < b.block_no
group by a.file_id, a.chain_no""")
def _(t):
    return B.chain_conflicts(t.blocks)


@query("block_lines", """
select file_id, block_no, count(*) n_lines from (
  select l.file_id, l.line_no, coalesce(max_by(b.block_no, b.start_line), -1) block_no
  from v_code_line l left join v_block b on b.file_id = l.file_id and b.start_line < l.line_no and l.line_no < b.end_line
  group by l.file_id, l.line_no) group by file_id, block_no""")
def _(t):
    return B.block_lines(t.lines, t.tree)


@query("block_at", """
select l.file_id, l.line_no, min_by(b.block_no, (b.end_line - b.start_line) * 100000 + b.block_no) block_no
from v_source_line l left join v_block b on b.file_id = l.file_id and b.start_line < l.line_no and l.line_no < b.end_line
group by l.file_id, l.line_no""")
def _(t):
    return B.block_at(t.lines, t.tree)


@query("config_blocks", """
select distinct b.file_id, b.block_no from v_block b
join v_block m on m.file_id = b.file_id and m.chain_no = b.chain_no
join v_block h on h.file_id = m.file_id and h.start_line >= m.start_line and h.start_line < m.end_line
where h.expr like '%CONFIG_%'""")
def _(t):
    return B.config_blocks(t.blocks).select("file_id", "block_no")


@query("structure_listing", """
select b.file_id, b.name, b.kind, b.expr, h.txt as header, f.txt as footer, b.parent_no, b.prev_no
from v_block b join v_source_line h on h.file_id = b.file_id and h.line_no = b.start_line
left join v_source_line f on f.file_id = b.file_id and f.line_no = b.end_line""")
def _(t):
    return B.structure_listing(t.lines, t.tree)


@query("decision_blocks", """
with d as (select file_id, depth, kind, expr, start_line, end_line, false dummy from v_block
  union all select file_id, max(depth), 'else', '', max(end_line), max(end_line), true from v_block
    group by file_id, chain_no having count(*) filter (where kind = 'else') = 0)
select file_id, depth::bigint depth, kind, expr, start_line, end_line, dummy,
  row_number() over (partition by file_id order by start_line, dummy) - 1 block_no from d""")
def _(t):
    return B.decision_blocks(t.blocks)


@query("define_versions", "select file_id, block_no, line_no, symbol, is_undef, version from v_define")
def _(t):
    return t.defines


@query("rewrite_symbols", r"""
with e as (select b.file_id, b.block_no, unnest(regexp_extract_all(b.expr, '[A-Za-z_][A-Za-z0-9_]*|[^A-Za-z_]+')) piece,
    generate_subscripts(regexp_extract_all(b.expr, '[A-Za-z_][A-Za-z0-9_]*|[^A-Za-z_]+'), 1) i from v_block b)
select b.file_id, b.block_no, coalesce(string_agg(e.piece || repeat('.', coalesce(v.version, 0)::bigint), '' order by e.i), '') expr
from v_block b left join e on e.file_id = b.file_id and e.block_no = b.block_no
left join v_use_version v on v.file_id = e.file_id and v.block_no = e.block_no and v.symbol = e.piece
group by b.file_id, b.block_no""")
def _(t):
    return t.rewritten.select("file_id", "block_no", "expr")


@query("block_defines", """
select file_id, block_no, symbol, min(line_no) first_line, count(*) n_defines from v_define group by all""")
def _(t):
    return B.block_defines(t.defines)


@query("directive_skeleton", """
select d.file_id, d.line_no, 0 part, s.txt from v_directive d join v_source_line s using (file_id, line_no)
union all select file_id, start_line, 1, name from v_block""")
def _(t):
    return B.directive_skeleton(t.lines, t.tree)


@query("include_guards", """
with d as (select *, row_number() over (partition by file_id order by line_no) i,
    row_number() over (partition by file_id order by line_no desc) j from v_directive)
select a.file_id, a.arg guard from d a join d b using (file_id) join d z using (file_id)
join v_block k on k.file_id = a.file_id and k.block_no = 0 and k.end_line = z.line_no
where a.i = 1 and b.i = 2 and z.j = 1 and a.kind = 'ifndef' and b.kind = 'define' and z.kind = 'endif' and a.arg = b.arg""")
def _(t):
    return B.include_guards(t.lines, t.tree)


@query("drop_statements", r"""
select file_id, line_no, txt from v_document_line where not regexp_matches(txt, '^\s*#\s*(error|warning|assert|include_next)\b')""")
def _(t):
    return L.drop_statements(t.document_line)


@query("join_continuations", r"""
with m as (select *, coalesce(lag(txt like '%\') over (partition by file_id order by line_no), false) cont from v_document_line),
g as (select *, sum(case when cont then 0 else 1 end) over (partition by file_id order by line_no) grp from m)
select file_id, min(line_no) line_no,
  string_agg(case when txt like '%\' then left(txt, length(txt) - 1) else txt end, '' order by line_no) txt from g group by file_id, grp""")
def _(t):
    return X.join_continuations(t.document_line)


@query("normalize_define_zero", r"""
select file_id, line_no, regexp_replace(txt, '^\s*#\s*define\s+([A-Za-z_][A-Za-z0-9_]*)\s+0\s*$', '#undef \1') txt from v_source_line""")
def _(t):
    return L.normalize_define_zero(t.lines)


@query("block_expression", "select file_id, block_no, expr from v_block")
def _(t):
    starts = t.tree.filter(F.col("block_no").isNotNull())
    return L.block_expression(starts).select("file_id", "block_no", "expr")


@query("expr_symbols", "select file_id, block_no, symbol from v_use")
def _(t):
    return L.expr_symbols(t.blocks.select("file_id", "block_no", "expr"))


@query("expr_literals", r"""
select file_id, block_no, true supported, grp::bigint grp, symbol, positive from v_lit
union all select file_id, block_no, true, null, null, null from v_plain where plain = '1'
union all select file_id, block_no, false, null, null, null from v_unsupported
union all select file_id, block_no, false, null, null, null from v_block where expr = ''""")
def _(t):
    return L.expr_literals(t.blocks.select("file_id", "block_no", "expr"))


@query("plain_condition", "select file_id, block_no, plain from v_plain where (file_id, block_no) not in (select (file_id, block_no) from v_unsupported)")
def _(t):
    return L.supported_conditions(t.blocks.select("file_id", "block_no", "expr"))


@query("unsupported_blocks", "select file_id, block_no, chain_no from v_unsupported")
def _(t):
    return V.unsupported_blocks(t.blocks)


@query("undecided_count", "select file_id, count(*) n_undecided from v_unsupported group by file_id")
def _(t):
    return t.undecided.groupBy("file_id").agg(F.count("*").alias("n_undecided"))
