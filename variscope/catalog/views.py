"""DuckDB side of the projections and of the tables most queries start from."""

from variscope.catalog.base import view

view("v_source_line", """
with li as (select l_orderkey file_id, l_returnflag rf, l_suppkey % 6 form,
    concat('CONFIG_P', cast(l_partkey % 40 as varchar(10))) a,
    concat('CONFIG_P', cast(l_suppkey % 40 as varchar(10))) b,
    row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) seq
  from lineitem),
t as (select file_id, seq, 1 k, case rf when 'N' then case form when 0 then '#if !defined(' || a || ')' when 1 then '#if defined(' || a || ') || defined(' || b || ')'
      when 2 then '#if 1' when 3 then '#if !(defined(' || a || ') || defined(' || b || '))'
      when 4 then '#if (defined(' || a || ') && defined(' || b || ')) || defined(' || a || ')' else '#ifdef ' || a end when 'A' then concat('#if ', a, ' || ', b) else concat('#ifndef ', a) end txt from li
  union all select file_id, seq, 2, 'code();' from li
  union all select file_id, seq, 3, concat('#elif ', b) from li where rf = 'A'
  union all select file_id, seq, 4, 'code();' from li where rf = 'A'
  union all select file_id, seq, 5, '#else' from li where rf = 'A'
  union all select file_id, seq, 3, concat('#define ', b) from li where rf = 'R'
  union all select file_id, seq, 4, concat('#if ', b, ' && !', a) from li where rf = 'R'
  union all select file_id, seq, 5, 'code();' from li where rf = 'R'
  union all select file_id, seq, 6, '#endif' from li where rf = 'R'
  union all select file_id, seq, 7, '#endif' from li)
select file_id, row_number() over (partition by file_id order by seq, k) line_no, txt from t
""")

view("v_source_file", """
select o_orderkey file_id,
  case when o_orderkey % 4 = 0 then concat('arch/', lower(r_name), '/kernel/f', cast(o_orderkey as varchar(20)), '.c')
       else concat('drivers/', lower(c_mktsegment), '/f', cast(o_orderkey as varchar(20)), '.c') end path
from orders join customer on o_custkey = c_custkey join region on r_regionkey = o_orderkey % 5
""")

view("v_model_symbol", """
select distinct r_name arch, concat('CONFIG_P', cast(p_partkey % 40 as varchar(10))) symbol,
  case when p_partkey % 40 % 3 = 0 then 'tristate' else 'boolean' end type
from part cross join region where p_partkey % 10 <> 7
""")

view("v_model_literal", """
with s as (select distinct p_partkey % 40 i, r_regionkey r, r_name arch from part cross join region where p_partkey % 10 <> 7),
l as (select arch, i, 1 clause_no, (i * 3 + r + 1) % 40 j, true positive from s
  union all select arch, i, 1, (i * 5 + 2) % 40, true from s
  union all select arch, i, 2, (i + 7) % 40, false from s where i % 4 = 0)
select arch, concat('CONFIG_P', cast(i as varchar(10))) symbol, clause_no,
  concat('CONFIG_P', cast(j as varchar(10))) lit_symbol, positive from l where i <> j
""")

view("v_model_meta", """
select r_name arch, 'ALWAYS_ON' key, concat('CONFIG_P', cast(r_regionkey as varchar(10))) value from region
union all select r_name, 'ALWAYS_OFF', concat('CONFIG_P', cast(r_regionkey + 20 as varchar(10))) from region
""")

view("v_config", """
select l_orderkey % 200 config_id, concat('CONFIG_P', cast(l_partkey % 40 as varchar(10))) symbol,
  min(case l_returnflag when 'A' then 'y' when 'N' then 'n' else 'm' end) value
from lineitem group by l_orderkey % 200, concat('CONFIG_P', cast(l_partkey % 40 as varchar(10)))
""")

view("v_tool_message", """
select event_id % 12 config_id, event_id seq,
  concat('src/f', cast(user_id % 20 as varchar(10)), '.c:', cast(event_id % 50 as varchar(10)), ':', cast(event_id % 7 as varchar(10)), ': ',
    case when event_type = 'error' then 'error: ' else 'warning: ' end, 'bad ', event_type, ' [-Wx]') line
from events
""")

view("v_trace_event", """
select event_id, ts, event_type func, user_id * 1000 + event_id % 1000 addr, event_id % 16 off,
  (user_id * 7919 + event_id) % 500000 caller_addr from events
""")

view("v_module", """
select s_name name, s_suppkey * 5000 base, 3000 + s_nationkey * 10 size from supplier
""")

view("v_selection_literal", """
select distinct l_orderkey % 300 selection_id, concat('CONFIG_P', cast(l_partkey % 8 as varchar(10))) symbol,
  case when l_partkey % 8 % 3 = 0 then 'm' else 'y' end value from lineitem
""")

view("v_selection_file", """
select distinct l_orderkey % 300 selection_id, concat('obj/f', cast(l_suppkey % 30 as varchar(10)), '.o') file from lineitem
""")
view("v_build", "select distinct l_orderkey file_id, l_partkey % 200 config_id from lineitem")

view("v_document_line", """
select doc_id file_id, unnest(string_split(text, chr(10))) txt,
  cast(generate_subscripts(string_split(text, chr(10)), 1) as bigint) line_no from documents
""")

view("v_directive", r"""
select file_id, line_no, kind, arg from (
  select file_id, line_no,
    regexp_extract(txt, '^\s*#\s*(ifdef|ifndef|if|elif|else|endif|define|undef|include)\b\s*(.*)$', 1) kind,
    trim(regexp_extract(txt, '^\s*#\s*(ifdef|ifndef|if|elif|else|endif|define|undef|include)\b\s*(.*)$', 2)) arg
  from v_source_line) where kind <> ''
""")

view("v_structure", r"""
with c as (select *, case when kind in ('if','ifdef','ifndef') then 1 when kind = 'endif' then -1 else 0 end d
  from v_directive where kind in ('if','ifdef','ifndef','elif','else','endif')),
n as (select *, sum(d) over f + case when kind = 'endif' then 1 else 0 end depth,
    case when kind <> 'endif' then count(*) filter (where kind <> 'endif') over f - 1 end block_no
  from c window f as (partition by file_id order by line_no)),
g as (select *, sum(case when d = 1 then 1 else 0 end) over l grp, lead(line_no) over l next_line
  from n window l as (partition by file_id, depth order by line_no))
select file_id, line_no, kind, arg, depth, block_no,
  min(block_no) over (partition by file_id, depth, grp) chain_no,
  case when d <> 1 then lag(block_no) over (partition by file_id, depth, grp order by line_no) end prev_no, next_line
from g
""")

view("v_block", r"""
select b.file_id, b.block_no, concat('B', b.block_no) as name, b.kind, b.depth, b.chain_no, p.block_no parent_no, b.prev_no,
  case when b.kind = 'else' then '' when b.kind = 'ifndef' then concat('! ', b.arg) else trim(replace(b.arg, 'defined', '')) end expr,
  b.line_no start_line, b.next_line end_line
from v_structure b left join v_structure p
  on p.file_id = b.file_id and p.depth = b.depth - 1 and p.block_no is not null
  and p.line_no < b.line_no and p.next_line > b.line_no
where b.block_no is not null
""")

view("v_code_line", r"""
select file_id, line_no from v_source_line where not regexp_matches(txt, '^\s*#')
""")

view("v_define", r"""
select d.file_id, coalesce(i.block_no, -1) block_no, d.line_no, d.symbol, d.is_undef,
  row_number() over (partition by d.file_id, d.symbol order by d.line_no) as version
from (select file_id, line_no, kind = 'undef' is_undef, regexp_extract(arg, '^([A-Za-z_][A-Za-z0-9_]*)', 1) symbol
      from v_directive where kind in ('define', 'undef')) d
left join (select file_id, line_no, block_no from (
    select d.file_id, d.line_no, b.block_no,
      row_number() over (partition by d.file_id, d.line_no order by b.end_line - b.start_line) rn
    from v_directive d join v_block b on b.file_id = d.file_id and b.start_line < d.line_no and d.line_no < b.end_line
    where d.kind in ('define', 'undef')) where rn = 1) i
  on i.file_id = d.file_id and i.line_no = d.line_no
""")

view("v_use", r"""
select distinct file_id, block_no, start_line, symbol from (
  select file_id, block_no, start_line, unnest(regexp_extract_all(expr, '[A-Za-z_][A-Za-z0-9_]*')) symbol from v_block)
""")

view("v_use_version", r"""
select u.file_id, u.block_no, u.symbol, count(d.line_no) as version
from v_use u left join v_define d on d.file_id = u.file_id and d.symbol = u.symbol and d.line_no < u.start_line
group by u.file_id, u.block_no, u.symbol
""")

view("v_list_item", """
select case when n_regionkey % 2 = 0 then 'white' else 'black' end list, concat('CONFIG_P', cast(n_nationkey as varchar)) item from nation""")

view("v_worklist_line", """
select case file_id % 5 when 0 then './' || path when 1 then replace(path, '/', '//') when 2 then 'x/../' || path
  when 3 then 'gone/' || path else path end line from v_source_file""")

view("v_location_line", """
select path || ':' || (l_linenumber * 3) || case when l_suppkey % 2 = 0 then ':' || (l_suppkey % 80) else '' end line
from lineitem join v_source_file on l_orderkey = file_id""")

view("v_model", """
select s.arch, s.symbol, coalesce(string_agg(g.t, ' && ' order by g.clause_no), '') formula
from v_model_symbol s left join (select arch, symbol, clause_no,
    '(' || string_agg(case when positive then '' else '!' end || lit_symbol, ' || ' order by lit_symbol) || ')' t
  from v_model_literal group by arch, symbol, clause_no) g on g.arch = s.arch and g.symbol = s.symbol
group by s.arch, s.symbol""")

view("v_edge", "select distinct arch, symbol src, lit_symbol dst from v_model_literal")

view("v_file_arch", r"""
select f.file_id, a.arch specific_arch, coalesce(a.arch, (select min(arch) from v_model)) arch
from v_source_file f left join (select distinct arch from v_model) a
  on lower(a.arch) = regexp_extract(f.path, '(?:^|/)arch/([A-Za-z0-9]+)/', 1)""")

view("v_file_use", "select distinct u.file_id, a.arch, u.symbol from v_use u join v_file_arch a using (file_id)")

view("v_related", """recursive
select arch, symbol as start, symbol from (select arch, symbol from v_file_use union select arch, symbol from v_model)
union select r.arch, r.start, e.dst from v_related r join v_edge e on e.arch = r.arch and e.src = r.symbol""")

view("v_forced", """
select arch, value symbol, key = 'ALWAYS_ON' as is_on from v_model_meta
union select arch, item, list = 'white' from (select distinct arch from v_model) cross join v_list_item""")

view("v_file_slice", """
select distinct u.file_id, u.arch, r.symbol from v_file_use u join v_related r on r.arch = u.arch and r.start = u.symbol""")

view("v_file_missing", """
select s.file_id, s.arch, s.symbol from v_file_slice s
where regexp_full_match(s.symbol, 'CONFIG_[^ ]+') and not exists (select 1 from v_model m where m.arch = s.arch and m.symbol = s.symbol)
  and not exists (select 1 from v_define d where d.file_id = s.file_id and d.symbol = s.symbol)""")

view("v_include", """
select f.file_id src, t.file_id dst from v_source_file f join v_source_file t on t.file_id = f.file_id // 2""")

view("v_partial_config", """
select l_orderkey % 200 config_id, concat('CONFIG_P', cast(l_suppkey % 40 as varchar)) symbol, min(case l_linestatus when 'F' then 'y' else 'n' end) as value
from lineitem group by all""")

view("v_config_arch", """
select distinct l_orderkey % 200 config_id, r_name arch from lineitem join region on r_regionkey = l_orderkey % 200 % 5""")

view("v_assignment", """
select config_id, symbol var, value = 'y' val from v_config union all select config_id, symbol || '_MODULE', true from v_config where value = 'm'""")

view("v_config_literal", """
with c as (select c.config_id, a.arch, c.symbol, c.value, s.type from v_config c join v_config_arch a using (config_id)
  join v_model_symbol s on s.arch = a.arch and s.symbol = c.symbol)
select config_id, arch, symbol var, value = 'y' val from c where type = 'boolean'
union all select config_id, arch, symbol, true from c where type = 'tristate' and value = 'y'
union all select config_id, arch, symbol || '_MODULE', true from c where type = 'tristate' and value = 'm'
union all select config_id, arch, symbol, false from c where type = 'tristate' and value = 'n'
union all select config_id, arch, symbol || '_MODULE', false from c where type = 'tristate' and value = 'n'""")

view("v_plain", r"""
select *, regexp_replace(regexp_replace(regexp_replace(replace(expr, ' ', ''), '(^|[|(!&])\((\w+)\)', '\1\2', 'g'), '(^|[|(!&])\((\w+)\)', '\1\2', 'g'),
  '^!\((\w+)\|\|(\w+)\)$', '!\1&&!\2') plain from v_block""")

view("v_unsupported", r"select file_id, block_no, chain_no from v_plain where regexp_matches(plain, '^\(.*&&.*\)\|\|')")

view("v_lit", r"""
with g as (select file_id, block_no, unnest(string_split(regexp_replace(plain, '[()]', '', 'g'), '&&')) part,
  generate_subscripts(string_split(regexp_replace(plain, '[()]', '', 'g'), '&&'), 1) - 1 grp from v_plain
  where plain not in ('', '1') and (file_id, block_no) not in (select (file_id, block_no) from v_unsupported))
select file_id, block_no, grp, ltrim(lit, '!') symbol, lit not like '!%' positive
from (select file_id, block_no, grp, unnest(string_split(part, '||')) lit from g)""")

view("v_own", """
select b.file_id, u.config_id, b.block_no, b.chain_no, b.parent_no, b.expr in ('', '1') or g.ok own
from (select * from v_block where (file_id, block_no) not in (select (file_id, block_no) from v_unsupported)) b join v_build u using (file_id) left join (
  select file_id, config_id, block_no, bool_and(ok) ok from (
    select l.file_id, u.config_id, l.block_no, l.grp, bool_or((t.var is not null) = l.positive) ok
    from v_lit l join v_build u using (file_id) left join (select config_id, var from v_assignment where val) t
      on t.config_id = u.config_id and t.var = l.symbol group by all) group by all) g
  on g.file_id = b.file_id and g.config_id = u.config_id and g.block_no = b.block_no""")

view("v_won", """
select file_id, config_id, block_no, coalesce(parent_no, -1) parent_no from (
  select *, row_number() over (partition by file_id, config_id, chain_no order by block_no) i from v_own where own) where i = 1""")

view("v_enabled", """recursive
select file_id, config_id, -1::bigint as block_no from v_build
union all select w.file_id, w.config_id, w.block_no from v_enabled e join v_won w
  on w.file_id = e.file_id and w.config_id = e.config_id and w.parent_no = e.block_no""")

view("v_all_block", """
select file_id, block_no from v_block where (file_id, block_no) not in (select (file_id, block_no) from v_unsupported)
union all select distinct file_id, -1 from v_source_line""")

view("v_line_inside", """
select l.file_id, l.line_no, l.txt, coalesce(max_by(b.block_no, b.start_line), -1) block_no
from v_source_line l left join v_block b on b.file_id = l.file_id and b.start_line < l.line_no and l.line_no < b.end_line
where not regexp_matches(l.txt, '^#(if|elif|else|endif)') group by l.file_id, l.line_no, l.txt""")

view("v_line_count", """
select file_id, block_no, count(*) n_lines from v_line_inside where txt not like '#%' group by all""")

view("v_solution", """
select u.file_id, b.config_id, u.symbol, t.var is not null val from (select distinct file_id, symbol from v_file_use) u
join v_build b using (file_id) left join (select config_id, var from v_assignment where val) t on t.config_id = b.config_id and t.var = u.symbol""")

view("v_message", r"""
with c as (select config_id, seq, regexp_replace(regexp_replace(line, '\s*\[(-W[^\[]+|enabled by default)\]$', ''), '(:\d+):\d+: ', '\1: ') line from v_tool_message),
w as (select *, regexp_extract(line, '^\s*([^ \t]+)([ \t]+)(.*)', 1) word, regexp_extract(line, '^\s*([^ \t]+)([ \t]+)(.*)', 3) rest from c),
h as (select *, case when lag(word) over (partition by config_id order by seq) = word then 0 else 1 end s from w),
g as (select *, sum(s) over (partition by config_id order by seq) grp from h)
select config_id, min(seq) seq, string_agg(case when s = 1 then line else rest end, ' | ' order by seq) line from g group by config_id, grp""")

view("v_parsed", r"""
select config_id, seq, split_part(line, ' ', 1) location, case when line like '%error: %' then 'error' when line like '%warning: %' then 'warning' end severity,
  regexp_replace(line, '^\S+ \S+ ', '') as text from v_message""")

view("v_address", """
select event_id, ts, 0 part, addr - off addr from v_trace_event union all select event_id, ts, 1, caller_addr from v_trace_event""")

view("v_offset", """
select a.addr, min_by(m.name, m.base) as module, a.addr - min(m.base) module_off
from (select distinct addr from v_address) a left join v_module m on a.addr between m.base and m.base + m.size group by a.addr""")

view("v_closure_edge", """
select file_id, block_no src, parent_no dst from v_block where parent_no is not null
union select file_id, block_no, prev_no from v_block where prev_no is not null
union select u.file_id, u.block_no, d.block_no from v_use u join v_define d on d.file_id = u.file_id and d.symbol = u.symbol where d.block_no >= 0""")

view("v_closure", """recursive
select file_id, block_no, block_no member_no from v_block
union select c.file_id, c.block_no, e.dst from v_closure c join v_closure_edge e on e.file_id = c.file_id and e.src = c.member_no""")

view("v_group", "select file_id, block_no, grp, list(case when positive then symbol else '!' || symbol end) ls from v_lit group by all")

view("v_negated", """
select file_id, block_no, case when max(n) = 1 then null else 1 end many, list(g order by grp) gs from (
  select file_id, block_no, grp, len(ls) n, ls g from v_group) group by file_id, block_no""")

view("v_block_clause", """
with b as (select b.*, 'B' || b.block_no bv, 'B' || b.parent_no pv,
    case when b.prev_no is null then null when b.prev_no = b.chain_no then 'B' || b.prev_no else 'T' || b.prev_no end tv,
    exists (select 1 from v_block n where n.file_id = b.file_id and n.prev_no = b.block_no) followed from v_block b
    where (b.file_id, b.block_no) not in (select (file_id, block_no) from v_unsupported)),
flat as (select b.file_id, b.block_no, b.bv, b.pv, b.tv, list(l.ls) filter (where l.ls is not null) gs
  from b left join v_group l on l.file_id = b.file_id and l.block_no = b.block_no group by all),
neg as (select file_id, block_no, bv, pv, tv, case when gs is null then [''] when len(gs) = 1 then gs[1] else [array_to_string(flatten(gs), ' ')] end ways from flat)
select file_id, block_no, '!' || bv || ' ' || pv clause from b where pv is not null
union all select g.file_id, g.block_no, '!B' || g.block_no || ' ' || array_to_string(g.ls, ' ') from v_group g
union all select file_id, block_no, '!' || bv || ' !' || tv from b where tv is not null
union all select file_id, block_no, concat_ws(' ', bv, '!' || pv, tv, w) from (
  select file_id, block_no, bv, pv, tv, unnest(list_transform(ways, lambda s: nullif(array_to_string(
    list_transform(list_filter(string_split(s, ' '), lambda x: x <> ''), lambda x: case when x like '!%' then ltrim(x, '!') else '!' || x end), ' '), ''))) w from neg)
union all select file_id, block_no, '!T' || block_no || ' ' || tv || ' ' || bv from b where followed and tv is not null
union all select file_id, block_no, 'T' || block_no || ' !' || tv from b where followed and tv is not null
union all select file_id, block_no, 'T' || block_no || ' !' || bv from b where followed and tv is not null""")

view("v_block_clause_lit", """
select distinct file_id, block_no, clause, ltrim(t, '!') var, t not like '!%' positive from (
  select file_id, block_no, array_to_string(list_sort(list_distinct(string_split(clause, ' '))), ' ') clause,
    unnest(string_split(clause, ' ')) t from v_block_clause)""")

view("v_code_closure", """recursive
select file_id, block_no, block_no member_no from v_block
union select c.file_id, c.block_no, e.dst from v_code_closure c join (
  select file_id, block_no src, parent_no dst from v_block where parent_no is not null
  union select file_id, block_no, prev_no from v_block where prev_no is not null) e on e.file_id = c.file_id and e.src = c.member_no""")

view("v_slice_lit", """
select c.file_id, c.block_no, l.clause, l.var, l.positive from v_code_closure c
join v_block_clause_lit l on l.file_id = c.file_id and l.block_no = c.member_no
union select file_id, block_no, 'B' || block_no, 'B' || block_no, true from v_block""")

view("v_slice_var", """
select file_id, block_no, var, row_number() over (partition by file_id, block_no order by var) - 1 bit
from (select distinct file_id, block_no, var from v_slice_lit)""")

view("v_slice_mask", """
select l.file_id, l.block_no, l.clause, sum(case when l.positive then 1 << v.bit::int else 0 end)::bigint pos,
  sum(case when l.positive then 0 else 1 << v.bit::int end)::bigint neg
from v_slice_lit l join v_slice_var v using (file_id, block_no, var) group by all""")

view("v_slice_model", """
with n as (select file_id, block_no, count(*) n from v_slice_var group by all),
a as (select file_id, block_no, unnest(range(1 << n::int)) mask from n)
select a.file_id, a.block_no, a.mask from a join v_slice_mask m using (file_id, block_no)
group by a.file_id, a.block_no, a.mask having bool_and((a.mask & m.pos) <> 0 or (~a.mask & m.neg) <> 0)""")

view("v_observed", """
with n as (select file_id, block_no, count(*) n from v_enabled group by all)
select b.file_id, b.block_no, case when n.n is null then 'never' when n.n = p.n then 'always' end state
from v_block b left join n using (file_id, block_no) left join n p on p.file_id = b.file_id and p.block_no = coalesce(b.parent_no, -1)
where (n.n is null or n.n = p.n) and (b.file_id, b.block_no) not in (select (file_id, block_no) from v_unsupported)""")

view("v_defect", """
select o.file_id, o.block_no, case o.state when 'never' then 'dead' else 'undead' end suffix, a.arch, a.specific_arch is not null is_global,
  case when b.kind = 'else' then 'missing' else 'kconfig' end kind
from v_observed o join v_block b using (file_id, block_no) join v_file_arch a using (file_id)""")

view("v_model_clause", """
select m.arch, m.symbol || ':' || m.clause_no clause, m.lit_symbol var, m.positive from v_model_literal m
union select distinct arch, symbol || ':' || clause_no, symbol, false from v_model_literal
union select arch, key || ':' || value, value, key = 'ALWAYS_ON' from v_model_meta""")
