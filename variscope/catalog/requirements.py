"""Named queries: merged requirements of source locations."""

from pyspark.sql import functions as F

from variscope.catalog.base import query, view
from variscope.catalog.clauses import kept_slices
from variscope.operators import clauses as E, constraints as C, requirements as Q
from variscope.sources import text as S

view("v_located", r"""
select distinct file_id, block_no from (
  select l.file_id, l.line_no, min_by(b.block_no, (b.end_line - b.start_line) * 100000 + b.block_no) block_no
  from (select distinct f.file_id, cast(regexp_extract(line, '^(.*?):(\d+)', 2) as bigint) line_no
    from v_location_line join v_source_file f on f.path = regexp_extract(line, '^(.*?):(\d+)', 1)) l
  join v_block b on b.file_id = l.file_id and b.start_line < l.line_no and l.line_no < b.end_line group by l.file_id, l.line_no)""")

view("v_place", r"""
select a.addr, f.file_id, f.path, a.addr % 40 line_no from (select distinct addr from v_address) a join v_source_file f on f.file_id = a.addr % 1000""")

view("v_ran", r"""
select distinct file_id, block_no from (
  select l.file_id, l.line_no, min_by(b.block_no, (b.end_line - b.start_line) * 100000 + b.block_no) block_no
  from (select distinct file_id, line_no from v_place where path not like 'drivers/machinery%') l
  join v_block b on b.file_id = l.file_id and b.start_line < l.line_no and l.line_no < b.end_line group by l.file_id, l.line_no)""")


def merged_sql(located: str) -> str:
    return rf"""
with ok as (select file_id, block_no from {located} where (file_id, block_no) in (select (file_id, block_no) from v_slice_model)),
named as (select file_id, block_no, clause, case when positive then '' else '!' end
    || case when regexp_matches(var, '^[BT]\d+$') then 'F' || file_id || ':' else '' end || var l from v_slice_lit join ok using (file_id, block_no))
select distinct string_agg(l, ' || ' order by l) as clause from named group by file_id, block_no, clause
union select 'FILE_' || translate(path, '/-+:,', '_____') from v_source_file where file_id in (select file_id from {located})
union select case when list = 'white' then '' else '!' end || item from v_list_item"""


def block_slices(t, only=None):
    """(file_id, block_no, lits): each block's own clauses and the claim that it is active; with ``only`` of just these blocks."""
    claim = t.blocks.select(*Q.ID, F.array(C.yes(C.block_var(F.col("block_no")))).alias("lits"))
    if only is not None:
        return C.block_slices(t.blocks, t.blocks, None, None, only).unionByName(claim.join(only, Q.ID, "left_semi"))
    return t._keep("block_slices", lambda: C.block_slices(t.blocks, t.blocks, None).unionByName(claim))


def verdicts(t):
    keys, merged = kept_slices(t)
    return t._keep("verdicts", lambda: keys.join(E.satisfiable_slices(merged), "sid").select(*Q.ID, "verdict"))


def located(t):
    return t._keep("located", lambda: Q.located_blocks(S.locations(t.location_line), t.source_file, t.tree))


@query("located_blocks", "select file_id, block_no from v_located")
def _(t):
    return located(t)


@query("merge_requirements", merged_sql("v_located"))
def _(t):
    return Q.merge_requirements(located(t), block_slices(t, located(t)), verdicts(t), t.source_file, t.list_item)


@query("merge_left_out", "select file_id, block_no from v_located except select file_id, block_no from v_slice_model")
def _(t):
    return Q.left_out(located(t), verdicts(t))


@query("location_configuration", """
with b as (select file_id, block_no, mask from (
  select *, row_number() over (partition by file_id, block_no order by bit_count(mask), mask) i from v_slice_model join v_located using (file_id, block_no)) where i = 1)
select file_id, block_no, var as symbol, case when (mask >> bit::int) & 1 = 1 then 'y' else 'n' end as value
from b join v_slice_var using (file_id, block_no) where var like 'CONFIG%'""")
def _(t):
    keys, merged = kept_slices(t)
    none = t.blocks.select(*Q.ID, F.lit("").alias("symbol")).filter(F.lit(False))
    return Q.location_configuration(located(t), keys, merged, none)


@query("tailored_configuration", merged_sql("v_ran"))
def _(t):
    places = t.addresses.select("addr").distinct().withColumn("file_id", F.col("addr") % 1000).join(t.source_file, "file_id").select("addr", "path", (F.col("addr") % 40).alias("line_no"))
    ignored = t.spark.createDataFrame([("^drivers/machinery",)], "pattern string")
    return Q.tailored_configuration(t.addresses, places, ignored, t.source_file, t.tree, block_slices(t), verdicts(t), t.list_item)
