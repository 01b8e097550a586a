"""Named queries: traces as streams, each beside a statement on the tables."""

import uuid

from pyspark.sql import functions as F

from variscope.catalog.base import query, view
from variscope.session import scratch_dir
from variscope.sources import projections as P
from variscope.streaming import traces as ST

#: Files that a trace comes in, a micro-batch each; every LATE-th event comes DELAYED files later.
FILES, LATE, DELAYED = 8, 7, 3


def arrivals(t, late):
    """(folder, schema) of the trace as FILES files in order of arrival, written one after the other."""

    kept = t.__dict__.setdefault("_arrivals", {})
    if late not in kept:
        n = t.trace_event.agg(F.max("event_id")).first()[0] + 1
        more = F.when(F.col("event_id") % LATE == 0, DELAYED).otherwise(0) if late else F.lit(0)
        rows = t.trace_event.withColumn("batch", F.least(F.floor(F.col("event_id") * FILES / F.lit(n)) + more, F.lit(FILES - 1)).cast("bigint"))
        path = f"{scratch_dir(t.spark)}/arrivals-{uuid.uuid4().hex}"
        for i in range(FILES):
            rows.filter(F.col("batch") == i).coalesce(1).sortWithinPartitions("event_id").write.mode("append").parquet(path)
        kept[late] = path, rows.schema
    return kept[late]


def stream(t, late=False):
    return ST.event_stream(t.spark, *arrivals(t, late))


@query("module_offsets_stream", "select addr, module, module_off from v_offset")
def _(t):
    """Modules are read from the table again for each micro-batch."""
    folder = f"{scratch_dir(t.spark)}/lookup-{uuid.uuid4().hex}"
    return ST.module_lookup(stream(t), lambda: P.module(t.spark, t.sf), folder).select("addr", "module", "module_off")


@query("trace_settled_stream", """
with a as (select e.func, d.addr, min(epoch_us(e.ts) // 1000) ms from v_address d join v_trace_event e using (event_id) group by all),
g as (select func, ms, lead(ms) over (partition by func order by ms) n from a)
select func as key, ms as last_ms from g
where n - ms > 1800000 or (n is null and ms + 1800000 <= (select max(epoch_us(ts) // 1000) from v_trace_event) - 600000)""")
def _(t):
    return ST.run_to_table(ST.settled_keys(stream(t)))


view("v_arrival", f"""
select event_id, ts, least(event_id * {FILES} // ((select max(event_id) from v_trace_event) + 1) + case when event_id % {LATE} = 0 then {DELAYED} else 0 end, {FILES - 1}) batch
from v_trace_event""")
view("v_late", """
select a.event_id, a.ts, a.batch from v_arrival a
where a.ts <= (select max(ts) from v_arrival b where b.batch <= a.batch - 2) - interval 10 minutes""")


@query("late_events_stream", "select event_id from v_late")
def _(t):
    """Events that the running stream dropped: those it was given and did not give out."""
    given, _ = ST.run_with_drops(ST.on_time(stream(t, late=True)))
    return t.trace_event.select("event_id").join(given.select("event_id"), "event_id", "left_anti")


@query("late_events_dropped", "select batch, count(*) n_dropped from v_late group by batch")
def _(t):
    """Rows dropped in each micro-batch, as its state operators report."""
    return ST.run_with_drops(ST.on_time(stream(t, late=True)))[1].filter("n_dropped > 0")


@query("late_events_by_batch", "select event_id, ts, batch from v_late")
def _(t):
    from variscope.operators.traces import late_by_batch

    path, schema = arrivals(t, True)
    rows = t.spark.read.schema(schema).parquet(path)
    return late_by_batch(rows).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
