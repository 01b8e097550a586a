"""Traces as streams: restarts, modules that appear while the trace runs, keys that settle, dropped rows."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from variscope.streaming import traces as ST

EVENT = "event_id long, ts timestamp, func string, addr long, off long, caller_addr long"
START = datetime(2024, 1, 1)


def event(i, minutes, func, addr, caller=0):
    return (i, START + timedelta(minutes=minutes), func, addr, 0, caller)


def put(spark, folder, rows):
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(folder)


def schema_of(spark):
    return spark.createDataFrame([], EVENT).schema


def test_lookup_goes_on_after_a_restart_and_knows_new_modules(spark, tmp_path):
    source, modules, folder = (f"{tmp_path}/{n}" for n in ("events", "modules", "lookup"))
    table = lambda rows: spark.createDataFrame(rows, "name string, base long, size long").write.mode("overwrite").parquet(modules)
    table([("a", 100, 50)])
    put(spark, source, [event(0, 0, "f", 110, 500), event(1, 1, "f", 150, 110)])
    run = lambda: {tuple(r) for r in ST.module_lookup(ST.event_stream(spark, source, schema_of(spark)), lambda: spark.read.parquet(modules), folder).select("addr", "module", "module_off").collect()}
    first = {(110, "a", 10), (150, "a", 50), (500, None, None)}
    assert run() == first
    table([("a", 100, 50), ("b", 600, 10)])
    put(spark, source, [event(2, 2, "f", 605, 110), event(3, 3, "f", 500, 151)])
    assert run() == first | {(605, "b", 5), (151, None, None)}
    assert run() == first | {(605, "b", 5), (151, None, None)}


def test_keys_settle_when_nothing_new_comes(spark, tmp_path):
    """A known address is nothing new; a pause ends by a new address, or by the watermark."""
    source = f"{tmp_path}/events"
    put(spark, source, [event(0, 0, "f", 1, 2), event(1, 10, "f", 1, 2), event(2, 45, "f", 3, 1), event(3, 0, "g", 7, 7), event(4, 20, "g", 8, 7)])
    put(spark, source, [event(5, 50, "f", 4, 1), event(6, 200, "h", 9, 9)])
    got = {(r["key"], r["last_ms"]) for r in ST.run_to_table(ST.settled_keys(ST.event_stream(spark, source, schema_of(spark)))).collect()}
    at = lambda m: int((START + timedelta(minutes=m) - datetime(1970, 1, 1)).total_seconds() * 1000)
    assert got == {("f", at(0)), ("f", at(50)), ("g", at(20))}


def test_dropped_rows_are_observed(spark, tmp_path):
    source = f"{tmp_path}/events"
    for batch in ([event(0, 0, "f", 1)], [event(1, 100, "f", 1)], [event(2, 200, "f", 1), event(3, 95, "f", 1)], [event(4, 80, "f", 1), event(5, 89, "f", 1), event(6, 91, "f", 1)]):
        put(spark, source, batch)
    rows, drops = ST.run_with_drops(ST.on_time(ST.event_stream(spark, source, schema_of(spark))))
    assert {r["event_id"] for r in rows.collect()} == {0, 1, 2, 3, 6}
    assert {(r["batch"], r["n_dropped"]) for r in drops.filter("n_dropped > 0").collect()} == {(3, 2)}
    from variscope.operators.traces import late_by_batch

    twin = spark.createDataFrame([(0, 0, 0), (1, 100, 1), (2, 200, 2), (3, 95, 2), (4, 80, 3), (5, 89, 3), (6, 91, 3)], "event_id long, m long, batch long")
    twin = twin.withColumn("ts", F.timestamp_millis(F.col("m") * 60_000 + F.unix_millis(F.lit(START))))
    assert {r["event_id"] for r in late_by_batch(twin).collect()} == {4, 5}
