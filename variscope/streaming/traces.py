"""Traces as streams: first sightings, module lookup, growth per window, keys that settle, late rows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from variscope.operators.traces import module_offsets, trace_addresses
from variscope.session import scratch_dir

#: State store that keyed processors with timers need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A folder of event files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_seen(events: DataFrame, delay: str | None = None) -> DataFrame:
    """Addresses at their first occurrence.

    Without ``delay`` every address is remembered (exact, state grows with the number of
    addresses); with it only those within the watermark are.
    """
    rows = trace_addresses(events).withColumn("ts", F.col("ts").cast("timestamp"))
    if delay is None:
        return rows.dropDuplicates(["addr"])
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["addr"])


def growth(events: DataFrame, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """New addresses per window, given out when the watermark passes the window's end."""
    seen = first_seen(events, delay)
    return seen.groupBy(F.window("ts", size).alias("w")).agg(F.count(F.lit(1)).alias("n_new")).select(F.col("w.start").alias("start"), "n_new")


def module_lookup(events: DataFrame, modules: Callable[[], DataFrame], folder: str) -> DataFrame:
    """Module and offset of every address at its first occurrence, for what a stream has now.

    Each micro-batch calls ``modules`` anew, so modules loaded while the trace runs are known from the next batch on, and
    writes a folder of its own, which a repeated batch overwrites. State and results are kept in ``folder``: a
    later call with the same folder goes on where this one ended, and returns the results of all calls.
    """

    def batch(rows: DataFrame, number: int) -> None:
        module_offsets(rows, modules()).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    new = first_seen(events).select("addr")
    query = new.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return events.sparkSession.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out")


class _Settling(StatefulProcessor):
    """Gives out a key when ``quiet`` milliseconds pass in which it got nothing new.

    The state of a key is its latest time and one timer. Times of a micro-batch are taken in order; a pause found
    among them counts like one that a timer ends.
    """

    def __init__(self, quiet: int) -> None:
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (Spark's names)
        last = self.last.get()[0] if self.last.exists() else None
        settled = []
        for at in sorted(int(x) for pdf in rows for x in pdf["ms"]):
            if last is not None and at - last > self.quiet:
                settled.append(last)
            last = at if last is None else max(at, last)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update((last,))
        self.handle.registerTimer(last + self.quiet)
        yield self._rows(key, settled)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get()[0]
        self.last.clear()
        yield self._rows(key, [last])

    @staticmethod
    def _rows(key, times: list[int]) -> pd.DataFrame:
        """Plain object and integer columns, whatever pandas would infer."""
        return pd.DataFrame({"key": pd.Series([key[0]] * len(times), dtype=object), "last_ms": pd.Series(times, dtype="int64")})


def settled_keys(events: DataFrame, key: str = "func", quiet: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """(key, last_ms): keys whose addresses don't grow any more, with the time of their last new one.

    A key comes again after each further pause of more than ``quiet``; a pause at the end counts when the watermark
    has passed it. Needs the state store ROCKSDB, which ``run_to_table`` sets.
    """
    length = int(pd.Timedelta(quiet).total_seconds() * 1000)
    rows = events.select(F.col(key).alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.explode(F.array(F.col("addr") - F.col("off"), F.col("caller_addr"))).alias("addr"))
    new = rows.withWatermark("ts", delay).dropDuplicates(["key", "addr"]).select("key", "ts", F.unix_millis("ts").alias("ms"))
    return new.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_Settling(length), outputStructType="key string, last_ms bigint", outputMode="append", timeMode="eventTime")


def on_time(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Events that aren't behind the watermark: a state operator drops the others and counts them."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def run_with_drops(stream: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, drops): result of a stream, and (batch, n_dropped) as its state operators report them.

    Nothing is worked out again: the counts are read from the progress of the query, one row for each micro-batch.
    """
    spark = stream.sparkSession
    with _setting(spark, "spark.sql.streaming.numRecentProgressUpdates", "100000"):
        rows, query = _run(stream, "append")
        steps = [p if isinstance(p, dict) else json.loads(p.json) for p in query.recentProgress]
    found = [(int(p["batchId"]), sum(int(o["numRowsDroppedByWatermark"]) for o in p["stateOperators"])) for p in steps]
    return rows, spark.createDataFrame(found or [], "batch bigint, n_dropped bigint").groupBy("batch").agg(F.max("n_dropped").alias("n_dropped"))


@contextmanager
def _setting(spark: SparkSession, name: str, value: str):
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process what is available now into a table of the shared folder and read that."""
    with _setting(stream.sparkSession, "spark.sql.streaming.stateStore.providerClass", ROCKSDB):
        return _run(stream, mode)[0]


def _run(stream: DataFrame, mode: str):
    spark = stream.sparkSession
    base = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out"), query
