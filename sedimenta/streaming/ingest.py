"""Continuous ingest and stateful views with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from sedimenta.functions.scalar import wrapping_sum


def source_of(spark: SparkSession, path: str, ddl: str, max_files: int = 64) -> DataFrame:
    """A folder of Parquet files as a stream of at most ``max_files`` files a micro-batch, which is its backpressure."""
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", max_files).parquet(path)


def append_to(log, checkpoint: str, source: DataFrame, prepare: Callable[[DataFrame], DataFrame] | None = None, once: bool = True) -> StreamingQuery:
    """Append a stream to a table's log, one commit a micro-batch, each exactly once.

    ``source`` has the log's columns without batch, or ``prepare`` makes them.  ``once`` stops when everything
    that is there has been read; otherwise the stream runs on.  A commit carries the stream's name (its
    checkpoint) and the number of the micro-batch, so one that is retried after a failure isn't written again.
    """

    def commit(rows: DataFrame, epoch: int) -> None:
        rows = prepare(rows) if prepare else rows
        if not rows.isEmpty():
            log.append(rows, source=(checkpoint, epoch))

    writer = source.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def counters(log: DataFrame, key: str = "k", delta: str = "val") -> DataFrame:
    """Running sums of increments for each key (use with output mode ``update`` or ``complete``)."""
    return log.filter(F.col("op") == "inc").groupBy(key).agg(wrapping_sum(F.col(delta)).alias("total"), F.count("*").alias("n"))


def newest_values(log: DataFrame, key: str = "k", value: str = "val") -> DataFrame:
    """Running newest write of each key: its value, op and expiry, by ``seq``."""
    last = F.max(F.struct("seq", "op", F.col(value).alias("value"), "expires_at"))
    return log.filter(F.col("op") != "inc").groupBy(key).agg(last.alias("last")).select(key, "last.*")


def expiring_values(log: DataFrame, key: str = "k", value: str = "val", delay: str = "0 seconds") -> DataFrame:
    """Changes of the live rows as a stream: ``key, value, live`` (update mode); state is given back when it expires.

    ``log`` has ``key``, ``value``, ``op``, ``ts_ms`` and ``expires_at``.  Event time is ``ts_ms``: once it has
    passed a row's ``expires_at``, the row is reported as not live and its state goes; a delete does so at once.
    """
    import pandas as pd

    timed = log.filter(F.col("op") != "inc").select(
        F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"), "op", "ts_ms", "expires_at", F.timestamp_millis("ts_ms").alias("at")
    )

    def update(names: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            gone = state.get[0]
            state.remove()
            yield pd.DataFrame({"key": [names[0]], "value": [gone], "live": [False]})
            return
        last = state.get if state.exists else None  # value, ts_ms, expires_at
        op = "put"
        for frame in frames:
            for r in frame.sort_values("ts_ms", kind="stable").itertuples():
                if last is None or r.ts_ms >= last[1]:
                    last, op = (r.value, int(r.ts_ms), int(r.expires_at)), r.op
        if op == "del":
            if state.exists:
                state.remove()
            yield pd.DataFrame({"key": [names[0]], "value": [None], "live": [False]})
            return
        now = state.getCurrentWatermarkMs()
        if last[2] and last[2] < now:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"key": [names[0]], "value": [last[0]], "live": [False]})
            return
        state.update(last)
        if last[2]:
            state.setTimeoutTimestamp(last[2] + 1)
        yield pd.DataFrame({"key": [names[0]], "value": [last[0]], "live": [True]})

    return timed.withWatermark("at", delay).groupBy("key").applyInPandasWithState(
        update, "key string, value string, live boolean", "value string, ts_ms long, expires_at long", "update", "EventTimeTimeout"
    )


def run_once(view: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stateful view over everything that is there; its result is kept as Parquet under ``path``, never on the driver."""

    def keep(rows: DataFrame, _: int) -> None:
        rows.write.mode("overwrite").parquet(path)

    view.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return view.sparkSession.read.schema(view.schema).parquet(path)
