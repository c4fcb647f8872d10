"""Streaming queries over the fixture log, with the batch answer as their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions.scalar import is_live
from sedimenta.sources import fixtures as X
from sedimenta.sources.fixtures import NOW_MS, sql
from sedimenta.sources.logstore import working_dir
from sedimenta.streaming import ingest


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of mutations."""
    path = f"{sf_dir}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 4)
    is_file = spark.read.parquet(path).select(F.input_file_name().alias("f")).first().f.rstrip("/").endswith("/events.parquet")
    return X.mutations_of(events.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if is_file else events.parquet(path))


def _run(spark: SparkSession, view: DataFrame) -> DataFrame:
    folder = working_dir(spark, "stream")
    return ingest.run_once(view, f"{folder}/rows", f"{folder}/checkpoint")


def stream_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, ingest.counters(_stream(spark, sf_dir)))


def stream_ingest_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _run(spark, ingest.newest_values(_stream(spark, sf_dir)))
    return rows.filter(F.col("op") != "del").filter(is_live(F.col("expires_at"), NOW_MS)).select("k", "value", "seq")


QUERIES = {"stream_counter": stream_counter, "stream_ingest_latest": stream_ingest_latest}
ORACLE_SQL = {
    "stream_counter": sql("SELECT k, CAST(sum(val) AS BIGINT) AS total, count(*) AS n FROM mutation_log WHERE op = 'inc' GROUP BY k"),
    "stream_ingest_latest": sql(
        f"SELECT k, val AS value, seq FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) r FROM mutation_log WHERE op <> 'inc') "
        f"WHERE r = 1 AND op <> 'del' AND (expires_at = 0 OR expires_at >= {NOW_MS})"
    ),
}
