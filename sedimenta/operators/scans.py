"""Reads over resolved relations: point gets, scans, ranked search, counts, index and blob joins."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.scalar import has_prefix


def get(rows: DataFrame, **key) -> DataFrame:
    """The rows whose key columns have these values; the predicates reach the file scan."""
    for name, value in key.items():
        rows = rows.filter(F.col(name) == F.lit(value))
    return rows


def scan_prefix(rows: DataFrame, prefix: bytes, key: str = "key") -> DataFrame:
    """Rows whose binary key starts with ``prefix``, as a key range."""
    return rows.filter(has_prefix(F.col(key), prefix))


def scan_where(rows: DataFrame, predicates: Iterable[Column]) -> DataFrame:
    for p in predicates:
        rows = rows.filter(p)
    return rows


def hot_search(history: DataFrame, needle: str, limit: int, tie: Column | None = None) -> DataFrame:
    """History whose URL or title contains ``needle`` whatever its case, by visits, then time, then key; top ``limit``."""
    low = needle.lower()
    found = history.filter(F.lower("url").contains(low) | F.lower("title").contains(low)) if low else history
    tie = F.col("url") if tie is None else tie
    return found.orderBy(F.desc("visit_count"), F.desc("ts_ms"), tie.asc()).limit(limit)


def url_contains(history: DataFrame, domain: str) -> DataFrame:
    """History of a domain to wipe: the text may stand anywhere in the URL, case matters."""
    return history.filter(F.col("url").contains(domain))


def without(rows: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys aren't among the deleted ones."""
    return rows.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def by_index(rows: DataFrame, index: DataFrame, *keys: str) -> DataFrame:
    """Rows that an index points to; entries without a row are dropped."""
    return rows.join(index.select(*keys).distinct(), list(keys), "left_semi")


def split_blobs(rows: DataFrame, threshold: int, key: str = "key", value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(rows with large values left out, (key, value) of the large ones)."""
    large = F.octet_length(value) > threshold
    inline = rows.withColumn("in_blob", large).withColumn(value, F.when(~large, F.col(value)))
    return inline, rows.filter(large).select(key, value)


def with_blobs(inline: DataFrame, blobs: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Rows with their large values put back."""
    held = blobs.select(F.col(key).alias("_blob_key"), F.col(value).alias("_blob"))
    out = inline.join(held, F.col("in_blob") & (F.col(key) == F.col("_blob_key")), "left")
    return out.select(*[F.coalesce("_blob", value).alias(value) if c == value else c for c in inline.columns if c != "in_blob"])


def live_blobs(blobs: DataFrame, current: DataFrame, *ids: str) -> DataFrame:
    """Blobs that the current version of their key still points to."""
    return blobs.join(current.select(*ids).distinct(), list(ids), "left_semi")


def stats(counts: dict[str, DataFrame], disk_bytes: int = 0) -> DataFrame:
    """One row: live rows of every table, their sum, disk use in whole MB, and 0 for memory."""
    parts = None
    for name, rows in counts.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        parts = one if parts is None else parts.unionByName(one)
    columns = [F.coalesce(F.sum(F.when(F.col("name") == n, F.col("n"))), F.lit(0)).alias(f"{n}_count") for n in counts]
    return parts.agg(*columns, F.sum("n").alias("total_count")).withColumns(
        {"disk_usage_mb": F.lit(disk_bytes // (1 << 20)).cast("long"), "memory_usage_mb": F.lit(0).cast("long")}
    )
