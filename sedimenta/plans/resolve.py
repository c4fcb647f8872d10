"""Version resolution: from an append-only mutation log to the live row of every key.

A log row has key columns, ``op`` (put, del, inc), ``ts_ms``, ``expires_at`` and a total order ``seq`` (any
orderable column).  Filters on key columns may be pushed below resolution; filters on values must stay above
it, because a row that fails them still hides older versions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions.scalar import is_live, wrapped


def newest(log: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """The newest row of every key, tombstones included.

    The rank limit is planned before the exchange as well as after it, so a hot key sends one row a task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(seq).desc()))
    return log.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def resolve_latest(log: DataFrame, keys: Sequence[str], now_ms: int | None = None, seq: str = "seq") -> DataFrame:
    """Live rows of a log without counters: the newest wins, tombstones and expired rows hide their key."""
    rows = newest(log, keys, seq).filter(F.col("op") != "del")
    return rows if now_ms is None else rows.filter(is_live(F.col("expires_at"), now_ms))


def fold_counters(log: DataFrame, keys: Sequence[str], value: Column, delta: Column, seq: str = "seq") -> DataFrame:
    """Per key: ``value`` (base plus newer increments, wrapping), ``base_op``, ``last_op``, ``last_seq``, ``expires_at``.

    The base is the newest row that isn't an increment.  Bases are aggregated first and joined back, so that
    both steps combine before their exchange and a hot key is split like any skewed join.
    """
    own = [F.col(k).alias(f"_base_{k}") for k in keys]
    bases = log.filter(F.col("op") != "inc").groupBy(*keys).agg(F.max(seq).alias("_base"), F.max_by("op", seq).alias("_op"))
    bases = bases.select(*own, "_base", "_op")
    on = [F.col(k).eqNullSafe(F.col(f"_base_{k}")) for k in keys]
    rows = log.withColumns({"_value": value, "_delta": delta}).join(bases, on, "left")
    rows = rows.filter(F.col("_base").isNull() | (F.col(seq) >= F.col("_base")))
    part = F.when(F.col("op") == "inc", F.col("_delta")).otherwise(F.coalesce(F.col("_value"), F.lit(0)))
    return rows.groupBy(*keys).agg(
        wrapped(F.sum(part.cast("decimal(38,0)"))).alias("value"),
        F.coalesce(F.max("_op"), F.lit("inc")).alias("base_op"),
        F.max_by("op", seq).alias("last_op"),
        F.max_by("expires_at", seq).alias("expires_at"),
        F.max(seq).alias("last_seq"),
    )


def resolve_counters(log: DataFrame, keys: Sequence[str], value: Column, delta: Column, now_ms: int | None = None, seq: str = "seq") -> DataFrame:
    """Live counters: an increment over a tombstone starts from 0, and the newest row's expiry counts."""
    rows = fold_counters(log, keys, value, delta, seq).filter(F.col("last_op") != "del")
    return rows if now_ms is None else rows.filter(is_live(F.col("expires_at"), now_ms))


def committed(log: DataFrame, commits: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Rows of batches that were committed; an unfinished batch is as if never written."""
    return log.join(commits.select(batch).distinct(), batch, "left_semi")


def merged_runs(*runs: DataFrame) -> DataFrame:
    """One log from several runs; a row written twice (same ``seq``) counts once."""
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run)
    return out.dropDuplicates(["seq"])


def compacted(log: DataFrame, keys: Sequence[str], value: Column, delta: Column, final: bool, now_ms: int | None = None, seq: str = "seq") -> DataFrame:
    """A run that says the same as ``log``: one row a key.

    Below the last level tombstones stay, pure increments stay increments (their base lies deeper), and
    expired rows stay, because they hide older versions.  At the last level tombstones and expired rows go,
    and increments become plain values.
    """
    rows = fold_counters(log, keys, value, delta, seq)
    op = F.when(F.col("last_op") == "del", "del").when((F.col("base_op") == "inc") & F.lit(not final), "inc").otherwise("put")
    rows = rows.select(*keys, op.alias("op"), F.when(F.col("last_op") != "del", F.col("value")).alias("value"), "expires_at", F.col("last_seq").alias(seq))
    if not final:
        return rows
    rows = rows.filter(F.col("op") != "del")
    return rows if now_ms is None else rows.filter(is_live(F.col("expires_at"), now_ms))
