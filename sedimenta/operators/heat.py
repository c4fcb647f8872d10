"""Access heat of keys and of segments, and what to evict."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions.scalar import SATURATED, heat_now, heat_shard

# Heat of one access
WEIGHTS = {"read": 1, "write": 2, "delete": 3, "compact": 4}


def by_key(log: DataFrame) -> DataFrame:
    """Heat (saturating), accesses, first and last time of every key of ``log(k, weight, ts_s)``."""
    return log.groupBy("k").agg(
        F.least(F.sum("weight"), F.lit(SATURATED)).alias("heat"), F.count("*").alias("accesses"), F.min("ts_s").alias("first_s"), F.max("ts_s").alias("last_s")
    )


def decayed(heat: DataFrame, now_s: int) -> DataFrame:
    return heat.withColumn("heat_now", heat_now(F.col("heat"), F.lit(now_s) - F.col("last_s")))


def evicted(heat: DataFrame, surplus: int | None = None, threshold: int = 10, shards: int = 32, capacity: int | None = None) -> DataFrame:
    """Of the coldest keys of each shard, those colder than ``threshold``.

    Either ``surplus`` keys of each shard are looked at, or as many as a shard holds over its ``capacity``.
    """
    order = Window.partitionBy("shard").orderBy("heat", "k")
    rows = heat.withColumn("shard", heat_shard(F.col("k").cast("string"), shards)).withColumn("rank", F.row_number().over(order))
    most = F.lit(surplus)
    if capacity is not None:
        rows = rows.join(F.broadcast(rows.groupBy("shard").agg(F.count("*").alias("held"))), "shard")  # a row a shard
        most = F.col("held") - capacity
    return rows.filter((F.col("rank") <= most) & (F.col("heat") < threshold))


def of_segments(entries: DataFrame, heat: DataFrame) -> DataFrame:
    """Mean heat (rounded down) of every segment of ``entries(segment, k)``; unseen keys count 0."""
    joined = entries.select("segment", "k").join(heat.select("k", "heat"), "k", "left")
    return joined.groupBy("segment").agg(F.floor(F.sum(F.coalesce("heat", F.lit(0))) / F.greatest(F.count("*"), F.lit(1))).cast("long").alias("heat"))


def coldest_first(segments: DataFrame) -> DataFrame:
    """``segments(segment, heat)`` in the order in which they are compacted."""
    return segments.orderBy("heat", "segment")


class HeatMap:
    """Heat of the keys a driver touches one by one; at most ``max_entries`` keys are held.

    When a shard is over its share, its coldest keys go, if they are colder than the hot threshold; a shard full
    of hot keys takes no new ones.
    """

    SHARDS = 32

    def __init__(self, config):
        self._config = config
        self._most = max(1, config.max_entries // self.SHARDS)
        self._shards: list[dict[tuple, list[int]]] = [{} for _ in range(self.SHARDS)]

    def _shard(self, key: tuple) -> dict[tuple, list[int]]:
        return self._shards[sum(repr(key).encode()) % self.SHARDS]

    def record(self, key: tuple, kind: str, now_s: int) -> None:
        """One access; ``kind`` is read, write, delete or compact."""
        shard = self._shard(key)
        seen = shard.get(key)
        if seen is None:
            if len(shard) >= self._most:
                for cold in sorted(shard, key=lambda k: (shard[k][0], repr(k)))[: len(shard) - self._most + 1]:
                    if shard[cold][0] < self._config.hot_threshold:
                        del shard[cold]
                if len(shard) >= self._most:
                    return
            shard[key] = [WEIGHTS[kind], 1, now_s, now_s]
            return
        seen[0] = min(seen[0] + WEIGHTS[kind], SATURATED)
        seen[1] += 1
        seen[3] = now_s

    def heat(self, key: tuple, now_s: int) -> int:
        """Heat after decay by whole minutes; 0 for a key that isn't held."""
        seen = self._shard(key).get(key)
        if seen is None:
            return 0
        minutes = (now_s - seen[3]) // 60
        return int(seen[0] * self._config.decay_factor**minutes) if minutes >= 1 else seen[0]

    def __len__(self) -> int:
        return sum(map(len, self._shards))
