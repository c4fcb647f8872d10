"""Segment metadata, compaction planning, purging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MB = 1 << 20
LEVEL_MB = (10, 100, 1000, 10_000, 100_000, 1_000_000)


def segment_stats(entries: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Entries, key bytes and largest entry of every segment of ``entries(segment, key, value)``."""
    size = F.octet_length(key) + F.octet_length(value) + 17
    return entries.groupBy("segment").agg(
        F.count("*").alias("entry_count"), F.sum(F.octet_length(key)).cast("long").alias("total_key_size"), F.max(size).cast("long").alias("max_entry_size")
    )


def level_sizes(segments: DataFrame) -> DataFrame:
    """Files and bytes of every level of ``segments(level, bytes)``."""
    return segments.groupBy("level").agg(F.count("*").alias("files"), F.sum("bytes").cast("long").alias("bytes"))


def level_threshold(level: Column, sizes_mb: tuple[int, ...] = LEVEL_MB, scale: float = 1.0) -> Column:
    """Bytes over which a level is compacted; levels beyond the list use its last entry."""
    limits = [int(s * MB * scale) for s in sizes_mb]
    return F.coalesce(F.get(F.array(*[F.lit(x).cast("long") for x in limits]), level - 1), F.lit(limits[-1]).cast("long"))


def compaction_candidates(segments: DataFrame, max_level0_files: int = 4, sizes_mb: tuple[int, ...] = LEVEL_MB, scale: float = 1.0) -> DataFrame:
    """Levels to compact: level 0 by its number of files, deeper ones by their bytes."""
    sizes = level_sizes(segments)
    due = F.when(F.col("level") == 0, F.col("files") >= max_level0_files).otherwise(F.col("bytes") > level_threshold(F.col("level"), sizes_mb, scale))
    return sizes.filter(due)


LAST_LEVEL = 9


def level_due(level: int, files: int, size: int, max_level0_files: int = 4, sizes_mb: tuple[int, ...] = LEVEL_MB) -> bool:
    """The same rule for one level's numbers."""
    if level == 0:
        return files >= max_level0_files
    return size > sizes_mb[min(level, len(sizes_mb)) - 1] * MB
