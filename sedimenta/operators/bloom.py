"""A Bloom filter as a relation of bitmap pages: built and asked by joins, so it may be as large as it must."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_BITS = 32768  # of a page as the built-in bitmap functions lay it out


def shape(n: int, false_positives: float) -> tuple[int, int]:
    """(bits, hash functions) for ``n`` keys."""
    bits = max(PAGE_BITS, math.floor(-n * math.log(false_positives) / math.log(2) ** 2))
    return bits, max(1, math.floor(bits / max(1, n) * math.log(2)))


def _bits(key: Column, bits: int, hashes: int) -> Column:
    """The bit numbers of a key, by double hashing."""
    first, second = F.xxhash64(key), F.xxhash64(key, F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(F.shiftrightunsigned(first, 2) + i * F.shiftrightunsigned(second, 8), F.lit(bits).cast("long")))


def built(keys: DataFrame, key: str, bits: int, hashes: int) -> DataFrame:
    """``page, bitmap`` of the filter over column ``key``; null keys aren't in it.  At most ``bits / 32768`` rows."""
    at = keys.filter(F.col(key).isNotNull()).select(F.explode(_bits(F.col(key), bits, hashes)).alias("bit"))
    at = at.select(F.expr(f"bit div {PAGE_BITS}").alias("page"), (F.col("bit") % PAGE_BITS).alias("at"))
    return at.groupBy("page").agg(F.bitmap_construct_agg("at").alias("bitmap"))


def may_contain(probes: DataFrame, key: str, pages: DataFrame, bits: int, hashes: int) -> DataFrame:
    """Those rows of ``probes`` whose key may be in the filter: all that are in it, and few others."""
    asked = probes.filter(F.col(key).isNotNull()).select(key).distinct().select(key, F.explode(_bits(F.col(key), bits, hashes)).alias("bit"))
    asked = asked.select(key, F.expr(f"bit div {PAGE_BITS}").alias("page"), (F.col("bit") % PAGE_BITS).alias("at"))
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), F.expr("cast(at div 8 as int) + 1"), F.lit(1))), 16, 10).cast("int")
    is_set = F.expr("shiftright(byte, cast(at % 8 as int)) & 1") == 1
    found = asked.join(pages, "page", "left").withColumn("byte", F.coalesce(byte, F.lit(0)))
    passing = found.groupBy(key).agg(F.bool_and(is_set).alias("passes")).filter("passes").select(key)
    return probes.join(passing, key, "left_semi")
