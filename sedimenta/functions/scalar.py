"""Scalar expressions, all built from JVM-side functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 128-bit FNV-1a offset basis in 32-bit limbs (low to high) and the prime 2**88 + 315
FNV_BASIS = (0x6295C58D, 0x62B82175, 0x07BB0142, 0x6C62272E)
FNV_PRIME_LOW = 315
LIMB = 0xFFFFFFFF

# Bits of a cookie's flags
SECURE, HTTP_ONLY = 1, 2

SATURATED = 4294967295  # unsigned 32-bit


def bytes_of(value: Column) -> Column:
    """The bytes of a binary or string column as an array of numbers."""
    raw = value.cast("binary")
    byte = lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("long")
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(raw), F.lit(1))), byte)
    return F.when(F.octet_length(raw) > 0, every).otherwise(F.array().cast("array<bigint>"))


def fnv1a128(value: Column) -> Column:
    """128-bit FNV-1a of a string's UTF-8 bytes, as 32 lower-case hex digits."""
    start = F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip("abcd", FNV_BASIS)])

    def step(s: Column, x: Column) -> Column:
        a = s["a"].bitwiseXOR(x)
        high = lambda v: F.shiftright(v, 32)
        lift = lambda v: F.shiftleft(v, 24).bitwiseAND(LIMB)
        t0 = a * FNV_PRIME_LOW
        t1 = s["b"] * FNV_PRIME_LOW + high(t0)
        t2 = s["c"] * FNV_PRIME_LOW + high(t1) + lift(a)
        t3 = s["d"] * FNV_PRIME_LOW + high(t2) + F.shiftright(a, 8) + lift(s["b"])
        return F.struct(*[t.bitwiseAND(LIMB).alias(n) for n, t in zip("abcd", (t0, t1, t2, t3))])

    text = lambda s: F.lower(F.concat(*[F.lpad(F.hex(s[n]), 8, "0") for n in "dcba"]))
    return F.aggregate(bytes_of(value), start, step, text)


def hash_from_halves(low: Column, high: Column) -> Column:
    """A 128-bit hash from two signed 64-bit halves, as 32 hex digits."""
    return F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def container_slot(name: Column) -> Column:
    """The name's hash mod 16."""
    return F.conv(F.substring(fnv1a128(name), 32, 1), 16, 10).cast("int")


def little_endian(hash_hex: Column) -> Column:
    """The 16 key bytes of a hash, lowest first; binary columns order by unsigned bytes."""
    pairs = F.transform(F.sequence(F.lit(15), F.lit(0)), lambda i: F.substring(hash_hex, i * 2 + 1, F.lit(2)))
    return F.unhex(F.array_join(pairs, ""))


def _reversed_bytes(number: Column, digits: int) -> Column:
    """A non-negative number as ``digits`` hex digits, lowest byte first."""
    padded = F.lpad(F.hex(number), digits, "0")
    return F.array_join(F.transform(F.sequence(F.lit(digits // 2 - 1), F.lit(0)), lambda i: F.substring(padded, i * 2 + 1, F.lit(2))), "")


def blob_pointer(offset: Column, size: Column) -> Column:
    """The twelve bytes of a pointer into the blobs: offset (64 bits) and size (32 bits), lowest byte first."""
    return F.unhex(F.concat(_reversed_bytes(offset.cast("long"), 16), _reversed_bytes(size.cast("long"), 8)))


def read_blob_pointer(pointer: Column) -> Column:
    """``struct<offset, size>`` of a pointer; null if it has fewer than twelve bytes."""

    def number(start: int, n: int) -> Column:
        digits = F.hex(F.substring(pointer, start, n))
        pairs = F.transform(F.sequence(F.lit(n - 1), F.lit(0)), lambda i: F.substring(digits, i * 2 + 1, F.lit(2)))
        return F.conv(F.array_join(pairs, ""), 16, -10).cast("long")

    return F.when(F.octet_length(pointer) >= 12, F.struct(number(1, 8).alias("offset"), number(9, 4).alias("size")))


def length_prefixed(text: Column) -> Column:
    """A string as the bytes of its length (64 bits, lowest first) and its UTF-8 bytes."""
    length = F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0")
    pairs = F.transform(F.sequence(F.lit(7), F.lit(0)), lambda i: F.substring(length, i * 2 + 1, F.lit(2)))
    return F.concat(F.unhex(F.array_join(pairs, "")), text.cast("binary"))


def key_prefix(key: Column) -> Column:
    """The bytes up to and including the first colon, else the first eight bytes; a binary value."""
    raw = key.cast("binary")
    # a byte below 128 is a character of its own in UTF-8, so the colon's place is counted in bytes
    at = F.length(F.substring_index(F.decode(raw, "ISO-8859-1"), ":", 1)) + 1
    return F.when(at <= F.octet_length(raw), F.substring(raw, F.lit(1), at)).otherwise(F.substring(raw, 1, 8))


def shard_of_key(key: Column, shards: int = 16) -> Column:
    """First byte of the key mod ``shards``; 0 for an empty key."""
    first = F.conv(F.hex(F.substring(key.cast("binary"), 1, 1)), 16, 10).cast("int")
    return F.when(F.octet_length(key) > 0, first % shards).otherwise(F.lit(0))


def heat_shard(key: Column, shards: int = 32) -> Column:
    """Sum of the key's bytes mod ``shards``."""
    return (F.aggregate(bytes_of(key), F.lit(0).cast("long"), lambda s, x: s + x) % shards).cast("int")


def entry_size(key: Column, value: Column) -> Column:
    """Bytes that an entry counts for: key, value and 17 of overhead."""
    return F.octet_length(key) + F.octet_length(value) + 17


def wrapped(total: Column) -> Column:
    """A decimal total as a signed 64-bit number that wraps around."""
    modulus = F.lit("18446744073709551616").cast("decimal(38,0)")
    low = F.pmod(total.cast("decimal(38,0)"), modulus)
    half = F.lit("9223372036854775808").cast("decimal(38,0)")
    return F.when(low >= half, low - modulus).otherwise(low).cast("long")


def wrapping_sum(value: Column) -> Column:
    """Sum of 64-bit numbers that wraps around instead of failing."""
    return wrapped(F.sum(value.cast("decimal(38,0)")))


def heat_now(heat: Column, age_s: Column, decay: float = 0.95, period_s: int = 60) -> Column:
    """Heat after whole periods of decay, rounded down."""
    periods = F.floor(age_s / period_s)
    return F.when(periods >= 1, F.floor(heat * F.pow(F.lit(decay), periods))).otherwise(heat).cast("long")


def is_live(expires_at: Column, now_ms: int) -> Column:
    """Rows never expire at 0, else they live up to and including ``expires_at``."""
    return (expires_at == 0) | (expires_at >= F.lit(now_ms))


def is_secure(flags: Column) -> Column:
    return flags.bitwiseAND(SECURE) != 0


def is_http_only(flags: Column) -> Column:
    return flags.bitwiseAND(HTTP_ONLY) != 0


def successor(prefix: bytes) -> bytes | None:
    """The smallest byte string above all that start with ``prefix``; None if there is none."""
    kept = prefix.rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else None


def has_prefix(key: Column, prefix: bytes) -> Column:
    """A range of binary keys, which reaches the file scan (a test for a prefix would not)."""
    if not prefix:
        return F.lit(True)
    low = key >= F.lit(prefix)
    above = successor(prefix)
    return low if above is None else low & (key < F.lit(above))


def index_key(kind: str, origin_hash: Column, key: Column, value: Column) -> Column:
    """Keys of the three built-in local-storage indexes."""
    parts = {"value": (value, key), "key": (key, value), "origin_hash": (origin_hash, key, value)}
    if kind not in parts:
        raise ValueError(f"no index on {kind!r}")
    return F.concat_ws(":", F.lit("idx:localstore"), F.lit("origin" if kind == "origin_hash" else kind), *parts[kind])


CONTAINER_NAME = r"^[\p{IsAlphabetic}\p{N}_-]+$"


def valid_container_name(name: Column) -> Column:
    return name.rlike(CONTAINER_NAME)
