"""Typed tables over mutation logs.

Writers take dictionaries, a list of them, or a DataFrame; every call is one atomic batch.  Reads resolve the
log lazily.  ``clock`` gives the time in milliseconds, so results can be repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.functions.scalar import has_prefix, is_live, wrapped, wrapping_sum
from sedimenta.operators import scans
from sedimenta.operators.heat import HeatMap
from sedimenta.operators.maintenance import LAST_LEVEL, level_due
from sedimenta.operators.query import QueryBuilder
from sedimenta.plans.resolve import newest
from sedimenta.sources.config import Config
from sedimenta.sources.logstore import MemoryLog
from sedimenta.sources.schema import COOKIE_DEFAULTS, INDEXES, TABLES, Table

Rows = dict | Iterable[dict] | DataFrame


class LogTable:
    """What all tables share."""

    def __init__(self, spark: SparkSession, schema: Table, log, clock: Callable[[], int], config: Config | None = None, heat: HeatMap | None = None):
        self.spark, self.schema, self.log, self.clock = spark, schema, log, clock
        self.config = config or Config()
        self.heat = heat if heat is not None else HeatMap(self.config.heatmap)
        self.extractors: dict[str, Column] = {}

    # writing
    def _frame(self, rows: Rows, columns: str) -> DataFrame:
        if isinstance(rows, DataFrame):
            return rows
        rows = [rows] if isinstance(rows, dict) else list(rows)
        self._touch(rows, "write" if columns != self.schema.keys else "delete")
        kind = T._parse_datatype_string(columns)
        return self.spark.createDataFrame([tuple(r[f] for f in kind.names) for r in rows], kind)

    def _touch(self, rows: Iterable[dict], kind: str) -> None:
        """Heat of keys the driver has at hand; keys of a DataFrame aren't gathered for it."""
        for r in rows:
            self.heat.record((self.schema.name, *[r[k] for k in self.schema.key_names]), kind, self.clock() // 1000)

    def _append(self, rows: DataFrame, op: str, expires_at: int = 0, delta=None) -> None:
        """Rows of key and value columns (only keys for del and inc) as one batch, in their order."""
        self.log.append(self._mutations(rows, op, expires_at, delta))

    def _mutations(self, rows: DataFrame, op: str, expires_at: int = 0, delta=None) -> DataFrame:
        values = self.schema.value_names
        kind = T._parse_datatype_string(self.schema.log_ddl)["row"].dataType
        row = F.struct(*[F.col(v) for v in values]).cast(kind) if op == "put" else F.lit(None).cast(kind)
        return rows.select(
            *self.schema.key_names, F.lit(op).alias("op"), row.alias("row"), (F.lit(None) if delta is None else delta).cast("long").alias("delta"),
            F.lit(self.clock()).cast("long").alias("ts_ms"), F.lit(expires_at).cast("long").alias("expires_at"), F.monotonically_increasing_id().alias("pos"),
        )

    def put(self, rows: Rows, ttl_ms: int | None = None) -> None:
        expires = 0 if ttl_ms is None else self.clock() + ttl_ms
        self._append(self._frame(rows, f"{self.schema.keys}, {self.schema.values}"), "put", expires)

    def delete(self, keys: Rows) -> None:
        self._append(self._frame(keys, self.schema.keys), "del")

    def batch(self, puts: Rows = (), deletes: Rows = ()) -> None:
        """Puts, then deletes, committed together."""
        first = self._mutations(self._frame(puts, f"{self.schema.keys}, {self.schema.values}"), "put")
        second = self._mutations(self._frame(deletes, self.schema.keys), "del").withColumn("pos", F.col("pos") + (1 << 62))
        self.log.append(first.unionByName(second))

    # reading
    def ordered(self) -> DataFrame:
        return self.log.read().withColumn("seq", F.struct("batch", "pos"))

    def _fold(self, log: DataFrame, final: bool) -> DataFrame:
        """One row a key that says the same as ``log`` (with ``seq``); ``final`` if nothing older lies elsewhere."""
        return newest(log, self.schema.key_names)

    def resolved(self) -> DataFrame:
        """The newest row of every key with its op and expiry."""
        return self._fold(self.ordered(), True)

    def live(self) -> DataFrame:
        rows = self.resolved().filter(F.col("op") != "del").filter(is_live(F.col("expires_at"), self.clock()))
        return rows.select(*self.schema.key_names, "row.*", "expires_at")

    def rows(self) -> DataFrame:
        """Live rows of the table's own columns."""
        return self.live().drop("expires_at")

    def all(self) -> DataFrame:
        """Live rows in key order."""
        return self.rows().withColumn("key_bytes", self.schema.key_bytes()).orderBy("key_bytes").drop("key_bytes")

    def find(self, **key) -> DataFrame:
        return scans.get(self.rows(), **key)

    def one(self, **key):
        """The row, or None; counts as a read of the key."""
        self._touch([key], "read")
        return next(iter(self.find(**key).take(1)), None)

    def count(self) -> int:
        return self.live().count()

    def portable(self, rows: DataFrame) -> DataFrame:
        """Log rows as another kind of log can take them."""
        return rows

    def accepted(self, rows: DataFrame) -> DataFrame:
        """Log rows of another log as this table keeps them."""
        return rows

    def iterate(self):
        """Live rows in key order, one partition at a time on the driver."""
        return self.all().toLocalIterator(prefetchPartitions=True)

    def remove_where(self, gone: DataFrame) -> int:
        """Delete the keys of ``gone`` and tell how many there were."""
        keys = gone.select(*self.schema.key_names).persist()
        try:
            n = keys.count()
            if n:
                self._append(keys, "del")
            return n
        finally:
            keys.unpersist()

    # indexes of one's own
    def add_index(self, name: str, extractor: Column) -> None:
        """An index over live rows: ``extractor`` is an expression of the table's columns, null for rows it leaves out."""
        self.extractors[name] = extractor

    def index_entries(self, name: str) -> DataFrame:
        """``index_key`` and the key columns of every indexed row."""
        found = self.rows().select(self.extractors[name].alias("index_key"), *self.schema.key_names)
        return found.filter("index_key is not null")

    def by_index(self, name: str, value) -> DataFrame:
        """Live rows whose derived key is ``value``."""
        return self.rows().filter(self.extractors[name] == F.lit(value))

    # maintenance
    def compact(self, final: bool = True) -> None:
        """Rewrite the log with one row a key; at the last level tombstones and expired rows go."""
        rows = self.resolved()
        if final:
            rows = rows.filter(F.col("op") != "del").filter(is_live(F.col("expires_at"), self.clock()))
        self.log.replace(rows)

    def maintain(self) -> list[int]:
        """Merge the levels that are due, from the top down, and tell which: a result goes to the next level, which
        may make that one due.  Tombstones and expired rows go only with the merge that reaches everything."""
        if isinstance(self.log, MemoryLog):
            return []
        done, lsm = [], self.config.lsm_tree
        for level in range(LAST_LEVEL):
            levels = self.log.levels()
            held = levels.get(level, {})
            if not level_due(level, len(held), sum(held.values()), lsm.max_level0_files, lsm.level_thresholds_mb):
                continue
            deeper = any(levels[x] for x in levels if x > level)
            numbers = sorted(held)
            rows = self._fold(self.log.read(numbers).withColumn("seq", F.struct("batch", "pos")), not deeper)
            if not deeper:
                rows = rows.filter(F.col("op") != "del").filter(is_live(F.col("expires_at"), self.clock()))
            self.log.replace(rows, numbers, level + 1)
            done.append(level)
        return done

    def purge_expired(self) -> int:
        """Drop rows whose newest version has expired and tell how many keys that were; memory is given back."""
        dead = self.resolved().filter((F.col("op") != "del") & ~is_live(F.col("expires_at"), self.clock()))
        if not isinstance(self.log, MemoryLog):
            return self.remove_where(dead)
        n = dead.count()
        if n:
            self.compact()
        return n


class History(LogTable):
    def insert(self, rows: Rows) -> None:
        self.put(rows)

    def insert_with_ttl(self, rows: Rows, ttl_ms: int) -> None:
        self.put(rows, ttl_ms)

    def increment(self, url_hash: str | DataFrame, by: int = 1) -> None:
        """Add to visits, of one row or of all keys of a DataFrame; an absent or deleted row starts empty, from 0."""
        keys = url_hash if isinstance(url_hash, DataFrame) else {"url_hash": url_hash}
        self._append(self._frame(keys, "url_hash string"), "inc", delta=F.lit(by))

    def _fold(self, log: DataFrame, final: bool) -> DataFrame:
        """As for every table, with newer increments added to ``visit_count``; the newest row's expiry counts.

        Sums wrap around.  Without a base, increments stay one increment unless ``final``.  Bases are aggregated
        first and joined back: both steps combine before their exchange, and a hot key is split like any skewed join.
        """
        bases = log.filter(F.col("op") != "inc").groupBy("url_hash").agg(F.max("seq").alias("base"))
        rows = log.join(bases, "url_hash", "left").filter(F.col("base").isNull() | (F.col("seq") >= F.col("base")))
        folded = rows.groupBy("url_hash").agg(
            F.min_by(F.struct("op", "row"), "seq").alias("first"),
            F.max_by(F.struct("op", "ts_ms", "expires_at", "batch", "pos"), "seq").alias("last"), F.coalesce(wrapping_sum(F.col("delta")), F.lit(0)).alias("added"),
        )
        row = F.col("first.row")
        visits = wrapped(F.coalesce(row["visit_count"], F.lit(0)).cast("decimal(38,0)") + F.col("added").cast("decimal(38,0)"))
        made = F.struct(
            F.coalesce(row["ts_ms"], F.lit(0)).alias("ts_ms"), F.coalesce(row["url"], F.lit("")).alias("url"), F.coalesce(row["title"], F.lit("")).alias("title"),
            visits.alias("visit_count"),
        )
        loose = (F.col("first.op") == "inc") & F.lit(not final)  # its base, if any, lies deeper
        op = F.when(loose, "inc").when(F.col("last.op") == "inc", "put").otherwise(F.col("last.op"))
        return folded.select(
            "url_hash", op.alias("op"), F.when(op == "put", made).alias("row"), F.when(loose, F.col("added")).alias("delta"),
            "last.ts_ms", "last.expires_at", "last.batch", "last.pos",
        )

    def get(self, url_hash: str):
        return self.one(url_hash=url_hash)

    def hot_search(self, needle: str, limit: int) -> DataFrame:
        return scans.hot_search(self.rows(), needle, limit, self.schema.key_bytes())

    def wipe_domain(self, domain: str) -> int:
        return self.remove_where(scans.url_contains(self.rows(), domain))


class Bookmarks(LogTable):
    def insert(self, rows: Rows) -> None:
        self.put(rows)

    def get_all(self) -> DataFrame:
        return self.all()


class Cookies(LogTable):
    def insert(self, rows: Rows) -> None:
        """Missing path, domain and flags are empty, empty and 0."""
        if not isinstance(rows, DataFrame):
            rows = [COOKIE_DEFAULTS | r for r in ([rows] if isinstance(rows, dict) else rows)]
        self.put(rows)

    def get(self, domain_hash: str, name: str):
        return self.one(domain_hash=domain_hash, name=name)

    def get_by_domain(self, domain_hash: str) -> DataFrame:
        return self.all().filter(F.col("domain_hash") == domain_hash)

    def get_all(self) -> DataFrame:
        return self.all()


class Cache(LogTable):
    def insert(self, rows: Rows) -> None:
        self.put(rows)

    def get(self, url_hash: str):
        return self.one(url_hash=url_hash)


class LocalStore(LogTable):
    def insert(self, rows: Rows) -> None:
        """All three indexes."""
        self.insert_with_index(rows, INDEXES)

    def insert_with_index(self, rows: Rows, fields: Iterable[str]) -> None:
        """Only the named indexes; no names means all of them, an unknown name is an error."""
        fields = list(fields)
        if unknown := [f for f in fields if f not in INDEXES]:
            raise ValueError(f"no index on {unknown[0]!r}")
        rows = self._frame(rows, "origin_hash string, key string, value string")
        self.put(rows.withColumn("index_fields", F.array(*[F.lit(f) for f in fields or INDEXES])))

    def get(self, origin_hash: str, key: str):
        return self.one(origin_hash=origin_hash, key=key)

    def get_by_origin(self, origin_hash: str) -> DataFrame:
        return self.all().filter(F.col("origin_hash") == origin_hash)

    def remove(self, origin_hash: str, key: str) -> None:
        self.delete({"origin_hash": origin_hash, "key": key})

    def clear_origin(self, origin_hash: str) -> int:
        return self.remove_where(self.find(origin_hash=origin_hash))

    def query(self) -> QueryBuilder:
        return QueryBuilder(self.rows().withColumn("key_bytes", self.schema.key_bytes()))


class Settings(LogTable):
    def set(self, key: str, value: str) -> None:
        self.put({"key": key, "value": value})

    def get(self, key: str) -> str | None:
        row = self.one(key=key)
        return row and row.value

    def remove(self, key: str) -> None:
        self.delete({"key": key})


BLOB_BYTES = 65_536  # values over this stand apart from the log


class BinaryStore(LogTable):
    """Raw keys and values.  On disk, large values go to a log of blobs, named by their digest, before the row that
    points to them is committed, so that scans and merges of keys don't carry them."""

    blobs = None  # set by the container, for logs on disk

    def _frame(self, rows: Rows, columns: str) -> DataFrame:
        if columns == self.schema.keys:
            return super()._frame(rows, columns)
        return self._apart(super()._frame(rows, "key binary, value binary"), F.col("value"), lambda value, blob: [F.col("key"), value.alias("value"), blob.alias("blob")])

    def _apart(self, rows: DataFrame, value: Column, shown: Callable[[Column, Column], list[Column]]) -> DataFrame:
        """``rows`` as ``shown`` makes them from the value that stays and the blob's name; large values are written."""
        name = F.lit(None).cast("string")
        if self.blobs is not None:
            large = F.coalesce(F.octet_length(value) > BLOB_BYTES, F.lit(False))
            held = rows.filter(large).select(F.sha2(value, 256).alias("blob"), value.alias("value"), F.monotonically_increasing_id().alias("pos"))
            if not held.isEmpty():
                self.blobs.append(held, dealt=True)  # sorting by digest would move every value
            name = F.when(large, F.sha2(value, 256))
            value = F.when(~large, value)
        return rows.select(*shown(value, name))

    def _together(self, rows: DataFrame, value: Column, blob: Column, shown: Callable[[Column], list[Column]], made: Callable[[Column], Column] = lambda v: v) -> DataFrame:
        """``rows`` with what is ``made`` of their values, large ones put back; rows without a blob meet nothing and stay apart."""
        if self.blobs is None or not self.blobs.batches():
            return rows.select(*shown(made(value)))
        held = self._one_of_each(self._places()).select(F.col("blob").alias("_name"), made(F.col("value")).alias("_blob"))
        large = rows.filter(blob.isNotNull()).withColumn("_wanted", blob).hint("shuffle_hash")
        met = large.join(held, F.col("_wanted") == F.col("_name"), "left")
        return rows.filter(blob.isNull()).select(*shown(made(value))).unionByName(met.select(*shown(F.col("_blob"))))

    def _places(self) -> DataFrame:
        """``_name`` of every blob and where the first of its rows stands."""
        return self.blobs.read().groupBy(F.col("blob").alias("_name")).agg(F.min(F.struct("batch", "pos")).alias("_place"))

    def _one_of_each(self, places: DataFrame) -> DataFrame:
        """The blobs' rows at ``places``, by a bit a row that every task gets: values don't move.

        Positions count up inside a partition, so a page of 32,768 bits has as many rows; its end without rows is left out.
        """
        page, bit = F.shiftright("pos", 15), F.col("pos").bitwiseAND(32767)
        bits = places.select("_place.*").groupBy(F.col("batch").alias("_batch"), page.alias("_page"))
        bits = bits.agg(F.bitmap_construct_agg(bit).alias("_bits"), F.max(bit).alias("_last"))
        bits = bits.withColumn("_bits", F.substring("_bits", F.lit(1), F.shiftright("_last", 3).cast("int") + 1))
        met = self.blobs.read().join(F.broadcast(bits), (F.col("batch") == F.col("_batch")) & (page == F.col("_page")))
        byte = F.conv(F.hex(F.substring("_bits", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        set_ = F.expr("(1 << cast(pos & 7 as int))").bitwiseAND(F.coalesce(byte, F.lit(0))) != 0
        return met.filter(set_).drop("_batch", "_page", "_bits", "_last")

    def rows(self) -> DataFrame:
        return self._together(self.live(), F.col("value"), F.col("blob"), lambda value: [F.col("key"), value.alias("value")])

    def mapped(self, made: Callable[[Column], Column]) -> DataFrame:
        """``key`` of every live row and what is ``made`` of its value, large values where they stand, before keys meet them."""
        return self._together(self.live(), F.col("value"), F.col("blob"), lambda value: [F.col("key"), value.alias("value")], made)

    def portable(self, rows: DataFrame) -> DataFrame:
        row = lambda value: F.struct(value.alias("value"), F.lit(None).cast("string").alias("blob"))
        others = [c for c in rows.columns if c != "row"]
        return self._together(rows, F.col("row.value"), F.col("row.blob"), lambda value: [*map(F.col, others), row(value).alias("row")])

    def accepted(self, rows: DataFrame) -> DataFrame:
        others = [c for c in rows.columns if c != "row"]
        return self._apart(rows, F.col("row.value"), lambda value, blob: [*map(F.col, others), F.struct(value.alias("value"), blob.alias("blob")).alias("row")])

    def put(self, rows: Rows | bytes, value: bytes | None = None, ttl_ms: int | None = None) -> None:
        super().put({"key": rows, "value": value} if isinstance(rows, (bytes, bytearray)) else rows, ttl_ms)

    def get(self, key: bytes) -> bytes | None:
        """The row first, then its blob, if it has one, by name."""
        self._touch([{"key": key}], "read")
        row = next(iter(scans.get(self.live(), key=key).take(1)), None)
        if row is None or row.blob is None:
            return None if row is None else bytes(row.value)
        return bytes(scans.get(self.blobs.read(), blob=row.blob).first().value)

    def delete(self, keys: Rows | bytes) -> None:
        super().delete({"key": keys} if isinstance(keys, (bytes, bytearray)) else keys)

    def scan_prefix(self, prefix: bytes) -> DataFrame:
        """The key range reaches the log's scan, below version resolution."""
        return self.rows().filter(has_prefix(F.col("key"), prefix)).orderBy("key")

    def all_entries(self) -> DataFrame:
        return self.all()

    def gc_blobs(self) -> int:
        """Drop blobs that no key's newest version points to, and tell how many rows of blobs that were."""
        if self.blobs is None or not self.blobs.batches():
            return 0
        before = self.blobs.read().count()
        current = self.live().filter("blob is not null").select(F.col("blob").alias("_name"))
        self.blobs.replace(self._one_of_each(scans.live_blobs(self._places(), current, "_name")), dealt=True)
        return before - self.blobs.read().count()


KINDS = {
    "history": History, "bookmarks": Bookmarks, "cookies": Cookies, "cache": Cache,
    "localstore": LocalStore, "settings": Settings, "binarystore": BinaryStore,
}
assert set(KINDS) == set(TABLES)
