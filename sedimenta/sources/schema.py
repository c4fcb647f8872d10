"""The seven tables: key columns, value columns and the bytes their keys order by."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedimenta.functions.scalar import length_prefixed, little_endian


@dataclass(frozen=True)
class Table:
    name: str
    keys: str  # DDL of the key columns
    values: str  # DDL of the other columns

    @property
    def key_names(self) -> list[str]:
        return [c.split()[0] for c in self.keys.split(", ")]

    @property
    def value_names(self) -> list[str]:
        return [c.split()[0] for c in self.values.split(", ")]

    @property
    def log_ddl(self) -> str:
        """A mutation: key, op (put, del, inc), the row's other columns, delta, times, and its total order."""
        fields = ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in self.values.split(", "))
        return f"{self.keys}, op string, row struct<{fields}>, delta bigint, ts_ms bigint, expires_at bigint, batch bigint, pos bigint"

    def key_bytes(self) -> Column:
        first, *rest = self.key_names
        if first.endswith("_hash"):
            parts = [little_endian(F.col(first)), *[length_prefixed(F.col(k)) for k in rest]]
            return F.concat(*parts) if rest else parts[0]
        return F.col(first).cast("binary")


TABLES = {
    t.name: t
    for t in (
        Table("history", "url_hash string", "ts_ms bigint, url string, title string, visit_count bigint"),
        Table("cookies", "domain_hash string, name string", "value string, path string, domain string, expiry_s bigint, flags smallint"),
        Table("cache", "url_hash string", "headers string, body binary, etag string, last_modified_ms bigint"),
        Table("localstore", "origin_hash string, key string", "value string, index_fields array<string>"),
        Table("settings", "key string", "value string"),
        Table("bookmarks", "url_hash string", "url string, title string, folder string, created_at bigint"),
        Table("binarystore", "key binary", "value binary, blob string"),
    )
}

BLOB_DDL = "blob string, value binary, batch bigint, pos bigint"

# Tags of tables and entry kinds; unknown tags mean history and put
TABLE_TAGS = {1: "history", 2: "cookies", 3: "cache", 4: "localstore", 5: "settings", 6: "bookmarks", 7: "binarystore"}
INDEXES = ("value", "key", "origin_hash")
COOKIE_DEFAULTS = {"path": "", "domain": "", "flags": 0}


def table_of_tag(tag: Column) -> Column:
    out = F.when(tag == 1, TABLE_TAGS[1])
    for number, name in TABLE_TAGS.items():
        out = out.when(tag == number, name)
    return out.otherwise("history")
