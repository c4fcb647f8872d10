"""The fluent builder over local-storage rows; it only gathers expressions, Catalyst plans them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.scalar import has_prefix


class QueryBuilder:
    """``prefix``, ``filter``, ``value_eq`` and ``limit`` in any order, then ``execute``.

    ``value_eq`` finds rows whose value is indexed (``index_fields`` holds 'value') and equal; it honours the
    prefix as well.  Rows come in key order, and ``limit(0)`` gives none.
    """

    def __init__(self, rows: DataFrame, key: str = "key_bytes", value: str = "value", index_fields: str | None = "index_fields"):
        self._rows, self._key, self._value, self._index = rows, key, value, index_fields
        self._filters: list[Column] = []
        self._limit: int | None = None

    def prefix(self, prefix: bytes) -> "QueryBuilder":
        self._filters.append(has_prefix(F.col(self._key), prefix))
        return self

    def filter(self, predicate: Column | Callable[..., bool], *columns: str) -> "QueryBuilder":
        """A column expression, or a Python function of the named columns (all but the key bytes by default)."""
        if not isinstance(predicate, Column):
            names = columns or tuple(c for c in self._rows.columns if c != self._key)
            predicate = F.udf(predicate, "boolean", useArrow=True)(*names)
        self._filters.append(predicate)
        return self

    def value_eq(self, value: str) -> "QueryBuilder":
        match = F.col(self._value) == F.lit(value)
        self._filters.append(match & F.array_contains(self._index, "value") if self._index else match)
        return self

    def limit(self, n: int) -> "QueryBuilder":
        self._limit = n
        return self

    def execute(self) -> DataFrame:
        rows = self._rows
        for f in self._filters:
            rows = rows.filter(f)
        rows = rows.orderBy(self._key)
        return rows if self._limit is None else rows.limit(self._limit)
