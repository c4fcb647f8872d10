"""The string-keyed surface: URLs and origins instead of hashes, integers as status (0 done, -1 failed)."""

from __future__ import annotations

from collections.abc import Callable

from sedimenta.sources.engine import Engine
from sedimenta.sources.schema import INDEXES

# 128-bit FNV-1a
BASIS, PRIME = 0x6C62272E07BB014262B821756295C58D, (1 << 88) + 0x13B


def text_hash(text: str) -> str:
    """As the column function of the same hash, for one string on the driver."""
    h = BASIS
    for byte in text.encode():
        h = (h ^ byte) * PRIME % (1 << 128)
    return f"{h:032x}"


def halves_hash(low: int, high: int) -> str:
    return f"{(high << 64 | low):032x}"


def lossy(text: str | bytes) -> str:
    """Foreign callers may hand over bytes; what isn't UTF-8 in them becomes the replacement character."""
    return text if isinstance(text, str) else bytes(text).decode("utf-8", "replace")


class StringApi:
    """Every call works on the default container.  Texts may be given as bytes (see :func:`lossy`)."""

    def __init__(self, engine: Engine):
        self.engine = engine

    def _status(self, action: Callable[[], object]) -> int:
        try:
            action()
            return 0
        except Exception:  # the surface reports failures as a number
            return -1

    def _visit(self, url: str, title: str) -> dict:
        return {"url_hash": text_hash(url), "ts_ms": self.engine._clock(), "url": url, "title": title, "visit_count": 1}

    def history_insert(self, url: str, title: str) -> int:
        url, title = lossy(url), lossy(title)
        return self._status(lambda: self.engine.history().insert(self._visit(url, title)))

    def history_insert_with_ttl(self, url: str, title: str, ttl_ms: int) -> int:
        url, title = lossy(url), lossy(title)
        return self._status(lambda: self.engine.history().insert_with_ttl(self._visit(url, title), ttl_ms))

    def history_increment(self, low: int, high: int) -> int:
        return self._status(lambda: self.engine.history().increment(halves_hash(low, high)))

    def history_get_title(self, low: int, high: int) -> str | None:
        row = self.engine.history().get(halves_hash(low, high))
        return row and row.title

    def localstore_insert(self, origin: str, key: str, value: str) -> int:
        origin, key, value = lossy(origin), lossy(key), lossy(value)
        return self._status(lambda: self.engine.localstore().insert({"origin_hash": text_hash(origin), "key": key, "value": value}))

    def localstore_get(self, origin: str, key: str) -> str | None:
        origin, key = lossy(origin), lossy(key)
        row = self.engine.localstore().get(text_hash(origin), key)
        return row and row.value

    def localstore_remove(self, origin: str, key: str) -> int:
        origin, key = lossy(origin), lossy(key)
        return self._status(lambda: self.engine.localstore().remove(text_hash(origin), key))

    def localstore_clear(self, origin: str) -> int:
        origin = lossy(origin)
        return self._status(lambda: self.engine.localstore().clear_origin(text_hash(origin)))

    def localstore_get_all(self, origin: str, callback: Callable[[str, str], object]) -> int:
        """Calls back with every key and value of an origin, in key order."""
        origin = lossy(origin)
        return self._status(lambda: [callback(r.key, r.value) for r in self.engine.localstore().get_by_origin(text_hash(origin)).toLocalIterator()])

    def settings_set(self, key: str, value: str) -> int:
        key, value = lossy(key), lossy(value)
        return self._status(lambda: self.engine.settings().set(key, value))

    def settings_get(self, key: str | bytes) -> str | None:
        """Strict: a key that isn't UTF-8 has no setting."""
        try:
            key = key if isinstance(key, str) else bytes(key).decode("utf-8")
        except UnicodeDecodeError:
            return None
        return self.engine.settings().get(key)

    def settings_remove(self, key: str) -> int:
        key = lossy(key)
        return self._status(lambda: self.engine.settings().remove(key))

    def close(self) -> int:
        return self._status(self.engine.close)


def open_database(spark, path: str) -> StringApi | None:
    """None if it can't be opened."""
    try:
        return StringApi(Engine.open(spark, path))
    except Exception:
        return None


__all__ = ["INDEXES", "StringApi", "halves_hash", "lossy", "open_database", "text_hash"]
