"""Settings of a database directory (``sedimenta.toml``); any error in the file means all defaults."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields

# The defaults of the contract


@dataclass(frozen=True)
class LsmConfig:
    max_level0_files: int = 4
    max_memtable_size_mb: int = 20
    level_thresholds_mb: tuple[int, ...] = (10, 100, 1000, 10_000, 100_000, 1_000_000)
    compaction_cpu_limit: float = 0.05
    compaction_idle_ms: int = 5000
    compaction_deadline_s: int = 30
    verify_checksums: bool = False


@dataclass(frozen=True)
class HeatConfig:
    max_entries: int = 10_000
    hot_threshold: int = 10
    decay_factor: float = 0.95


@dataclass(frozen=True)
class Config:
    lsm_tree: LsmConfig = field(default_factory=LsmConfig)
    heatmap: HeatConfig = field(default_factory=HeatConfig)


REQUIRED = ("max_level0_files", "max_memtable_size_mb", "level_thresholds_mb")


def parse(text: str | None) -> Config:
    """A given ``[lsm_tree]`` table must have its first three keys, and values must have the right kinds."""
    try:
        raw = tomllib.loads(text or "")
        lsm, heat = raw.get("lsm_tree"), raw.get("heatmap")
        if lsm is not None and any(k not in lsm for k in REQUIRED):
            return Config()
        return Config(_typed(LsmConfig, lsm or {}), _typed(HeatConfig, heat or {}))
    except (tomllib.TOMLDecodeError, TypeError, ValueError):
        return Config()


def _typed(kind, values: dict):
    known = {}
    for f in fields(kind):
        if f.name in values:
            default, value = f.default, values[f.name]
            if isinstance(default, tuple):
                value = tuple(int(x) for x in value)
            elif isinstance(default, bool) != isinstance(value, bool) or not isinstance(value, (int, float)):
                raise TypeError(f.name)
            known[f.name] = value
    return kind(**known)
