"""Weights of documents in a mixture, and schedules: arithmetic on columns and layered settings."""

from __future__ import annotations

import copy

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import is_canonical


def resolve_profile(name: str, **changes) -> dict:
    """A named profile with changes laid over it: era and genre by key, the rest whole; None changes nothing."""
    if name not in fixed.PROFILES:
        raise ValueError(f"no profile {name!r}; there are {sorted(fixed.PROFILES)}")
    out = copy.deepcopy(fixed.PROFILES[name]) | {"name": name}
    for key, value in changes.items():
        if value is not None:
            out[key] = out[key] | value if key in ("era", "genre") else value
    return out


def parse_pairs(pairs: list[str] | None) -> dict[str, float]:
    """["a=1", ...] as a dict; an item without = is refused."""
    if any("=" not in p for p in pairs or []):
        raise ValueError("expected key=value")
    return {k.strip(): float(v) for k, v in (p.split("=", 1) for p in pairs or [])}


def _factor(value: Column, factors: dict[str, float]) -> Column:
    if not factors:
        return F.lit(1.0)
    table = F.create_map(*[F.lit(x) for pair in factors.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.coalesce(value, F.lit("unknown"))), F.lit(1.0))


def weight(profile: dict, tier: Column, era: Column, genre: Column, work: Column, quality: Column, non_latin: Column, min_quality: float = 0.0) -> Column:
    """The product of the profile's factors, capped, to four places; 0 for bad scans and for texts that aren't Latin."""
    q = F.coalesce(quality, F.lit(1.0))
    w = F.coalesce(tier, F.lit(1)).cast("double") if profile["use_tier"] else F.lit(1.0)
    w = w * _factor(era, profile["era"]) * _factor(genre, profile["genre"])
    if profile["canon"] != 1.0:
        w = w * F.when(is_canonical(work), profile["canon"]).otherwise(1.0)
    if profile["quality"]:
        w = w * F.when(q < 1, F.greatest(F.lit(0.1), F.least(F.lit(1.0), (q - 0.7) / 0.3))).otherwise(1.0)
    if profile.get("max_weight"):
        w = F.least(w, F.lit(float(profile["max_weight"])))
    return F.when((q < min_quality) | (F.coalesce(non_latin, F.lit(0.0)) > 40), 0.0).otherwise(F.round(w, 4))


def learning_rate(i: Column, warmup: int, total: int, top: float, least: float, decay: float) -> Column:
    """Linear warm-up, constant, linear decay over the last part."""
    start = int(total * (1 - decay))
    progress = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (i - start) / F.lit(float(max(1, total - start)))))
    return F.when(i < warmup, top * (i + 1) / F.lit(float(warmup + 1))).when(i < start, top).otherwise(least + (top - least) * (1 - progress))
