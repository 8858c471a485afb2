"""Column expressions over vectors, ages and importance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How fast each kind of memory fades, against a semantic one.
FADING = {"episodic": 0.5, "semantic": 1.0, "procedural": 3.0, "working": 0.25}
MEMORY_TYPES = ("semantic", "episodic", "procedural", "working")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is all zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def unit(a: Column) -> Column:
    size = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(size == 0, F.lit(1.0)).otherwise(size))


def age_days(then: Column, now: Column) -> Column:
    """Days from then to now, 0 for later times, null where either is unknown."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    days = (micros(now) - micros(then)) / F.lit(86_400_000_000.0)
    return F.when(days < 0, F.lit(0.0)).otherwise(days)


def recency(updated: Column, now: Column, half_life: float = 30.0) -> Column:
    """1 now, a half after each half-life; a half where the time is unknown."""
    return F.coalesce(F.pow(F.lit(0.5), age_days(updated, now) / F.lit(max(half_life, 0.01))), F.lit(0.5))


def clamped(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def effective_importance(importance: Column, kind: Column, updated: Column, now: Column, half_life: float = 90.0, floor: float = 0.15, enabled: bool = True) -> Column:
    """Importance as it fades with age, down to a share of it; as it is where the age is unknown."""
    if not enabled:
        return importance
    pace = F.lit(1.0)
    for name, factor in FADING.items():
        pace = F.when(kind == name, F.lit(factor)).otherwise(pace)
    life = F.greatest(F.lit(half_life) * pace, F.lit(0.01))
    left = F.lit(floor) + F.lit(1 - floor) * F.pow(F.lit(0.5), age_days(updated, now) / life)
    return importance * F.coalesce(left, F.lit(1.0))


def memory_type(c: Column) -> Column:
    """Unknown kinds are semantic."""
    known = F.lower(F.trim(c))
    return F.when(known.isin(*MEMORY_TYPES), known).otherwise("semantic")


def importance(c: Column, clamp: bool = True) -> Column:
    """Text or number to importance; a half where it is neither."""
    value = F.coalesce(c.try_cast("double"), F.lit(0.5))
    return clamped(value) if clamp else value


def reciprocal(rank: Column, weight: float = 1.0, k: int = 60, shift: int = 1) -> Column:
    """Share of a list in a fused rank; rank counts from 0, null gives 0."""
    return F.coalesce(F.lit(float(weight)) / (F.lit(float(k + shift)) + rank), F.lit(0.0))
