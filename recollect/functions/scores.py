"""Lifecycle scores as Catalyst expressions; ``now`` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Priorities and warmth of tiers.
TIER_PRIORITY = {"working": 5, "semantic": 4, "procedural": 3, "episodic": 2, "archived": 1}
TIER_WARMTH = {"working": 1.0, "semantic": 0.7, "procedural": 0.6, "episodic": 0.4, "archived": 0.1}
#: The same by access heat of results.
TIER_BOOST = {"working": 1.0, "episodic": 0.75, "semantic": 0.55, "procedural": 0.5, "archived": 0.2}


def hours(now: Column, then: Column) -> Column:
    return F.greatest(F.lit(0.0), (now - then) / 3600.0)


def decay(importance: Column, last: Column, now: Column, half_life: float = 48.0) -> Column:
    return importance * F.pow(F.lit(2.0), -hours(now, last) / half_life)


def recency(last: Column, now: Column, half_life: float = 12.0) -> Column:
    return F.coalesce(F.pow(F.lit(2.0), -hours(now, last) / half_life), F.lit(0.0))


def frequency(count_24h: Column) -> Column:
    return F.least(F.lit(1.0), count_24h / 10.0)


def combined(freq: Column, rec: Column) -> Column:
    return 0.6 * freq + 0.4 * rec


def by_tier(tier: Column, values: dict, other) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(tier == k, v) if out is None else out.when(tier == k, v)
    return out.otherwise(other)


def heat(freq: Column, rec: Column, decay_score: Column, importance: Column, tier: Column) -> Column:
    return 0.35 * freq + 0.30 * rec + 0.20 * decay_score + 0.10 * importance + 0.05 * by_tier(tier, TIER_WARMTH, 0.4)


def heat_label(value: Column) -> Column:
    return F.when(value >= 0.75, "hot").when(value >= 0.45, "warm").otherwise("cold")


def relation_confidence(similarity: Column) -> Column:
    return F.when(similarity >= 0.80, 0.95).when(similarity >= 0.70, 0.90).when(similarity >= 0.60, 0.87).otherwise(0.82)


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
