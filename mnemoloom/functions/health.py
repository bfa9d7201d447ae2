"""Time, health and configuration as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEALTH = {"grounded": 1.3, "active": 1.0, "stale": 0.4, "dormant": 0.2}


def days_since(ts: Column, now: str) -> Column:
    """Whole days from an ISO time (UTC if naive) to ``now``; 999 if there is none or it can't be read."""
    return F.coalesce(F.floor((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.try_to_timestamp(ts))) / 86400), F.lit(999))


def health_multiplier(state: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in HEALTH.items() for x in pair])
    return F.coalesce(F.element_at(table, state), F.lit(1.0))


def decay_state(days: Column, active: int = 30, stale: int = 60) -> Column:
    return F.when(days <= active, "active").when(days <= stale, "stale").otherwise("dormant")


def calibrated(scoped: Column, whole: Column, key: str, scope: Column, default: float) -> Column:
    """A setting: the scope's own value, else the profile's, else the default."""
    return F.coalesce(F.try_element_at(F.try_element_at(scoped, scope), F.lit(key)), F.try_element_at(whole, F.lit(key)), F.lit(default))


def overlay(defaults: Column, saved: Column) -> Column:
    """Saved settings over defaults; nulls don't count."""
    kept = F.map_filter(saved, lambda _, v: v.isNotNull())
    rest = F.map_filter(defaults, lambda k, _: ~F.map_contains_key(kept, k))
    return F.map_concat(rest, kept)


def cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float, batch: bool = False) -> Column:
    return (tokens_in * price_in + tokens_out * price_out) / 1e6 * (0.5 if batch else 1.0)
