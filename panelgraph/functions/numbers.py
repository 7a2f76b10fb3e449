"""Numeric expressions. Missing is NULL everywhere; NaN and infinity never leave a parse."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelgraph.fixed_values import GROWTH_BOUND


def number(c: Column) -> Column:
    """Lenient double: text that is no number, NaN and infinity become NULL."""
    value = c.try_cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def count_value(c: Column) -> Column:
    """Lenient non-negative number: not a number or missing -> 0, floor 0."""
    return F.greatest(F.coalesce(number(c), F.lit(0.0)), F.lit(0.0))


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Clip to a range; NULL stays NULL (``least``/``greatest`` alone would skip it)."""
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def share(part: Column, total: Column) -> Column:
    """part / max(total, 1), clipped to [0, 1]."""
    return clip(part / F.greatest(total, F.lit(1)), 0.0, 1.0)


def safe_growth(current: Column, previous: Column) -> Column:
    """(current - previous) / max(previous, 1), clipped; NULL when either side is NULL."""
    base = F.when(previous.isNotNull(), F.greatest(previous.cast("double"), F.lit(1.0)))
    return clip((current - previous) / base, -GROWTH_BOUND, GROWTH_BOUND)


def safe_growth_or_zero(current: Column, previous: Column) -> Column:
    return F.coalesce(safe_growth(current, previous), F.lit(0.0))


def log_momentum(current: Column, previous: Column) -> Column:
    return F.log1p(current.cast("double")) - F.log1p(previous.cast("double"))


def round_half_up(c: Column) -> Column:
    """floor(x + 0.5): halves go up, also for negative numbers."""
    return F.floor(c + F.lit(0.5))
