"""Leak-free time-series features over a balanced panel.

Two rules for missing history, chosen by ``fill``: zero (absence of events is zero) or NULL
(unobserved history stays missing). All windows of one panel share one partitioning and one
sort, so a whole feature table costs a single shuffle, usually the one that built the panel.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelgraph.fixed_values import ACTIVE_THRESHOLD, LAGS, WINDOWS
from panelgraph.functions.numbers import log_momentum, safe_growth, safe_growth_or_zero
from panelgraph.operators.panel import ENTITY, MONTH


def timeline(entity: str | Sequence[str] = ENTITY, month: str = MONTH) -> WindowSpec:
    keys = [entity] if isinstance(entity, str) else list(entity)
    return Window.partitionBy(*keys).orderBy(month)


def lagged(c: str, k: int, w: WindowSpec, fill: float | None = None) -> Column:
    value = F.lag(c, k).over(w)
    return value if fill is None else F.coalesce(value, F.lit(fill))


def rolling(c: str, how: str, frame: WindowSpec, *, rows: int | None = None, fill: float | None = None) -> Column:
    """Sum or mean over a frame; with ``rows`` it is NULL unless the frame holds that many."""
    value = {"sum": F.sum, "mean": F.avg}[how](c).over(frame)
    if rows is not None:
        value = F.when(F.count(F.lit(1)).over(frame) == rows, value)
    return value if fill is None else F.coalesce(value, F.lit(fill))


def before(w: WindowSpec, n: int) -> WindowSpec:
    """The n rows before the current one."""
    return w.rowsBetween(-n, -1)


def upto(w: WindowSpec, n: int) -> WindowSpec:
    """The current row and the n - 1 before it."""
    return w.rowsBetween(-(n - 1), 0)


def event_features(
    panel: DataFrame,
    *,
    lags: Sequence[int] = LAGS,
    windows: Sequence[int] = WINDOWS,
    threshold: float = ACTIVE_THRESHOLD,
    entity: str = ENTITY,
    month: str = MONTH,
) -> DataFrame:
    """Lags, prior and trailing windows, deltas, growth and momentum; missing history is zero."""
    w = timeline(entity, month)
    measures = {"fatalities": "fatalities_best_total", "events": "events_total"}
    # each earlier row is fetched once; sums over frames add them up, oldest first, in the order a frame would
    longest = max(windows)
    steps = sorted({1, *lags, *range(1, longest + 1)})
    rows = panel.select("*", *[F.lag(c, k).over(w).alias(f"_{name}_{k}") for name, c in measures.items() for k in steps])

    def at(name: str, k: int) -> Column:
        return F.col(f"_{name}_{k}" if k else measures[name])

    def earlier(name: str, k: int) -> Column:
        return F.coalesce(at(name, k), F.lit(0))

    def total(name: str, first: int, last: int) -> Column:
        """Sum over the rows from ``first`` to ``last`` steps back."""
        terms = [earlier(name, k) for k in range(first, last - 1, -1)]
        return sum(terms[1:], terms[0])

    def mean(name: str, first: int, last: int) -> Column:
        known = [at(name, k).isNotNull().cast("int") for k in range(first, last - 1, -1)]
        number = sum(known[1:], known[0])
        return F.when(number > 0, total(name, first, last).cast("double") / number).otherwise(F.lit(0.0))

    new: dict[str, Column] = {}
    for k in lags:
        for name in measures:
            new[f"{name}_lag_{k}m"] = earlier(name, k)
    for n in windows:
        for name in measures:
            new[f"{name}_prior_sum_{n}m"] = total(name, n, 1)
    for n in windows:
        for name in measures:
            new[f"{name}_rolling_sum_{n}m"] = total(name, n - 1, 0)
        new[f"fatalities_rolling_mean_{n}m"] = mean("fatalities", n - 1, 0)
    previous = {name: earlier(name, 1) for name in measures}
    for name, c in measures.items():
        new[f"delta_{name}_1m"] = F.col(c) - previous[name]
    for name, c in measures.items():
        new[f"growth_rate_{name}_1m"] = safe_growth_or_zero(F.col(c), previous[name])
    for name, c in measures.items():
        new[f"momentum_{name}_log_1m"] = log_momentum(F.col(c), previous[name])
    active = total("fatalities", longest - 1, 0) >= threshold
    new["project_active_conflict_indicator"] = active.cast("int")
    return rows.select(*panel.columns, *[c.alias(n) for n, c in new.items()])


NEWS_LAGGED = {
    "conflict_news": "conflict_news_count",
    "conflict_news_ratio": "conflict_news_ratio",
    "avg_tone": "avg_tone",
    "escalation_signal": "escalation_signal",
}
NEWS_PRIOR = {
    "conflict_news_prior_sum": ("conflict_news_count", "sum"),
    "avg_tone_prior_mean": ("avg_tone", "mean"),
    "escalation_signal_prior_mean": ("escalation_signal", "mean"),
}
NEWS_TRAILING = {
    "conflict_news_rolling_sum": ("conflict_news_count", "sum"),
    "avg_tone_rolling_mean": ("avg_tone", "mean"),
}


def news_features(
    panel: DataFrame,
    *,
    lags: Sequence[int] = LAGS,
    windows: Sequence[int] = WINDOWS,
    lagged_columns: Mapping[str, str] = NEWS_LAGGED,
    entity: str = ENTITY,
    month: str = MONTH,
) -> DataFrame:
    """The same kinds of features where history before the first month stays NULL."""
    w = timeline(entity, month)
    new: dict[str, Column] = {}
    for k in lags:
        for name, c in lagged_columns.items():
            new[f"{name}_lag_{k}m"] = lagged(c, k, w)
    for n in windows:
        for name, (c, how) in NEWS_PRIOR.items():
            new[f"{name}_{n}m"] = rolling(c, how, before(w, n), rows=n)
    for n in windows:
        for name, (c, how) in NEWS_TRAILING.items():
            new[f"{name}_{n}m"] = rolling(c, how, upto(w, n), rows=n)
    count, previous = F.col("conflict_news_count"), lagged("conflict_news_count", 1, w)
    new["delta_conflict_news_1m"] = count - previous
    new["safe_conflict_news_growth_rate_1m"] = safe_growth(count, previous)
    new["momentum_conflict_news_log_1m"] = log_momentum(count, previous)
    return panel.select("*", *[c.alias(n) for n, c in new.items()])


def month_as_text(df: DataFrame, month: str = MONTH) -> DataFrame:
    """The stored form of a month start, ``yyyy-MM-dd``."""
    return df.withColumn(month, F.date_format(month, "yyyy-MM-dd"))
