"""Expressions over pairs of entities."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelgraph.fixed_values import BLOODLESS_TENSION, FATALITY_SCALE, TENSION_WEIGHTS
from panelgraph.functions.numbers import clip

UNDIRECTED, NEWS, HYBRID = "undirected_conflict", "directed_news", "hybrid"


def canonical(a: Column, b: Column) -> tuple[Column, Column]:
    """The two ends in alphabetical order."""
    return F.least(a, b), F.greatest(a, b)


def composite_tension(
    fatalities: Column, events: Column, articles: Column, tone: Column, conflict_articles: Column
) -> Column:
    """Tension in [0, 1] from a conflict part, a news part, or the weighted sum of both."""
    deaths = F.coalesce(fatalities.cast("double"), F.lit(0.0))
    has_conflict = (F.coalesce(events, F.lit(0)) > 0) | (deaths > 0)
    has_news = F.coalesce(articles, F.lit(0)) > 0
    conflict = F.when(deaths > 0, F.least(F.lit(1.0), F.log1p(deaths) / F.lit(math.log1p(FATALITY_SCALE)))).otherwise(
        F.lit(BLOODLESS_TENSION)
    )
    hostility = F.greatest(F.lit(0.0), -F.coalesce(tone, F.lit(0.0)))
    news = clip(0.5 * hostility + 0.5 * (conflict_articles / F.greatest(articles, F.lit(1))), 0.0, 1.0)
    w_conflict, w_news = TENSION_WEIGHTS
    mixed = (
        F.when(has_conflict & has_news, w_conflict * conflict + w_news * news)
        .when(has_conflict, conflict)
        .when(has_news, news)
        .otherwise(F.lit(0.0))
    )
    return clip(mixed, 0.0, 1.0)


def relationship_nature(has_conflict: Column, has_news: Column) -> Column:
    return F.when(has_conflict & has_news, F.lit(HYBRID)).when(has_news, F.lit(NEWS)).otherwise(F.lit(UNDIRECTED))
