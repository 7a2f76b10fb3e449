"""Events and articles to pair tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelgraph.fixed_values import GOVERNMENT_MARKER, GOVERNMENT_NAMES
from panelgraph.functions import pairs
from panelgraph.functions.numbers import count_value
from panelgraph.functions.text import government_codes
from panelgraph.operators.features import before, lagged, rolling, timeline

SOURCE, TARGET = "source_country_iso3", "target_country_iso3"
CONFLICT_MEASURES = {
    "fatalities_best_total": "fatalities_best",
    "fatalities_low_total": "fatalities_low",
    "fatalities_high_total": "fatalities_high",
    "deaths_civilians_total": "deaths_civilians",
}


def with_sides(events: DataFrame, names: Sequence[tuple[str, str]] = GOVERNMENT_NAMES) -> DataFrame:
    """Add the states on either side, and whether side B names a government at all.

    Text without a government on side B is not searched further.
    """
    candidate = F.coalesce(F.col("side_b").contains(GOVERNMENT_MARKER), F.lit(False))
    marked = events.withColumn("is_candidate", candidate)
    nothing = F.array().cast("array<string>")
    sides = {
        f"states_{s}": F.when(F.col("is_candidate"), government_codes(F.col(f"side_{s}"), names)).otherwise(nothing)
        for s in ("a", "b")
    }
    return marked.withColumns(sides)


def _unequal_pairs() -> Column:
    every = F.flatten(
        F.transform(
            F.col("states_a"),
            lambda a: F.transform(F.col("states_b"), lambda b: F.struct(a.alias("a"), b.alias("b"))),
        )
    )
    return F.filter(every, lambda p: p["a"] != p["b"])


def state_pairs(events: DataFrame, names: Sequence[tuple[str, str]] = GOVERNMENT_NAMES) -> DataFrame:
    """One row per event and pair of opposing states, ends in alphabetical order. No shuffle."""
    paired = with_sides(events, names).withColumn("_pair", F.explode(_unequal_pairs()))
    a, b = pairs.canonical(F.col("_pair.a"), F.col("_pair.b"))
    return paired.select(
        F.col("id").alias("event_id"),
        a.alias("country_a_iso3"),
        b.alias("country_b_iso3"),
        a.alias(SOURCE),
        b.alias(TARGET),
        F.lit(False).alias("is_directed"),
        F.lit(pairs.UNDIRECTED).alias("relationship_nature"),
        "year_month",
        "event_date",
        count_value(F.col("best")).alias("fatalities_best"),
        count_value(F.col("low")).alias("fatalities_low"),
        count_value(F.col("high")).alias("fatalities_high"),
        count_value(F.col("deaths_civilians")).alias("deaths_civilians"),
        "conflict_name",
    )


def pair_exclusions(events: DataFrame, names: Sequence[tuple[str, str]] = GOVERNMENT_NAMES) -> DataFrame:
    """One row that accounts for every event: retained, non-state, or not mapped to two states."""
    sided = with_sides(events, names).withColumn("_pairs", F.size(_unequal_pairs()))
    candidate, retained = F.col("is_candidate"), F.col("_pairs") > 0
    return sided.agg(
        F.count(F.lit(1)).alias("total_events_processed"),
        F.count_if(candidate).alias("bilateral_candidate_events"),
        F.count_if(retained).alias("bilateral_events_retained"),
        F.coalesce(F.sum("_pairs"), F.lit(0)).alias("bilateral_dyad_observations_extracted"),
        F.count_if(~candidate).alias("intrastate_civil_events_excluded"),
        F.count_if(candidate & ~retained).alias("unmapped_events_excluded"),
        F.count_if(~retained).alias("total_excluded_records"),
    )


def news_pairs(articles: DataFrame) -> DataFrame:
    """Directed pairs publisher -> target by month; never reversed, never within one country."""
    valid = articles.filter(F.col(SOURCE).isNotNull() & F.col(TARGET).isNotNull() & (F.col(SOURCE) != F.col(TARGET)))
    grouped = valid.groupBy(SOURCE, TARGET, "year_month").agg(
        F.count("article_id").alias("news_article_count"),
        F.avg("tone_score").alias("news_avg_tone"),
        F.count_if("is_negative_tone").alias("news_negative_tone_count"),
        F.count_if("is_conflict_relevant").alias("news_conflict_article_count"),
    )
    total = F.col("news_article_count")

    def part(name: str) -> Column:
        return F.coalesce(F.try_divide(F.col(name), total), F.lit(0.0))

    return grouped.withColumns(
        {
            "is_directed": F.lit(True),
            "relationship_nature": F.lit(pairs.NEWS),
            "news_negative_tone_share": part("news_negative_tone_count"),
            "news_conflict_ratio": part("news_conflict_article_count"),
        }
    )


def conflict_totals(pair_events: DataFrame) -> DataFrame:
    """Event count and sums by unordered pair, over all time."""
    sums = [F.sum(c).alias(total) for total, c in CONFLICT_MEASURES.items()]
    return pair_events.groupBy(
        F.col("country_a_iso3").alias("pair_a"), F.col("country_b_iso3").alias("pair_b")
    ).agg(F.count("event_id").alias("conflict_events_total"), *sums)


def news_totals(monthly: DataFrame, tone: str = "monthly_mean") -> DataFrame:
    """Directed pairs over all time, from their months.

    ``tone``: "monthly_mean" is the plain mean of monthly means, "weighted" weighs each month
    by its articles.
    """
    mean = {
        "monthly_mean": F.avg("news_avg_tone"),
        "weighted": F.sum(F.col("news_avg_tone") * F.col("news_article_count")) / F.sum("news_article_count"),
    }[tone]
    grouped = monthly.groupBy(SOURCE, TARGET).agg(
        F.sum("news_article_count").alias("news_article_count"),
        mean.alias("news_avg_tone"),
        F.sum("news_negative_tone_count").alias("news_negative_tone_count"),
        F.sum("news_conflict_article_count").alias("news_conflict_article_count"),
    )
    count = F.greatest(F.col("news_article_count"), F.lit(1))
    return grouped.withColumns(
        {
            "news_negative_tone_share": F.col("news_negative_tone_count") / count,
            "news_conflict_ratio": F.col("news_conflict_article_count") / count,
        }
    )


CUMULATIVE_COLUMNS = (
    SOURCE, TARGET, "is_directed", "relationship_nature", "period_type", "has_historical_conflict",
    "conflict_events_total", *CONFLICT_MEASURES, "news_article_count", "news_avg_tone",
    "news_negative_tone_count", "news_negative_tone_share", "news_conflict_article_count",
    "news_conflict_ratio", "composite_tension_index",
)


def cumulative_dyads(pair_events: DataFrame, articles: DataFrame, *, tone: str = "monthly_mean") -> DataFrame:
    """All-time pair table: directed news, undirected conflict, or both (hybrid).

    One full outer join on the unordered pair does the work of three: a conflict is attached
    to each direction that has news, and is kept alone when none has.
    """
    a, b = pairs.canonical(F.col(SOURCE), F.col(TARGET))
    news = news_totals(news_pairs(articles), tone).withColumns({"pair_a": a, "pair_b": b})
    joined = conflict_totals(pair_events).join(news, ["pair_a", "pair_b"], "full")
    has_conflict = F.col("conflict_events_total").isNotNull()
    has_news = F.col(SOURCE).isNotNull()
    zero = ["conflict_events_total", "news_article_count", "news_negative_tone_count", "news_conflict_article_count"]
    zero_double = [*CONFLICT_MEASURES, "news_negative_tone_share", "news_conflict_ratio"]
    named = joined.withColumns(
        {
            "relationship_nature": pairs.relationship_nature(has_conflict, has_news),
            "is_directed": has_news,
            "has_historical_conflict": has_conflict,
            "period_type": F.lit("cumulative_historical"),
        }
    ).withColumns({SOURCE: F.coalesce(SOURCE, "pair_a"), TARGET: F.coalesce(TARGET, "pair_b")})
    filled = named.na.fill(0, zero).na.fill(0.0, zero_double)
    tension = pairs.composite_tension(
        F.col("fatalities_best_total"),
        F.col("conflict_events_total"),
        F.col("news_article_count"),
        F.col("news_avg_tone"),
        F.col("news_conflict_article_count"),
    )
    return filled.withColumn("composite_tension_index", tension).select(*CUMULATIVE_COLUMNS)


def by_tension(dyads: DataFrame) -> DataFrame:
    """Strongest tension first; names break ties."""
    return dyads.orderBy(F.desc("composite_tension_index"), SOURCE, TARGET)


def monthly_dyads(pair_events: DataFrame, articles: DataFrame) -> DataFrame:
    """Pair x month table with tension of the month and lags over the pair's observed months."""
    conflict = pair_events.groupBy(
        F.col("country_a_iso3").alias(SOURCE), F.col("country_b_iso3").alias(TARGET), "year_month"
    ).agg(
        F.count("event_id").alias("conflict_events_monthly"),
        F.sum("fatalities_best").alias("fatalities_best_monthly"),
    )
    news = news_pairs(articles).select(
        SOURCE,
        TARGET,
        "year_month",
        F.col("news_article_count").alias("news_article_count_monthly"),
        F.col("news_avg_tone").alias("news_avg_tone_monthly"),
        F.col("news_conflict_article_count").alias("news_conflict_count_monthly"),
    )
    joined = conflict.join(news, [SOURCE, TARGET, "year_month"], "full")
    has_conflict = F.coalesce(F.col("conflict_events_monthly") > 0, F.lit(False))
    has_news = F.coalesce(F.col("news_article_count_monthly") > 0, F.lit(False))
    named = joined.withColumns(
        {
            "is_directed": has_news,
            "relationship_nature": pairs.relationship_nature(has_conflict, has_news),
        }
    )
    counts = ["conflict_events_monthly", "news_article_count_monthly", "news_conflict_count_monthly"]
    filled = named.na.fill(0, counts).na.fill(0.0, ["fatalities_best_monthly"])
    tension = pairs.composite_tension(
        F.col("fatalities_best_monthly"),
        F.col("conflict_events_monthly"),
        F.col("news_article_count_monthly"),
        F.col("news_avg_tone_monthly"),
        F.col("news_conflict_count_monthly"),
    )
    scored = filled.withColumn("monthly_tension_index", tension)
    w = timeline([SOURCE, TARGET], "year_month")
    return scored.select(
        SOURCE,
        TARGET,
        "is_directed",
        "relationship_nature",
        "year_month",
        "conflict_events_monthly",
        "fatalities_best_monthly",
        "news_article_count_monthly",
        "news_avg_tone_monthly",
        "news_conflict_count_monthly",
        "monthly_tension_index",
        lagged("monthly_tension_index", 1, w).alias("monthly_tension_lag_1m"),
        lagged("conflict_events_monthly", 1, w).alias("conflict_events_lag_1m"),
        lagged("news_article_count_monthly", 1, w).alias("news_count_lag_1m"),
        rolling("conflict_events_monthly", "sum", before(w, 3), rows=3).alias("conflict_events_prior_sum_3m"),
    )
