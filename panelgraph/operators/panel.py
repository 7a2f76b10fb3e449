"""Balanced entity x month panels.

A panel is made by filling gaps, not by a cross join: each entity's observed months are
walked once in order and every row also emits the silent months up to the next one. That
needs one shuffle by entity, which the feature windows then reuse.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelgraph.fixed_values import ESCALATION_WEIGHTS, VIOLENCE_TYPES
from panelgraph.functions.dates import is_partial_month, month_start, year_month
from panelgraph.functions.numbers import clip, share
from panelgraph.session import cut

ENTITY, MONTH = "country_iso3", "month_start"

EVENT_METRICS = (
    "events_total", "fatalities_best_total", "fatalities_low_total", "fatalities_high_total",
    "fatalities_civilian_total", "events_state_based", "fatalities_state_based", "events_non_state",
    "fatalities_non_state", "events_one_sided", "fatalities_one_sided",
)
NEWS_COUNTS = (
    "news_count_total", "unique_domains_count", "negative_tone_count", "extreme_tone_count",
    "conflict_news_count", "military_escalation_count", "armed_conflict_count", "ceasefire_peace_count",
    "sanctions_count",
)
NEWS_TONES = ("avg_tone", "conflict_news_avg_tone")
NEWS_CATEGORIES = {
    "military_escalation_count": "cat_military_escalation",
    "armed_conflict_count": "cat_armed_conflict",
    "ceasefire_peace_count": "cat_ceasefire_peace",
    "sanctions_count": "cat_sanctions_economic",
}


def fill_panel(
    monthly: DataFrame,
    low: Column,
    high: Column,
    zero: Mapping[str, object],
    *,
    entity: str = ENTITY,
    month: str = MONTH,
    entities: DataFrame | None = None,
) -> DataFrame:
    """One row per entity and month from ``low`` to ``high``; silent months get ``zero`` values.

    ``monthly`` has at most one row per entity and month. Entities whose months all lie
    outside the range, and the extra ``entities``, appear with silent months only.
    """
    rows = monthly.select(entity, month, *zero).withColumns({"_low": low, "_high": high})
    if entities is not None:
        extra = entities.select(entity).distinct().withColumns({"_low": low, "_high": high})
        rows = rows.unionByName(extra.withColumn(month, F.lit(None).cast("date")), allowMissingColumns=True)
    # Rows outside the range become anchors just before it: they only bring the entity in.
    inside = F.coalesce(F.col(month).between(F.col("_low"), F.col("_high")), F.lit(False))
    rows = rows.withColumns(
        {"_inside": inside, "_at": F.when(inside, F.col(month)).otherwise(F.add_months("_low", -1))}
    )
    walk = Window.partitionBy(entity).orderBy("_at")
    rows = rows.withColumns(
        {
            "_from": F.when(F.lag("_at").over(walk).isNull() | ~F.col("_inside"), F.col("_low")).otherwise(F.col("_at")),
            "_to": F.coalesce(F.add_months(F.lead("_at").over(walk), -1), F.col("_high")),
        }
    )
    months = F.when(
        F.col("_from") <= F.col("_to"), F.sequence("_from", "_to", F.expr("interval 1 month"))
    ).otherwise(F.array().cast("array<date>"))
    filled = rows.withColumn("_month", F.explode(months))
    observed = F.col("_inside") & (F.col("_month") == F.col("_at"))
    values = [F.when(observed, F.coalesce(F.col(c), F.lit(z))).otherwise(F.lit(z)).alias(c) for c, z in zero.items()]
    return filled.select(
        entity,
        F.col("_month").alias(month),
        F.year("_month").alias("year"),
        F.month("_month").alias("month"),
        year_month(F.col("_month")).alias("year_month"),
        *values,
    )


def monthly_event_totals(events: DataFrame, entity: str = ENTITY) -> DataFrame:
    """Counts and sums per entity and month, in total and per violence type, in one pass."""
    measures = [
        F.count("id").alias("events_total"),
        F.sum("best").alias("fatalities_best_total"),
        F.sum("low").alias("fatalities_low_total"),
        F.sum("high").alias("fatalities_high_total"),
        F.sum("deaths_civilians").alias("fatalities_civilian_total"),
    ]
    for code, name in VIOLENCE_TYPES.items():
        of_type = F.col("type_of_violence") == code
        measures.append(F.count(F.when(of_type, F.col("id"))).alias(f"events_{name}"))
        measures.append(F.sum(F.when(of_type, F.col("best"))).alias(f"fatalities_{name}"))
    return events.groupBy(entity, month_start(F.col("event_date")).alias(MONTH)).agg(*measures)


def event_panel(
    events: DataFrame, *, min_year: int | None = None, max_year: int | None = None, entity: str = ENTITY
) -> DataFrame:
    """Clean events to a balanced entity x month panel in which silence is zero.

    The panel covers the years of all events, within ``min_year`` and ``max_year`` if given. Bounds come
    from the monthly totals, which are written once, so events are read once.
    """
    monthly = cut(monthly_event_totals(events, entity))
    year = F.year(MONTH)
    first, last = F.min(year), F.max(year)
    low = F.make_date(first if min_year is None else F.greatest(F.lit(min_year), first), F.lit(1), F.lit(1))
    high = F.make_date(last if max_year is None else F.least(F.lit(max_year), last), F.lit(12), F.lit(1))
    bounds = monthly.agg(F.struct(low.alias("low"), high.alias("high")).alias("bounds")).scalar()
    known = monthly.filter(F.col(entity).isNotNull())
    zero = {c: 0 if c.startswith("events") else 0.0 for c in EVENT_METRICS}
    panel = fill_panel(known, bounds["low"], bounds["high"], zero, entity=entity)
    return panel.withColumn("has_conflict_event", (F.col("events_total") > 0).cast("int"))


def outside_years(events: DataFrame, min_year: int | None, max_year: int | None) -> DataFrame:
    """How many events a panel of these years leaves out."""
    year = F.year("event_date")
    out = F.lit(False)
    if min_year is not None:
        out = out | (year < min_year)
    if max_year is not None:
        out = out | (year > max_year)
    return events.agg(F.count_if(out).alias("events_outside"))


#: What a panel reads of scored articles.
NEWS_INPUTS = (
    "article_id", "published_at_utc", "source_country_iso3", "target_country_iso3", "domain", "tone_score",
    "is_negative_tone", "is_extreme_tone", "is_conflict_relevant", *NEWS_CATEGORIES.values(),
)


def monthly_news_totals(articles: DataFrame, entity: Column) -> DataFrame:
    """Article counts, distinct domains, tones and category counts in one pass."""
    relevant = F.coalesce(F.col("is_conflict_relevant"), F.lit(False))
    measures = [
        F.count("article_id").alias("news_count_total"),
        F.countDistinct("domain").alias("unique_domains_count"),
        F.avg("tone_score").alias("avg_tone"),
        F.count_if("is_negative_tone").alias("negative_tone_count"),
        F.count_if("is_extreme_tone").alias("extreme_tone_count"),
        F.count(F.when(relevant, F.col("article_id"))).alias("conflict_news_count"),
        F.avg(F.when(relevant, F.col("tone_score"))).alias("conflict_news_avg_tone"),
    ]
    measures += [F.count_if(relevant & F.col(flag)).alias(name) for name, flag in NEWS_CATEGORIES.items()]
    measures += [F.min("published_at_utc").alias("first_at"), F.max("published_at_utc").alias("last_at")]
    at = month_start(F.col("published_at_utc")).alias(MONTH)
    return articles.select(entity.alias(ENTITY), at, "*").filter(F.col(ENTITY).isNotNull()).groupBy(ENTITY, MONTH).agg(*measures)


def with_news_signals(panel: DataFrame) -> DataFrame:
    """Ratios per article and the weighted escalation signal."""
    total = F.col("news_count_total")
    ratios = panel.withColumns(
        {
            "conflict_news_ratio": share(F.col("conflict_news_count"), total),
            "negative_tone_share": share(F.col("negative_tone_count"), total),
            "source_diversity": share(F.col("unique_domains_count"), total),
        }
    )
    w_conflict, w_negative, w_military = ESCALATION_WEIGHTS
    signal = (
        w_conflict * F.col("conflict_news_ratio")
        + w_negative * F.col("negative_tone_share")
        + w_military * share(F.col("military_escalation_count"), total)
    )
    return ratios.withColumn("escalation_signal", clip(signal, 0.0, 1.0))


def news_panel(articles: DataFrame, *, entities: DataFrame | None = None) -> DataFrame:
    """Scored articles to a balanced panel, from the first to the last observed month.

    ``entities`` (column country_iso3) joins the observed entities, so that the panel covers
    the same ones as another panel. Articles are read once: bounds come from the written monthly totals.
    """
    if "source_country_iso3" not in articles.columns:
        articles = articles.withColumn("source_country_iso3", F.lit(None).cast("string"))
    totals = cut(monthly_news_totals(articles, F.col("target_country_iso3")))
    if totals.isEmpty():  # no target at all: sources stand in
        totals = cut(monthly_news_totals(articles, F.col("source_country_iso3")))
    bounds = totals.agg(F.struct(F.min("first_at").alias("first"), F.max("last_at").alias("last")).alias("bounds")).scalar()
    zero = {c: 0 for c in NEWS_COUNTS} | {c: 0.0 for c in NEWS_TONES}
    panel = fill_panel(
        totals.drop("first_at", "last_at"), month_start(bounds["first"]), month_start(bounds["last"]), zero, entities=entities
    )
    partial = is_partial_month(F.col(MONTH), bounds["first"], bounds["last"])
    return with_news_signals(panel).withColumn("is_partial_month", partial)


def entity_set(df: DataFrame, entity: str = ENTITY) -> DataFrame:
    return df.select(entity).filter(F.col(entity).isNotNull()).distinct()


def joinable_keys(left: DataFrame, right: DataFrame, keys: Sequence[str] = (ENTITY, "year_month")) -> DataFrame:
    """How many panel keys two panels share (keys are unique on either side)."""
    shared = left.select(*keys).join(right.select(*keys), list(keys), "left_semi")
    return shared.agg(F.count(F.lit(1)).alias("overlapping_keys"))
