"""The four data flows end to end. Each writes its tables, then reports its quality gates."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelgraph import fixed_values as fv
from panelgraph.operators import articles as art
from panelgraph.operators import clean, dyads, features, graph, impact, panel, quality
from panelgraph.session import cut
from panelgraph.sources import sinks


def _prefixed(rules: quality.Rules, prefix: str) -> quality.Rules:
    return {prefix + name: rule for name, rule in rules.items()}


def _gated(*checks: DataFrame, stop: bool = True) -> DataFrame:
    """The rules of a flow, written once; a failed one stops the run unless ``stop`` is off."""
    stacked = cut(quality.stack_checks(*checks))
    if stop:
        quality.enforce(stacked)
    return stacked


def build_events(raw: DataFrame, folder: str, *, order: Column | None = None) -> DataFrame:
    """Raw event records -> events/, event_features/ and their metadata; returns the gates."""
    spark = raw.sparkSession
    order = order if order is not None else F.col("ingest_order")
    cleaned = clean.clean_events(raw, order=order)
    by_year = functools.partial(sinks.write_table, partition_by=["event_year"], sort_by=["event_date", "country_iso3"])
    event_checks = quality.write_checked(cleaned, f"{folder}/events", quality.rows_rule(), quality.null_rules(["country_iso3"]), write=by_year)
    events = spark.read.parquet(f"{folder}/events")
    table = features.month_as_text(features.event_features(panel.event_panel(events)))
    in_order = functools.partial(sinks.write_table, sort_by=["country_iso3", "month_start"])
    feature_checks = quality.write_checked(table, f"{folder}/event_features", _prefixed(quality.rows_rule(), "features "), quality.finite_rules(table), write=in_order)
    stored = spark.read.parquet(f"{folder}/event_features")
    sinks.write_metadata(
        sinks.panel_metadata(stored),
        f"{folder}/event_metadata",
        {"threshold_deaths_12m": fv.ACTIVE_THRESHOLD},
    )
    return _gated(event_checks, feature_checks)


def build_news(
    raw: DataFrame,
    folder: str,
    *,
    order: Column | None = None,
    entities: DataFrame | None = None,
    other_panel: DataFrame | None = None,
    gazetteer: Sequence[tuple[str, str]] = fv.GAZETTEER,
    taxonomy: Mapping[str, Sequence[str]] = fv.TAXONOMY,
    valences: Mapping[str, float] = fv.VALENCES,
    publishers: DataFrame | None = None,
    stop: bool = True,
) -> DataFrame:
    """Raw articles -> articles/, news_features/ and their metadata; returns the gates."""
    spark = raw.sparkSession
    order = order if order is not None else F.col("ingest_order")
    normal = art.normalize_articles(raw, order=order, gazetteer=gazetteer, publishers=publishers)
    sinks.write_table(art.score_articles(normal, taxonomy=taxonomy, valences=valences), f"{folder}/articles")
    scored = spark.read.parquet(f"{folder}/articles")
    table = features.month_as_text(features.news_features(panel.news_panel(scored, entities=entities)))
    sinks.write_table(table, f"{folder}/news_features", sort_by=["country_iso3", "month_start"])
    stored = spark.read.parquet(f"{folder}/news_features")
    sinks.write_metadata(sinks.panel_metadata(stored), f"{folder}/news_metadata")
    now = [*panel.NEWS_COUNTS, *panel.NEWS_TONES, "conflict_news_ratio", "negative_tone_share", "source_diversity", "escalation_signal"]
    checks = [
        quality.check(scored, quality.rows_rule(), quality.bound_rules({"tone_score": (-1.0, 1.0)})),
        quality.check(stored, quality.finite_rules(stored, allow_null=None), quality.null_rules(now)),
        quality.boolean_columns(stored, ["is_partial_month"]),
        quality.missing_history_kept(
            stored, {f"conflict_news_lag_{k}m": k for k in fv.LAGS}, "country_iso3", "month_start"
        ),
    ]
    if other_panel is not None:
        checks.append(quality.joinable(other_panel, stored, ["country_iso3", "year_month"]))
    return _gated(*checks, stop=stop)


def build_relationships(events: DataFrame, articles: DataFrame, nodes: DataFrame, folder: str) -> DataFrame:
    """Events and articles -> dyads/, node_metrics/, graph/ and metadata; returns the gates."""
    spark = events.sparkSession
    table = dyads.cumulative_dyads(dyads.state_pairs(events), articles)
    sinks.write_table(dyads.by_tension(table), f"{folder}/dyads")
    stored = spark.read.parquet(f"{folder}/dyads")
    sinks.write_table(graph.by_rank(graph.node_metrics(nodes, stored)), f"{folder}/node_metrics")
    metrics = spark.read.parquet(f"{folder}/node_metrics")
    sinks.write_graph(graph.graph_nodes(metrics), graph.graph_links(stored), f"{folder}/graph")
    excluded = dyads.pair_exclusions(events).select(F.struct("*").alias("x")).scalar()
    summary = graph.graph_summary(metrics, stored).withColumn("exclusions", excluded)
    sinks.write_metadata(summary, f"{folder}/graph_metadata")
    return _gated(
        quality.has_columns(stored, dyads.CUMULATIVE_COLUMNS),
        quality.check(stored, quality.loop_rule(), quality.bound_rules({"composite_tension_index": (0.0, 1.0)})),
        quality.check(metrics, quality.bound_rules({"in_degree": (0, None), "out_degree": (0, None)}), quality.sum_rule("pagerank_centrality")),
        quality.same_keys(metrics, nodes, ["country_iso3"]),
        quality.same_count(graph.graph_links(stored), stored, "one link per dyad"),
    )


def what_if(
    scenarios: DataFrame,
    metrics: DataFrame,
    dyad_table: DataFrame,
    news: DataFrame,
    *,
    month: str,
    archetypes: DataFrame | None = None,
    back: float = fv.HYBRID_BACK_COUNTERFACTUAL,
    max_iter: int = fv.PAGERANK_MAX_ITER,
    tol: float = fv.PAGERANK_TOL,
    digits: int = 4,
    rank_digits: int = 6,
) -> dict[str, DataFrame]:
    """Run a table of scenarios; returns countries, dyads, summary and rejected scenarios."""
    filled = impact.with_scenario_defaults(scenarios, archetypes)
    checked = cut(impact.check_scenarios(filled, metrics, dyad_table))
    valid = impact.valid_scenarios(checked)
    nodes = cut(impact.baseline_nodes(metrics, impact.baseline_month(news, month)))
    shocked = cut(impact.shocked_edges(valid, dyad_table))
    node_arrivals, edge_arrivals = impact.propagate(valid, nodes, dyad_table, shocked)
    edges = cut(impact.counterfactual_edges(valid, dyad_table, shocked, edge_arrivals))
    after = impact.counterfactual_metrics(
        valid, nodes, edges, back=back, max_iter=max_iter, tol=tol, digits=digits, rank_digits=rank_digits
    )
    countries = impact.country_impacts(valid, nodes, after, node_arrivals)
    return {
        "countries": countries,
        "dyads": edges,
        "summary": impact.impact_summary(valid, countries, edges),
        "rejected": impact.rejected_scenarios(checked),
    }


def build_what_if(
    scenarios: DataFrame, metrics: DataFrame, dyad_table: DataFrame, news: DataFrame, folder: str, *, month: str
) -> DataFrame:
    """Write scenario tables and graphs; returns the gates over all scenarios."""
    result = what_if(scenarios, metrics, dyad_table, news, month=month)
    spark = metrics.sparkSession
    for name in ("countries", "dyads", "rejected"):
        sinks.write_table(result[name], f"{folder}/{name}")
    countries, edges = spark.read.parquet(f"{folder}/countries"), spark.read.parquet(f"{folder}/dyads")
    valid = impact.with_scenario_defaults(scenarios)
    sinks.write_table(impact.impact_summary(valid, countries, edges), f"{folder}/summary")
    sinks.write_graph(impact.impact_graph_nodes(countries), impact.impact_graph_links(edges), f"{folder}/graph")
    ranks = countries.groupBy("scenario_id").agg(F.sum("counterfactual_pagerank").alias("rank_sum"))
    return _gated(
        quality.same_keys(countries, metrics, ["country_iso3"]),
        quality.in_bounds(ranks, {"rank_sum": (1 - 1e-3, 1 + 1e-3)}),
        quality.check(countries, quality.bound_rules({"counterfactual_tone": (-1.0, 1.0)} | {f"counterfactual_{d}_degree": (0, None) for d in ("in", "out", "total")})),
        quality.in_bounds(edges, {"counterfactual_tension_index": (0.0, 1.0)}),
    )
