"""Registered queries: every operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelgraph.fixed_values import STRESS_SENSITIVITIES
from panelgraph.functions.numbers import clip
from panelgraph.operators import articles as art
from panelgraph.operators import clean, dyads, features, graph, impact, panel, quality, scoring
from panelgraph.plans import views
from panelgraph.plans.flows import what_if
from panelgraph.session import cut
from panelgraph.sources import sinks
from panelgraph.streaming import articles as live
from panelgraph.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]


def shown(df: DataFrame, digits: int = 9, *, counts: tuple[str, ...] = ()) -> DataFrame:
    """Comparable output: rounded doubles without negative zero, long counts, dates as text."""
    out = []
    for field in df.schema.fields:
        c, kind = F.col(field.name), field.dataType.typeName()
        if kind == "double":
            # rounding goes through decimals; a whole number is what it gives already
            c = F.when(c == F.rint(c), c).otherwise(F.round(c, digits)) + F.lit(0.0)
        elif kind in ("integer", "long"):
            c = c.cast("long")
        elif kind == "date":
            c = c.cast("string")
        elif kind == "timestamp":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(field.name))
    return df.select(*out)


def nullable_as_double(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("double") for n in names})


# --- events -------------------------------------------------------------------------------


def events_clean(spark, d):
    codes, names = views.code_tables(spark, d)
    cleaned = clean.clean_events(views.raw_events(spark, d), order=F.col("ingest_order"), codes=codes, names=names)
    return shown(cleaned.withColumn("country_id", F.col("country_id").cast("double")))


def events_unmapped(spark, d):
    return shown(clean.unmapped_countries(views.raw_events(spark, d), *views.code_tables(spark, d)))


def event_monthly_totals(spark, d):
    return shown(panel.monthly_event_totals(views.order_events(spark, d)))


def event_panel(spark, d):
    return shown(panel.event_panel(views.order_events(spark, d)))


def event_panel_years(spark, d):
    return shown(panel.event_panel(views.order_events(spark, d), min_year=1997, max_year=1999))


def event_features(spark, d):
    return shown(views.order_features(spark, d))


def event_features_customer(spark, d):
    return shown(views.order_features(spark, d, "customer"))


def event_panel_metadata(spark, d):
    table = sinks.panel_metadata(panel.event_panel(views.order_events(spark, d)))
    return shown(table.withColumn("feature_columns", F.array_join("feature_columns", ",")))


# --- articles -----------------------------------------------------------------------------


def articles_normalized(spark, d):
    return shown(views.normal_articles(spark, d).drop("title", "url").withColumn("year", F.col("year").cast("long")))


def articles_targets_joined(spark, d):
    """The entities of the titles again, with the gazetteer as a table that is joined."""
    articles = cut(views.normal_articles(spark, d).drop("target_country_iso3", "target_country_confidence"))
    terms = spark.createDataFrame([(t, c, i) for i, (t, c) in enumerate(views.TERMS)], "term string, iso3 string, ord int")
    return shown(art.with_target_by_join(articles, terms).select("article_id", "target_country_iso3", "target_country_confidence"))


def articles_scored(spark, d):
    scored = views.scored_articles(spark, d)
    return shown(
        scored.select(
            "article_id", "target_country_iso3", "is_conflict_relevant", "conflict_category_count",
            "primary_conflict_category", *[f"cat_{c}" for c in views.CATEGORIES], "tone_score",
            "is_negative_tone", "is_extreme_tone", "conflict_intensity",
        )
    )


def articles_relevance(spark, d):
    return shown(art.relevance_share(views.scored_articles(spark, d)))


def news_panel(spark, d):
    refs = views.nodes(spark, d)
    # only what the panel reads is scored and written: no texts, no intensity
    return shown(panel.news_panel(cut(views.scored_articles(spark, d).select(*panel.NEWS_INPUTS)), entities=refs))


def news_features(spark, d):
    df = features.news_features(panel.news_panel(views.reports(spark, d)))
    whole = [c for c in df.columns if "lag" in c or "prior" in c or "rolling" in c or c.startswith("delta")]
    return shown(nullable_as_double(df, *whole))


def news_panel_by_publisher(spark, d):
    """No article has a target: publishers stand in for all of them."""
    blind = views.reports(spark, d).withColumn("target_country_iso3", F.lit(None).cast("string"))
    return shown(panel.news_panel(blind))


def panels_joinable(spark, d):
    return shown(panel.joinable_keys(panel.event_panel(views.order_events(spark, d)), views.report_panel(spark, d)))


# --- pairs --------------------------------------------------------------------------------


def state_pairs(spark, d):
    return shown(dyads.state_pairs(views.sided_events(spark, d), views.GOVERNMENTS))


def pair_exclusions(spark, d):
    return shown(dyads.pair_exclusions(views.sided_events(spark, d), views.GOVERNMENTS))


def news_pairs_monthly(spark, d):
    return shown(dyads.news_pairs(views.reports(spark, d)))


def news_pairs_total(spark, d):
    return shown(dyads.news_totals(dyads.news_pairs(views.reports(spark, d))))


def news_pairs_weighted(spark, d):
    return shown(dyads.news_totals(dyads.news_pairs(views.reports(spark, d)), "weighted"))


def conflict_pairs_total(spark, d):
    return shown(dyads.conflict_totals(dyads.state_pairs(views.sided_events(spark, d), views.GOVERNMENTS)))


def dyads_cumulative(spark, d):
    return shown(views.pair_table(spark, d))


def dyads_by_supplier(spark, d):
    """The directed pairs again at a finer grain: single suppliers reporting about nations."""
    lines = views.table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_discount", "l_returnflag", "l_shipdate")
    orders = views.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    customers = views.table(spark, d, "customer").select("c_custkey", "c_nationkey")
    tone = 1 - 20 * F.col("l_discount")
    placed = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    rows = lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
    articles = rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("article_id"),
        F.concat(F.lit("S"), "l_suppkey").alias("source_country_iso3"),
        F.concat(F.lit("N"), "c_nationkey").alias("target_country_iso3"),
        F.date_format("l_shipdate", "yyyy-MM").alias("year_month"),
        tone.alias("tone_score"),
        (tone < -0.2).alias("is_negative_tone"),
        (F.col("l_returnflag") == "R").alias("is_conflict_relevant"),
    )
    none = spark.createDataFrame([], dyads.state_pairs(views.sided_events(spark, d), views.GOVERNMENTS).schema)
    kept = ["source_country_iso3", "target_country_iso3", "relationship_nature", "news_article_count", "news_avg_tone", "composite_tension_index"]
    return shown(dyads.cumulative_dyads(none, articles).select(*kept))


def dyads_strongest(spark, d):
    """Top ten of the tension report."""
    top = dyads.by_tension(views.pair_table(spark, d).withColumn("composite_tension_index", F.round("composite_tension_index", 9)))
    return shown(top.limit(10).select("source_country_iso3", "target_country_iso3", "composite_tension_index"))


def dyads_monthly(spark, d):
    df = dyads.monthly_dyads(dyads.state_pairs(views.sided_events(spark, d), views.GOVERNMENTS), views.reports(spark, d))
    return shown(nullable_as_double(df, "conflict_events_lag_1m", "news_count_lag_1m", "conflict_events_prior_sum_3m"))


# --- graph --------------------------------------------------------------------------------


def node_degrees(spark, d):
    return shown(graph.node_degrees(views.nodes(spark, d), views.pair_table(spark, d), digits=9))


def node_ranks(spark, d):
    pairs_ = cut(views.pair_table(spark, d))
    steps = graph.transitions(
        graph.with_edge_defaults(pairs_, "composite_tension_index"), graph.baseline_back_weight(F.col("weight"))
    )
    return shown(graph.pagerank(views.nodes(spark, d), steps))


def node_ranks_converged(spark, d):
    """Ranks as a multiple of the mean rank, by the default stop rule."""
    metrics = graph.node_metrics(views.nodes(spark, d), cut(views.pair_table(spark, d)), rank_digits=12)
    n = views.nodes(spark, d).select("country_iso3").distinct().agg(F.count("*")).scalar()
    return shown(metrics.select("country_iso3", (F.col("pagerank_centrality") * n).alias("pagerank_centrality")), 8)


def trade_ranks(spark, d):
    """PageRank of the trade graph: supplier -> customer by quantity, customer -> supplier by lines."""
    lines = views.table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_returnflag")
    orders = views.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    customer, supplier = F.concat(F.lit("C"), "o_custkey"), F.concat(F.lit("S"), "l_suppkey")
    sold = joined.select(supplier.alias("src"), customer.alias("dst"), F.col("l_quantity").alias("weight"))
    returned = joined.filter(F.col("l_returnflag") == "R").select(
        customer.alias("src"), supplier.alias("dst"), F.lit(1.0).alias("weight")
    )
    known = views.table(spark, d, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("country_iso3")).unionByName(
        views.table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("country_iso3"))
    )
    return shown(graph.pagerank(known, sold.unionByName(returned)))


def graph_links(spark, d):
    return shown(graph.graph_links(views.pair_table(spark, d), digits=9))


def graph_nodes(spark, d):
    metrics = graph.node_metrics(views.nodes(spark, d), cut(views.pair_table(spark, d)), digits=9, rank_digits=9)
    return shown(graph.graph_nodes(metrics))


def graph_summary(spark, d):
    pairs_ = cut(views.pair_table(spark, d))
    return shown(graph.graph_summary(graph.node_degrees(views.nodes(spark, d), pairs_), pairs_))


# --- what-if ------------------------------------------------------------------------------


def _baseline(spark, d):
    pairs_ = cut(views.pair_table(spark, d))
    metrics = graph.node_metrics(views.nodes(spark, d), pairs_, digits=9, rank_digits=9)
    news = impact.baseline_month(cut(views.report_panel(spark, d)), "1998-06")
    return pairs_, cut(impact.baseline_nodes(metrics, news))


def scenarios_checked(spark, d):
    checked = impact.check_scenarios(views.scenarios(spark), views.nodes(spark, d), views.pair_table(spark, d))
    return checked.select("scenario_id", F.array_join("reasons", "; ").alias("reasons"), "edge_matched")


def news_baseline_month(spark, d):
    """A month that does not exist falls back to the latest one."""
    month = impact.baseline_month(views.report_panel(spark, d), "2030-01")
    return shown(month.select("country_iso3", "year_month", "news_count_total", "avg_tone", "escalation_signal"))


def _valid(spark, d, pairs_):
    return impact.valid_scenarios(impact.check_scenarios(views.scenarios(spark), views.nodes(spark, d), pairs_))


def impact_targets(spark, d):
    pairs_, nodes = _baseline(spark, d)
    return shown(impact.shocked_targets(_valid(spark, d, pairs_), nodes))


def impact_shocked_edges(spark, d):
    pairs_ = cut(views.pair_table(spark, d))
    return shown(impact.shocked_edges(_valid(spark, d, pairs_), pairs_))


def _propagated(spark, d):
    pairs_ = cut(views.pair_table(spark, d))
    valid = _valid(spark, d, pairs_)
    shocked = cut(impact.shocked_edges(valid, pairs_))
    return (pairs_, valid, shocked, *impact.propagate(valid, views.nodes(spark, d), pairs_, shocked))


def impact_node_arrivals(spark, d):
    arrived = _propagated(spark, d)[3]
    return shown(arrived.groupBy("scenario_id", "node").agg(F.sum("tone_shift").alias("tone_shift"), F.min("hop").alias("hop")))


def impact_deep_arrivals(spark, d):
    """Nodes reached over up to four hops of a sparse graph, and what reaches them."""
    pairs_, nodes = cut(views.bulk_pairs(spark, d)), views.bulk_nodes(spark, d)
    chosen = impact.with_scenario_defaults(spark.createDataFrame(views.BULK_SCENARIOS, views.SCENARIO_DDL))
    arrived, _ = impact.propagate(chosen, nodes, pairs_, cut(impact.shocked_edges(chosen, pairs_)))
    return shown(arrived.groupBy("scenario_id", "node").agg(F.sum("tone_shift").alias("tone_shift"), F.min("hop").alias("hop")))


def impact_dyads(spark, d):
    pairs_, valid, shocked, _, shifts = _propagated(spark, d)
    edges = impact.counterfactual_edges(valid, pairs_, shocked, shifts)
    return shown(edges)


def _what_if(spark, d):
    pairs_ = cut(views.pair_table(spark, d))
    metrics = graph.node_metrics(views.nodes(spark, d), pairs_, digits=9, rank_digits=9)
    return what_if(
        views.scenarios(spark), cut(metrics), pairs_, cut(views.report_panel(spark, d)), month="1998-06", digits=9, rank_digits=9
    )


def impact_countries(spark, d):
    return shown(
        _what_if(spark, d)["countries"].select(
            "scenario_id", "country_iso3", "is_direct_target", "ripple_hop",
            "counterfactual_tone",
            "counterfactual_conflict_news_count",
            "counterfactual_escalation_signal",
            "counterfactual_pagerank",
            "counterfactual_in_degree", "counterfactual_out_degree", "counterfactual_total_degree",
            "counterfactual_weighted_in",
            "counterfactual_weighted_out", "baseline_pagerank", "delta_tone", "delta_escalation_signal", "delta_pagerank",
            "delta_weighted_in", "delta_weighted_out", "delta_conflict_news_count", "delta_in_degree", "delta_out_degree", "delta_total_degree",
        )
    )


def impact_summary(spark, d):
    return shown(_what_if(spark, d)["summary"])


# --- quality ------------------------------------------------------------------------------


def quality_events(spark, d):
    codes, names = views.code_tables(spark, d)
    events = clean.clean_events(views.raw_events(spark, d), order=F.col("ingest_order"), codes=codes, names=names)
    return shown(
        quality.check(
            events,
            quality.rows_rule(),
            quality.null_rules(["country_iso3", "latitude"]),
            quality.finite_rules(events.select("best", "high", "low", "deaths_civilians")),
            quality.bound_rules({"latitude": (-90, 90), "longitude": (-180, 180)}),
        )
    )


def quality_graph(spark, d):
    pairs_ = cut(views.pair_table(spark, d))
    nodes = views.nodes(spark, d)
    ends = pairs_.select(F.col("source_country_iso3").alias("country_iso3"))
    return shown(
        quality.stack_checks(
            quality.has_columns(pairs_, ["composite_tension_index", "gone"]),
            quality.check(pairs_, quality.loop_rule(), quality.bound_rules({"composite_tension_index": (0.0, 1.0), "news_avg_tone": (-1.0, 1.0)})),
            quality.same_keys(ends, nodes, ["country_iso3"]),
            quality.same_count(pairs_, nodes, "as many pairs as nodes"),
            quality.conserved(graph.node_metrics(nodes, pairs_, rank_digits=12), "pagerank_centrality"),
        )
    )


def quality_news(spark, d):
    df = cut(features.news_features(panel.news_panel(views.reports(spark, d))))
    checks = quality.stack_checks(
        quality.boolean_columns(df, ["is_partial_month", "year"]),
        quality.missing_history_kept(df, {"conflict_news_lag_3m": 3, "avg_tone_lag_12m": 12}, "country_iso3", "month_start"),
        quality.joinable(df, panel.event_panel(views.order_events(spark, d)), ["country_iso3", "year_month"]),
        quality.finite_numbers(df.select("avg_tone", "avg_tone_lag_1m"), allow_null=None),
    )
    return shown(checks)


# --- scoring ------------------------------------------------------------------------------


def _records(spark, d):
    """Records with different columns stacked by name."""
    customers = views.table(spark, d, "customer").select(F.col("c_mktsegment").alias("country"), F.col("c_acctbal").cast("string").alias("fatalities"))
    parts = views.table(spark, d, "part").select(F.col("p_brand").alias("country"), F.col("p_size").cast("string").alias("fatalities"), "p_type")
    suppliers = views.table(spark, d, "supplier").select(F.col("s_name").alias("country"))
    stacked = customers.unionByName(parts, allowMissingColumns=True).unionByName(suppliers, allowMissingColumns=True)
    return stacked


def entity_totals(spark, d):
    return shown(scoring.entity_totals(_records(spark, d)), 4)


def entity_warnings(spark, d):
    """Forest scores per customer: events and summed value of their orders in thousands."""
    totals = _classifier_totals(spark, d)
    return shown(scoring.score(scoring.train_classifier(totals), totals))


def classifier_split(spark, d):
    """Entities and labels on either side of the split."""
    totals = _classifier_totals(spark, d)
    return shown(totals.groupBy("is_train", "escalation_warning").agg(F.count(F.lit(1)).alias("entities"), F.sum("recent_events").alias("events")))


def feature_importances(spark, d):
    """Accuracy on the held-out customers that is lost when a feature's values are dealt to other customers."""
    totals = _classifier_totals(spark, d)
    table = scoring.permutation_importances(scoring.train_classifier(totals), totals.filter(~F.col("is_train")))
    return shown(scoring.top_importances(table))


def _classifier_totals(spark, d):
    orders = views.table(spark, d, "orders").select(
        F.col("o_custkey").alias("country"), (F.col("o_totalprice") / 40000).alias("fatalities")
    )
    return cut(scoring.with_split(scoring.entity_totals(orders)))


def pair_status(spark, d):
    """Severity bands over 100 x tension, for every banded domain."""
    pairs_ = views.pair_table(spark, d)
    domains = F.array(*[F.lit(x) for x in ("conflict", "economy", "energy", "global_impact", "overview", "hotspot")])
    scores = pairs_.select(
        "source_country_iso3", "target_country_iso3", F.round(100 * F.col("composite_tension_index"), 4).alias("score"),
        F.explode(domains).alias("domain"),
    )
    return shown(scoring.with_status(scores))


def pair_sub_scores(spark, d):
    scores = scoring.pair_bases(views.pair_table(spark, d)).select("pair_a", "pair_b", F.col("conflict").alias("score"))
    return shown(scoring.sub_scores(scores))


def contribution_split(spark, d):
    """Months whose change raised or lowered an entity's fatalities."""
    changes = views.order_features(spark, d).select("country_iso3", "year_month", F.col("delta_fatalities_1m").alias("contribution"))
    raising, lowering = scoring.split_contributions(changes)
    both = raising.withColumn("direction", F.lit("up")).unionByName(lowering.withColumn("direction", F.lit("down")))
    return shown(both.groupBy("country_iso3", "direction").agg(F.count(F.lit(1)).alias("months"), F.sum("contribution").alias("total")))


def risk_outlook(spark, d):
    return shown(scoring.outlook(scoring.pair_bases(views.pair_table(spark, d))))


def risk_outlook_fan(spark, d):
    return shown(scoring.outlook_fan(scoring.outlook(scoring.pair_bases(views.pair_table(spark, d)), domains=["escalation"])))


def risk_outlook_drivers(spark, d):
    scores = scoring.outlook(scoring.pair_bases(views.pair_table(spark, d)))
    return shown(scoring.outlook_drivers(scores, ["conflict", "energy"]).drop("status"))


def factor_stress(spark, d):
    """Stress under each entity-month's own growth rates as shocks."""
    df = views.order_features(spark, d)
    scale = {"gpr": 100.0, "oil": 10.0, "gold": 5.0, "fx": 1.0}
    source = {"gpr": "growth_rate_fatalities_1m", "oil": "growth_rate_events_1m", "gold": "momentum_fatalities_log_1m", "fx": "momentum_events_log_1m"}
    shocks = df.select(
        "country_iso3", "year_month",
        *[clip(F.round(F.col(source[f]), 4) * scale[f], -100.0, 100.0).alias(f) for f, *_ in STRESS_SENSITIVITIES],
    )
    out = scoring.factor_stress(shocks)
    return shown(out.select(
        "country_iso3", "year_month", "net_return_forecast", "downside_probability", "upside_probability", "projected_level", "point_change",
        *[f"{f}_impact" for f, *_ in STRESS_SENSITIVITIES],
    ), 2)


# --- files and streams --------------------------------------------------------------------


def _landed(spark, d):
    """The raw articles as packed JSON files of some thousand rows in the shared folder, as a collector would land them."""
    from uuid import uuid4

    from panelgraph.session import shared_folder

    base = f"{shared_folder(spark)}/panelgraph/{uuid4().hex}"
    raw = views.raw_articles(spark, d).drop("kind", "number")
    raw.write.option("maxRecordsPerFile", 5000).option("compression", "gzip").json(f"{base}/raw")
    return base


def _followed(spark, d):
    """Articles stored by the stream, then unique articles and counts kept up in several batches."""
    base = _landed(spark, d)
    enriched = live.enrich_stream(live.stream_raw_articles(spark, f"{base}/raw"), gazetteer=views.TERMS, taxonomy=views.CATEGORIES, valences=views.WORDS)
    incremental.store_articles(enriched, base, span="month").awaitTermination()
    files = len(spark.read.parquet(f"{base}/articles").inputFiles())
    incremental.follow_articles(spark, base, max_files=files // 2 + 1, span="month").awaitTermination()
    return base


def stream_daily_counts(spark, d):
    """All days of the enriched article stream, each article once."""
    return shown(incremental.daily_counts(spark.read.parquet(f"{_followed(spark, d)}/domain_counts")))


def stream_monthly_counts(spark, d):
    """Months merged from the days' counts; a domain of several days counts once."""
    return shown(incremental.monthly_counts(spark.read.parquet(f"{_followed(spark, d)}/domain_counts")))


def stream_unique_articles(spark, d):
    """Article ids that are left once copies and repeated titles of a day are gone."""
    return shown(spark.read.parquet(f"{_followed(spark, d)}/unique").select("article_id"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        events_clean, events_unmapped, event_monthly_totals, event_panel, event_panel_years, event_features,
        event_features_customer, event_panel_metadata, articles_normalized, articles_targets_joined, articles_scored, articles_relevance,
        news_panel, news_features, news_panel_by_publisher, panels_joinable, state_pairs, pair_exclusions,
        news_pairs_monthly, news_pairs_total, news_pairs_weighted, conflict_pairs_total, dyads_cumulative,
        dyads_by_supplier, dyads_strongest, dyads_monthly, node_degrees, node_ranks, node_ranks_converged,
        trade_ranks, graph_links, graph_nodes, graph_summary, scenarios_checked, news_baseline_month,
        impact_targets, impact_shocked_edges, impact_node_arrivals, impact_deep_arrivals, impact_dyads, impact_countries,
        impact_summary, quality_events, quality_graph, quality_news, entity_totals, entity_warnings,
        feature_importances, pair_status, pair_sub_scores, contribution_split, risk_outlook, risk_outlook_fan,
        risk_outlook_drivers, factor_stress, classifier_split, stream_daily_counts, stream_monthly_counts,
        stream_unique_articles,
    )
}
