"""Weighted relationship graph: half edges, node metrics, PageRank, node-link form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelgraph.fixed_values import (
    HYBRID_BACK_BASELINE,
    PAGERANK_ALPHA,
    PAGERANK_MAX_ITER,
    PAGERANK_TOL,
)
from panelgraph.functions import pairs
from panelgraph.operators.dyads import SOURCE, TARGET
from panelgraph.plans.pagerank import rank_nodes
from panelgraph.sources import dims

NODE = "country_iso3"
METRIC_COLUMNS = (
    NODE, "country_name", "in_degree", "out_degree", "total_degree", "weighted_in_degree",
    "weighted_out_degree", "conflict_adversary_count", "pagerank_centrality", "mean_incoming_tone",
    "mean_outgoing_tone", "mean_dyadic_tension", "has_active_edges",
)


def is_undirected() -> Column:
    return ~F.col("is_directed") | (F.col("relationship_nature") == pairs.UNDIRECTED)


def is_hybrid() -> Column:
    return ~is_undirected() & (F.col("relationship_nature") == pairs.HYBRID)


def baseline_back_weight(weight: Column) -> Column:
    """Weight of the way back on a hybrid edge: full with deaths, half without."""
    deaths = F.coalesce(F.col("fatalities_best_total"), F.lit(0.0))
    return F.when(deaths > 0, weight).otherwise(HYBRID_BACK_BASELINE * weight)


def with_edge_defaults(dyads: DataFrame, weight: str) -> DataFrame:
    """Dyads as typed edges: src, dst, weight, kind flags and tone, with defaults for gaps."""

    def column(name: str, default: object) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in dyads.columns else F.lit(default)

    tone = F.col("news_avg_tone") if "news_avg_tone" in dyads.columns else F.lit(None)
    return dyads.withColumns(
        {
            "src": F.col(SOURCE),
            "dst": F.col(TARGET),
            "weight": F.coalesce(F.col(weight).cast("double"), F.lit(0.0)),
            "is_directed": column("is_directed", True),
            "relationship_nature": column("relationship_nature", pairs.NEWS),
            "has_conflict": column("has_historical_conflict", False),
            "fatalities_best_total": column("fatalities_best_total", 0.0),
            "tone": tone.cast("double"),
        }
    )


def half_edges(edges: DataFrame, back: Column, *, group: tuple[str, ...] = ()) -> DataFrame:
    """Two rows per edge, one for each end, with what the edge adds to that end."""
    weight, none = F.col("weight"), F.lit(None).cast("double")
    mutual, hybrid = is_undirected(), is_hybrid()
    two_way = mutual | hybrid
    back_weight = F.when(mutual, weight).when(hybrid, back).otherwise(F.lit(0.0))
    one_if_two_way = two_way.cast("long")
    tone = F.when(~mutual, F.col("tone"))

    def end(node: str, partner: str, ins: Column, outs: Column, w_in: Column, w_out: Column, t_in: Column, t_out: Column):
        return F.struct(
            F.col(node).alias("node"),
            F.col(partner).alias("partner"),
            ins.alias("ins"),
            outs.alias("outs"),
            w_in.alias("w_in"),
            w_out.alias("w_out"),
            t_in.alias("tone_in"),
            t_out.alias("tone_out"),
        )

    one = F.lit(1).cast("long")
    halves = F.array(
        end("src", "dst", one_if_two_way, one, back_weight, weight, none, tone),
        end("dst", "src", one, one_if_two_way, weight, back_weight, tone, none),
    )
    return edges.select(*group, "weight", F.explode(halves).alias("_h")).select(*group, "weight", "_h.*")


def within(edges: DataFrame, nodes: DataFrame, *, group: tuple[str, ...] = ()) -> DataFrame:
    """Edges whose two ends are both reference nodes.

    The joins feed another shuffle, so adaptive execution is free to split a hub's edges.
    """
    for end in ("src", "dst"):
        known = nodes.select(*group, F.col(NODE).alias(end)).distinct()
        edges = edges.join(known, [*group, end], "left_semi")
    return edges


def transitions(edges: DataFrame, back: Column, *, group: tuple[str, ...] = ()) -> DataFrame:
    """Directed steps (src, dst, weight) of a random walk; only positive weights."""
    weight = F.col("weight")
    mutual, hybrid = is_undirected(), is_hybrid()
    forward = F.struct(F.col("src").alias("src"), F.col("dst").alias("dst"), weight.alias("w"))
    backward = F.struct(
        F.col("dst").alias("src"), F.col("src").alias("dst"), F.when(mutual, weight).otherwise(back).alias("w")
    )
    steps = F.when(mutual | hybrid, F.array(forward, backward)).otherwise(F.array(forward))
    return (
        edges.filter(weight > 0)
        .select(*group, F.explode(steps).alias("_s"))
        .select(*group, "_s.src", "_s.dst", F.col("_s.w").alias("weight"))
        .filter(F.col("weight") > 0)
    )


def node_totals(halves: DataFrame, *, group: tuple[str, ...] = ()) -> DataFrame:
    """Degrees, strengths, distinct partners and means per node.

    Rows are first summed per (node, partner), which counts partners without a distinct
    aggregate and keeps a hub's edges on many tasks.
    """
    per_partner = halves.groupBy(*group, "node", "partner").agg(
        F.sum("ins").alias("ins"),
        F.sum("outs").alias("outs"),
        F.sum("w_in").alias("w_in"),
        F.sum("w_out").alias("w_out"),
        F.sum("tone_in").alias("tone_in"),
        F.count("tone_in").alias("n_in"),
        F.sum("tone_out").alias("tone_out"),
        F.count("tone_out").alias("n_out"),
        F.sum("weight").alias("tension"),
        F.count("weight").alias("n_tension"),
    )
    return per_partner.groupBy(*group, "node").agg(
        F.sum("ins").alias("in_degree"),
        F.sum("outs").alias("out_degree"),
        F.count(F.lit(1)).alias("total_degree"),
        F.sum("w_in").alias("weighted_in"),
        F.sum("w_out").alias("weighted_out"),
        F.try_divide(F.sum("tone_in"), F.sum("n_in")).alias("mean_incoming_tone"),
        F.try_divide(F.sum("tone_out"), F.sum("n_out")).alias("mean_outgoing_tone"),
        F.try_divide(F.sum("tension"), F.sum("n_tension")).alias("mean_tension"),
    )


def adversary_counts(edges: DataFrame) -> DataFrame:
    """Distinct conflict partners per node; only the node itself must be a reference node."""
    ends = F.array(
        F.struct(F.col("src").alias("node"), F.col("dst").alias("partner")),
        F.struct(F.col("dst").alias("node"), F.col("src").alias("partner")),
    )
    both = edges.filter("has_conflict").select(F.explode(ends).alias("_e")).select("_e.*").distinct()
    return both.groupBy("node").agg(F.count(F.lit(1)).alias("conflict_adversary_count"))


def pagerank(
    nodes: DataFrame,
    steps: DataFrame,
    *,
    alpha: float = PAGERANK_ALPHA,
    max_iter: int = PAGERANK_MAX_ITER,
    tol: float = PAGERANK_TOL,
) -> DataFrame:
    """(country_iso3, pagerank) for every node; ``steps`` are (src, dst, weight) rows."""
    ranked = rank_nodes(nodes.select(F.col(NODE).alias("node")), steps, alpha=alpha, max_iter=max_iter, tol=tol)
    return ranked.select(F.col("node").alias(NODE), F.col("rank").alias("pagerank"))


def node_degrees(
    nodes: DataFrame, dyads: DataFrame, *, weight: str = "composite_tension_index", digits: int = 4
) -> DataFrame:
    """Everything about a node that one pass over its edges gives, isolated nodes included."""
    edges = with_edge_defaults(dyads, weight)
    totals = node_totals(half_edges(within(edges, nodes), baseline_back_weight(F.col("weight"))))
    names = dims.display_names(nodes.sparkSession)
    joined = (
        nodes.select(NODE)
        .distinct()
        .join(totals.withColumnRenamed("node", NODE), NODE, "left")
        .join(adversary_counts(edges).withColumnRenamed("node", NODE), NODE, "left")
        .join(names, NODE, "left")
    )
    counts = ["in_degree", "out_degree", "total_degree", "conflict_adversary_count"]
    return joined.na.fill(0, counts).select(
        NODE,
        F.coalesce("country_name", NODE).alias("country_name"),
        "in_degree",
        "out_degree",
        "total_degree",
        F.round(F.coalesce("weighted_in", F.lit(0.0)), digits).alias("weighted_in_degree"),
        F.round(F.coalesce("weighted_out", F.lit(0.0)), digits).alias("weighted_out_degree"),
        "conflict_adversary_count",
        F.round("mean_incoming_tone", digits).alias("mean_incoming_tone"),
        F.round("mean_outgoing_tone", digits).alias("mean_outgoing_tone"),
        F.round(F.coalesce("mean_tension", F.lit(0.0)), digits).alias("mean_dyadic_tension"),
        (F.col("total_degree") > 0).alias("has_active_edges"),
    )


def node_metrics(
    nodes: DataFrame,
    dyads: DataFrame,
    *,
    weight: str = "composite_tension_index",
    alpha: float = PAGERANK_ALPHA,
    max_iter: int = PAGERANK_MAX_ITER,
    tol: float = PAGERANK_TOL,
    digits: int = 4,
    rank_digits: int = 6,
) -> DataFrame:
    """Degrees, strengths, adversaries, tones, tension and PageRank of every reference node."""
    steps = transitions(with_edge_defaults(dyads, weight), baseline_back_weight(F.col("weight")))
    ranks = pagerank(nodes, steps, alpha=alpha, max_iter=max_iter, tol=tol)
    rounded = ranks.select(NODE, F.round("pagerank", rank_digits).alias("pagerank_centrality"))
    return node_degrees(nodes, dyads, weight=weight, digits=digits).join(rounded, NODE).select(*METRIC_COLUMNS)


def by_rank(metrics: DataFrame) -> DataFrame:
    """Highest PageRank first, then most partners; names break ties."""
    return metrics.orderBy(F.desc("pagerank_centrality"), F.desc("total_degree"), NODE)


def graph_nodes(metrics: DataFrame) -> DataFrame:
    """Nodes of the node-link form."""
    return metrics.select(
        F.col(NODE).alias("id"),
        F.col("country_name").alias("label"),
        "in_degree",
        "out_degree",
        "total_degree",
        F.col("conflict_adversary_count").alias("conflict_adversaries"),
        F.col("pagerank_centrality").alias("pagerank"),
        "mean_dyadic_tension",
        "has_active_edges",
    )


def graph_links(dyads: DataFrame, *, digits: int = 4) -> DataFrame:
    """Links of the node-link form; a missing tone stays NULL."""
    return dyads.select(
        F.col(SOURCE).alias("source"),
        F.col(TARGET).alias("target"),
        "is_directed",
        "relationship_nature",
        F.coalesce("conflict_events_total", F.lit(0)).alias("conflict_events"),
        F.coalesce("fatalities_best_total", F.lit(0.0)).alias("fatalities"),
        F.coalesce("news_article_count", F.lit(0)).alias("news_articles"),
        F.col("news_avg_tone").alias("avg_tone"),
        F.round(F.coalesce("composite_tension_index", F.lit(0.0)), digits).alias("tension_index"),
        F.col("has_historical_conflict").alias("has_conflict"),
    )


def graph_summary(metrics: DataFrame, dyads: DataFrame) -> DataFrame:
    """One row about the graph: nodes, active nodes, dyads by kind, strongest tension."""
    node_part = metrics.agg(
        F.struct(
            F.count(F.lit(1)).alias("total_reference_nodes"),
            F.count_if("has_active_edges").alias("active_nodes_with_edges"),
        ).alias("n")
    ).scalar()
    return (
        dyads.agg(
            F.count(F.lit(1)).alias("total_directed_dyads"),
            F.count_if("has_historical_conflict").alias("bilateral_conflict_dyads"),
            F.count_if(F.col("news_article_count") > 0).alias("directed_news_dyads"),
            F.coalesce(F.max("composite_tension_index"), F.lit(0.0)).alias("max_tension_index"),
        )
        .withColumn("_n", node_part)
        .select("_n.*", "*")
        .drop("_n")
    )
