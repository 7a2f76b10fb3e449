"""What-if impact of shocks on a graph, for a whole table of scenarios at once.

scenario_id is part of every key. Baseline edges are stored once; only shocked values exist
per scenario.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelgraph.fixed_values import (
    ARRIVAL_TONE_CAP,
    DEFAULT_DECAY,
    DEFAULT_DEPTH,
    HYBRID_BACK_COUNTERFACTUAL,
    HYBRID_BACK_PROPAGATION,
    MIN_SEED,
    NEWS_TO_ESCALATION,
    NEWS_TO_TENSION,
    PAGERANK_ALPHA,
    PAGERANK_MAX_ITER,
    PAGERANK_TOL,
    TONE_TO_ESCALATION,
    TONE_TO_TENSION,
)
from panelgraph.functions import pairs
from panelgraph.functions.numbers import clip
from panelgraph.operators.dyads import SOURCE, TARGET
from panelgraph.operators.graph import (
    NODE,
    half_edges,
    is_hybrid,
    is_undirected,
    node_totals,
    transitions,
    with_edge_defaults,
    within,
)
from panelgraph.plans.pagerank import rank_nodes
from panelgraph.plans.skew import hot_keys, replicate, salt
from panelgraph.session import cut

SCENARIO = "scenario_id"
SCENARIO_SCHEMA = T.StructType(
    [
        T.StructField("scenario_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("target_country_iso3", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("dyad_a", T.StringType()),
        T.StructField("dyad_b", T.StringType()),
        T.StructField("archetype", T.StringType()),
        T.StructField("tone_delta", T.DoubleType()),
        T.StructField("conflict_news_multiplier", T.DoubleType()),
        T.StructField("tension_delta", T.DoubleType()),
        T.StructField("sever_dyadic_tie", T.BooleanType()),
        T.StructField("propagation_depth", T.IntegerType()),
        T.StructField("decay_factor", T.DoubleType()),
    ]
)
DEFAULTS = {
    "tone_delta": 0.0,
    "conflict_news_multiplier": 1.0,
    "sever_dyadic_tie": False,
    "propagation_depth": DEFAULT_DEPTH,
    "decay_factor": DEFAULT_DECAY,
}


def with_scenario_defaults(scenarios: DataFrame, archetypes: DataFrame | None = None) -> DataFrame:
    """Fill unset parameters: from the scenario's archetype when that table is given, then defaults."""
    for field in SCENARIO_SCHEMA.fields:
        if field.name not in scenarios.columns:
            scenarios = scenarios.withColumn(field.name, F.lit(None).cast(field.dataType))
    if archetypes is not None:
        renamed = archetypes.select("archetype", *[F.col(c).alias(f"_{c}") for c in DEFAULTS])
        scenarios = scenarios.join(renamed, "archetype", "left").withColumns(
            {c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in DEFAULTS}
        )
    filled = scenarios.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULTS.items()})
    return filled.select(*[F.col(f.name).cast(f.dataType) for f in SCENARIO_SCHEMA.fields])


def check_scenarios(scenarios: DataFrame, nodes: DataFrame, dyads: DataFrame) -> DataFrame:
    """Add ``reasons``: the broken rules of each scenario, empty when it is valid.

    Also ``edge_matched``: whether the named pair meets an edge at all; a directed edge is
    met in its own direction only.
    """
    known = nodes.select(F.col(NODE).alias("_node")).distinct()
    checked = scenarios
    for column in ("target_country_iso3", "dyad_a", "dyad_b"):
        flag = known.withColumnRenamed("_node", column).withColumn(f"_known_{column}", F.lit(True))
        checked = checked.join(flag, column, "left")
    low, high = pairs.canonical(F.col("dyad_a"), F.col("dyad_b"))
    checked = checked.withColumns({"_low": low, "_high": high})
    # Only edges that some scenario names are looked at further; the scenario side is small,
    # so the edge table is filtered where it is read.
    named = checked.select("_low", "_high").distinct()
    edge_low, edge_high = pairs.canonical(F.col(SOURCE), F.col(TARGET))
    met = dyads.select(SOURCE, TARGET, "is_directed", edge_low.alias("_low"), edge_high.alias("_high")).join(
        named, ["_low", "_high"], "left_semi"
    )
    edges = met.groupBy("_low", "_high").agg(
        F.bool_or(F.col(SOURCE) == F.col("_low")).alias("_forward"),
        F.bool_or(F.col(SOURCE) == F.col("_high")).alias("_backward"),
        F.bool_or(~F.col("is_directed")).alias("_undirected"),
        F.lit(True).alias("_either"),
    )
    checked = checked.join(edges, ["_low", "_high"], "left")

    def holds(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    has_pair = F.col("dyad_a").isNotNull() & F.col("dyad_b").isNotNull()
    half_pair = F.col("dyad_a").isNotNull() != F.col("dyad_b").isNotNull()
    rules = {
        "unknown target": ~holds("_known_target_country_iso3"),
        "pair needs two codes": half_pair,
        "pair of one country": has_pair & (F.col("dyad_a") == F.col("dyad_b")),
        "unknown country in pair": has_pair
        & (F.col("dyad_a") != F.col("dyad_b"))
        & ~(holds("_known_dyad_a") & holds("_known_dyad_b")),
        "tension change without pair": F.col("tension_delta").isNotNull() & ~has_pair,
        "severance without pair": F.col("sever_dyadic_tie") & ~has_pair,
        "severance of a missing edge": F.col("sever_dyadic_tie") & has_pair & ~holds("_either"),
        "negative multiplier": F.col("conflict_news_multiplier") < 0,
        "negative depth": F.col("propagation_depth") < 0,
        "decay outside 0..1": ~F.col("decay_factor").between(0.0, 1.0),
    }
    reasons = F.array_compact(F.array(*[F.when(broken, F.lit(rule)) for rule, broken in rules.items()]))
    exact = F.when(F.col("dyad_a") == F.col("_low"), holds("_forward")).otherwise(holds("_backward"))
    matched = has_pair & (exact | holds("_undirected"))
    return checked.select(*scenarios.columns, reasons.alias("reasons"), matched.alias("edge_matched"))


def valid_scenarios(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("reasons") == 0).drop("reasons", "edge_matched")


def rejected_scenarios(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("reasons") > 0)


def baseline_month(news: DataFrame, preferred: str) -> DataFrame:
    """The rows of the preferred month or, when it is absent, of the latest one."""
    month = news.agg(
        F.coalesce(F.max(F.when(F.col("year_month") == preferred, F.col("year_month"))), F.max("year_month")).alias("m")
    ).scalar()
    return news.filter(F.col("year_month") == month)


def baseline_nodes(metrics: DataFrame, news: DataFrame) -> DataFrame:
    """Node metrics with the news state of the baseline month; a silent node is neutral."""
    state = news.select(
        NODE,
        F.col("avg_tone").alias("baseline_tone"),
        F.col("conflict_news_count").cast("long").alias("baseline_conflict_news_count"),
        F.col("escalation_signal").alias("baseline_escalation_signal"),
    )
    joined = metrics.join(state, NODE, "left")
    return joined.select(
        NODE,
        "country_name",
        F.coalesce("baseline_tone", F.lit(0.0)).alias("baseline_tone"),
        F.coalesce("baseline_conflict_news_count", F.lit(0)).alias("baseline_conflict_news_count"),
        F.coalesce("baseline_escalation_signal", F.lit(0.0)).alias("baseline_escalation_signal"),
        F.col("pagerank_centrality").alias("baseline_pagerank"),
        F.col("in_degree").alias("baseline_in_degree"),
        F.col("out_degree").alias("baseline_out_degree"),
        F.col("total_degree").alias("baseline_total_degree"),
        F.col("weighted_in_degree").alias("baseline_weighted_in"),
        F.col("weighted_out_degree").alias("baseline_weighted_out"),
    )


def seed_shock() -> Column:
    """Tension change at the target: as given, else from the tone and news shocks."""
    implied = -TONE_TO_TENSION * F.col("tone_delta") + NEWS_TO_TENSION * (F.col("conflict_news_multiplier") - 1.0)
    return F.coalesce(F.col("tension_delta"), implied)


def shocked_targets(scenarios: DataFrame, nodes: DataFrame) -> DataFrame:
    """Direct shock on the target node of each scenario."""
    multiplier, tone = F.col("conflict_news_multiplier"), F.col("tone_delta")
    joined = scenarios.join(nodes.withColumnRenamed(NODE, "target_country_iso3"), "target_country_iso3")
    news = F.bround(F.col("baseline_conflict_news_count") * multiplier, 0)
    escalation = (
        F.col("baseline_escalation_signal")
        + NEWS_TO_ESCALATION * (multiplier - 1.0)
        + TONE_TO_ESCALATION * F.greatest(F.lit(0.0), -tone)
    )
    return joined.select(
        SCENARIO,
        F.col("target_country_iso3").alias(NODE),
        clip(F.col("baseline_tone") + tone, -1.0, 1.0).alias("shocked_tone"),
        F.greatest(F.lit(0), news.cast("long")).alias("shocked_news"),
        clip(escalation, 0.0, 1.0).alias("shocked_escalation"),
    )


def shocked_edges(scenarios: DataFrame, dyads: DataFrame) -> DataFrame:
    """Edges a scenario names: (scenario, source, target, is_severed, direct_tension).

    A directed edge is met in its own direction only, an undirected one in both. Two equi
    joins on the pair, one per direction, so the edge table is never scanned per scenario.
    """
    named = scenarios.filter(F.col("dyad_a").isNotNull() & F.col("dyad_b").isNotNull()).select(
        SCENARIO, "dyad_a", "dyad_b", "tension_delta", "sever_dyadic_tie"
    )
    edges = dyads.select(SOURCE, TARGET, "is_directed", "composite_tension_index")
    forward = named.select(
        SCENARIO, F.col("dyad_a").alias(SOURCE), F.col("dyad_b").alias(TARGET), "tension_delta", "sever_dyadic_tie",
        F.lit(False).alias("_reverse"),
    )
    reverse = named.select(
        SCENARIO, F.col("dyad_b").alias(SOURCE), F.col("dyad_a").alias(TARGET), "tension_delta", "sever_dyadic_tie",
        F.lit(True).alias("_reverse"),
    )
    met = forward.unionByName(reverse).join(edges, [SOURCE, TARGET]).filter(~F.col("_reverse") | ~F.col("is_directed"))
    tension = F.col("composite_tension_index")
    direct = (
        F.when(F.col("sever_dyadic_tie"), F.lit(0.0))
        .when(F.col("tension_delta").isNotNull(), clip(tension + F.col("tension_delta"), 0.0, 1.0))
        .otherwise(tension)
    )
    return met.select(
        SCENARIO, SOURCE, TARGET, F.col("sever_dyadic_tie").alias("is_severed"), direct.alias("direct_tension")
    )


def adjacency(edges: DataFrame) -> DataFrame:
    """Ways a shock can travel: (node, neighbour, weight, source, target). Baseline weights."""
    weight = F.col("weight")

    def way(a: str, b: str, w: Column) -> Column:
        return F.struct(F.col(a).alias("node"), F.col(b).alias("neighbour"), w.alias("way_weight"))

    ways = (
        F.when(is_undirected(), F.array(way("src", "dst", weight), way("dst", "src", weight)))
        .when(is_hybrid(), F.array(way("src", "dst", weight), way("dst", "src", HYBRID_BACK_PROPAGATION * weight)))
        .otherwise(F.array(way("src", "dst", weight)))
    )
    return edges.select(SOURCE, TARGET, F.explode(ways).alias("_w")).select("_w.*", SOURCE, TARGET)


def propagate(scenarios: DataFrame, nodes: DataFrame, dyads: DataFrame, shocked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spread each scenario's seed over the graph, hop by hop.

    Returns node arrivals (scenario, node, hop, tone_shift) and edge arrivals (scenario,
    source, target, tension_shift). One hop is one equi join of the frontier with the ways
    out, for all scenarios together.

    The tone shift of each single arrival is capped. Every way shares out its node's shock, so
    a scenario's arrivals at hop h add up to at most |seed| * decay^h: fewer than
    |seed| / cap arrivals can ever exceed the cap. Those stay single rows. All others are
    light, and so is everything that comes of them: light arrivals at one node are added up,
    marked, and never capped. The frontier never outgrows nodes plus that few.
    """
    edges = within(with_edge_defaults(dyads, "composite_tension_index"), nodes)
    ways = cut(adjacency(edges))
    # A hub's ways are dealt over slots, and what moves from it goes to each of them: no task holds them all.
    hot = cut(hot_keys(ways, ["node"]))
    dealt = salt(ways, ["node"], hot, F.col("neighbour"))
    # Joined to the few frontier nodes of a hop, never to all ways.
    totals = cut(ways.groupBy("node").agg(F.sum("way_weight").alias("_total")))
    severed = shocked.filter("is_severed").select(SCENARIO, SOURCE, TARGET)
    # Severing takes ways out of a scenario, so its two ends share out less weight there.
    lost = cut(
        ways.join(severed, [SOURCE, TARGET]).groupBy(SCENARIO, "node").agg(F.sum("way_weight").alias("_lost"))
    )
    seeds = scenarios.withColumn("delta", seed_shock()).filter(
        (F.col("propagation_depth") > 0) & (F.abs(F.col("delta")) > MIN_SEED)
    )
    frontier = cut(
        seeds.select(
            SCENARIO,
            F.col("target_country_iso3").alias("node"),
            "delta",
            F.col("decay_factor").alias("decay"),
            F.col("propagation_depth").alias("depth"),
            F.lit(False).alias("light"),
        )
    )
    visited = frontier.select(SCENARIO, "node")
    deepest = seeds.agg(F.max("propagation_depth")).first()[0] or 0
    node_parts, edge_parts = [], []
    for hop in range(1, deepest + 1):
        moving = frontier.filter(F.col("depth") >= hop)
        arrivals = (
            moving.join(totals, "node")
            .join(lost, [SCENARIO, "node"], "left")
            .transform(lambda df: replicate(df, ["node"], hot))
            .join(dealt, ["node", "slot"])
            .join(severed.withColumn("_severed", F.lit(True)), [SCENARIO, SOURCE, TARGET], "left")
            .filter(F.col("_severed").isNull())
            .join(
                visited.select(SCENARIO, F.col("node").alias("neighbour")), [SCENARIO, "neighbour"], "left_anti"
            )
        )
        total = F.col("_total") - F.coalesce(F.col("_lost"), F.lit(0.0))
        part = F.when(total > 1e-15, F.col("way_weight") / total).otherwise(F.lit(0.0))
        arrived = cut(
            arrivals.select(
                SCENARIO,
                F.col("neighbour").alias("node"),
                (F.col("delta") * F.col("decay") * part).alias("delta"),
                "decay",
                "depth",
                "light",
                SOURCE,
                TARGET,
            )
        )
        size = F.abs(F.col("delta"))
        heavy = ~F.col("light") & (size > ARRIVAL_TONE_CAP)
        effect = F.when(heavy, F.lit(ARRIVAL_TONE_CAP)).otherwise(size)
        node_parts.append(
            arrived.groupBy(SCENARIO, "node")
            .agg(F.sum(-F.signum("delta") * effect).alias("tone_shift"))
            .withColumn("hop", F.lit(hop))
        )
        edge_parts.append(arrived.groupBy(SCENARIO, SOURCE, TARGET).agg(F.sum("delta").alias("tension_shift")))
        if hop == deepest:
            break
        # Light arrivals at a node merge into one row, heavy ones keep their own (by edge).
        own = F.when(heavy, F.monotonically_increasing_id()).otherwise(F.lit(-1))
        frontier = cut(
            arrived.withColumn("_own", own)
            .groupBy(SCENARIO, "node", "_own")
            .agg(F.sum("delta").alias("delta"), F.first("decay").alias("decay"), F.first("depth").alias("depth"))
            .withColumn("light", F.col("_own") < 0)
            .drop("_own")
        )
        if frontier.isEmpty():
            break
        visited = visited.unionByName(arrived.select(SCENARIO, "node").distinct())
    return _stack(node_parts, scenarios, "node string, tone_shift double, hop int"), _stack(
        edge_parts, scenarios, f"{SOURCE} string, {TARGET} string, tension_shift double"
    )


def _stack(parts: Sequence[DataFrame], scenarios: DataFrame, columns: str) -> DataFrame:
    if not parts:
        return scenarios.sparkSession.createDataFrame([], f"{SCENARIO} string, {columns}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def counterfactual_edges(
    scenarios: DataFrame, dyads: DataFrame, shocked: DataFrame, edge_arrivals: DataFrame
) -> DataFrame:
    """Every dyad under every scenario, with what happened to it."""
    moved = edge_arrivals.groupBy(SCENARIO, SOURCE, TARGET).agg(F.sum("tension_shift").alias("tension_shift"))
    changes = shocked.join(moved, [SCENARIO, SOURCE, TARGET], "full")
    # One row per scenario and dyad is the size of the result itself.
    every = dyads.withColumn("_s", F.explode(_scenario_ids(scenarios))).withColumnRenamed("_s", SCENARIO)
    joined = every.join(changes, [SCENARIO, SOURCE, TARGET], "left")
    direct = F.col("direct_tension").isNotNull()
    severed = F.coalesce("is_severed", F.lit(False))
    rippled = F.col("tension_shift").isNotNull() & ~direct
    tension = F.col("composite_tension_index")
    after = (
        F.when(direct, F.col("direct_tension"))
        .when(rippled, clip(tension + F.col("tension_shift"), 0.0, 1.0))
        .otherwise(tension)
    )
    return joined.select(
        SCENARIO,
        SOURCE,
        TARGET,
        "is_directed",
        "relationship_nature",
        tension.alias("baseline_tension_index"),
        after.alias("counterfactual_tension_index"),
        F.round(after - tension, 4).alias("delta_tension_index"),
        severed.alias("is_severed"),
        direct.alias("is_directly_shocked"),
        rippled.alias("is_ripple_affected"),
        "has_historical_conflict",
        "fatalities_best_total",
        "news_avg_tone",
    )


def _scenario_ids(scenarios: DataFrame) -> Column:
    """The ids as one array: the scenario list is user input, far below one row of data."""
    return scenarios.agg(F.collect_set(SCENARIO).alias("ids")).scalar()


def counterfactual_metrics(
    scenarios: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    *,
    back: float = HYBRID_BACK_COUNTERFACTUAL,
    alpha: float = PAGERANK_ALPHA,
    max_iter: int = PAGERANK_MAX_ITER,
    tol: float = PAGERANK_TOL,
    digits: int = 4,
    rank_digits: int = 6,
) -> DataFrame:
    """Degrees, strengths and PageRank per scenario and node on the shocked edges.

    Severed edges and edges without weight do not count. ``back`` is the share of a hybrid
    edge's weight that leads back; pass the baseline share for equal treatment.
    """
    live = edges.filter(~F.col("is_severed") & (F.col("counterfactual_tension_index") > 0))
    typed = with_edge_defaults(live, "counterfactual_tension_index")
    every = nodes.select(NODE).distinct().withColumn(SCENARIO, F.explode(_scenario_ids(scenarios)))
    group = (SCENARIO,)
    back_weight = back * F.col("weight")
    totals = node_totals(half_edges(within(typed, nodes), back_weight, group=group), group=group)
    steps = transitions(typed, back_weight, group=group)
    ranks = rank_nodes(
        every.select(SCENARIO, F.col(NODE).alias("node")), steps, alpha=alpha, max_iter=max_iter, tol=tol, group=group
    )
    joined = every.join(totals.withColumnRenamed("node", NODE), [SCENARIO, NODE], "left").join(
        ranks.withColumnRenamed("node", NODE), [SCENARIO, NODE], "left"
    )
    zero = F.lit(0)
    return joined.select(
        SCENARIO,
        NODE,
        F.round("rank", rank_digits).alias("counterfactual_pagerank"),
        F.coalesce("in_degree", zero).alias("counterfactual_in_degree"),
        F.coalesce("out_degree", zero).alias("counterfactual_out_degree"),
        F.coalesce("total_degree", zero).alias("counterfactual_total_degree"),
        F.round(F.coalesce("weighted_in", F.lit(0.0)), digits).alias("counterfactual_weighted_in"),
        F.round(F.coalesce("weighted_out", F.lit(0.0)), digits).alias("counterfactual_weighted_out"),
    )


def country_impacts(
    scenarios: DataFrame, nodes: DataFrame, metrics: DataFrame, node_arrivals: DataFrame
) -> DataFrame:
    """Baseline, counterfactual and delta of every node under every scenario."""
    arrived = node_arrivals.groupBy(SCENARIO, F.col("node").alias(NODE)).agg(
        F.sum("tone_shift").alias("tone_shift"), F.min("hop").alias("hop")
    )
    joined = (
        metrics.join(nodes, NODE)
        .join(shocked_targets(scenarios, nodes), [SCENARIO, NODE], "left")
        .join(arrived, [SCENARIO, NODE], "left")
    )
    direct = F.col("shocked_tone").isNotNull()
    rippled_tone = clip(F.col("baseline_tone") + F.coalesce("tone_shift", F.lit(0.0)), -1.0, 1.0)
    after = joined.withColumns(
        {
            "is_direct_target": direct,
            "ripple_hop": F.when(direct, F.lit(0)).otherwise(F.coalesce("hop", F.lit(-1))),
            "counterfactual_tone": F.when(direct, F.col("shocked_tone")).otherwise(rippled_tone),
            "counterfactual_conflict_news_count": F.coalesce("shocked_news", "baseline_conflict_news_count"),
            "counterfactual_escalation_signal": F.coalesce("shocked_escalation", "baseline_escalation_signal"),
        }
    )
    digits = {
        "tone": 4, "conflict_news_count": None, "escalation_signal": 4, "pagerank": 6, "in_degree": None,
        "out_degree": None, "total_degree": None, "weighted_in": 4, "weighted_out": 4,
    }
    columns = [SCENARIO, NODE, "country_name", "is_direct_target", "ripple_hop"]
    for name, places in digits.items():
        before_, after_ = F.col(f"baseline_{name}"), F.col(f"counterfactual_{name}")
        change = after_ - before_
        columns += [before_, after_, (change if places is None else F.round(change, places)).alias(f"delta_{name}")]
    return after.select(*columns)


def impact_summary(scenarios: DataFrame, countries: DataFrame, dyads: DataFrame) -> DataFrame:
    """One row per scenario: who is affected, what is cut, largest rise and fall of PageRank."""
    reached = F.col("is_direct_target") | (F.col("ripple_hop") > 0)
    delta = F.col("delta_pagerank")
    # Ties go to the alphabetically first country.
    per_country = countries.groupBy(SCENARIO).agg(
        F.count(F.lit(1)).alias("total_reference_countries"),
        F.count_if("is_direct_target").alias("directly_shocked_countries"),
        F.count_if(reached & ~F.col("is_direct_target")).alias("ripple_affected_countries_count"),
        F.count_if(reached).alias("total_affected_countries_count"),
        F.count_if(~reached).alias("unaffected_countries_count"),
        F.min(F.struct((-delta).alias("d"), F.col(NODE).alias("c"))).alias("_up"),
        F.min(F.struct(delta.alias("d"), F.col(NODE).alias("c"))).alias("_down"),
    )
    per_dyad = dyads.groupBy(SCENARIO).agg(
        F.count(F.lit(1)).alias("total_dyads_simulated"), F.count_if("is_severed").alias("severed_dyads_count")
    )
    joined = scenarios.select(SCENARIO, "target_country_iso3").join(per_country, SCENARIO).join(per_dyad, SCENARIO, "left")
    return joined.na.fill(0, ["total_dyads_simulated", "severed_dyads_count"]).select(
        "*",
        F.col("_up.c").alias("max_pagerank_increase_country"),
        (0.0 - F.col("_up.d")).alias("max_pagerank_increase"),
        F.col("_down.c").alias("max_pagerank_decrease_country"),
        F.col("_down.d").alias("max_pagerank_decrease"),
    ).drop("_up", "_down")


def impact_graph_nodes(countries: DataFrame) -> DataFrame:
    return countries.select(
        SCENARIO,
        F.col(NODE).alias("id"),
        F.col("country_name").alias("label"),
        "is_direct_target",
        "ripple_hop",
        "baseline_pagerank",
        "counterfactual_pagerank",
        "delta_pagerank",
        "baseline_tone",
        "counterfactual_tone",
        "delta_tone",
        F.col("counterfactual_total_degree").alias("total_degree"),
    )


def impact_graph_links(dyads: DataFrame) -> DataFrame:
    return dyads.select(
        SCENARIO,
        F.col(SOURCE).alias("source"),
        F.col(TARGET).alias("target"),
        "is_directed",
        "relationship_nature",
        F.col("baseline_tension_index").alias("baseline_tension"),
        F.col("counterfactual_tension_index").alias("counterfactual_tension"),
        F.col("delta_tension_index").alias("delta_tension"),
        "is_severed",
        "is_directly_shocked",
        "is_ripple_affected",
    )
