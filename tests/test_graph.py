"""Pair tables, tension, node metrics and PageRank."""

import math
import random

import numpy as np
import pytest
from conftest import rows_by
from pyspark.sql import functions as F

from panelgraph.functions import pairs, text
from panelgraph.operators import dyads, graph
from panelgraph.plans import pagerank as pr
from panelgraph.plans import skew

EVENTS = "id long, side_a string, side_b string, year_month string, event_date string, best double, low double, high double, deaths_civilians double, conflict_name string"
NEWS = "article_id string, source_country_iso3 string, target_country_iso3 string, year_month string, tone_score double, is_negative_tone boolean, is_conflict_relevant boolean"
DYADS = (
    "source_country_iso3 string, target_country_iso3 string, is_directed boolean, relationship_nature string, "
    "has_historical_conflict boolean, conflict_events_total long, fatalities_best_total double, news_article_count long, "
    "news_avg_tone double, composite_tension_index double"
)


@pytest.mark.parametrize(
    "value,codes",
    [
        ("Government of Russia (Soviet Union)", ["RUS"]),
        ("Government of United Kingdom, Government of United States of America", ["GBR", "USA"]),
        ("Government of Australia, Government of United Kingdom, Government of United States of America", ["AUS", "GBR", "USA"]),
        ("Government of Iraq; Government of Iraq , Government of Narnia", ["IRQ"]),
        ("FARC", []), ("Civilians", []), ("", []), (None, []),
    ],
)
def test_government_codes(spark, value, codes):
    df = spark.createDataFrame([(value,)], "t string")
    assert df.select(text.government_codes(F.col("t")).alias("x")).first().x == codes


SIDES = [
    (1, "Government of Russia (Soviet Union)", "Government of Ukraine", "2022-03", "2022-03-01", 50.0, 40.0, 60.0, 5.0, "x"),
    (2, "Government of Colombia", "FARC", "2015-05", "2015-05-10", 10.0, 10.0, 10.0, 0.0, "x"),
    (3, "Government of Syria", "Syrian insurgents", "2016-08", "2016-08-15", 30.0, 20.0, 40.0, 12.0, "x"),
    (4, "Government of United Kingdom, Government of United States of America", "Government of Iraq", "2003-04", "2003-04-05", 100.0, 80.0, 120.0, 20.0, "x"),
    (5, "Rebels", "Government of Narnia", "2003-04", "2003-04-05", 1.0, 1.0, 1.0, 0.0, "x"),
    (6, "Government of Iraq", "Government of Iraq", "2003-04", "2003-04-05", None, 1.0, 1.0, 0.0, "x"),
    (7, "Government of Mali", None, "2003-04", "2003-04-05", 1.0, 1.0, 1.0, 0.0, "x"),
]


def test_state_pairs_and_exclusions(table):
    events = table(SIDES, EVENTS)
    got = dyads.state_pairs(events).collect()
    assert {(r.source_country_iso3, r.target_country_iso3) for r in got} == {("RUS", "UKR"), ("GBR", "IRQ"), ("IRQ", "USA")}
    assert len(got) == 3 and not any(r.is_directed for r in got)
    stats = dyads.pair_exclusions(events).first().asDict()
    assert stats == {
        "total_events_processed": 7, "bilateral_candidate_events": 4, "bilateral_events_retained": 2,
        "bilateral_dyad_observations_extracted": 3, "intrastate_civil_events_excluded": 3,
        "unmapped_events_excluded": 2, "total_excluded_records": 5,
    }


def test_news_pairs_are_directed(table):
    rows = [
        ("a", "IND", "UKR", "2026-10", -0.8, True, True), ("b", "IND", "UKR", "2026-10", 0.0, False, False),
        ("c", "UKR", "UKR", "2026-10", -0.5, True, True), ("d", "USA", None, "2026-10", 0.2, False, False),
    ]
    got = dyads.news_pairs(table(rows, NEWS)).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.source_country_iso3, r.target_country_iso3, r.news_article_count) == ("IND", "UKR", 2)
    assert r.news_avg_tone == pytest.approx(-0.4) and r.news_negative_tone_share == 0.5 and r.news_conflict_ratio == 0.5


@pytest.mark.parametrize(
    "args,low,high",
    [((0.0, 0, 0, None, 0), 0, 0), ((10.0, 1, 0, None, 0), 0.3, 0.4), ((50000.0, 1000, 0, None, 0), 1, 1),
     ((0.0, 3, 0, None, 0), 0.25, 0.25), ((0.0, 0, 10, -1.0, 10), 1, 1), ((500.0, 20, 5, -0.6, 3), 0.7, 0.9),
     ((0.0, 0, 4, 0.5, 1), 0.125, 0.125)],
)
def test_tension(spark, args, low, high):
    df = spark.createDataFrame([args], "f double, e long, a long, t double, c long")
    got = df.select(
        pairs.composite_tension(F.col("f"), F.col("e"), F.col("a"), F.col("t"), F.col("c")).alias("x"))
    value = got.first().x
    assert low - 1e-12 <= value <= high + 1e-12
    if args == (500.0, 20, 5, -0.6, 3):
        assert value == pytest.approx(0.6 * math.log1p(500) / math.log1p(1000) + 0.4 * (0.3 + 0.3))


INDPAK = [(10, "Government of India", "Government of Pakistan", "2022-01", "2022-01-10", 20.0, 20.0, 20.0, 0.0, "x")]


def test_hybrid_attaches_to_both_directions(table):
    news = [("a", "IND", "PAK", "2026-08", -0.7, True, True), ("b", "PAK", "IND", "2026-08", 0.1, False, False),
            ("c", "PAK", "IND", "2026-09", 0.3, False, False), ("d", "PAK", "IND", "2026-09", 0.5, False, False),
            ("e", "USA", "IND", "2026-09", 0.5, False, False)]
    events = dyads.state_pairs(table(INDPAK + SIDES[:1], EVENTS))
    got = rows_by(dyads.cumulative_dyads(events, table(news, NEWS)), "source_country_iso3", "target_country_iso3")
    assert {k: r.relationship_nature for k, r in got.items()} == {
        ("IND", "PAK"): "hybrid", ("PAK", "IND"): "hybrid", ("USA", "IND"): "directed_news", ("RUS", "UKR"): "undirected_conflict"}
    back = got["PAK", "IND"]
    assert back.conflict_events_total == 1 and back.news_article_count == 3 and back.is_directed
    assert back.news_avg_tone == pytest.approx((0.1 + 0.4) / 2)  # plain mean of monthly means
    weighted = rows_by(dyads.cumulative_dyads(events, table(news, NEWS), tone="weighted"), "source_country_iso3", "target_country_iso3")
    assert weighted["PAK", "IND"].news_avg_tone == pytest.approx(0.9 / 3)
    alone = got["RUS", "UKR"]
    assert alone.news_avg_tone is None and alone.news_article_count == 0 and not alone.is_directed
    ordered = dyads.by_tension(dyads.cumulative_dyads(events, table(news, NEWS))).collect()
    assert [r.composite_tension_index for r in ordered] == sorted((r.composite_tension_index for r in got.values()), reverse=True)


def test_monthly_lags_use_observed_months(table):
    rows = [(i, *INDPAK[0][1:3], ym, ym + "-10", float(b), 0.0, 0.0, 0.0, "x")
            for i, (ym, b) in enumerate([("2022-01", 10), ("2022-02", 50), ("2022-03", 1000), ("2022-07", 1)])]
    news = [("a", "IND", "PAK", "2022-03", -0.7, True, True), ("b", "PAK", "IND", "2022-03", -0.7, True, True)]
    got = rows_by(dyads.monthly_dyads(dyads.state_pairs(table(rows, EVENTS)), table(news, NEWS)),
                  "source_country_iso3", "year_month")
    assert got["IND", "2022-01"].conflict_events_lag_1m is None and got["IND", "2022-01"].conflict_events_prior_sum_3m is None
    assert got["IND", "2022-02"].conflict_events_lag_1m == 1
    assert got["IND", "2022-03"].relationship_nature == "hybrid" and got["PAK", "2022-03"].relationship_nature == "directed_news"
    july = got["IND", "2022-07"]
    assert july.conflict_events_prior_sum_3m == 3 and july.news_count_lag_1m == 1 and july.monthly_tension_lag_1m > 0.6


def test_monthly_dyads_without_events_or_news(spark, table):
    none = spark.createDataFrame([], EVENTS)
    news = table([("a", "IND", "PAK", "2022-03", -0.7, True, True)], NEWS)
    assert dyads.monthly_dyads(dyads.state_pairs(none), news).count() == 1
    assert dyads.monthly_dyads(dyads.state_pairs(table(INDPAK, EVENTS)), spark.createDataFrame([], NEWS)).count() == 1
    assert dyads.cumulative_dyads(dyads.state_pairs(none), spark.createDataFrame([], NEWS)).count() == 0


def conflict(a, b, w, deaths=100.0, nature="undirected_conflict", directed=False, tone=None, has=True):
    return (a, b, directed, nature, has, 3, deaths, 0 if tone is None else 2, tone, w)


def nodes_of(table, names):
    return table([(n,) for n in names], "country_iso3 string")


def test_symmetric_conflict(table):
    got = rows_by(graph.node_metrics(nodes_of(table, ["IRQ", "KWT", "USA"]), table([conflict("IRQ", "KWT", 1.0)], DYADS), max_iter=4), "country_iso3")
    for c in ("IRQ", "KWT"):
        r = got[c]
        assert (r.in_degree, r.out_degree, r.total_degree, r.weighted_in_degree, r.weighted_out_degree) == (1, 1, 1, 1.0, 1.0)
        assert r.conflict_adversary_count == 1 and r.mean_dyadic_tension == 1.0 and r.mean_incoming_tone is None
    assert got["IRQ"].pagerank_centrality == got["KWT"].pagerank_centrality > got["USA"].pagerank_centrality
    usa = got["USA"]
    assert (usa.in_degree, usa.total_degree, usa.has_active_edges, usa.mean_dyadic_tension) == (0, 0, False, 0.0)
    assert usa.country_name == "United States"


def test_directed_news(table):
    edge = conflict("USA", "COD", 0.25, 0.0, "directed_news", True, -0.5, False)
    got = rows_by(graph.node_metrics(nodes_of(table, ["USA", "COD", "XXX"]), table([edge], DYADS), max_iter=3), "country_iso3")
    usa, cod = got["USA"], got["COD"]
    assert (usa.out_degree, usa.in_degree, usa.weighted_out_degree, usa.weighted_in_degree) == (1, 0, 0.25, 0.0)
    assert (cod.in_degree, cod.out_degree, cod.weighted_in_degree, cod.weighted_out_degree) == (1, 0, 0.25, 0.0)
    assert (usa.mean_outgoing_tone, usa.mean_incoming_tone, cod.mean_incoming_tone) == (-0.5, None, -0.5)
    assert got["XXX"].country_name == "XXX" and usa.conflict_adversary_count == 0


@pytest.mark.parametrize("deaths,back", [(5.0, 0.4), (0.0, 0.2)])
def test_hybrid_back_weight(table, deaths, back):
    edge = conflict("IND", "PAK", 0.4, deaths, "hybrid", True, -0.5)
    got = rows_by(graph.node_degrees(nodes_of(table, ["IND", "PAK"]), table([edge], DYADS)), "country_iso3")
    assert (got["IND"].weighted_out_degree, got["IND"].weighted_in_degree) == (0.4, back)
    assert (got["PAK"].in_degree, got["PAK"].out_degree, got["PAK"].weighted_out_degree) == (1, 1, back)


def test_partners_outside_the_reference(table):
    edges = table([conflict("IRQ", "OUT", 1.0), conflict("IRQ", "KWT", 0.5), conflict("KWT", "IRQ", 0.3, 0.0, "directed_news", True, 0.1, False)], DYADS)
    got = rows_by(graph.node_degrees(nodes_of(table, ["IRQ", "KWT"]), edges), "country_iso3")
    assert set(got) == {"IRQ", "KWT"}
    assert got["IRQ"].conflict_adversary_count == 2 and got["IRQ"].in_degree == 2 and got["IRQ"].total_degree == 1


def test_empty_graphs(spark, table):
    none = spark.createDataFrame([], DYADS)
    steps = spark.createDataFrame([], "src string, dst string, weight double")
    assert graph.pagerank(spark.createDataFrame([], "country_iso3 string"), steps).count() == 0
    assert [r.pagerank for r in graph.pagerank(nodes_of(table, ["A"]), steps).collect()] == [1.0]
    assert [r.pagerank for r in graph.pagerank(nodes_of(table, list("ABC")), steps).collect()] == pytest.approx([1 / 3] * 3)
    got = graph.node_metrics(nodes_of(table, ["USA", "UKR"]), none).collect()
    assert len(got) == 2 and not any(r.has_active_edges or r.in_degree or r.conflict_adversary_count for r in got)


def dense_pagerank(nodes, steps, alpha=0.85, max_iter=100, tol=1e-6):
    at = {n: i for i, n in enumerate(nodes)}
    n = len(nodes)
    m = np.zeros((n, n))
    for s, d, w in steps:
        if s in at and d in at and w > 0:
            m[at[s], at[d]] += w
    out = m.sum(1)
    m[out > 0] /= out[out > 0][:, None]
    m[out == 0] = 1 / n
    p = np.full(n, 1 / n)
    for _ in range(max_iter):
        q = alpha * p @ m + (1 - alpha) / n
        stop = np.abs(q - p).sum() < tol
        p = q
        if stop:
            break
    return dict(zip(nodes, p / p.sum()))


def random_steps(rng, names):
    return [(rng.choice(names + ["OUT"]), rng.choice(names), rng.choice([0.0, 0.2, 0.5, 1.0, -1.0])) for _ in range(len(names) * 2)]


@pytest.mark.parametrize("max_hot", [1000, 20])
def test_pagerank_equals_dense(table, monkeypatch, max_hot):
    monkeypatch.setattr(pr, "hot_keys", lambda df, keys: skew.hot_keys(df, keys, max_hot=max_hot))
    rng = random.Random(11)
    names = [f"n{i:02d}" for i in range(12)]
    steps = random_steps(rng, names) + [("n00", n, 0.3) for n in names[1:]]
    got = {r.country_iso3: r.pagerank for r in graph.pagerank(nodes_of(table, names), table(steps, "src string, dst string, weight double"), tol=1e-2).collect()}
    want = dense_pagerank(names, steps, tol=1e-2)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-12)


def test_pagerank_of_many_graphs_stops_each_by_itself(table):
    rng = random.Random(5)
    names = [f"n{i}" for i in range(6)]
    per = {g: random_steps(rng, names) for g in ("g1", "g2")} | {"g3": [], "g4": [("n0", "n1", 1.0), ("n1", "n0", 1.0)]}
    steps = table([(g, *s) for g, ss in per.items() for s in ss], "g string, src string, dst string, weight double")
    nodes = table([(g, n) for g in per for n in names], "g string, node string")
    got = pr.rank_nodes(nodes, steps, alpha=0.85, max_iter=100, tol=3e-2, group=("g",)).collect()
    for g, ss in per.items():
        want = dense_pagerank(names, ss, tol=3e-2)
        mine = {r.node: r.rank for r in got if r.g == g}
        assert mine == pytest.approx(want, abs=1e-12), g


def test_pagerank_reports_its_steps(table):
    steps = table([("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 0.5), ("c", "b", 0.5)], "src string, dst string, weight double")
    nodes = table([("a",), ("b",), ("c",)], "node string")
    report = {}
    pr.rank_nodes(nodes, steps, alpha=0.85, max_iter=100, tol=1e-3, report=report)
    assert report["converged"] and report["moved"] < 1e-3 and 1 < report["iterations"] < 100
    with pytest.warns(UserWarning, match="still move"):
        pr.rank_nodes(nodes, steps, alpha=0.85, max_iter=2, tol=1e-12, report=report)
    assert report["iterations"] == 2 and not report["converged"]


def test_graph_form_and_summary(table):
    edges = table([conflict("RUS", "UKR", 0.95444), conflict("USA", "RUS", 0.2, 0.0, "directed_news", True, -0.3, False)], DYADS)
    metrics = graph.node_metrics(nodes_of(table, ["RUS", "UKR", "USA", "FRA"]), edges, max_iter=6)
    nodes, links = graph.graph_nodes(metrics).collect(), rows_by(graph.graph_links(edges), "source", "target")
    assert {n.id for n in nodes} == {"RUS", "UKR", "USA", "FRA"} and sum(n.pagerank for n in nodes) == pytest.approx(1, abs=1e-5)
    link = links["RUS", "UKR"]
    assert (link.tension_index, link.avg_tone, link.has_conflict, link.conflict_events) == (0.9544, None, True, 3)
    s = graph.graph_summary(metrics, edges).first()
    assert (s.total_reference_nodes, s.active_nodes_with_edges, s.total_directed_dyads, s.bilateral_conflict_dyads, s.directed_news_dyads) == (4, 3, 2, 1, 1)
    assert graph.by_rank(metrics).first().country_iso3 in ("RUS", "UKR")


def test_hot_keys_are_few_and_salted_rows_still_meet(table):
    rows = [("hub", i) for i in range(300)] + [(f"k{i}", i) for i in range(600)]
    df = table(rows, "k string, v int")
    hot = skew.hot_keys(df, ["k"], max_hot=10)
    assert [(r.k, r.fan) for r in hot.collect()] == [("hub", 4)]
    salted = skew.salt(df, ["k"], hot, F.col("v"))
    assert salted.filter("k = 'hub'").select("slot").distinct().count() == 4
    dim = table([(k, len(k)) for k in {r[0] for r in rows}], "k string, n int")
    joined = salted.join(skew.replicate(dim, ["k"], hot), ["k", "slot"])
    assert joined.count() == 900


def test_pagerank_adds_up_iterations_it_knows(table, monkeypatch):
    """A two-sided graph swings for over 80 iterations; few are run, and the ranks are those of the iteration at which the rule holds."""
    rng = random.Random(9)
    sellers, buyers = [f"s{i}" for i in range(12)], [f"c{i}" for i in range(60)]
    given = [(s, b, float(rng.randrange(1, 50))) for s in sellers for b in rng.sample(buyers, 30)]
    given += [(b, s, 1.0) for b in buyers[:57] for s in rng.sample(sellers, 6)]  # three buyers keep what they get
    nodes = table([(x,) for x in sellers + buyers], "node string")
    kept, keep, report = [], pr.Revolving.keep, {}
    monkeypatch.setattr(pr.Revolving, "keep", lambda self, df: kept.append(1) or keep(self, df))
    got = pr.rank_nodes(nodes, table(given, "src string, dst string, weight double"), alpha=0.85, max_iter=200, tol=1e-6, report=report).collect()
    want = dense_pagerank(sellers + buyers, given, tol=1e-6)
    assert {r.node: r.rank for r in got} == pytest.approx(want, abs=1e-13)
    assert report["converged"] and report["iterations"] > 60 and len(kept) < 50
