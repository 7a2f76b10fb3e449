"""What-if shocks on a hand-made graph of six nodes, against brute force."""

import random

import pytest
from conftest import rows_by
from pyspark.sql import functions as F
from test_graph import DYADS, dense_pagerank

from panelgraph.operators import impact
from panelgraph.plans.flows import what_if
from panelgraph.sources import dims

NODES = ["AAA", "BBB", "CCC", "DDD", "EEE", "FFF"]  # FFF is isolated
# source, target, directed, nature, conflict, events, deaths, articles, tone, tension
EDGES = [
    ("AAA", "BBB", False, "undirected_conflict", True, 3, 50.0, 0, None, 0.6),
    ("BBB", "CCC", True, "hybrid", True, 2, 10.0, 4, -0.3, 0.5),
    ("CCC", "DDD", True, "directed_news", False, 0, 0.0, 2, -0.1, 0.3),
    ("AAA", "CCC", True, "directed_news", False, 0, 0.0, 1, 0.2, 0.2),
    ("DDD", "EEE", True, "directed_news", False, 0, 0.0, 1, 0.2, 0.0),
]
NEWS = [("AAA", "2026-09", 10, -0.2, 4, 0.3), ("BBB", "2026-09", 5, 0.1, 1, 0.1), ("AAA", "2026-08", 1, 0.9, 9, 0.9)]
NEWS_DDL = "country_iso3 string, year_month string, news_count_total long, avg_tone double, conflict_news_count long, escalation_signal double"
METRICS_DDL = (
    "country_iso3 string, country_name string, pagerank_centrality double, in_degree long, out_degree long, "
    "total_degree long, weighted_in_degree double, weighted_out_degree double"
)
FIELDS = ["scenario_id", "target_country_iso3", "dyad_a", "dyad_b", "tone_delta", "conflict_news_multiplier",
          "tension_delta", "sever_dyadic_tie", "propagation_depth", "decay_factor"]
SCEN_DDL = ("scenario_id string, target_country_iso3 string, dyad_a string, dyad_b string, tone_delta double, "
            "conflict_news_multiplier double, tension_delta double, sever_dyadic_tie boolean, propagation_depth int, decay_factor double")


def scenario(i, target, pair=(None, None), tone=0.0, mult=1.0, tension=None, sever=False, depth=2, decay=0.5):
    return (i, target, *pair, tone, mult, tension, sever, depth, decay)


def brute_force(s, edges, nodes=NODES, news=None):
    """One scenario with plain loops over paths, every arrival on its own."""
    s = dict(zip(FIELDS, s))
    tone = {n: (news or {}).get(n, 0.0) for n in nodes}
    tone[s["target_country_iso3"]] = max(-1.0, min(1.0, tone[s["target_country_iso3"]] + s["tone_delta"]))
    tension = [e[9] for e in edges]
    direct, cut_, moved = set(), set(), set()
    for k, e in enumerate(edges):
        ends = {(e[0], e[1])} if e[2] else {(e[0], e[1]), (e[1], e[0])}
        if (s["dyad_a"], s["dyad_b"]) in ends:
            direct.add(k)
            if s["sever_dyadic_tie"]:
                cut_.add(k)
                tension[k] = 0.0
            elif s["tension_delta"] is not None:
                tension[k] = max(0.0, min(1.0, tension[k] + s["tension_delta"]))
    seed = s["tension_delta"] if s["tension_delta"] is not None else -0.5 * s["tone_delta"] + 0.2 * (s["conflict_news_multiplier"] - 1)
    hop = {s["target_country_iso3"]: 0}
    level = [(s["target_country_iso3"], seed)] if abs(seed) > 1e-4 else []
    for h in range(1, s["propagation_depth"] + 1):
        arrivals = []
        for node, delta in level:
            ways = []
            for k, e in enumerate(edges):
                if k in cut_:
                    continue
                back = e[9] if not e[2] else 0.5 * e[9] if e[3] == "hybrid" else None
                if e[0] == node:
                    ways.append((e[1], k, e[9]))
                if e[1] == node and back is not None:
                    ways.append((e[0], k, back))
            total = sum(w for *_, w in ways)
            for other, k, w in ways:
                if hop.get(other, 99) > h - 1:
                    arrivals.append((other, k, delta * s["decay_factor"] * (w / total if total else 0.0)))
        for other, k, d in arrivals:
            hop.setdefault(other, h)
            sign = (d > 0) - (d < 0)
            tone[other] = max(-1.0, min(1.0, tone[other] - sign * min(0.4, abs(d))))
            if k not in direct:
                moved.add(k)
                tension[k] = max(0.0, min(1.0, tension[k] + d))
        level = [(o, d) for o, _, d in arrivals]
    return tone, tension, hop, direct, cut_, moved


@pytest.fixture
def base(table):
    metrics = table([(n, n, round(1 / 6, 6), 1, 1, 1, 0.5, 0.5) for n in NODES], METRICS_DDL)
    return metrics, table(EDGES, DYADS), table(NEWS, NEWS_DDL)


INVALID = {
    "unknown target": scenario("a", "XYZ"),
    "unknown target ": scenario("b", ""),
    "pair of one country": scenario("c", "AAA", ("AAA", "AAA")),
    "unknown country in pair": scenario("d", "AAA", ("AAA", "FAKE")),
    "tension change without pair": scenario("e", "AAA", tension=0.3),
    "negative multiplier": scenario("f", "AAA", mult=-0.5),
    "negative depth": scenario("g", "AAA", depth=-1),
    "decay outside 0..1": scenario("h", "AAA", decay=1.5),
    "severance without pair": scenario("i", "AAA", sever=True),
    "severance of a missing edge": scenario("j", "AAA", ("AAA", "EEE"), sever=True),
    "pair needs two codes": scenario("k", "AAA", ("AAA", None)),
}


def test_scenario_rules(table, base):
    metrics, edges, _ = base
    rows = list(INVALID.values()) + [scenario("ok", "AAA", ("BBB", "AAA"), sever=True), scenario("rev", "AAA", ("DDD", "CCC"), sever=True)]
    filled = impact.with_scenario_defaults(table(rows, SCEN_DDL))
    got = rows_by(impact.check_scenarios(filled, metrics, edges), "scenario_id")
    for rule, row in INVALID.items():
        assert got[row[0]].reasons == [rule.strip()], rule
    assert got["ok"].reasons == [] and got["ok"].edge_matched
    assert got["rev"].reasons == [] and not got["rev"].edge_matched  # passes, but meets no edge


def test_archetypes_fill_unset_parameters(spark, table):
    rows = [("x", "AAA", "military_mobilization", None, 3.0), ("y", "AAA", None, None, None)]
    df = table(rows, "scenario_id string, target_country_iso3 string, archetype string, tone_delta double, conflict_news_multiplier double")
    got = rows_by(impact.with_scenario_defaults(df, dims.archetypes(spark)), "scenario_id")
    assert (got["x"].tone_delta, got["x"].conflict_news_multiplier, got["x"].decay_factor) == (-0.6, 3.0, 0.6)
    assert (got["y"].tone_delta, got["y"].conflict_news_multiplier, got["y"].propagation_depth) == (0.0, 1.0, 2)
    plain = rows_by(impact.with_scenario_defaults(df), "scenario_id")
    assert plain["x"].tone_delta == 0.0


def test_baseline_month(table, base):
    news = base[2]
    assert impact.baseline_month(news, "2026-08").count() == 1
    assert impact.baseline_month(news, "2030-01").count() == 2


SCENARIOS = [
    scenario("tone", "AAA", tone=-0.5),
    scenario("deep", "AAA", tone=-0.6, mult=2.0, depth=4, decay=0.9),
    scenario("zero", "AAA", tone=-0.5, depth=0),
    scenario("sever", "AAA", ("BBB", "AAA"), tone=0.4, sever=True, depth=3),
    scenario("tension", "BBB", ("BBB", "CCC"), tension=0.3),
    scenario("heavy", "AAA", ("AAA", "BBB"), tension=5.0, depth=4, decay=1.0),
    scenario("down", "CCC", tone=10.0, depth=2),
    scenario("isolated", "FFF", tone=-0.5),
    scenario("reverse", "CCC", ("CCC", "BBB"), tension=0.3),
    scenario("nothing", "CCC"),
]


def test_what_if_equals_brute_force(table, base):
    metrics, edges, news = base
    out = what_if(table(SCENARIOS + [INVALID["negative depth"]], SCEN_DDL), metrics, edges, news, month="2026-09", tol=1e-2)
    countries = rows_by(out["countries"], "scenario_id", "country_iso3")
    links = rows_by(out["dyads"], "scenario_id", "source_country_iso3", "target_country_iso3")
    summary = rows_by(out["summary"], "scenario_id")
    assert len(countries) == len(SCENARIOS) * 6 and len(links) == len(SCENARIOS) * len(EDGES)
    assert [r.scenario_id for r in out["rejected"].collect()] == ["g"]
    start = {"AAA": -0.2, "BBB": 0.1}
    for s in SCENARIOS:
        tone, tension, hop, direct, severed, moved = brute_force(s, EDGES, news=start)
        for n in NODES:
            row = countries[s[0], n]
            assert row.counterfactual_tone == pytest.approx(tone[n], abs=1e-12), (s[0], n)
            assert row.delta_tone == pytest.approx(tone[n] - start.get(n, 0.0), abs=6e-5)
            assert row.ripple_hop == hop.get(n, -1) and row.is_direct_target == (n == s[1])
        ways = []
        for k, e in enumerate(EDGES):
            row = links[s[0], e[0], e[1]]
            assert row.counterfactual_tension_index == pytest.approx(tension[k], abs=1e-12), (s[0], e[:2])
            assert (row.is_directly_shocked, row.is_severed, row.is_ripple_affected) == (k in direct, k in severed, k in moved)
            if k not in severed and tension[k] > 0:
                ways.append((e[0], e[1], tension[k]))
                if not e[2] or e[3] == "hybrid":
                    ways.append((e[1], e[0], tension[k] * (0.7 if e[2] else 1.0)))
        ranks = dense_pagerank(NODES, ways, tol=1e-2)
        for n in NODES:
            assert countries[s[0], n].counterfactual_pagerank == pytest.approx(ranks[n], abs=6e-7), (s[0], n)
            assert countries[s[0], n].counterfactual_weighted_out == pytest.approx(sum(w for a, _, w in ways if a == n), abs=6e-5)
            assert countries[s[0], n].counterfactual_total_degree == len({b for a, b, _ in ways if a == n} | {a for a, b, _ in ways if b == n})
        line = summary[s[0]]
        assert line.ripple_affected_countries_count == len(hop) - 1 and line.severed_dyads_count == len(severed)
        assert line.total_affected_countries_count + line.unaffected_countries_count == 6
        best = max(NODES, key=lambda n: (countries[s[0], n].delta_pagerank, -NODES.index(n)))
        assert line.max_pagerank_increase_country == best
    hit = countries["deep", "AAA"]
    assert hit.counterfactual_conflict_news_count == 8 and hit.counterfactual_escalation_signal == pytest.approx(0.3 + 0.2 + 0.18)
    assert countries["down", "CCC"].counterfactual_tone == 1.0


def test_merged_light_arrivals_are_not_capped(table):
    """Two arrivals of 0.4 meet at DDD; together they exceed the cap, each alone does not."""
    way = lambda a, b: (a, b, True, "directed_news", False, 0, 0.0, 0, None, 0.5)
    edges = [way("AAA", "BBB"), way("AAA", "CCC"), way("BBB", "DDD"), way("CCC", "DDD"), way("DDD", "EEE"), way("EEE", "FFF")]
    rows = [scenario("light", "AAA", tone=-1.6, depth=4, decay=1.0), scenario("heavy", "AAA", tone=-4.0, depth=4, decay=1.0)]
    valid, dyads = impact.with_scenario_defaults(table(rows, SCEN_DDL)), table(edges, DYADS)
    arrived, _ = impact.propagate(valid, table([(n,) for n in NODES], "country_iso3 string"), dyads, impact.shocked_edges(valid, dyads))
    got = {(r.scenario_id, r.node): r.tone_shift for r in arrived.collect()}
    assert got["light", "BBB"] == pytest.approx(-0.4) and got["light", "DDD"] == pytest.approx(-0.8)
    assert got["light", "EEE"] == pytest.approx(-0.8) and got["light", "FFF"] == pytest.approx(-0.8)
    assert got["heavy", "BBB"] == pytest.approx(-0.4) and got["heavy", "FFF"] == pytest.approx(-0.8)
    for s in rows:
        tone = brute_force(s, edges)[0]
        for n in NODES[1:]:
            assert max(-1.0, got[s[0], n]) == pytest.approx(tone[n])


def test_propagation_on_random_graphs(table):
    """Parallel ways, zero weights, strong seeds, depth up to four."""
    rng = random.Random(2)
    nodes = table([(n,) for n in NODES], "country_iso3 string")
    edges, seen = [], set()
    while len(edges) < 12:
        a, b = rng.sample(NODES, 2)
        if (a, b) in seen:
            continue
        seen.add((a, b))
        nature = rng.choice(["undirected_conflict", "hybrid", "directed_news"])
        edges.append((a, b, nature != "undirected_conflict", nature, False, 0, 0.0, 0, None, rng.choice([0.0, 0.1, 0.4, 0.9])))
    scenarios = []
    for i in range(40):
        e = rng.choice(edges)
        pair = (e[0], e[1]) if rng.random() < 0.6 else (None, None)
        tension = rng.choice([2.5, -1.5, 0.2]) if pair[0] and rng.random() < 0.6 else None
        scenarios.append(scenario(f"s{i}", rng.choice(NODES), pair, rng.choice([-0.9, 0.3, 0.0]), rng.choice([0.5, 1.0, 4.0]),
                                  tension, pair[0] is not None and rng.random() < 0.3, rng.randint(0, 4), rng.choice([0.5, 1.0])))
    valid = impact.with_scenario_defaults(table(scenarios, SCEN_DDL))
    dyads = table(edges, DYADS)
    shocked = impact.shocked_edges(valid, dyads)
    arrived, shifted = impact.propagate(valid, nodes, dyads, shocked)
    tones = rows_by(arrived.groupBy("scenario_id", "node").agg(F.sum("tone_shift").alias("t"), F.min("hop").alias("hop")), "scenario_id", "node")
    links = rows_by(impact.counterfactual_edges(valid, dyads, shocked, shifted), "scenario_id", "source_country_iso3", "target_country_iso3")
    for s in scenarios:
        tone, tension, hop, *_ = brute_force(s, edges)
        for n in NODES:
            if n != s[1]:
                got = tones.get((s[0], n))
                assert max(-1, min(1, got.t if got else 0.0)) == pytest.approx(tone[n], abs=1e-9), (s, n)
                assert (got.hop if got else None) == hop.get(n)
        for k, e in enumerate(edges):
            assert links[s[0], e[0], e[1]].counterfactual_tension_index == pytest.approx(tension[k], abs=1e-9), (s, e)


def test_a_hub_is_spread_over_slots_and_reached_all_the_same(spark, table, monkeypatch):
    """A node with half of all edges: its ways leave from many slots, and arrivals are those of a plain walk."""
    from panelgraph.plans import skew

    rnd = random.Random(2)
    edges = [("HUB", f"L{i}", rnd.uniform(0.1, 1)) for i in range(120)] + [(f"L{i}", f"M{i % 60}", rnd.uniform(0.1, 1)) for i in range(120)]
    dyads = table([(a, b, False, "undirected_conflict", w) for a, b, w in edges], "source_country_iso3 string, target_country_iso3 string, is_directed boolean, relationship_nature string, composite_tension_index double")
    nodes = table([(n,) for n in {x for a, b, _ in edges for x in (a, b)}], "country_iso3 string")
    chosen = impact.with_scenario_defaults(table([scenario("far", "M7", tone=-0.9, mult=3.0, depth=4, decay=0.9), scenario("hub", "HUB", tone=-0.9, depth=2)], SCEN_DDL))
    slots = []

    def watched(df, keys, hot, spread):
        out = skew.salt(df, keys, hot, spread)
        slots.append({r.node: r.n for r in out.groupBy("node").agg(F.count_distinct("slot").alias("n")).collect()})
        return out

    monkeypatch.setattr(impact, "salt", watched)
    monkeypatch.setattr(impact, "hot_keys", lambda df, keys: skew.hot_keys(df, keys, max_hot=20))
    arrived, _ = impact.propagate(chosen, nodes, dyads, impact.shocked_edges(chosen, dyads))
    got = {(r.scenario_id, r.node): (r.hop, r.shift) for r in arrived.groupBy("scenario_id", "node").agg(F.min("hop").alias("hop"), F.sum("tone_shift").alias("shift")).collect()}
    assert slots[0]["HUB"] > 3 and max(n for k, n in slots[0].items() if k != "HUB") == 1
    ways = {}
    for a, b, w in edges:
        ways.setdefault(a, []).append((b, w))
        ways.setdefault(b, []).append((a, w))
    for name, target, seed, depth, decay in (("far", "M7", 0.45 + 0.4, 4, 0.9), ("hub", "HUB", 0.45, 2, 0.5)):
        hops, front, shifts = {target: 0}, [(target, seed)], {}
        for hop in range(1, depth + 1):
            new = [(b, d * decay * w / sum(x for _, x in ways[a])) for a, d in front for b, w in ways[a] if hops.get(b, hop) >= hop]
            for b, d in new:
                hops.setdefault(b, hop)
                shifts[b] = shifts.get(b, 0.0) - min(0.4, d)
            front = new
        assert {n: h for (s, n), (h, _) in got.items() if s == name} == {n: hops[n] for n in shifts}
        assert all(got[name, n][1] == pytest.approx(shifts[n]) for n in shifts)
