"""Classifier, bands, outlook, stress and quality gates."""

import hashlib
import math
import random

import pytest
from conftest import rows_by
from pyspark.sql import functions as F

from panelgraph.operators import quality, scoring
from panelgraph.sources import dims


def test_entity_totals_and_label(table):
    rows = [("A", "30"), ("A", "30"), ("B", "50"), ("B", None), ("C", "junk"), (None, "999"), ("D", "NaN")]
    got = rows_by(scoring.entity_totals(table(rows, "country string, fatalities string")), "country")
    assert {k: (r.recent_events, r.conflict_intensity, r.escalation_warning) for k, r in got.items()} == {
        "A": (2, 60.0, 1), "B": (2, 50.0, 0), "C": (1, 0.0, 0), "D": (1, 0.0, 0)}


def test_classifier_learns_and_split_ignores_partitions(spark, table, tmp_path):
    totals = table([(f"c{i}", i % 7 + 1, float(i)) for i in range(200)], "country string, recent_events long, conflict_intensity double")
    totals = totals.withColumn("escalation_warning", (F.col("conflict_intensity") > 50).cast("int"))
    a, b = (scoring.with_split(totals.repartition(n)) for n in (1, 9))
    assert a.exceptAll(b).count() == 0 and 120 < a.filter("is_train").count() < 190
    model = scoring.train_classifier(a, trees=10)
    scoring.save_model(model, str(tmp_path / "model"))
    model = scoring.load_model(str(tmp_path / "model"))
    assert scoring.accuracy(model, a) > 0.9
    got = rows_by(scoring.score(model, a), "country")
    assert got["c199"].status == "High Escalation Risk" and got["c1"].status == "Normal / Low Risk"
    table_ = scoring.importances(model, spark)
    assert sum(r.importance for r in table_.collect()) == pytest.approx(1.0)
    assert scoring.top_importances(table_, top=1).first().feature == "conflict_intensity"
    with pytest.raises(ValueError):
        scoring.train_classifier(a.limit(1))


def plain_forest(model):
    """The fitted forest in plain Python: features -> class, by walking its trees."""

    def read(node):
        stats = list(node.impurityStats().stats())
        if node.numDescendants() == 0:
            return [x / sum(stats) for x in stats]
        split = node.split()
        return split.featureIndex(), split.threshold(), read(node.leftChild()), read(node.rightChild())

    def votes(node, x):
        while isinstance(node, tuple):
            node = node[2] if x[node[0]] <= node[1] else node[3]
        return node

    trees = [read(t._java_obj.rootNode()) for t in model.stages[-1].trees]

    def predict(x):
        total = [sum(v) for v in zip(*(votes(t, x) for t in trees), strict=True)]
        return total.index(max(total))

    return predict


def test_scores_and_permutation_importances_match_plain_python(spark, table):
    rnd = random.Random(4)
    rows = [(f"c{i}", rnd.randrange(1, 9), rnd.uniform(30, 70)) for i in range(300)]
    totals = table(rows, "country string, recent_events long, conflict_intensity double")
    totals = scoring.with_split(totals.withColumn("escalation_warning", (F.col("conflict_intensity") > 50).cast("int"))).cache()
    model = scoring.train_classifier(totals, trees=8)
    predict = plain_forest(model)
    held = [r for r in totals.collect() if not r.is_train]
    scored = rows_by(scoring.score(model, totals), "country")
    assert all(scored[c].escalation_prediction == predict((n, x)) for c, n, x in rows)
    place = lambda r: hashlib.md5(f"42:swap:{r.country}".encode()).hexdigest()
    for group_rows in (4096, 20):
        groups = {}
        for r in held:
            groups.setdefault(int(place(r)[24:], 16) % math.ceil(len(held) / group_rows), []).append(r)
        pairs = [(r, q[(i + 1) % len(q)]) for g in groups.values() for q in [sorted(g, key=place)] for i, r in enumerate(q)]
        right = lambda of: sum(predict(of(r, o)) == r.escalation_warning for r, o in pairs) / len(held)
        whole = right(lambda r, o: (r.recent_events, r.conflict_intensity))
        want = {
            "recent_events": whole - right(lambda r, o: (o.recent_events, r.conflict_intensity)),
            "conflict_intensity": whole - right(lambda r, o: (r.recent_events, o.conflict_intensity)),
        }
        got = rows_by(scoring.permutation_importances(model, totals.filter("not is_train"), group_rows=group_rows, categories={"conflict_intensity": "deaths"}), "feature")
        assert {f: r.importance for f, r in got.items()} == pytest.approx(want)
        assert got["conflict_intensity"].category == "deaths" and want["conflict_intensity"] > 0.2
    assert scoring.permutation_importances(model, totals.limit(0)).count() == 0


def test_top_importances_by_category(table):
    rows = [(f"f{i:02d}", "macro" if i % 2 else "market", float(i)) for i in range(20)]
    df = table(rows, "feature string, category string, importance double")
    assert [r.feature for r in scoring.top_importances(df).collect()] == [f"f{i:02d}" for i in range(19, 3, -1)]
    assert scoring.top_importances(df, "macro").count() == 10


@pytest.mark.parametrize(
    "domain,score,status",
    [("conflict", 80.0, "Critical"), ("conflict", 79.9, "Elevated"), ("conflict", 44.9, "Guarded"), ("economy", 50.0, "Moderate Exposure"),
     ("energy", 75.0, "Acute Disruption"), ("global_impact", 54.0, "Localized"), ("overview", 55.0, "medium"), ("hotspot", 85.0, "critical"),
     ("escalation", 50.0, None)],
)
def test_status_bands(table, domain, score, status):
    assert scoring.with_status(table([(domain, score)], "domain string, score double")).first().status == status


def test_sub_scores_and_contributions(table):
    got = rows_by(scoring.sub_scores(table([("p", 99.0), ("q", 50.0)], "pair string, score double")), "pair", "signal")
    assert got["p", "political"].sub_score == 93 and got["p", "cyber"].sub_score == 81 and got["q", "border"].sub_score == 38
    up, down = scoring.split_contributions(table([(1.0,), (-2.0,), (0.0,)], "contribution double"))
    assert (up.count(), down.count()) == (1, 1)


def test_outlook(spark, table):
    dyads = table([("B", "A", 0.5), ("A", "B", 0.645), ("C", "A", 0.99)], "source_country_iso3 string, target_country_iso3 string, composite_tension_index double")
    scores = rows_by(scoring.outlook(scoring.pair_bases(dyads)), "pair_a", "pair_b", "horizon_days", "domain")
    assert len(scores) == 2 * 4 * 5
    assert scores["A", "B", 30, "escalation"].score == 62  # 65 - 3
    assert scores["A", "B", 30, "conflict"].score == 63  # round(-2.4) = -2
    assert scores["A", "B", 365, "energy"].score == 71  # round(6.3) = 6
    assert scores["A", "C", 180, "escalation"].score == 96 and scores["A", "C", 180, "conflict"].status == "Critical"
    given = table([("A", "B", 82.0, 88.0, 72.0, 86.0, 84.0)], "pair_a string, pair_b string, escalation double, conflict double, economy double, energy double, global_impact double")
    bases = scoring.pair_bases(dyads, given)
    over = rows_by(scoring.outlook(bases, domains=["economy"]), "pair_a", "pair_b", "horizon_days")
    assert over["A", "B", 90].score == 73 and over["A", "C", 90].score == 95
    fan = rows_by(scoring.outlook_fan(scoring.outlook(scoring.pair_bases(dyads))), "pair_a", "pair_b", "horizon_days", "step")
    last = fan["A", "B", 30, 5]
    assert (last.horizon, last.risk, last.upper, last.lower, last.baseline) == ("365D", 72, 89, 56, 60)
    drivers = scoring.outlook_drivers(scoring.outlook(scoring.pair_bases(dyads)), ["energy"]).collect()
    assert len(drivers) == 8 and {r.impact for r in drivers} == {"high", "medium"}


def test_factor_stress(spark):
    got = rows_by(scoring.factor_stress(dims.stress_presets(spark)), "shock_id")
    war = got["war_escalation"]
    net = 0.68 - 0.27 - 16.5 * 0.095 - 6.8 * 0.04 - 1.8 * 0.22
    assert war.net_return_forecast == pytest.approx(net, abs=6e-3)
    assert war.downside_probability == pytest.approx(min(95, 41.6 + 22.5 + 16.5 * 1.25 + 6.8 * 0.75 + 1.8 * 2.8), abs=0.06)
    assert war.projected_level == pytest.approx(25014.6 * (1 + net / 100), abs=0.51)
    assert got["de_escalation"].downside_probability == pytest.approx(41.6 - 6.75 - 10.625 - 2.4 - 2.24, abs=0.06)


def test_gates(table):
    df = table([(1.0, 5, "a"), (float("nan"), 6, "b"), (None, 7, None)], "x double, n int, s string")
    got = rows_by(
        quality.stack_checks(
            quality.not_empty(df), quality.has_columns(df, ["x", "y"]), quality.no_nulls(df, ["s"]), quality.finite_numbers(df),
            quality.in_bounds(df, {"n": (5, 6)}), quality.boolean_columns(df, ["n"]), quality.conserved(df, "n", 18.0),
        ),
        "rule",
    )
    passed = {k: r.passed for k, r in got.items()}
    assert passed == {"not empty": True, "has x": True, "has y": False, "no nulls in s": False, "finite x": False, "finite n": True,
                      "n in [5, 6]": False, "n is boolean": False, "sum of n is 18.0": True}
    assert got["finite x"].observed == 2 and got["n in [5, 6]"].observed == 1
    assert rows_by(quality.finite_numbers(df, allow_null=None), "rule")["finite x"].observed == 1
    with pytest.raises(ValueError, match="no nulls in s"):
        quality.enforce(quality.no_nulls(df, ["s"]))
    quality.enforce(quality.not_empty(df))
    assert not quality.not_empty(df.filter("n > 9")).first().passed
    pairs = table([("a", "a"), ("a", "b")], "source_country_iso3 string, target_country_iso3 string")
    assert quality.no_self_loops(pairs).first().observed == 1
    keys = table([("a",), ("b",)], "s string")
    assert quality.same_keys(df.filter("s is not null"), keys, ["s"]).first().passed
    assert quality.same_keys(keys, keys.limit(1), ["s"]).first().observed == 1
    assert not quality.same_count(keys, df).first().passed
    assert quality.joinable(keys, df, ["s"]).first().observed == 2


def test_fused_rules_read_a_table_once(spark, table, tmp_path):
    rows = [("A", 1.0, 5), ("B", float("nan"), None), (None, 3.0, 200), ("D", None, -1)]
    df = table(rows, "k string, x double, n int")
    rules = lambda d: (quality.rows_rule(), quality.null_rules(["k"]), quality.finite_rules(d, allow_null=["n"]), quality.bound_rules({"n": (0, 100)}), quality.sum_rule("n", 204.0))
    want = {
        "not empty": (True, 4.0), "no nulls in k": (False, 1.0), "finite x": (False, 2.0), "finite n": (True, 0.0), "n in [0, 100]": (False, 2.0),
        "sum of n is 204.0": (True, 204.0),
    }
    written = quality.write_checked(df, str(tmp_path / "t"), *rules(df))
    assert {r.rule: (r.passed, r.observed) for r in written.collect()} == want
    stored = spark.read.parquet(str(tmp_path / "t"))
    fused = quality.check(stored, *rules(stored))
    assert {r.rule: (r.passed, r.observed) for r in fused.collect()} == want
    assert fused._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    apart = quality.stack_checks(quality.not_empty(stored), quality.no_nulls(stored, ["k"]), quality.finite_numbers(stored, allow_null=["n"]), quality.in_bounds(stored, {"n": (0, 100)}), quality.conserved(stored, "n", 204.0))
    assert sorted(map(tuple, apart.collect())) == sorted(map(tuple, fused.collect()))
    nothing = quality.write_checked(df.limit(0), str(tmp_path / "e"), *rules(df))
    assert {r.rule for r in nothing.collect() if not r.passed} == {"not empty", "sum of n is 204.0"}
    with pytest.raises(ValueError, match="twice"):
        quality.check(df, quality.rows_rule(), quality.rows_rule())
    with pytest.raises(ValueError, match="no nulls in k"):
        quality.enforce(fused)
