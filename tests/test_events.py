"""Cleaning, the event panel and its features."""

import datetime as dt
import functools
import operator
import random

import pytest
from conftest import rows_by
from pyspark.sql import functions as F

from panelgraph.functions.numbers import safe_growth, safe_growth_or_zero
from panelgraph.operators import clean, features, panel

D = dt.date
CLEAN = "id long, country_iso3 string, event_date date, best double, low double, high double, deaths_civilians double, type_of_violence int"
RAW = (
    "id string, year string, type_of_violence string, conflict_name string, side_a string, side_b string, "
    "country string, country_id string, region string, date_start string, date_end string, best string, "
    "high string, low string, deaths_civilians string, latitude string, longitude string, seq int"
)


def raw(id="1", year="2020", kind="1", country="Algeria", code="615", start="2020-03-04", end="2020-03-05",
        best="5", high="6", low="4", civ="1", lat="10", lon="20", seq=0):
    return (id, year, kind, "c", "a", "b", country, code, "r", start, end, best, high, low, civ, lat, lon, seq)


@pytest.mark.parametrize(
    "current,previous,expected", [(0, 0, 0.0), (50, 0, 10.0), (5, 10, -0.5), (10, 0, 10.0), (0, 10, -1.0), (500, 1, 10.0), (100, 100, 0.0)]
)
def test_growth_never_divides_by_zero(table, current, previous, expected):
    row = table([(float(current), float(previous))], "c double, p double").select(
        safe_growth(F.col("c"), F.col("p")).alias("g")).first()
    assert row.g == expected


def test_growth_with_missing_history(table):
    df = table([(3.0, None)], "c double, p double")
    row = df.select(safe_growth(F.col("c"), F.col("p")).alias("a"), safe_growth_or_zero(F.col("c"), F.col("p")).alias("b")).first()
    assert row.a is None and row.b == 0.0


def test_country_code_by_number_then_name(table):
    df = table([("615", "Algeria"), (None, " Colombia "), ("999999", "Nowhere"), ("615.0", "x")], "country_id string, country string")
    got = {r.country: r.country_iso3 for r in clean.with_country_codes(df).collect()}
    assert got == {"Algeria": "DZA", " Colombia ": "COL", "Nowhere": None, "x": "DZA"}


def test_clean_events(table):
    rows = [
        raw(seq=0),
        raw(best="99", seq=1),  # same id, later: dropped
        raw(id="2", start="junk", end="2021-02-03 04:05:06", seq=2),
        raw(id="3", start=None, end=None, year="2019", seq=3),
        raw(id="4", start=None, end=None, year="x", seq=4),  # no date at all: dropped
        raw(id="5", code="0", country="Atlantis", seq=5),  # unmapped: dropped
        raw(id="6", best="-3", high="NaN", low="junk", civ=None, kind="7", lat="95", lon="20", seq=6),
        raw(id="7", lat=None, lon="20", kind=None, seq=7),
    ]
    got = rows_by(clean.clean_events(table(rows, RAW), order=F.col("seq")), "id")
    assert set(got) == {"1", "2", "3", "6", "7"}
    assert got["1"].best == 5.0 and got["1"].violence_type_label == "state_based"
    assert got["2"].event_date == D(2021, 2, 3) and got["2"].year_month == "2021-02"
    assert got["3"].event_date == D(2019, 1, 1)
    assert (got["6"].best, got["6"].high, got["6"].low, got["6"].deaths_civilians) == (0, 0, 0, 0)
    assert got["6"].violence_type_label == "unknown" and got["6"].latitude is None and got["6"].longitude is None
    assert got["7"].latitude is None and got["7"].longitude == 20.0 and got["7"].type_of_violence == 0
    assert list(got["1"].asDict()) == list(clean.CLEAN_EVENT_COLUMNS)


def test_unmapped_countries_are_reported(table):
    rows = [raw(), raw(id="2", code=None, country="Atlantis"), raw(id="3", code="1", country="Atlantis")]
    got = clean.unmapped_countries(table(rows, RAW)).collect()
    assert [(r.country, r.records) for r in got] == [("Atlantis", 2)]


def test_keep_first_ignores_partitioning(table):
    rows = [raw(id=str(i % 5), best=str(i), seq=i) for i in range(100)]
    df = table(rows, RAW)
    for n in (1, 7):
        got = rows_by(clean.clean_events(df.repartition(n), order=F.col("seq")), "id")
        assert {k: r.best for k, r in got.items()} == {str(i): float(i) for i in range(5)}


EVENTS = [
    (1, "COL", D(2020, 1, 15), 10.0, 8.0, 12.0, 2.0, 1),
    (2, "COL", D(2020, 2, 10), 5.0, 4.0, 6.0, 1.0, 2),
    (3, "DZA", D(2020, 1, 20), 3.0, 2.0, 4.0, 0.0, 1),
]


def test_panel_fills_silence_with_zero(table):
    got = rows_by(panel.event_panel(table(EVENTS, CLEAN), min_year=2020, max_year=2020), "country_iso3", "year_month")
    assert len(got) == 24
    silent, busy = got["DZA", "2020-02"], got["COL", "2020-01"]
    assert (silent.events_total, silent.fatalities_best_total, silent.has_conflict_event) == (0, 0.0, 0)
    assert (busy.events_total, busy.fatalities_best_total, busy.has_conflict_event) == (1, 10.0, 1)
    assert got["COL", "2020-02"].events_non_state == 1 and got["COL", "2020-02"].events_state_based == 0


def test_panel_clips_years_but_keeps_entities(table):
    rows = EVENTS + [(4, "AGO", D(2018, 5, 1), 1.0, 1.0, 1.0, 0.0, 1), (5, "AGO", D(2018, 6, 1), 1.0, 1.0, 1.0, 0.0, 1),
                     (6, "COL", D(2018, 6, 1), 7.0, 1.0, 1.0, 0.0, 1)]
    df = panel.event_panel(table(rows, CLEAN), min_year=2019, max_year=2020)
    got = rows_by(df, "country_iso3", "year_month")
    assert len(got) == 3 * 24
    assert all(r.events_total == 0 for k, r in got.items() if k[0] == "AGO")
    assert sum(r.fatalities_best_total for r in got.values()) == 18.0


def test_panel_equals_brute_force(table):
    rng = random.Random(7)
    rows = [(i, rng.choice("ABCDE"), D(rng.choice([2018, 2019, 2020]), rng.randint(1, 12), rng.randint(1, 28)),
             float(rng.randint(0, 9)), 0.0, 0.0, 0.0, rng.randint(1, 4)) for i in range(60)]
    got = rows_by(panel.event_panel(table(rows, CLEAN)), "country_iso3", "month_start")
    want = {(c, D(y, m, 1)): 0.0 for c in {r[1] for r in rows} for y in range(min(r[2].year for r in rows), max(r[2].year for r in rows) + 1) for m in range(1, 13)}
    for r in rows:
        want[r[1], r[2].replace(day=1)] += r[3]
    assert {k: r.fatalities_best_total for k, r in got.items()} == want


def test_feature_columns_are_complete(table):
    df = features.event_features(panel.event_panel(table(EVENTS, CLEAN)))
    assert len(df.columns) == 49 and df.columns[-1] == "project_active_conflict_indicator"
    assert df.columns[17:19] == ["fatalities_lag_1m", "events_lag_1m"]
    assert df.columns[33:36] == ["fatalities_rolling_sum_3m", "events_rolling_sum_3m", "fatalities_rolling_mean_3m"]


def test_event_feature_values(table):
    got = rows_by(features.event_features(panel.event_panel(table(EVENTS, CLEAN))), "country_iso3", "year_month")
    jan, feb, mar, may = (got["COL", f"2020-0{m}"] for m in (1, 2, 3, 5))
    assert (jan.fatalities_lag_1m, feb.fatalities_lag_1m, mar.fatalities_lag_2m) == (0, 10.0, 10.0)
    assert (jan.fatalities_prior_sum_3m, mar.fatalities_prior_sum_3m, may.fatalities_prior_sum_3m) == (0, 15.0, 5.0)
    assert (jan.fatalities_rolling_mean_3m, feb.fatalities_rolling_mean_3m, mar.fatalities_rolling_mean_3m) == (10.0, 7.5, 5.0)
    assert feb.delta_fatalities_1m == -5.0 and feb.growth_rate_fatalities_1m == -0.5
    assert jan.growth_rate_events_1m == 1.0 and jan.project_active_conflict_indicator == 0


def test_active_threshold(table):
    rows = [(1, "COL", D(2020, 1, 1), 24.0, 0.0, 0.0, 0.0, 1), (2, "COL", D(2020, 2, 1), 1.0, 0.0, 0.0, 0.0, 1)]
    got = rows_by(features.event_features(panel.event_panel(table(rows, CLEAN))), "year_month")
    assert [got[f"2020-{m:02d}"].project_active_conflict_indicator for m in (1, 2, 12)] == [0, 1, 1]


def test_no_leakage_from_future_events(table):
    base = [(1, "AFG", D(2021, 1, 10), 15.0, 10.0, 20.0, 5.0, 1), (2, "AFG", D(2021, 2, 15), 20.0, 15.0, 25.0, 8.0, 1)]
    later = base + [(3, "AFG", D(2021, 3, 25), 500.0, 400.0, 600.0, 100.0, 1)]
    a, b = (rows_by(features.event_features(panel.event_panel(table(r, CLEAN))), "year_month") for r in (base, later))
    for month in ("2021-01", "2021-02"):
        assert a[month] == b[month]
    assert a["2021-03"] != b["2021-03"]


def test_features_share_the_panel_shuffle(table):
    df = features.event_features(panel.event_panel(table(EVENTS, CLEAN)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    # the monthly totals are a table: one exchange by entity is left, for gaps and all windows
    assert plan.count("Exchange hashpartitioning") == 1
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_dirty_numbers_and_dates_end_no_job(table):
    given = [("1e30", "1", "2020-02-15"), ("615", "99999999999", "02/15/2020"), ("615", "nan", "15 Feb 2020"), ("615", "2", "20200215"), ("615", "3", "Feb 15, 2020")]
    rows = [raw(id=str(i), code=c, kind=k, start=d, end="", seq=i) for i, (c, k, d) in enumerate(given)]
    got = {r.id: r for r in clean.clean_events(table(rows, RAW), order=F.col("seq")).collect()}
    assert len(got) == 5 and {str(r.event_date)[:10] for r in got.values()} == {"2020-02-15"}
    assert got["1"].type_of_violence == 0 and got["3"].type_of_violence == 2


def test_wide_features_fetch_earlier_rows_once_and_compile(spark):
    import __spark_entry__

    panel_rows = spark.createDataFrame(
        [("A", f"2020-{m:02d}-01", None if m == 4 else 0.1 * m, m) for m in range(1, 13)] + [("B", "2020-01-01", None, 5)],
        "country_iso3 string, m string, fatalities_best_total double, events_total long",
    ).selectExpr("country_iso3", "to_date(m) as month_start", "fatalities_best_total", "events_total")
    table = features.event_features(panel_rows)
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert "lag(" in plan and " sum(" not in plan and " avg(" not in plan
    out = {(r.country_iso3, r.month_start.month): r for r in table.collect()}
    best = [None if m == 4 else 0.1 * m for m in range(1, 13)]
    for m in range(1, 13):
        for n in (3, 6, 12):
            known = [x for x in best[max(0, m - n) : m] if x is not None]
            assert out["A", m][f"fatalities_rolling_sum_{n}m"] == functools.reduce(operator.add, known)  # the built-in compensates
            assert out["A", m][f"fatalities_rolling_mean_{n}m"] == functools.reduce(operator.add, known) / len(known)
            assert out["A", m][f"events_prior_sum_{n}m"] == sum(range(max(1, m - n), m))
    assert out["B", 1].fatalities_rolling_sum_3m == 0 and out["B", 1].fatalities_rolling_mean_3m == 0
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    __spark_entry__.queries()["event_features"](spark, "/root/testdata/sf0.001")
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
