"""Article parsing, text scoring, deduplication, the news panel and its features."""

import datetime as dt
import random
import re

import pytest
from conftest import rows_by
from pyspark.sql import functions as F

from panelgraph import fixed_values as fv
from panelgraph.functions import dates, text
from panelgraph.operators import articles as art
from panelgraph.operators import features, panel

RAW = "url string, title string, seendate string, domain string, language string, sourcecountry string, seq int"
SCORED = (
    "article_id string, published_at_utc timestamp, target_country_iso3 string, domain string, "
    "is_conflict_relevant boolean, tone_score double, is_negative_tone boolean, is_extreme_tone boolean, "
    "cat_military_escalation boolean, cat_armed_conflict boolean, cat_ceasefire_peace boolean, cat_sanctions_economic boolean"
)
T = lambda s: dt.datetime.fromisoformat(s)


def ask(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    "seen,expected",
    [
        ("20260813T024500Z", "2026-08-13 02:45:00"), ("20260813024500", "2026-08-13 02:45:00"),
        ("20260813", "2026-08-13 00:00:00"), (" 2026-08-13 02:45:00 ", "2026-08-13 02:45:00"),
        ("2026-08-13", "2026-08-13 00:00:00"), ("", None), ("invalid_date", None), (None, None),
    ],
)
def test_article_time(spark, seen, expected):
    assert ask(spark, seen, lambda c: dates.article_time(c).cast("string")) == expected


@pytest.mark.parametrize("domain,expected", [(" WWW.BBC.com ", "bbc.com"), ("www.www.x.y", "www.x.y"), ("", "unknown"), (None, "unknown"), ("a.b", "a.b")])
def test_domain(spark, domain, expected):
    assert ask(spark, domain, text.canonical_domain) == expected


def test_article_id_ignores_case_and_outer_space(spark):
    df = spark.createDataFrame([(" HTTP://A/b\n", "Title "), ("http://a/b", "\ttitle")], "u string, t string")
    ids = [r.x for r in df.select(text.article_id(F.col("u"), F.col("t")).alias("x")).collect()]
    assert ids[0] == ids[1] and re.fullmatch("[0-9a-f]{16}", ids[0])


@pytest.mark.parametrize(
    "title,entity,confidence",
    [
        ("Heavy missile strikes hit Kyiv infrastructure", "UKR", 0.9),
        ("Global technology markets experience major rally", None, 0.0),
        ("Sudanese army advances in key border region", "SDN", 0.9),
        ("Sudan and South Sudan talk", "SSD", 0.95),  # phrases first
        ("US troops near Baghdad", "IRQ", 0.9),  # long words before short ones
        ("The US view", "USA", 0.75),
        ("A us-led force", None, 0.0),  # the hyphen makes another token
        ("Mali and Niger", "MLI", 0.9),  # list order on ties
        ("Al-Shabaab attack", "SOM", 0.9),
        ("New Delhian style", "IND", 0.95),  # phrases ignore word boundaries
        ("Résumé of Irané", None, 0.0),  # accented letters belong to the word
        (None, None, 0.0),
    ],
)
def test_target_entity(spark, title, entity, confidence):
    got = ask(spark, title, lambda c: text.target_entity(c, text.tokens(c)))
    assert (got.entity, got.confidence) == (entity, confidence)


def classify(spark, title):
    return art.with_taxonomy(spark.createDataFrame([(title,)], "title string")).first()


def test_taxonomy(spark):
    a = classify(spark, "Artillery shelling and troop buildup along frontline positions")
    assert a.is_conflict_relevant and a.cat_armed_conflict and a.cat_military_escalation
    assert a.conflict_category_count == 3 and a.primary_conflict_category == "armed_conflict"
    b = classify(spark, "Factions agree to immediate ceasefire and humanitarian truce")
    assert b.cat_ceasefire_peace and b.conflict_category_count == 2 and b.primary_conflict_category == "ceasefire_peace"
    c = classify(spark, "New trade restrictions and asset freeze sanctions announced")
    assert c.cat_sanctions_economic and c.conflict_category_count == 2  # no stemming of 'restrictions'
    d = classify(spark, "City announces new public transport electric bus fleet")
    assert not d.is_conflict_relevant and d.conflict_category_count == 0 and d.primary_conflict_category == "none"
    e = classify(spark, "Border clash: war, war, WAR; wardrobe")  # overlap counts twice, repeats once
    assert e.conflict_category_count == 3 and e.cat_border_tensions and e.cat_armed_conflict
    f = classify(spark, "Border clash")
    assert f.primary_conflict_category == "armed_conflict"  # first category wins the tie


def test_keywords_equal_single_searches(spark):
    rng = random.Random(3)
    words = [w for ws in fv.TAXONOMY.values() for w in ws]
    extra = ["refugee", "camp", "trade", "restriction-free", "é", "war_", "-war", "the", "peace"]
    lexicon = words + ["peace", "peace deal now", "camp"]  # also keywords that begin other keywords
    titles = [" ".join(rng.choice(words + extra) for _ in range(rng.randint(1, 12))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    got = df.select("t", text.keywords_found(F.col("t"), lexicon).alias("k")).collect()
    for row in got:
        assert set(row.k) == {w for w in lexicon if re.search(rf"\b{re.escape(w)}\b", row.t)}, row.t


def test_tokens_equal_plain_search(spark):
    titles = ["state-of-the-art café foo- us-led éa the", "--a-- 9-foo foo-9 x_y a1 'tis it's", "ÉÀ ABC dÉf", ""]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    for row in df.select("t", text.tokens(F.col("t")).alias("k")).collect():
        assert row.k == re.findall(r"\b[a-z\-]+\b", row.t.lower())


@pytest.mark.parametrize(
    "title,tone,negative,extreme",
    [
        ("Deadly attack kills dozens in terror massacre", (-0.8 - 0.7 - 1.0) / 3, True, True),
        ("Historic peace treaty brings ceasefire, relief, and cooperation", (0.8 + 0.6 + 0.7 + 0.5 + 0.6) / 5, False, True),
        ("Weather forecast indicates seasonal temperatures", 0.0, False, False),
        ("war war peace", (-0.8 - 0.8 + 0.8) / 3, True, False),  # every occurrence counts
        ("", 0.0, False, False),
    ],
)
def test_tone(spark, title, tone, negative, extreme):
    df = spark.createDataFrame([(title, 1)], "title string, conflict_category_count int")
    row = art.with_tone(df).first()
    assert row.tone_score == pytest.approx(tone, abs=1e-12)
    assert (row.is_negative_tone, row.is_extreme_tone) == (negative, extreme)


def test_intensity(spark):
    rows = [("one two  three\nfour", 2), ("x", 3), ("", 1)]
    got = art.with_tone(spark.createDataFrame(rows, "title string, conflict_category_count int")).collect()
    assert [r.conflict_intensity for r in got] == [0.5, 1.0, 1.0]


ARTICLES = [
    ("https://a.com/1", "Sudan peace talks resume", "20260715T100000Z", "www.a.com", "English", "United States", 0),
    ("https://a.com/1", "Sudan peace talks resume", "20260715T100000Z", "a.com", "English", "France", 1),
    ("https://b.com/m", "Sudan peace talks resume", "20260715T123000Z", "b.com", "English", "Kenya", 2),
    ("https://b.com/m", "Sudan peace talks resume", "20260716T123000Z", "b.com", None, " kenya ", 3),
    ("https://c.com/m", "Sudan peace talks resume", "20260716T123000Z", "", None, "Narnia", 4),
    ("  ", "No url", "20260716T123000Z", "", None, "Kenya", 5),
    ("https://d.com", " ", "20260716T123000Z", "", None, "Kenya", 6),
    ("https://e.com", "No time", "soon", "", None, "Kenya", 7),
]


@pytest.mark.parametrize("parts", [1, 5])
def test_normalize_keeps_first_copies(table, parts):
    df = art.normalize_articles(table(ARTICLES, RAW).repartition(parts), order=F.col("seq"))
    got = rows_by(df, "url")
    # b.com/m: its first copy is a mirror of a.com on the 15th, so the 16th belongs to c.com
    assert set(got) == {"https://a.com/1", "https://c.com/m"}
    a, c = got["https://a.com/1"], got["https://c.com/m"]
    assert (a.source_country_iso3, a.target_country_iso3, a.domain, a.year_month) == ("USA", "SDN", "a.com", "2026-07")
    assert (c.source_country_iso3, c.language, c.domain, c.raw_sourcecountry) == (None, "English", "unknown", "Narnia")
    assert list(a.asDict()) == list(art.ARTICLE_COLUMNS)


def article(i, at, target="UKR", domain="a", relevant=True, tone=-0.5, negative=True, extreme=False, cats=(False, True, False, False)):
    return (f"art{i}", T(at), target, domain, relevant, tone, negative, extreme, *cats)


def test_no_leakage_from_future_articles(table):
    base = [article(1, "2026-06-10"), article(2, "2026-07-15")]
    later = base + [article(3, "2026-08-20", tone=-0.9)]
    a, b = (rows_by(features.news_features(panel.news_panel(table(r, SCORED))), "year_month") for r in (base, later))
    same = [c for c in a["2026-06"].asDict() if c != "is_partial_month"]
    for month in ("2026-06", "2026-07"):
        assert [a[month][c] for c in same] == [b[month][c] for c in same]


def test_unobserved_history_stays_missing(table):
    rows = [article(1, "2026-07-15 10:00:00", "SDN"), article(2, "2026-08-10 12:00:00", "SDN")]
    got = rows_by(features.news_features(panel.news_panel(table(rows, SCORED))), "year_month")
    jul, aug = got["2026-07"], got["2026-08"]
    for c in ("conflict_news_lag_1m", "conflict_news_lag_6m", "conflict_news_prior_sum_3m", "delta_conflict_news_1m",
              "safe_conflict_news_growth_rate_1m", "momentum_conflict_news_log_1m", "conflict_news_rolling_sum_3m"):
        assert jul[c] is None
    assert aug.conflict_news_lag_1m == 1 and aug.conflict_news_lag_12m is None and aug.safe_conflict_news_growth_rate_1m == 0.0


def test_observed_silence_is_zero(table):
    rows = [article(1, "2026-07-20", "COL"), article(2, "2026-09-15", "COL", tone=-0.6)]
    got = rows_by(features.news_features(panel.news_panel(table(rows, SCORED))), "year_month")
    assert (got["2026-08"].news_count_total, got["2026-08"].conflict_news_count, got["2026-08"].avg_tone) == (0, 0, 0.0)
    assert got["2026-09"].conflict_news_lag_1m == 0 and got["2026-08"].conflict_news_lag_1m == 1
    assert got["2026-09"].avg_tone_rolling_mean_3m == pytest.approx((-0.5 + 0.0 - 0.6) / 3)


def test_news_signals(table):
    rows = [article(1, "2026-07-01", domain="a", cats=(True, True, False, True)), article(2, "2026-07-02", domain="a", relevant=False, tone=0.1, negative=False),
            article(3, "2026-07-30 23:59:59", domain="b", negative=False, extreme=True), article(4, "2026-07-03", domain="b", relevant=None, tone=0.0, negative=False)]
    r = panel.news_panel(table(rows, SCORED)).first()
    assert (r.news_count_total, r.unique_domains_count, r.conflict_news_count) == (4, 2, 2)
    assert (r.conflict_news_ratio, r.negative_tone_share, r.source_diversity) == (0.5, 0.25, 0.5)
    assert r.escalation_signal == pytest.approx(0.4 * 0.5 + 0.3 * 0.25 + 0.3 * 0.25)
    assert (r.military_escalation_count, r.armed_conflict_count, r.sanctions_count) == (1, 2, 1)
    assert r.conflict_news_avg_tone == pytest.approx(-0.5) and r.is_partial_month is False


def test_partial_months(table):
    rows = [article(1, "2026-07-14 23:45:00"), article(2, "2026-10-02 08:15:00")]
    got = rows_by(panel.news_panel(table(rows, SCORED)), "year_month")
    assert [got[f"2026-{m:02d}"].is_partial_month for m in (7, 8, 9, 10)] == [True, False, False, True]


def test_partial_month_edges(table):
    rows = [article(1, "2026-07-02 00:00:00"), article(2, "2026-09-29 23:59:58")]
    got = rows_by(panel.news_panel(table(rows, SCORED)), "year_month")
    assert [got[f"2026-{m:02d}"].is_partial_month for m in (7, 8, 9)] == [False, False, True]


def test_panel_takes_reference_entities(table):
    rows = [article(1, "2026-07-02", "UKR"), article(2, "2026-08-03", "UKR")]
    refs = table([("UKR",), ("FRA",), ("FRA",)], "country_iso3 string")
    got = rows_by(panel.news_panel(table(rows, SCORED), entities=refs), "country_iso3", "year_month")
    assert set(got) == {(c, m) for c in ("UKR", "FRA") for m in ("2026-07", "2026-08")}
    assert got["FRA", "2026-08"].news_count_total == 0


def test_source_country_stands_in_only_when_no_target_exists(table):
    ddl = SCORED + ", source_country_iso3 string"
    none = [article(1, "2026-07-02", None) + ("GBR",), article(2, "2026-08-03", None) + (None,)]
    got = panel.news_panel(table(none, ddl)).collect()
    assert [(r.country_iso3, r.year_month) for r in got] == [("GBR", "2026-07")]
    some = none + [article(3, "2026-07-04", "UKR") + ("FRA",)]
    got = panel.news_panel(table(some, ddl)).collect()
    assert [(r.country_iso3, r.year_month) for r in got] == [("UKR", "2026-07")]


def test_joinable_keys(table):
    ddl = "country_iso3 string, year_month string"
    a, b = table([("A", "1"), ("A", "2")], ddl), table([("A", "2"), ("B", "2")], ddl)
    assert panel.joinable_keys(a, b).first().overlapping_keys == 1
