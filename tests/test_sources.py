"""Readers, sinks, the end-to-end flows and the streams."""

import hashlib
import json

import pytest
from conftest import rows_by
from pyspark.sql import functions as F
from test_events import RAW as EVENT_DDL
from test_events import raw
from test_impact import SCEN_DDL, scenario

from panelgraph.operators import dyads, panel
from panelgraph.plans import flows
from panelgraph.session import shared_folder
from panelgraph.sources import dims, readers, sinks
from panelgraph.streaming import articles as live

HEADER = ",".join(readers.RAW_EVENT_COLUMNS)
LINE = '1,2020,1,"a ""b""\nc, d",Government of Mali,Government of Niger,Mali,432,Africa,2020-01-05,2020-01-06,5,6,4,1,10.5,20.5'


def test_csv_with_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "e.csv").write_text(HEADER + "\n" + LINE + "\n" + LINE.replace("1,2020", "2,2020", 1) + "\n", encoding="utf-8")
    df = readers.read_raw_events(spark, str(tmp_path / "e.csv"))
    assert readers.record_count(df) == 2
    assert df.orderBy("id").first().conflict_name == 'a "b"\nc, d'
    order = [r.id for r in df.orderBy("ingest_order").collect()]
    assert order == ["1", "2"]
    (tmp_path / "bad.csv").write_text("id,year\n1,2\n")
    with pytest.raises(ValueError, match="type_of_violence"):
        readers.read_raw_events(spark, str(tmp_path / "bad.csv"))


def test_json_array_with_missing_keys(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"url": "u", "title": "t"}, {"url": "v", "language": "French", "extra": 1}]))
    got = rows_by(readers.read_raw_articles(spark, str(tmp_path / "a.json")), "url")
    assert got["u"].language is None and got["v"].language == "French" and got["v"].title is None


def test_drifting_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Country,Fatalities\nX,1\n")
    (tmp_path / "b.csv").write_text("country,Other\nY,2\n")
    (tmp_path / "c.csv").write_text("COUNTRY,FATALITIES\nZ,3\n")
    paths = [str(tmp_path / n) for n in ("a.csv", "b.csv", "c.csv", "gone.csv")]
    df, skipped = readers.read_drifting_csv(spark, paths)
    got = rows_by(df, "country")
    assert set(df.columns) == {"country", "fatalities", "other"} and len(got) == 3
    assert (got["Z"].fatalities, got["Y"].fatalities, got["Y"].other) == ("3", None, "2")
    assert [r.path for r in skipped.collect()] == [paths[3]]


def test_headers_are_found_in_one_pass(spark, tmp_path):
    names = []
    for i in range(120):
        path = tmp_path / f"f {i}.csv"
        head = ['"Country","Fatal, all"', "country,FATALITIES", "Other,COUNTRY"][i % 3]
        path.write_text(f"{head}\n" + "".join(f"{a},{b}\n" for a, b in [(f"c{i}", i)] * 3))
        names.append(str(path))
    (tmp_path / "twice.csv").write_text("Id,id,x\n1,2,3\n")
    (tmp_path / "empty.csv").write_text("")
    odd = [str(tmp_path / n) for n in ("twice.csv", "empty.csv", "gone.csv")]
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("headers", "headers")
    df, skipped = readers.read_drifting_csv(spark, names + odd)
    spark.sparkContext.setJobGroup("rest", "rest")
    assert len(jobs.getJobIdsForGroup("headers")) < 12  # whatever the number of files
    reasons = {r.path: r.reason for r in skipped.collect()}
    assert reasons == {odd[0]: "columns named twice: id", odd[1]: "no header", odd[2]: "no such file"}
    assert set(df.columns) == {"country", "fatal, all", "fatalities", "other"} and df.count() == 360
    assert df.filter("country = 'c3'").select("fatal, all").distinct().first()[0] == "3"


def test_manifest_and_new_files(spark, tmp_path):
    for name, content in (("a.bin", b"one"), ("b.bin", b"two")):
        (tmp_path / name).write_bytes(content)
    manifest = readers.file_manifest(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: (r.length, r.sha256) for r in manifest.collect()}
    assert got["a.bin"] == (3, hashlib.sha256(b"one").hexdigest())
    seen = manifest.filter(F.col("path").endswith("a.bin"))
    assert [r.path.rsplit("/", 1)[1] for r in readers.new_files(manifest, seen).collect()] == ["b.bin"]


def test_projection_reaches_the_scan(spark, tmp_path):
    spark.range(5).selectExpr("id a", "id b", "id c").write.parquet(str(tmp_path / "t"))
    df = readers.read_table(spark, str(tmp_path / "t"), ["b"]).filter("b > 2")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<b:bigint>" in plan and "GreaterThan(b,2)" in plan
    assert readers.existing(df, ["x", "b"]).columns == ["b"]


def test_observed_write(spark, tmp_path):
    seen = sinks.write_observed(spark.range(7), str(tmp_path / "t"), rows=F.count(F.lit(1)), top=F.max("id"))
    assert seen == {"rows": 7, "top": 6}


def test_dimensions(spark):
    assert dims.state_codes(spark).filter("state_code = 615").first().iso3 == "DZA"
    assert dims.display_names(spark).count() == dims.display_names(spark).select("country_iso3").distinct().count()
    terms = [r.term for r in dims.gazetteer(spark).orderBy("ord").collect()]
    assert terms[:2] == ["ukraine", "ukrainian"] and len(terms) == len(set(terms))
    assert dims.taxonomy(spark).select("category").distinct().count() == 9
    for make in (dims.state_codes, dims.government_names, dims.event_country_names, dims.publisher_countries, dims.valences, dims.archetypes):
        assert make(spark).count() > 3
    joined = spark.range(10).withColumn("state_code", F.col("id").cast("int")).join(dims.state_codes(spark), "state_code", "left")
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()


def test_shared_folder_is_the_sessions(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_folder(spark) == named.rstrip("/") if named else shared_folder(spark)


ARTICLES = [
    (f"http://x/{i}", t, s, d, "English", c)
    for i, (t, s, d, c) in enumerate(
        [("War in Sudan: troops clash", "20260701T000000Z", "a.com", "United Kingdom"), ("Ukraine truce talks", "20260705T100000Z", "b.com", "France"),
         ("Mali and Niger sanctions", "20260820T100000Z", "a.com", "Kenya"), ("Niger attack kills", "20260930T230000Z", "c.com", "Kenya"),
         ("Nothing here", "20260910T230000Z", "c.com", "Kenya")]
    )
]
ARTICLE_DDL = "url string, title string, seendate string, domain string, language string, sourcecountry string"


def test_flows_end_to_end(spark, table, tmp_path):
    rows = [raw(id="1", seq=0), raw(id="2", country="Mali", code="432", start="2021-05-05", seq=1), raw(id="3", country="Niger", code="436", seq=2)]
    events_raw = table(rows, EVENT_DDL).withColumns({"side_a": F.lit("Government of Mali"), "side_b": F.lit("Government of Niger")})
    gates = flows.build_events(events_raw, str(tmp_path), order=F.col("seq"))
    assert gates.filter("not passed").count() == 0
    features = spark.read.parquet(str(tmp_path / "event_features"))
    assert features.count() == 3 * 24 and len(features.columns) == 49
    meta = spark.read.json(str(tmp_path / "event_metadata")).first()
    assert meta.total_rows == 72 and meta.unique_entities == 3 and meta.threshold_deaths_12m == 25 and len(meta.feature_columns) == 49
    nodes = panel.entity_set(features)
    gates = flows.build_news(table(ARTICLES, ARTICLE_DDL), str(tmp_path), order=F.col("url"), entities=nodes, other_panel=features, stop=False)
    failed = [r.rule for r in gates.filter("not passed").collect()]
    assert failed == ["joinable on country_iso3, year_month"]  # 2020-2021 against 2026
    events, articles = spark.read.parquet(str(tmp_path / "events")), spark.read.parquet(str(tmp_path / "articles"))
    assert articles.count() == 5
    gates = flows.build_relationships(events, articles, nodes, str(tmp_path))
    assert gates.filter("not passed").count() == 0
    table_ = spark.read.parquet(str(tmp_path / "dyads"))
    assert {r.relationship_nature for r in table_.collect()} == {"undirected_conflict", "directed_news"}
    assert spark.read.json(str(tmp_path / "graph/links")).count() == table_.count()
    info = spark.read.json(str(tmp_path / "graph_metadata")).first()
    assert info.total_reference_nodes == 3 and info.exclusions.bilateral_events_retained == 3
    metrics = spark.read.parquet(str(tmp_path / "node_metrics"))
    news = spark.read.parquet(str(tmp_path / "news_features"))
    gates = flows.build_what_if(
        table([scenario("s", "MLI", tone=-0.5), scenario("bad", "XXX")], SCEN_DDL), metrics, table_, news, str(tmp_path / "w"), month="2026-08")
    assert gates.filter("not passed").count() == 0
    assert spark.read.parquet(str(tmp_path / "w/rejected")).first().scenario_id == "bad"
    hit = rows_by(spark.read.parquet(str(tmp_path / "w/countries")), "country_iso3")
    assert hit["MLI"].is_direct_target and hit["NER"].ripple_hop == 1 and hit["DZA"].ripple_hop == -1


def test_streams(spark, table, tmp_path):
    landed = str(tmp_path / "landed")
    rows = ARTICLES + [ARTICLES[0], ("http://y/9", "Ukraine truce talks", "20260705T110000Z", "z.com", "English", "France")]
    table(rows, ARTICLE_DDL).write.json(landed)
    enriched = live.enrich_stream(live.stream_raw_articles(spark, landed))
    live.write_stream(enriched, str(tmp_path / "a"), str(tmp_path / "ac")).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "a"))
    assert stored.count() == 7
    unique = live.unique_articles(stored)
    assert unique.count() == 5
    days = live.daily_counts(unique)
    got = rows_by(days.groupBy("target_country_iso3").agg(F.sum("news_count_total").alias("n")), "target_country_iso3")
    want = rows_by(unique.filter("target_country_iso3 is not null").groupBy("target_country_iso3").agg(F.count("*").alias("n")), "target_country_iso3")
    assert got == want and {"SDN", "UKR", "MLI"} <= set(got)
    months = rows_by(live.months_from_days(days), "target_country_iso3")
    assert months["SDN"].news_count_total == got["SDN"].n


def test_streams_lose_nothing_in_any_order_and_batch_size(spark, table, tmp_path):
    times = [f"2026{m:02d}{d:02d}T0{d % 9}0000Z" for m in (1, 5, 7) for d in range(1, 9)]
    rows = [(f"http://x/{i % 17}", f"Ukraine truce talks {i % 5}", t, "x.com", "English", "France") for i, t in enumerate(times)]
    seen = []
    for n, (order, max_files) in enumerate([(rows, 1000), (rows, 1), (rows[::-1], 1), (rows[::3] + rows[1::3] + rows[2::3], 2)]):
        landed = str(tmp_path / f"landed{n}")
        for k in range(0, len(order), 4):
            table(order[k : k + 4], ARTICLE_DDL).coalesce(1).write.mode("append").json(landed)
        enriched = live.enrich_stream(live.stream_raw_articles(spark, landed, max_files=max_files))
        live.write_stream(enriched, str(tmp_path / f"a{n}"), str(tmp_path / f"c{n}")).awaitTermination()
        days = live.daily_counts(live.unique_articles(spark.read.parquet(str(tmp_path / f"a{n}"))))
        seen.append(sorted(map(tuple, days.collect())))
    assert seen[0] and all(s == seen[0] for s in seen)


def test_pair_extraction_needs_no_shuffle(spark, table):
    rows = [raw()]
    df = table(rows, EVENT_DDL).withColumns({"year_month": F.lit("2020-01"), "event_date": F.lit("2020-01-01")})
    assert "Exchange" not in dyads.state_pairs(df)._jdf.queryExecution().executedPlan().toString()


def test_csv_files_with_other_headers_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,best\n1,10\n")
    (tmp_path / "b.csv").write_text("best,id\n20,2\n")
    with pytest.raises(Exception, match="header|CSV"):
        readers.read_csv_text(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], multi_line=False).collect()
