"""The incremental article stream: any batch size, order and interruption gives the batch answer."""

import datetime
import random

import pytest
from conftest import rows_by
from pyspark.sql import functions as F

from panelgraph.streaming import articles as live
from panelgraph.streaming import incremental

ARTICLE_DDL = "url string, title string, seendate string, domain string, language string, sourcecountry string"


def landed_rows(count=40, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(count):
        # few ids and titles: copies of one id on several days, titles shared by several ids of a day
        url, title = f"http://x/{rnd.randrange(count // 3)}", f"Ukraine truce talks {rnd.randrange(4)}"
        rows.append((url, title, f"202607{rnd.randrange(1, 7):02d}T{rnd.randrange(24):02d}{i % 60:02d}00Z", f"d{rnd.randrange(3)}.com", "English", "France"))
    return rows


def land(table, rows, folder, per_file=8):
    for at in range(0, len(rows), per_file):
        table(rows[at : at + per_file], ARTICLE_DDL).coalesce(1).write.mode("append").json(folder)


def advance(spark, landed, folder, max_files, span="day"):
    incremental.store_articles(live.enrich_stream(live.stream_raw_articles(spark, landed, max_files=max_files)), folder, span=span).awaitTermination()
    query = incremental.follow_articles(spark, folder, max_files=max_files, span=span)
    query.awaitTermination()
    return query


def ids(spark, folder):
    return sorted(r.article_id for r in spark.read.parquet(f"{folder}/unique").collect())


def days(spark, folder):
    table = incremental.daily_counts(spark.read.parquet(f"{folder}/domain_counts"))
    return sorted((r.day, r.target_country_iso3, r.news_count_total, r.unique_domains, round(r.tone_sum, 9), r.conflict_news_count) for r in table.collect())


def test_any_order_and_batch_size_gives_the_batch_answer(spark, table, tmp_path):
    rows = landed_rows()
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    seen = []
    for n, (order, max_files, span) in enumerate([(rows, 1000, "day"), (shuffled, 4, "day"), (rows[::-1], 3, "month")]):
        landed, folder = str(tmp_path / f"landed{n}"), str(tmp_path / f"t{n}")
        land(table, order, landed)
        advance(spark, landed, folder, max_files, span)
        stored = spark.read.parquet(f"{folder}/articles")
        assert stored.count() == len(rows)
        assert ids(spark, folder) == sorted(r.article_id for r in live.unique_articles(stored.drop("day", "span")).collect())
        seen.append((ids(spark, folder), days(spark, folder)))
    assert seen[0][0] and all(s == seen[0] for s in seen)


def test_a_second_run_touches_only_its_days(spark, table, tmp_path):
    landed, folder = str(tmp_path / "landed"), str(tmp_path / "t")
    at = "2026070{}T{:02d}0000Z".format
    land(table, [(f"http://x/{d}", "Ukraine truce talks", at(d, 9), "a.com", "English", "France") for d in (1, 2, 3, 4)], landed)
    advance(spark, landed, folder, 1000)
    before = {r.day: r.batch for r in spark.read.parquet(f"{folder}/unique").collect()}
    # one new article on day 2, and an earlier copy of day 4's: day 4 loses its only row, day 1 keeps its title
    land(table, [("http://y", "Sudan truce", at(2, 8), "b.com", "English", "France"), ("http://x/4", "Ukraine truce talks", at(1, 3), "a.com", "English", "France")], landed)
    query = advance(spark, landed, folder, 1000)
    assert sum(p.numInputRows for p in query.recentProgress) == 2
    after = {r.day: r.batch for r in spark.read.parquet(f"{folder}/unique").collect()}
    day = lambda d: datetime.date(2026, 7, d)
    assert set(after) == {day(1), day(2), day(3)} and after[day(3)] == before[day(3)]
    assert after[day(1)] > before[day(1)] and after[day(2)] > before[day(2)]
    counts = rows_by(incremental.daily_counts(spark.read.parquet(f"{folder}/domain_counts")).groupBy("day").agg(F.sum("news_count_total").alias("n")), "day")
    assert {d: r.n for d, r in counts.items()} == {day(1): 1, day(2): 2, day(3): 1}


@pytest.mark.parametrize("broken_call", [1, 2])
def test_a_batch_cut_short_is_done_again(spark, table, tmp_path, monkeypatch, broken_call):
    rows = landed_rows(24, 5)
    whole, folder, landed = str(tmp_path / "whole"), str(tmp_path / "t"), str(tmp_path / "landed")
    land(table, rows, landed)
    advance(spark, landed, whole, 1000)
    calls, replace = [], incremental._replace

    def fails_once(df, path, *rest):
        calls.append(path)
        replace(df, path, *rest)
        if len(calls) == broken_call:
            raise RuntimeError("executor of the driver's batch is gone")

    monkeypatch.setattr(incremental, "_replace", fails_once)
    with pytest.raises(Exception, match="gone"):
        advance(spark, landed, folder, 4)
    advance(spark, landed, folder, 4)
    assert ids(spark, folder) == ids(spark, whole) and days(spark, folder) == days(spark, whole)


def test_months_count_a_domain_of_several_days_once(spark, table):
    rows = [(datetime.date(2026, 7, d), "UKR", dom, 1, -0.5, 1, 0, 1) for d, dom in ((1, "a"), (2, "a"), (2, "b"))] + [(datetime.date(2026, 8, 1), "UKR", "a", 2, 1.0, 0, 1, 0)]
    counts = table(rows, "day date, target_country_iso3 string, domain string, news_count_total long, tone_sum double, negative_tone_count long, extreme_tone_count long, conflict_news_count long")
    months = rows_by(incremental.monthly_counts(counts), "month_start")
    july, august = months[datetime.date(2026, 7, 1)], months[datetime.date(2026, 8, 1)]
    assert (july.news_count_total, july.unique_domains, july.avg_tone) == (3, 2, -0.5)
    assert (august.news_count_total, august.unique_domains, august.avg_tone) == (2, 1, 0.5)
    by_day = rows_by(incremental.daily_counts(counts), "day")
    assert by_day[datetime.date(2026, 7, 2)].unique_domains == 2


def test_batches_move_no_texts(spark, table, tmp_path):
    """Texts are written once; what a batch redoes is narrow, and whole rows come back from the articles."""
    landed, folder = str(tmp_path / "landed"), str(tmp_path / "t")
    land(table, landed_rows(), landed)
    advance(spark, landed, folder, 3)
    assert "title" not in spark.read.parquet(f"{folder}/unique").columns
    whole = incremental.unique_rows(spark, folder)
    assert sorted(r.article_id for r in whole.collect()) == ids(spark, folder)
    assert whole.where(F.col("title").isNull() | (F.sha2("title", 256) != F.col("title_key"))).count() == 0
