"""Keep-first by late materialisation and dates by shape."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from panelgraph.fixed_values import EVENT_DATE_FORMATS
from panelgraph.functions import dates
from panelgraph.operators.dedup import fixed_width, keep_first

ORDER = "struct<a: tinyint, d: date, n: int, s: smallint, f: boolean>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fixed_width_compares_like_the_struct(spark):
    rnd = random.Random(1)
    some = lambda *values: rnd.choice([None, *values])
    rows = [
        ((some(-128, 0, 127), some(datetime.date(1, 1, 1), datetime.date(2020, 2, 29), datetime.date(9999, 12, 31)), some(-(2**31), -1, 0, 2**31 - 1), some(-(2**15), 7), some(True, False)),)
        for _ in range(400)
    ]
    df = spark.createDataFrame(rows, f"o {ORDER}")
    out = df.select("o", fixed_width(F.col("o"), df.schema["o"].dataType).alias("k"))
    by_struct = [r.k for r in out.orderBy("o").collect()]
    assert by_struct == sorted(by_struct)
    assert len(set(by_struct)) == len({r[0] for r in rows})


@pytest.mark.parametrize("ddl, fits", [
    ("long", True), ("timestamp", True), ("struct<a: long, b: int>", True), ("struct<a: decimal(12,0), b: long>", True),
    ("struct<a: long, b: long>", False), ("string", False), ("double", False), ("decimal(12,2)", False),
])
def test_what_fits(spark, ddl, fits):
    df = spark.createDataFrame([], f"o {ddl}")
    assert (fixed_width(F.col("o"), df.schema["o"].dataType) is not None) == fits


def test_extremes_of_long_keys(spark):
    values = [-(2**63), -1, 0, 1, 2**63 - 1, None]
    df = spark.createDataFrame([((v, i),) for v in values for i in (5, -5, None)], "o struct<a: long, b: int>")
    out = df.select("o", fixed_width(F.col("o"), df.schema["o"].dataType).alias("k")).orderBy("o").collect()
    keys = [r.k for r in out]
    assert None not in keys and keys == sorted(keys) and len(set(keys)) == len(out)


@pytest.mark.parametrize("order", [F.col, lambda c: F.col(c).cast("string"), lambda c: F.struct(F.col(c).cast("date").alias("d"))])
def test_keep_first_matches_brute_force(spark, order):
    rnd = random.Random(7)
    stamps = [datetime.datetime(2020, 1, 1 + i) for i in range(28)]
    rows = [(rnd.choice([None, 1, 2, 3]), rnd.choice(["x", "y", None]), rnd.choice(stamps), "t" * rnd.randrange(3)) for _ in range(300)]
    rows = list({(r[0], r[2]): r for r in rows}.values())  # no ties among rows of a key
    df = spark.createDataFrame(rows, "k int, g string, at timestamp, text string")
    firsts = {}
    for r in sorted(rows, key=lambda r: r[2]):
        firsts.setdefault(r[0], r)
    assert sorted(map(str, map(tuple, keep_first(df, ["k"], order("at")).collect()))) == sorted(map(str, firsts.values()))
    second = {}
    for r in sorted(firsts.values(), key=lambda r: r[2]):
        second.setdefault(r[1], r)
    ties = len({r[2] for r in firsts.values()}) < len(firsts)
    chained = keep_first(df, ["k"], order("at"), ["g"]).collect()
    assert len(chained) == len(second)
    if not ties:
        assert sorted(map(str, map(tuple, chained))) == sorted(map(str, second.values()))


def test_keep_first_of_ties_and_nothing(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "a"), (None, 1, "b"), (None, 1, "b")], "k int, o int, t string")
    assert sorted(map(str, map(tuple, keep_first(df, ["k"], F.col("o"), ["t"]).collect()))) == ["(1, 5, 'a')", "(None, 1, 'b')"]
    assert keep_first(df.limit(0), ["k"], F.col("o")).count() == 0


def test_no_sort_aggregate_and_long_columns_move_late(spark):
    df = spark.range(1000).selectExpr("id % 7 k", "cast(id as int) o", "repeat('x', 500) text")
    text = plan(keep_first(df, ["k"], F.col("o")))
    assert "SortAggregate" not in text and "HashAggregate" in text
    # what is aggregated is key and order: texts stand in no aggregate
    assert not [line for line in text.splitlines() if "Aggregate" in line and "text" in line]


# --- dates --------------------------------------------------------------------------------


def read_all(spark, values, f):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(f(F.col("v"))).collect()]


def test_every_form_and_its_misses(spark):
    day = datetime.date(2021, 3, 5)
    good = ["2021-03-05", "2021-3-5", " 2021-03-05 ", "2021-03-05 10:00:00", "2021-03-05T10:00:00Z", "3/5/2021", "03/05/2021", "3-5-2021", "2021/3/5",
            "20210305", "5 Mar 2021", "5 mar 2021", "Mar 5, 2021", "5 March 2021", "March 5, 2021", "MARCH 5, 2021", "5.3.2021", "05.03.2021"]
    assert read_all(spark, good, dates.lenient_date) == [day] * len(good)
    bad = ["soon", "", None, "13/5/2021", "2/30/2021", "5 Mrz 2021", "2021030", "2021-13-05", "3/5/21", "31.4.2021", "5 Marchy 2021", "x3/5/2021", "3/5/2021x"]
    assert read_all(spark, bad, dates.lenient_date) == [None] * len(bad)
    assert read_all(spark, ["2020-02-29", "2/29/2020", "29 Feb 2020", "2/29/2021"], dates.lenient_date) == [datetime.date(2020, 2, 29)] * 3 + [None]


def test_forms_agree_with_the_parser_they_replace(spark):
    rnd = random.Random(3)
    days = [datetime.date(1990, 1, 1) + datetime.timedelta(days=rnd.randrange(15000)) for _ in range(200)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    for form in EVENT_DATE_FORMATS:
        text = F.date_format("d", form)
        assert df.where(~dates.lenient_date(text).eqNullSafe(F.col("d"))).count() == 0, form
        assert df.where(~F.try_to_timestamp(text, F.lit(form)).cast("date").eqNullSafe(dates.lenient_date(text, [form]))).count() == 0, form


def test_the_first_form_that_fits_wins(spark):
    assert read_all(spark, ["4/5/2021", "25/5/2021"], lambda c: dates.lenient_date(c, ["M/d/yyyy", "d/M/yyyy"])) == [datetime.date(2021, 4, 5), datetime.date(2021, 5, 25)]
    assert read_all(spark, ["2021-01-02"], lambda c: dates.lenient_date(c, [])) == [datetime.date(2021, 1, 2)]
    for form in ("EEE d MMM yyyy", "M/yyyy", "d/d/M/yyyy"):
        with pytest.raises(ValueError, match="form"):
            dates.shape(form)


def test_article_times_are_utc_in_any_zone(spark):
    values = ["20260705T110000Z", "20260705110000", "20260705", "2026-7-5 11:0:0", "2026-07-05", "2026-07-05T11:00:00Z", "soon", "20261305", "20260705T250000Z", None]
    want = ["2026-07-05 11:00:00", "2026-07-05 11:00:00", "2026-07-05 00:00:00", "2026-07-05 11:00:00", "2026-07-05 00:00:00", None, None, None, None, None]
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            got = read_all(spark, values, lambda c: F.unix_seconds(dates.article_time(c)))
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert got == [None if w is None else int(datetime.datetime.fromisoformat(w + "+00:00").timestamp()) for w in want]


def test_one_parse_however_many_forms(spark):
    text = plan(spark.range(1).selectExpr("cast(id as string) v").select(dates.lenient_date(F.col("v"))))
    assert text.count("regexp_replace") <= 2 and "gettimestamp" not in text.lower()
