"""A gazetteer as a joined table gives the answers of the literal form, at any size."""

import random

from conftest import rows_by
from pyspark.sql import functions as F

from panelgraph.fixed_values import GAZETTEER
from panelgraph.operators import articles as art

TERMS = "term string, iso3 string, ord int"


def both_ways(spark, table, titles, gazetteer):
    rows = table([(f"a{i}", t) for i, t in enumerate(titles)], "article_id string, title string")
    terms = table([(t, c, i) for i, (t, c) in enumerate(gazetteer)], TERMS)
    literal = rows_by(art.with_target_country(rows, gazetteer), "article_id")
    joined = rows_by(art.with_target_by_join(rows, terms), "article_id")
    pick = lambda d: {k: (r.target_country_iso3, r.target_country_confidence) for k, r in d.items()}
    return pick(literal), pick(joined)


def test_fixed_table_gives_the_same_answers(spark, table):
    rnd = random.Random(5)
    words = [w for term, _ in GAZETTEER for w in term.split(" ")] + ["truce", "talks", "in", "near-by", "x"]
    titles = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 7))) for _ in range(400)]
    titles += [t.upper() for t in titles[:50]] + [f"x{t}y" for t, _ in GAZETTEER] + [f"{t}, {u}" for (t, _), (u, _) in zip(GAZETTEER, GAZETTEER[1:])]
    titles += ["", " ", "  ", None, "a  b", " lead", "trail "]
    literal, joined = both_ways(spark, table, titles, GAZETTEER)
    assert joined == literal and len({v[0] for v in joined.values()}) > 20


def test_odd_phrases(spark, table):
    gazetteer = [("a b", "P1"), ("b c d", "P2"), ("a  b", "P3"), ("longer phrase than its key", "P4"), ("longer phrase than another", "P5"), ("abc", "S1"), ("abcd", "S2"), (" z", "P6"), ("q ", "P7")]
    titles = ["xa bx", "b c d", "a  b", "longer phrase than another one", "a longer phrase than its keys", "abc", "abcd abc", "abc abcd", "c z", "cq x", "cq", "b c", "a bc c d abc"]
    literal, joined = both_ways(spark, table, titles, gazetteer)
    assert joined == literal


def test_a_hundred_thousand_phrases(spark, table):
    terms = spark.range(100_000).select(
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("place"), F.col("id"), F.lit(" of n"), F.col("id") % 997))
        .otherwise(F.concat(F.lit("place"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"))).alias("term"),
        F.concat(F.lit("C"), F.col("id").cast("string")).alias("iso3"), F.col("id").cast("int").alias("ord"),
    )
    titles = [("t1", "Unrest at Place4 of n4 and place2 of n2"), ("t2", "placejjjjj talks"), ("t3", "place100001 of n1"), ("t4", "old placej and placeh"), ("t5", "xplace4 of n42")]
    got = rows_by(art.with_target_by_join(table(titles, "article_id string, title string"), terms), "article_id")
    assert {k: r.target_country_iso3 for k, r in got.items()} == {"t1": "C2", "t2": "C99999", "t3": None, "t4": "C7", "t5": "C4"}


def test_keys_come_of_scans(spark, table):
    """What follows a space is cut out by a scan, not put together again from the parts behind it at every space."""
    rows = table([("a1", "talks in new york  city")], "article_id string, title string")
    terms = table([("new york", "N1", 0), ("york  ci", "N2", 1), ("n ", "N3", 2)], TERMS)
    named = art.with_target_by_join(rows, terms)
    assert "array_join" not in named._jdf.queryExecution().optimizedPlan().toString()
    assert [r.target_country_iso3 for r in named.collect()] == ["N1"]
