"""The given star-schema tables seen as events, articles, pairs and scenarios.

Orders are events of the customer's nation, line items are reports of the supplier's nation
about the customer's nation, documents and pages are articles. Lexicons are words of those
texts; they are parameters, like the default ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelgraph.fixed_values import EVENT_DATE_FORMATS
from panelgraph.operators import articles as art
from panelgraph.operators import dyads, features, impact, panel

GOVERNMENTS = [(f"NATION_{i}", f"N{i:02d}") for i in range(24)]  # one nation stays unknown
TERMS = [
    ("thanedble the", "N01"), ("der der", "N02"), ("el ci", "N03"), ("thnt", "N04"), ("thble", "N05"),
    ("erin", "N06"), ("thwh", "N07"), ("onan", "N08"), ("eau", "N09"), ("der", "N10"), ("les", "N11"),
    ("und", "N12"), ("que", "N13"), ("ment", "N14"), ("sch", "N15"), ("attion", "N01"), ("elle", "N09"),
    ("erly", "N16"), ("only", "N17"),
]
CATEGORIES = {
    "armed_conflict": ["thor", "eren", "the the"],
    "violence_civilian": ["thed", "of the"],
    "military_escalation": ["thing", "and the"],
    "ceasefire_peace": ["thin", "eriner thanea"],
    "sanctions_economic": ["ertion", "de la", "que ci"],
    "displacement_refugees": ["onou", "pour"],
    "terrorism_insurgency": ["ench", "von", "aux"],
    "border_tensions": ["the and", "thst"],
    "diplomatic_escalation": ["onti", "und"],
}
WORDS = {
    "thor": -0.8, "thed": -0.7, "thing": -0.5, "thin": 0.6, "ertion": 0.5, "onou": -0.4, "pour": 0.4,
    "ench": -0.6, "von": 0.3, "aux": -0.3, "thst": -0.9, "onti": 0.7, "und": 0.2, "les": -0.5, "des": 0.4,
    "erst": -1.0, "la": 0.1, "he": -0.2,
}
LANGUAGES = {"en": " United Kingdom ", "fr": "FRANCE", "de": "Germany", "es": "Spain"}
BASE_SECONDS = 1704258000
# id, target, dyad_a, dyad_b, tone_delta, multiplier, tension_delta, sever, depth, decay
SCENARIOS = [
    ("tone", "N01", None, None, -0.4, 1.5, None, False, 2, 0.5),
    ("sever", "N02", "N02", "N03", -0.3, 1.2, None, True, 2, 0.4),
    ("mobilize", "N05", None, None, -0.6, 2.0, None, False, 1, 0.6),
    ("calm", "N07", None, None, 0.5, 0.3, None, False, 2, 0.5),
    ("tension", "N04", "N04", "N09", 0.0, 1.0, 2.0, False, 2, 0.9),
    ("still", "N11", None, None, -0.2, 1.0, None, False, 0, 0.5),
    ("unknown", "N99", None, None, -0.2, 1.0, None, False, 2, 0.5),
    ("loop", "N01", "N01", "N01", 0.0, 1.0, 0.1, False, 2, 1.5),
    ("implicit", "N01", None, None, 0.0, -1.0, 0.1, True, -1, 0.5),
]
SCENARIO_DDL = (
    "scenario_id string, target_country_iso3 string, dyad_a string, dyad_b string, tone_delta double, "
    "conflict_news_multiplier double, tension_delta double, sever_dyadic_tie boolean, propagation_depth int, "
    "decay_factor double"
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def nation_code(name: str = "n_name"):
    return F.concat(F.lit("N"), F.lpad(F.substring_index(name, "_", -1), 2, "0"))


def raw_events(spark: SparkSession, folder: str) -> DataFrame:
    """Untidy event records: one per line item, several with one id, gaps in dates and codes."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    nations = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    # one row group of the table stands for many landed files: its rows are dealt out before they are parsed
    lines = table(spark, folder, "lineitem").repartition("l_orderkey")
    # orders meet their customers first, so that lines, the longest table, move once
    placed = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    joined = lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
    shipped = iso = F.date_format("l_shipdate", "yyyy-MM-dd")
    for i, form in enumerate(EVENT_DATE_FORMATS, start=1):  # a column that mixes all forms
        shipped = F.when(F.col("l_orderkey") % 10 == i, F.date_format("l_shipdate", form)).otherwise(shipped)
    return joined.select(
        F.col("l_orderkey").alias("id"),
        F.year("l_shipdate").cast("string").alias("year"),
        F.expr("decode(l_returnflag, 'A', '1', 'N', '2', 'R', 'three')").alias("type_of_violence"),
        F.col("c_mktsegment").alias("conflict_name"),
        F.concat(F.lit("Government of "), "n_name").alias("side_a"),
        F.col("o_orderpriority").alias("side_b"),
        F.concat(F.lit(" "), "n_name").alias("country"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.col("n_nationkey").cast("string")).alias("country_id"),
        F.col("r_name").alias("region"),
        F.when(F.col("o_orderpriority") == "5-LOW", "soon").when(F.col("o_orderpriority") != "4-NOT SPECIFIED", shipped).alias("date_start"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.when(F.col("l_linenumber") % 2 == 0, F.concat(iso, F.lit(" 10:00:00"))).otherwise(shipped)).alias("date_end"),
        F.col("l_extendedprice").cast("string").alias("best"),
        F.when(F.col("l_linestatus") == "O", "n/a").otherwise(F.col("l_quantity").cast("string")).alias("high"),
        F.when(F.col("l_linestatus") == "O", "NaN").otherwise(F.col("l_quantity").cast("string")).alias("low"),
        F.col("c_acctbal").cast("string").alias("deaths_civilians"),
        (F.col("c_acctbal") / 100).alias("latitude"),
        (F.col("o_totalprice") / 2000).alias("longitude"),
        # prices in cents, letters as their numbers: an order of fixed width
        F.struct(
            F.col("l_linenumber").cast("byte"), F.col("l_shipdate").cast("date"), F.round(F.col("l_extendedprice") * 100).cast("int").alias("cents"),
            F.col("l_quantity").cast("short"), F.ascii("l_returnflag").cast("byte").alias("flag"), F.ascii("l_linestatus").cast("byte").alias("status"),
        ).alias("ingest_order"),
    )


def code_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Nation number -> code and, but for one region, nation name -> code."""
    nations = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    codes = nations.select(F.col("n_nationkey").alias("state_code"), nation_code().alias("iso3"))
    names = nations.filter(F.col("r_name") != "ASIA").select(F.col("n_name").alias("country_name"), nation_code().alias("iso3"))
    return codes, names


def order_events(spark: SparkSession, folder: str, entity: str = "nation") -> DataFrame:
    """Clean events: one per order, of the customer's nation or of the customer."""
    orders, customers = table(spark, folder, "orders"), table(spark, folder, "customer")
    if entity == "customer":
        placed = orders.withColumn("country_iso3", F.col("o_custkey"))
    else:
        nations = table(spark, folder, "nation").select("n_nationkey", nation_code().alias("country_iso3"))
        placed = orders.join(customers.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(
            nations, F.col("c_nationkey") == F.col("n_nationkey")
        )

    def deaths(scale: int):
        return F.floor(F.col("o_totalprice") / scale).cast("double")

    return placed.select(
        F.col("o_orderkey").alias("id"),
        "country_iso3",
        F.col("o_orderdate").cast("date").alias("event_date"),
        F.expr("decode(o_orderstatus, 'F', 1, 'O', 2, 'P', 3)").alias("type_of_violence"),
        deaths(1000).alias("best"),
        deaths(2000).alias("low"),
        deaths(500).alias("high"),
        deaths(4000).alias("deaths_civilians"),
    )


def order_features(spark: SparkSession, folder: str, entity: str = "nation") -> DataFrame:
    return features.event_features(panel.event_panel(order_events(spark, folder, entity)))


def sided_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with two sides: the customer's nation against the suppliers of returned lines."""
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    returned = (
        table(spark, folder, "lineitem")
        .filter(F.col("l_returnflag") == "R")
        .select("l_orderkey", "l_suppkey")
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy("l_orderkey")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_set("n_name")), lambda n: F.concat(F.lit("Government of "), n)), ", ").alias("side_b"))
    )
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    orders = (
        table(spark, folder, "orders")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return orders.join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("Government of "), "n_name").alias("side_a"),
        F.coalesce("side_b", F.lit("Rebels")).alias("side_b"),
        F.date_format("o_orderdate", "yyyy-MM").alias("year_month"),
        F.col("o_orderdate").cast("date").alias("event_date"),
        F.floor(F.col("o_totalprice") / 50000).cast("double").alias("best"),
        F.floor(F.col("o_totalprice") / 100000).cast("double").alias("low"),
        F.floor(F.col("o_totalprice") / 25000).cast("double").alias("high"),
        F.floor(F.col("o_totalprice") / 200000).cast("double").alias("deaths_civilians"),
        F.col("o_orderpriority").alias("conflict_name"),
    )


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """Scored articles: each line item is a report of the supplier's nation about the customer's."""
    nations = table(spark, folder, "nation")
    source = nations.select(F.col("n_nationkey").alias("s_nationkey"), nation_code().alias("source_country_iso3"))
    target = nations.select(F.col("n_nationkey").alias("c_nationkey"), nation_code().alias("target_country_iso3"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    # orders meet their customers first, so that lines move once; suppliers as they are read, because Spark knows the size of a file, not that of a join
    placed = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(target, "c_nationkey").select("o_orderkey", "target_country_iso3")
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_linenumber", "l_discount", "l_returnflag", "l_shipdate"
    )
    tone = 1 - 20 * F.col("l_discount")
    return (
        lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(source, "s_nationkey")
        .join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("article_id"),
            F.col("l_shipdate").cast("timestamp").alias("published_at_utc"),
            "source_country_iso3",
            "target_country_iso3",
            F.date_format("l_shipdate", "yyyy-MM").alias("year_month"),
            F.col("source_country_iso3").alias("domain"),
            tone.alias("tone_score"),
            (tone < -0.2).alias("is_negative_tone"),
            (F.abs(tone) >= 0.6).alias("is_extreme_tone"),
            (F.col("l_returnflag") == "R").alias("is_conflict_relevant"),
            (F.col("l_returnflag") == "R").alias("cat_military_escalation"),
            (F.col("l_linenumber") == 1).alias("cat_armed_conflict"),
            (F.col("l_linenumber") == 2).alias("cat_ceasefire_peace"),
            (F.col("l_linenumber") == 3).alias("cat_sanctions_economic"),
        )
    )


def raw_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Pages and documents as raw articles; titles are whole texts."""
    pages = table(spark, folder, "pages")
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    language = F.regexp_extract("url", r"example\.[a-z]+/([a-z]+)/", 1)
    at = F.timestamp_seconds(F.lit(BASE_SECONDS) + F.col("page_id") * 7919 % 40000 * 1000)
    formats = ["yyyyMMdd'T'HHmmss'Z'", "yyyyMMddHHmmss", "yyyyMMdd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]
    seen = F.lit("soon")
    for i, pattern in enumerate(formats):
        seen = F.when(~F.col("url").contains("utm_") & (F.col("page_id") % 5 == i), F.date_format(at, pattern)).otherwise(seen)

    def country(code):
        name = F.lit(None).cast("string")
        for short, long in LANGUAGES.items():
            name = F.when(code == short, long).otherwise(name)
        return name

    from_pages = pages.select(
        F.lit(0).alias("kind"),
        F.col("page_id").alias("number"),
        F.concat(F.col("url"), F.lit("\n")).alias("url"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        seen.alias("seendate"),
        F.when(F.col("url").startswith("https"), F.concat(F.lit("WWW."), host)).otherwise(host).alias("domain"),
        F.when(language != "en", language).alias("language"),
        country(language).alias("sourcecountry"),
    )
    documents = table(spark, folder, "documents")
    written = F.timestamp_seconds(F.lit(BASE_SECONDS) + F.col("n_chars") * 6151 % 40000 * 1000)
    from_documents = documents.select(
        F.lit(1).alias("kind"),
        F.col("doc_id").alias("number"),
        F.concat_ws("/", F.lit("http:/"), "source", "lang", "n_chars").alias("url"),
        F.col("text").alias("title"),
        F.date_format(written, formats[0]).alias("seendate"),
        F.concat(F.lit("www."), "source").alias("domain"),
        F.col("lang").alias("language"),
        country(F.col("lang")).alias("sourcecountry"),
    )
    return from_pages.unionByName(from_documents)


def normal_articles(spark: SparkSession, folder: str) -> DataFrame:
    order = F.struct("kind", "number")
    return art.normalize_articles(raw_articles(spark, folder), order=order, gazetteer=TERMS)


def scored_articles(spark: SparkSession, folder: str) -> DataFrame:
    return art.score_articles(normal_articles(spark, folder), taxonomy=CATEGORIES, valences=WORDS)


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").select(nation_code().alias("country_iso3"))


def pair_table(spark: SparkSession, folder: str) -> DataFrame:
    """All-time pairs of nations from two-sided events and reports."""
    return dyads.cumulative_dyads(
        dyads.state_pairs(sided_events(spark, folder), GOVERNMENTS), reports(spark, folder)
    )


def report_panel(spark: SparkSession, folder: str) -> DataFrame:
    return panel.news_panel(reports(spark, folder))


def bulk_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """A sparse graph of many nodes: suppliers and the customers of their largest lines, tense by discount."""
    lines = table(spark, folder, "lineitem").filter("l_quantity >= 49").select("l_orderkey", "l_suppkey", "l_discount", "l_returnflag")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    traded = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(
        F.concat(F.lit("S"), "l_suppkey").alias("source_country_iso3"), F.concat(F.lit("C"), "o_custkey").alias("target_country_iso3")
    )
    kind = F.min("l_returnflag")
    return traded.agg(
        (kind != "N").alias("is_directed"),
        F.when(kind == "A", "hybrid").when(kind == "R", "directed_news").otherwise("undirected_conflict").alias("relationship_nature"),
        ((1 + F.max(F.round(F.col("l_discount") * 100))) / 20).alias("composite_tension_index"),
    )


def bulk_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("country_iso3")).unionByName(
        table(spark, folder, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("country_iso3"))
    )


#: As ``SCENARIOS``: up to four hops; the last stays near its target.
BULK_SCENARIOS = [
    ("four", "S1", None, None, -0.9, 3.0, None, False, 4, 0.95),
    ("three", "S7", None, None, 0.8, 1.0, None, False, 3, 0.9),
    ("push", "S3", None, None, 0.0, 1.0, 0.7, False, 4, 1.0),
    ("near", "C10", None, None, -1.0, 1.5, None, False, 1, 0.5),
]


def scenarios(spark: SparkSession) -> DataFrame:
    return impact.with_scenario_defaults(spark.createDataFrame(SCENARIOS, SCENARIO_DDL))
