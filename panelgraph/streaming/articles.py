"""The article pipeline on a stream of landed files, with the batch expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from panelgraph.fixed_values import GAZETTEER, TAXONOMY, VALENCES
from panelgraph.functions import dates, text
from panelgraph.operators.articles import score_articles, usable_articles, with_source_country, with_target_country
from panelgraph.operators.dedup import keep_first
from panelgraph.sources.readers import ARTICLE_SCHEMA


def stream_raw_articles(spark: SparkSession, folder: str, *, max_files: int = 1000, multi_line: bool = False) -> DataFrame:
    """Landed JSON files as a stream with the declared schema."""
    reader = spark.readStream.schema(ARTICLE_SCHEMA).option("maxFilesPerTrigger", max_files)
    return reader.json(folder, multiLine=multi_line)


def enrich_stream(raw: DataFrame, *, gazetteer=GAZETTEER, publishers: DataFrame | None = None, taxonomy=TAXONOMY, valences=VALENCES) -> DataFrame:
    """Stateless part: ids, times, domain, publisher country, target, taxonomy and tone."""
    usable = usable_articles(raw).withColumns(
        {
            "article_id": text.article_id(F.col("url"), F.col("title")),
            "year_month": dates.year_month(F.col("published_at_utc")),
        }
    )
    placed = with_target_country(with_source_country(usable, publishers), gazetteer)
    return score_articles(placed, taxonomy=taxonomy, valences=valences)


def earliest() -> Column:
    """Order of articles: by second, then by id (16 hexadecimal digits)."""
    number = F.conv("article_id", 16, 10).cast("decimal(20,0)") - F.lit(Decimal(2**63)).cast("decimal(20,0)")
    return F.struct(F.unix_seconds("published_at_utc").cast("decimal(12,0)").alias("second"), number.cast("long").alias("id"))


def unique_articles(stored: DataFrame) -> DataFrame:
    """Every article once: the first of each id, then the first of each title and UTC day.

    Works on all that has landed, whatever the order of files and the size of batches, so nothing
    is late and no watermark drops a row.
    """
    return keep_first(stored, ["article_id"], earliest(), [F.to_date("published_at_utc"), F.sha2("title", 256)])


def daily_counts(articles: DataFrame) -> DataFrame:
    """Articles, approximate domains, tone and flags per target and UTC day, open days included."""
    return (
        articles.filter(F.col("target_country_iso3").isNotNull())
        .groupBy(F.to_date("published_at_utc").alias("day"), "target_country_iso3")
        .agg(
            F.count("article_id").alias("news_count_total"),
            F.approx_count_distinct("domain").alias("unique_domains_approx"),
            F.sum("tone_score").alias("tone_sum"),
            F.count_if("is_negative_tone").alias("negative_tone_count"),
            F.count_if("is_extreme_tone").alias("extreme_tone_count"),
            F.count_if("is_conflict_relevant").alias("conflict_news_count"),
        )
    )


def months_from_days(days: DataFrame) -> DataFrame:
    """Roll days up to months in batch: counts add up, the mean is sum over count."""
    month = dates.month_start(F.col("day")).alias("month_start")
    counts = ("news_count_total", "negative_tone_count", "extreme_tone_count", "conflict_news_count")
    return days.groupBy("target_country_iso3", month).agg(
        *[F.sum(c).alias(c) for c in counts], (F.sum("tone_sum") / F.sum("news_count_total")).alias("avg_tone")
    )


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet, exactly once, until the landed files are used up."""
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
