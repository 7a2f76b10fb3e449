"""Unique articles and daily counts kept up to date on the stream: each batch redoes only the days it touches.

The enriched articles are stored by UTC day (or by months, ``span``, where batches spread over years, as in a backfill:
then a batch redoes the months it touches). A second stream follows that table. Its state, one narrow
row per article id in the state store, holds the days on which copies of the id have landed; the copy
of the earliest day is the one that counts. A batch emits the ids it met, so it knows which days change:
those of its own rows, and later days that lose an id to an earlier copy. Only their partitions are read
again and written, each as a whole. Nothing depends on the order of files, the size of
batches or lateness, and no watermark drops a row.

Texts are written once, into ``articles``. All later steps tell titles apart by their SHA-256, stored beside them, so a batch that
redoes a day reads and moves narrow rows only; ``unique_rows`` gives the whole rows back.

Every write replaces partitions or a folder named by the batch, so a batch that is cut short is simply done again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from panelgraph.functions import dates
from panelgraph.operators.dedup import keep_first
from panelgraph.streaming.articles import earliest

DAY, SPAN = "day", "span"
#: Keys beyond memory live on the executors' disks and are saved in the checkpoint folder.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SEEN = T.StructType([T.StructField("article_id", T.StringType()), *(T.StructField(c, T.DateType()) for c in ("first_day", DAY, SPAN)), T.StructField("batch", T.IntegerType())])
#: Files that one batch may store for one span.
FILES_PER_SPAN = 4
#: Stored with each article: the key of its title, and a hash of the whole row, which breaks ties.
TITLE_KEY, CONTENT = "title_key", "content"
COUNTS = ("news_count_total", "tone_sum", "negative_tone_count", "extreme_tone_count", "conflict_news_count")


def spans(day: Column, span: str) -> Column:
    """The partition a day belongs to: itself, or the first day of its month or year."""
    return day if span == "day" else F.trunc(day, span)


def store_articles(enriched: DataFrame, folder: str, *, span: str = "day") -> StreamingQuery:
    """Append the enriched stream to ``articles`` by span of UTC days, exactly once, until the landed files are used up."""
    placed = enriched.withColumn(DAY, F.to_date("published_at_utc")).withColumn(SPAN, spans(F.col(DAY), span))
    placed = placed.withColumns({TITLE_KEY: F.sha2("title", 256), CONTENT: F.xxhash64(*[F.col(c) for c in sorted(placed.columns)])})
    # few files a span and batch, and a span with most of a batch on several tasks
    dealt = placed.repartition(F.col(SPAN), F.pmod(F.xxhash64("article_id"), F.lit(FILES_PER_SPAN)))
    return (
        dealt.writeStream.format("parquet").option("path", f"{folder}/articles").option("checkpointLocation", f"{folder}/_articles")
        .option("compression", "zstd")
        .partitionBy(SPAN).outputMode("append").trigger(availableNow=True).start()
    )


def follow_articles(spark: SparkSession, folder: str, *, max_files: int = 1000, span: str = "day") -> StreamingQuery:
    """Bring ``unique`` and ``domain_counts`` up to date with ``articles``, at most ``max_files`` files of it a batch."""
    stored = spark.read.parquet(f"{folder}/articles").schema
    stream = spark.readStream.schema(stored).option("maxFilesPerTrigger", max_files).parquet(f"{folder}/articles")
    seen = stream.groupBy("article_id").agg(F.min(DAY).alias("first_day"), F.collect_set(DAY).alias("days"))
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, STATE_STORE)
    try:  # a query keeps the settings it started with
        return (
            seen.writeStream.foreachBatch(lambda batch, number: redo_days(batch, number, folder, stored, span))
            .option("checkpointLocation", f"{folder}/_unique").outputMode("update").trigger(availableNow=True).start()
        )
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)


def redo_days(changes: DataFrame, batch: int, folder: str, articles: T.StructType, span: str = "day") -> None:
    """Write the spans that a batch touches anew.

    changes: article_id, first_day, days; articles: the stored table's schema. What the changes say is kept in ``seen``, by span
    and batch: from it each day knows which of its ids have an earlier copy elsewhere.
    """
    spark = changes.sparkSession
    met = Observation()
    placed = changes.select("article_id", "first_day", F.explode("days").alias(DAY)).withColumn(SPAN, spans(F.col(DAY), span))
    _write(placed.observe(met, F.collect_set(SPAN).alias("spans")).withColumn("batch", F.lit(batch)), f"{folder}/seen", SPAN, "batch")
    touched = sorted(met.get["spans"] or [])  # calendar dates
    if not touched:
        return
    elsewhere = _read(spark, f"{folder}/seen", SEEN, touched).where(F.col("first_day") < F.col(DAY)).select("article_id", DAY).distinct()
    stored = spark.read.schema(articles).parquet(f"{folder}/articles").drop("title").where(F.col(SPAN).isin(touched))  # pruned by the stream's log
    unique = unique_of_days(stored.join(elsewhere, ["article_id", DAY], "left_anti"))
    _replace(unique, f"{folder}/unique", touched, batch)
    _replace(domain_counts(_read(spark, f"{folder}/unique", unique.schema, touched)), f"{folder}/domain_counts", touched, batch)


def unique_of_days(stored: DataFrame) -> DataFrame:
    """The first copy of each id, then the first article of each title, within each day; the content breaks ties."""
    second = F.unix_seconds("published_at_utc").cast("decimal(12,0)").alias("second")
    by_id = keep_first(stored, [DAY, "article_id"], F.struct(second, CONTENT))
    return keep_first(by_id, [DAY, TITLE_KEY], earliest())


def unique_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The articles of ``unique`` with their titles; rows that are equal in everything count once."""
    keys = [SPAN, DAY, "article_id", CONTENT]
    articles = spark.read.parquet(f"{folder}/articles")
    return articles.join(spark.read.parquet(f"{folder}/unique").select(*keys), keys, "left_semi").dropDuplicates(keys)


def domain_counts(unique: DataFrame) -> DataFrame:
    """Counts per day, target and publisher domain: the state that adds up to exact distinct domains of any period."""
    return unique.filter(F.col("target_country_iso3").isNotNull()).groupBy(SPAN, DAY, "target_country_iso3", "domain").agg(
        F.count("article_id").alias("news_count_total"),
        F.sum("tone_score").alias("tone_sum"),
        F.count_if("is_negative_tone").alias("negative_tone_count"),
        F.count_if("is_extreme_tone").alias("extreme_tone_count"),
        F.count_if("is_conflict_relevant").alias("conflict_news_count"),
    )


def _over(counts: DataFrame, *period: str | Column) -> DataFrame:
    per_domain = counts.groupBy(*period, "target_country_iso3", "domain").agg(*[F.sum(c).alias(c) for c in COUNTS])
    names = [c for c in per_domain.columns if c not in ("domain", *COUNTS)]
    return per_domain.groupBy(*names).agg(*[F.sum(c).alias(c) for c in COUNTS], F.count("domain").alias("unique_domains"))


def daily_counts(counts: DataFrame) -> DataFrame:
    """Articles, tone, flags and distinct domains per target and day, from ``domain_counts``."""
    return _over(counts, DAY)


def monthly_counts(counts: DataFrame) -> DataFrame:
    """The same per month, with the mean tone; a domain of several days counts once."""
    months = _over(counts, dates.month_start(F.col(DAY)).alias("month_start"))
    return months.withColumn("avg_tone", F.col("tone_sum") / F.col("news_count_total")).drop("tone_sum")


def _write(df: DataFrame, path: str, *parts: str) -> None:
    """Replace the partitions that ``df`` has rows of: few files each, and adaptive execution splits a large one."""
    df.hint("rebalance", F.col(SPAN)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def _read(spark: SparkSession, path: str, schema: T.StructType, dates_: Sequence) -> DataFrame:
    """These spans of the table at ``path``; no other span's folder is looked into."""
    wanted = {f"{SPAN}={d.isoformat()}" for d in dates_}
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    there = [s.getPath().getName() for s in files.listStatus(root)] if files.exists(root) else []
    chosen = [f"{path}/{name}" for name in sorted(wanted.intersection(there))]
    if not chosen:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*chosen)


def _replace(df: DataFrame, path: str, dates_: Sequence, batch: int) -> None:
    """Replace the spans ``dates_`` of the table at ``path``; one that has no rows any more goes."""
    spark, written = df.sparkSession, Observation()
    _write(df.withColumn("batch", F.lit(batch)).observe(written, F.collect_set(SPAN).alias("spans")), path, SPAN)
    jvm = spark._jvm
    for date in set(dates_) - set(written.get["spans"] or []):
        gone = jvm.org.apache.hadoop.fs.Path(f"{path}/{SPAN}={date.isoformat()}")
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
