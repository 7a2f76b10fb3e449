"""Raw articles to scored, deduplicated articles. Everything before the dedup is narrow."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelgraph.fixed_values import (
    ARTICLE_TIME_FORMATS,
    GAZETTEER,
    PHRASE_CONFIDENCE,
    SHORT_WORD_CONFIDENCE,
    TAXONOMY,
    VALENCES,
    WORD_CONFIDENCE,
)
from panelgraph.functions import dates, text
from panelgraph.operators.dedup import keep_first
from panelgraph.sources import dims

ARTICLE_COLUMNS = (
    "article_id", "published_at_utc", "year", "month", "year_month", "title", "url", "domain", "language",
    "raw_sourcecountry", "source_country_iso3", "target_country_iso3", "target_country_confidence",
)


def usable_articles(raw: DataFrame, formats: Sequence[str] = ARTICLE_TIME_FORMATS) -> DataFrame:
    """Articles with a url, a title and a readable time; missing keys get their defaults."""

    def field(name: str, default: str = "") -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(default))

    trimmed = raw.withColumns(
        {
            "url": text.strip(field("url")),
            "title": text.strip(field("title")),
            "published_at_utc": dates.article_time(field("seendate"), formats),
            "domain": text.canonical_domain(field("domain")),
            "language": text.strip(field("language", "English")),
            "raw_sourcecountry": text.strip(field("sourcecountry")),
        }
    )
    return trimmed.filter(
        (F.col("url") != "") & (F.col("title") != "") & F.col("published_at_utc").isNotNull()
    )


def with_source_country(articles: DataFrame, publishers: DataFrame | None = None) -> DataFrame:
    """Add source_country_iso3 by the publisher's country name, any case; unknown -> NULL."""
    publishers = publishers if publishers is not None else dims.publisher_countries(articles.sparkSession)
    table = publishers.select(F.col("publisher_country").alias("_publisher"), F.col("iso3").alias("source_country_iso3"))
    return (
        articles.withColumn("_publisher", F.lower("raw_sourcecountry"))
        .join(table, "_publisher", "left")
        .drop("_publisher")
    )


def with_target_country(articles: DataFrame, gazetteer: Sequence[tuple[str, str]] = GAZETTEER) -> DataFrame:
    """Add the entity named in the title and its confidence."""
    named = articles.withColumn("_words", text.tokens(F.col("title")))
    named = named.withColumn("_target", text.target_entity(F.col("title"), F.col("_words"), gazetteer))
    return named.withColumns(
        {"target_country_iso3": F.col("_target.entity"), "target_country_confidence": F.col("_target.confidence")}
    ).drop("_words", "_target")


#: Characters of a phrase, from its first space on, by which it is found in a text.
PHRASE_KEY = 8


def with_target_by_join(articles: DataFrame, gazetteer: DataFrame, key: str = "article_id") -> DataFrame:
    """``with_target_country`` for a gazetteer that is a table of any size; the same answers.

    gazetteer: term, iso3, ord (its place in the list). A phrase (a term with a space) may stand anywhere in the lower-case title, also
    inside words. It then has its first space somewhere in the title, so the characters from there on are its key: phrases and
    titles meet in an equi join on them, and the phrase itself is looked for in the title afterwards. Single words meet the
    title's tokens. Only ``key`` (unique; a row without it names no entity) and keys are shuffled for the search; titles move once, to meet what was found.
    """
    lowered = F.lower("title")
    terms = gazetteer.filter(F.col("term").isNotNull() & (F.col("term") != "")).groupBy("term").agg(F.min(F.struct("ord", "iso3")).alias("_t")).select("term", "_t.ord", "_t.iso3")
    spaced = F.col("term").contains(" ")
    tail = F.substring(F.expr("substring(term, instr(term, ' '))"), 1, PHRASE_KEY)
    # of words, long ones come before short ones, then the list's order
    keyed = terms.select("term", "iso3", "ord", spaced.alias("phrase"), F.when(spaced, tail).otherwise(F.col("term")).alias("_key"), (F.length("term") <= 3).alias("short"))
    lengths = [r["n"] for r in keyed.filter("phrase").select(F.length("_key").alias("n")).distinct().collect()]  # at most PHRASE_KEY
    # one scan a length: what follows each space, with enough characters for a key of that length
    follows = [F.array_distinct(F.regexp_extract_all(lowered, F.lit(rf"(?s) (?=(.{{{n - 1}}}))"), F.lit(1))) for n in sorted(lengths)]
    tails = F.transform(F.flatten(F.array(*follows).cast("array<array<string>>")), lambda t: F.concat(F.lit(" "), t))
    # a phrase's key begins with its space, a word's has none
    both = F.concat(tails, F.array_distinct(text.tokens(F.col("title"))))
    met = articles.filter(F.col(key).isNotNull()).select(key, F.explode(both).alias("_key")).join(keyed, "_key")
    found = met.groupBy(key).agg(
        F.sort_array(F.collect_list(F.when(F.col("phrase"), F.struct("ord", "term", "iso3")))).alias("_phrases"),
        F.min(F.when(~F.col("phrase"), F.struct("short", "ord", "iso3"))).alias("_word"),
    )
    joined = articles.join(found, key, "left").withColumn("_low", lowered)
    first = F.get(F.filter("_phrases", lambda p: F.contains(F.col("_low"), p["term"])), 0)
    confidence = F.when(first.isNotNull(), PHRASE_CONFIDENCE).when(F.col("_word").isNull(), 0.0).when(F.col("_word.short"), SHORT_WORD_CONFIDENCE).otherwise(WORD_CONFIDENCE)
    return joined.withColumns(
        {"target_country_iso3": F.when(first.isNotNull(), first["iso3"]).otherwise(F.col("_word.iso3")), "target_country_confidence": confidence.cast("double")}
    ).drop("_phrases", "_word", "_low")


def first_articles(articles: DataFrame, order: Column) -> DataFrame:
    """First copy of each article_id, then the first of each title on one UTC day.

    Titles can be whole texts, so the second key holds the title's SHA-256: sorting and
    hashing copies costs the same however long they are.
    """
    same_day = [F.to_date("published_at_utc"), F.sha2("title", 256)]
    return keep_first(articles, ["article_id"], order, same_day)


def normalize_articles(
    raw: DataFrame,
    *,
    order: Column,
    gazetteer: Sequence[tuple[str, str]] = GAZETTEER,
    publishers: DataFrame | None = None,
    formats: Sequence[str] = ARTICLE_TIME_FORMATS,
) -> DataFrame:
    """Usable articles, each once, with ids, times, domain, publisher country and target.

    Text is scanned for targets only after the dedup, so dropped copies cost no scan.
    """
    usable = usable_articles(raw.withColumn("_input", order), formats)
    keyed = usable.withColumns(
        {
            "article_id": text.article_id(F.col("url"), F.col("title")),
            "year": F.year("published_at_utc"),
            "month": F.month("published_at_utc"),
            "year_month": dates.year_month(F.col("published_at_utc")),
        }
    )
    slim = keyed.select(*[c for c in ARTICLE_COLUMNS if c in keyed.columns], "_input")
    unique = first_articles(slim, F.col("_input")).drop("_input")
    return with_target_country(with_source_country(unique, publishers), gazetteer).select(*ARTICLE_COLUMNS)


def with_taxonomy(articles: DataFrame, taxonomy: Mapping[str, Sequence[str]] = TAXONOMY) -> DataFrame:
    """Add relevance, hit count, primary category and one flag per category."""
    every = [word for words in taxonomy.values() for word in words]
    found = articles.withColumn("_found", text.keywords_found(F.col("title"), every))
    hits = text.taxonomy_hits(F.col("_found"), taxonomy)
    counted = found.withColumns({f"_hits_{name}": c for name, c in hits.items()})
    columns = {name: F.col(f"_hits_{name}") for name in taxonomy}
    total = sum(list(columns.values())[1:], next(iter(columns.values())))
    labelled = counted.withColumns(
        {
            "is_conflict_relevant": total > 0,
            "conflict_category_count": total,
            "primary_conflict_category": text.primary_category(columns),
        }
        | {f"cat_{name}": c > 0 for name, c in columns.items()}
    )
    return labelled.drop("_found", *[f"_hits_{name}" for name in taxonomy])


def with_tone(articles: DataFrame, valences: Mapping[str, float] = VALENCES) -> DataFrame:
    """Add tone, its negative and extreme flags, and conflict intensity."""
    worded = articles.withColumn("_words", text.tokens(F.col("title")))
    worded = worded.withColumn("_known", text.known_words(F.col("_words"), valences))
    scored = worded.withColumn("tone_score", text.tone_score(F.col("_words"), F.col("_known"), valences))
    return scored.withColumns(
        {
            "is_negative_tone": text.is_negative(F.col("tone_score")),
            "is_extreme_tone": text.is_extreme(F.col("tone_score")),
            "conflict_intensity": text.conflict_intensity(F.col("conflict_category_count"), F.col("title")),
        }
    ).drop("_words", "_known")


def score_articles(
    articles: DataFrame,
    *,
    taxonomy: Mapping[str, Sequence[str]] = TAXONOMY,
    valences: Mapping[str, float] = VALENCES,
) -> DataFrame:
    return with_tone(with_taxonomy(articles, taxonomy), valences)


def relevance_share(articles: DataFrame) -> DataFrame:
    """Relevant articles and their share of all."""
    return articles.agg(
        F.count(F.lit(1)).alias("articles"),
        F.count_if("is_conflict_relevant").alias("relevant"),
        (F.count_if("is_conflict_relevant") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("relevant_share"),
    )
