"""Mixing sources to target weights by nested hash thresholds.

Every document has a 60-bit key, the head of an MD5 digest of its id and text. A source's words
are summed by key bucket; the bucket in which the running sum crosses the source's budget is split
by the next bits, the others are decided. No document is sorted: after the first pass over narrow
rows, only those of the boundary buckets (one part in 4096) are read again.

Budgets nest: the c-th copy of a document is in if its key stands below the threshold of copy c, and
a larger budget only adds. The document at the boundary gives the words that are still missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import WORD, Tables, whole

#: Bits of the key, and bits that one refinement fixes.
KEY_BITS, STEP_BITS = 60, 12


def n_words(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def document_key(doc_id: Column, text: Column) -> Column:
    """60 bits that depend on nothing but the id and the text, so reruns agree."""
    named = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), whole(text))
    return F.conv(F.substring(F.md5(named), 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, most: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, source_size -> plus target, budget.

    Sources by code point (null last) weigh ``weights``, repeating. They share all words by weight; a
    target stops at ``most`` times its source's size and the excess is shared again by weight, which
    has a closed form: with sources by cap over weight, the stopped ones are a prefix. The windows run
    over one row per source, not over documents.
    """
    everything = W.partitionBy(F.lit(0))
    place = (F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place + 1).cast("int")).cast("long")
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    by_cap = everything.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    left = ranked.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("words_left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"),
    ).withColumn("stopped", F.col("cap") * F.col("weight_left") <= F.col("words_left") * F.col("weight"))
    # the first source that is not stopped sets the words per weight of all after it
    free = F.min(F.when(~F.col("stopped"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "words_left", "weight_left"))).over(everything)
    target = F.when(F.col("stopped"), F.col("cap").cast("double")).otherwise(
        F.col("weight").cast("double") * free["words_left"] / free["weight_left"]
    )
    return left.select("source", "source_size", target.alias("target"), F.floor(target).cast("long").alias("budget"))


def mix(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), most: int = 3) -> DataFrame:
    """keep columns, source, size, source_size, target, taken for every document.

    docs: doc_id, text, source and what ``keep`` names; others are ignored. Null texts have size 0, a
    null source is a source. Equal rows (same id and text) share one key: they take equal words, and
    fewer than their number may be left over. Sources of size 0 have target 0. An empty table gives
    an empty result.
    """
    tables, columns = Tables(docs.sparkSession, "mix"), tuple(dict.fromkeys((*keep, "source")))
    sized = tables.write("sized", docs.select(
        *columns, n_words(F.col("text")).alias("size"), document_key(F.col("doc_id"), F.col("text")).alias("mix_key"),
    ))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = tables.write("targets", source_targets(sizes, most))
    thresholds = _thresholds(tables, sized, targets)
    joined = sized.join(thresholds, sized["source"].eqNullSafe(thresholds["t_source"]))
    extra = F.when(F.col("mix_key") < F.col("threshold"), F.col("size")).when(F.col("mix_key") == F.col("threshold"), F.col("share"))
    taken = F.col("copies") * F.col("size") + F.coalesce(extra, F.lit(0))
    return joined.select(*columns, "size", "source_size", "target", taken.cast("long").alias("taken"))


def _thresholds(tables: Tables, sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: copies all documents give, the threshold of one more, and each boundary row's share."""
    base = targets.select(
        F.col("source").alias("t_source"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0).cast("long").alias("copies"),
        "budget",
    )
    state = base.withColumn("missing", F.col("budget") - F.col("copies") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long"))
    rows, fixed = sized.select("source", "size", "mix_key"), 0
    for _ in range(KEY_BITS // STEP_BITS):
        shift = KEY_BITS - fixed - STEP_BITS
        inside = rows if not fixed else tables.write("boundary", rows.join(
            state.select("t_source", "prefix"),
            rows["source"].eqNullSafe(F.col("t_source")) & (F.shiftright("mix_key", shift + STEP_BITS) == F.col("prefix")),
        ).select("source", "size", "mix_key"))
        buckets = inside.groupBy("source", F.shiftright("mix_key", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("members"))
        running = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
        met = buckets.withColumn("upto", F.sum("words").over(running)).join(
            state.select("t_source", "missing"), F.col("source").eqNullSafe(F.col("t_source"))
        ).where(F.col("upto") > F.col("missing"))
        first = met.groupBy("t_source").agg(F.min_by(F.struct("bucket", (F.col("missing") - F.col("upto") + F.col("words")).alias("rest"), "members"), "bucket").alias("b"))
        state = tables.write("state", state.drop("members").join(first.withColumnRenamed("t_source", "f_source"), F.col("t_source").eqNullSafe(F.col("f_source")), "left").select(
            "t_source", "source_size", "target", "copies", "budget",
            F.coalesce(F.col("b.rest"), F.lit(0)).cast("long").alias("missing"),
            # nothing crosses: no threshold, all rows of the source are below
            F.coalesce(F.col("b.bucket"), F.lit((1 << (fixed + STEP_BITS)) - 1)).cast("long").alias("prefix"),
            F.coalesce(F.col("b.members"), F.lit(0)).cast("long").alias("members"),
        ))
        rows, fixed = inside, fixed + STEP_BITS
    tables.drop("boundary")
    return state.select(
        "t_source", "source_size", "target", "copies",
        F.col("prefix").alias("threshold"),
        F.when(F.col("members") > 0, F.expr("missing div members")).otherwise(0).cast("long").alias("share"),
    )
