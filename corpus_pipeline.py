"""A training-data pipeline over ``documents``: filter, deduplicate, sanitise, mix, pack.

Each stage is one operator of ``panelgraph.llm`` on all its predecessor kept. ``run`` writes every stage
as Parquet in the shared folder and gives the next one what it reads there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelgraph.llm import mixing, packing, personal, quality, simhash
from panelgraph.llm.tables import Tables

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules keep; the others go. Null and empty texts go."""
    return quality.assess(docs, COLUMNS).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id. Equal rows are one document."""
    return simhash.representatives(docs, COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; personal data and terms that disclose it give way to marks, n_chars follows the text."""
    found = personal.detect(docs, COLUMNS)
    clean = personal.sanitised(F.col("text"), {k: F.col(k) for k in (*personal.KINDS, personal.TERM_KIND)})
    return found.withColumn("text", clean).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it: 0 to 3; the one at a threshold counts from half on."""
    mixed = mixing.mix(docs, COLUMNS)
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    return mixed.withColumn("times", times).where("times > 0").select(*COLUMNS, F.explode(F.sequence(F.lit(1), "times"))).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens; a repeated document is packed each time."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 1)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("mixing", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: Tokenizer ids, XXH64 and expectation-maximisation are out of SQL's reach; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = tables.write(name, stage(spark, docs, sf_dir))
        if before:
            tables.drop(before)
        before = name
    return docs
