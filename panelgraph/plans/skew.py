"""Hot keys: find them with a proven bound on their number, then spread them over tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than 1 / MAX_HOT of all rows, so fewer than MAX_HOT can be.
MAX_HOT = 1000


def hot_keys(df: DataFrame, keys: Sequence[str], *, max_hot: int = MAX_HOT) -> DataFrame:
    """(keys..., fan): keys with more than ``1/max_hot`` of the rows, and parts to split each in.

    By the pigeonhole principle there are fewer than ``max_hot`` of them, whatever the data,
    which is what makes broadcasting this table safe.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1)).alias("_total")).scalar()
    part = total / F.lit(float(max_hot))
    return counts.filter(F.col("_n") > part).select(*keys, F.ceil(F.col("_n") / part).cast("int").alias("fan"))


def salt(df: DataFrame, keys: Sequence[str], hot: DataFrame, spread: Column) -> DataFrame:
    """Add ``slot``: 0 for ordinary keys, a hash of ``spread`` for hot ones."""
    marked = df.join(F.broadcast(hot), list(keys), "left")
    slot = F.coalesce(F.pmod(F.xxhash64(spread), F.col("fan")), F.lit(0)).cast("int")
    return marked.withColumn("slot", slot).drop("fan")


def replicate(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> DataFrame:
    """Repeat the rows of hot keys once per slot, so that every salted row finds its partner."""
    marked = df.join(F.broadcast(hot), list(keys), "left")
    slots = F.sequence(F.lit(0), F.coalesce(F.col("fan"), F.lit(1)) - 1)
    return marked.withColumn("slot", F.explode(slots)).drop("fan")
