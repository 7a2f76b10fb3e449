"""Connected components of a graph too large for one machine, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Tables


def connected(tables: Tables, links: DataFrame) -> DataFrame:
    """node, root: every node of ``links`` (u, v: longs), root being the smallest node it reaches.

    A round lets each node point its larger neighbours to the smallest node it knows (large star),
    then its smaller ones and itself (small star). Minima are aggregated before they are joined, so
    the centre of a star is one row there; its links are joined to that row and Spark may split them.
    Rounds grow with the logarithm of a component's diameter. Each is a table, so no lineage builds up.
    """
    stars = tables.write("stars", links.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    ).distinct())
    seen = None
    while True:
        state = stars.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if not state["n"] or (state["n"], state["x"]) == seen:
            break
        seen = (state["n"], state["x"])
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("low"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(least, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(
            least.select("u", F.col("low").alias("v"))
        )
        stars = tables.write("stars", small.distinct())
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
