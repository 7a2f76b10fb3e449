"""Weighted PageRank as an iterative DataFrame plan, for one graph or many at once."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from panelgraph.plans.skew import hot_keys, replicate, salt
from panelgraph.session import Revolving, cut


#: Share of ``tol`` that a jump over the remaining iterations may be wrong by, summed over all nodes.
JUMP_ERROR = 1e-6


def rank_nodes(
    nodes: DataFrame,
    steps: DataFrame,
    *,
    alpha: float,
    max_iter: int,
    tol: float,
    group: Sequence[str] = (),
    report: dict | None = None,
) -> DataFrame:
    """(group..., node, rank) by power iteration from equal ranks.

    ``nodes`` are (group..., node), ``steps`` are (group..., src, dst, weight). Parallel steps
    add up, weights <= 0 and steps that leave the node set are ignored, the rank of nodes
    without a way out is spread evenly, and each graph stops by itself at the first iteration
    whose L1 change is below ``tol``.

    The ways stay partitioned by source with hubs split over tasks, at every size; an iteration
    shuffles one row per node and the summed ranks. ``report`` gets the number of iterations, the last
    L1 change (of all graphs that still moved) and whether it fell below ``tol``; ranks that did not
    settle within ``max_iter`` are also warned about.
    """
    g = list(group)
    ranks, done, moved = _many(nodes, steps, g, alpha, max_iter, tol) if g else _one(nodes, steps, alpha, max_iter, tol)
    if report is not None:
        report.update(iterations=done, moved=moved, converged=moved < tol)
    if not moved < tol and done:
        warnings.warn(f"ranks still move by {moved} after {done} iterations", stacklevel=2)
    return ranks


def _one(nodes: DataFrame, steps: DataFrame, alpha: float, max_iter: int, tol: float) -> tuple[DataFrame, int, float]:
    """One graph, an iteration a job. Nodes are numbers here, so ways and sums are narrow; the rank stuck in nodes without a way
    out is observed in the job that computes it.

    Iterations that are known before they are run are not run. Two steps turn the change d(k-2) into d(k) = (alpha P)^2 d(k-2), with
    P a stochastic matrix. Parts of a change that P (nearly) keeps, as pieces of the graph that do not mix, or swaps, as the sides of a
    two-sided graph, shrink slowly, all others die out soon. Once d(k) = c d(k-2) + e for a number c <= alpha^2, all later changes are
    d(k-1) and d(k) times powers of c, but for less than 2 alpha^2 / (1 - alpha^2)^2 |e| in the L1 norm over all of them, because P
    never lengthens a vector. Where that is below ``JUMP_ERROR * tol``, the rest of the series is added up, to the iteration at which
    the stop rule holds. c is the best one of the iteration before.
    """
    spark, size = nodes.sparkSession, Observation()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = nodes.select("node").distinct().withColumn("id", F.monotonically_increasing_id())
    known = cut(known.observe(size, F.count(F.lit(1)).alias("n")))  # written once, so the numbers stay
    n = size.get["n"]
    if n == 0:
        return nodes.select("node", F.lit(1.0).alias("rank")), 0, float("inf")
    merged = steps.filter(F.col("weight") > 0).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    for end in ("src", "dst"):
        merged = merged.join(known.select(F.col("node").alias(end), F.col("id").alias(f"_{end}")), end).drop(end)
    ways = cut(merged.select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), "weight"))
    hot = cut(hot_keys(ways, ["src"]))
    out = cut(ways.groupBy("src").agg(F.sum("weight").alias("out")))
    split = not hot.isEmpty()
    keys = ["src", "slot"] if split else ["src"]
    if split:
        ways, shares = salt(ways, ["src"], hot, F.col("dst")), replicate(out, ["src"], hot)
    else:
        shares = out
    ways = ways.join(shares, keys).select(*keys, "dst", F.expr(f"{alpha!r}D * weight / out AS share"))
    ways = ways.repartition(parts, *keys).sortWithinPartitions(*keys).persist(StorageLevel.MEMORY_AND_DISK)  # sorted once for all merges
    table, seen = Revolving(spark), Observation()
    state = known.join(out.withColumnRenamed("src", "id"), "id", "left").selectExpr("id", "out IS NULL AS stuck", f"{1.0 / n!r}D AS x", *[f"CAST(NULL AS DOUBLE) AS p{i}" for i in (1, 2, 3)])
    state = table.keep(state.observe(seen, F.expr("coalesce(sum(if(stuck, x, NULL)), 0D) AS lost")))
    lost, done, moved, total, odd, even = seen.get["lost"], 0, float("inf"), 1.0, 0.0, 0.0
    a2 = c = alpha * alpha
    while done < max_iter and not moved < tol:
        seen, before = Observation(), moved
        senders = state.selectExpr("id AS src", "x")
        sent = ways.join(replicate(senders, ["src"], hot) if split else senders, keys)
        received = sent.groupBy(F.col("dst").alias("id")).agg(F.expr("sum(share * x) AS received"))
        step = f"coalesce(received, 0D) + {alpha * lost / n + (1.0 - alpha) / n!r}D"
        moves = state.join(received, "id", "left").selectExpr("id", "stuck", f"{step} AS x", "x AS p1", "p1 AS p2", "p2 AS p3")
        state = table.keep(
            moves.observe(
                seen,
                F.expr("coalesce(sum(if(stuck, x, NULL)), 0D) AS lost"),
                F.expr("sum(abs(x - p1)) AS moved"),
                F.expr("sum(x) AS total"),
                F.expr(f"sum(abs((x - p1) - {c!r}D * (p2 - p3))) AS e"),
                F.expr("sum((x - p1) * (p2 - p3)) AS dot"),
                F.expr("sum((p2 - p3) * (p2 - p3)) AS square"),
            )
        )
        lost, moved, total, e = (seen.get[c] for c in ("lost", "moved", "total", "e"))
        done += 1
        if e is not None and not moved < tol and 2 * a2 / (1 - a2) ** 2 * e <= JUMP_ERROR * tol:
            changes, power = (before, moved), 1.0
            while done < max_iter and not moved < tol:  # d(k-1), d(k), d(k-1), ... times powers of c
                on_odd = odd == even
                power = power * c if on_odd else power
                odd, even = (odd + power, even) if on_odd else (odd, even + power)
                moved, done = power * changes[0 if on_odd else 1], done + 1
            break
        c = min(max(seen.get["dot"] / seen.get["square"], 0.0), a2) if seen.get["square"] else a2
    ways.unpersist()
    rank = f"(x + {odd!r}D * coalesce(p1 - p2, 0D) + {even!r}D * coalesce(x - p1, 0D)) / {total!r}D"
    return state.join(known, "id").selectExpr("node", f"{rank} AS rank"), done, moved


def _many(nodes: DataFrame, steps: DataFrame, g: Sequence[str], alpha: float, max_iter: int, tol: float) -> tuple[DataFrame, int, float]:
    """Many graphs at once, an iteration a job; its totals are observed in the job that computes it.

    Each node has one own row (weight NULL) among the ways, which carries its old values along.
    So an iteration is one join and one aggregate over the same input.
    """
    size = Observation()
    own = nodes.select(*g, F.col("node").alias("src")).distinct()
    own = own.select("*", F.col("src").alias("dst"), F.lit(None).cast("double").alias("weight"))
    is_own = F.col("weight").isNull()
    ways = cut(_inside(nodes, steps, g).unionByName(own).observe(size, F.count_if(is_own).alias("n")))
    if size.get["n"] == 0:
        return nodes.select(*g, "node", F.lit(1.0).alias("rank")), 0, float("inf")
    hot = cut(hot_keys(ways, [*g, "src"]))
    out = ways.groupBy(*g, F.col("src").alias("node")).agg(F.sum("weight").alias("out"))
    table = Revolving(ways.sparkSession)
    counts = ways.filter("weight IS NULL").groupBy(*g).agg(F.count(F.lit(1)).alias("n"))
    state = out.join(counts, list(g)).withColumn("rank", 1.0 / F.col("n")).drop("n")
    state = table.keep(state.withColumn("previous", F.lit(None).cast("double")))
    ways = salt(ways, [*g, "src"], hot, F.col("dst")).repartition(*g, "src", "slot").persist(StorageLevel.MEMORY_AND_DISK)
    done, moved = 0, float("inf")
    for done in range(1, max_iter + 1):
        seen = Observation()
        state = table.keep(_iterate(state, ways, g, alpha, hot, _constants(state, tol, g)).observe(seen, F.expr("sum(abs(rank - previous)) AS moved")))
        moved = seen.get["moved"]  # nothing moves once all of them have stopped
        if moved < tol:
            break
    ways.unpersist()
    sums = state.groupBy(*g).agg(F.sum("rank").alias("_total"))
    return state.join(sums, list(g)).select(*g, "node", (F.col("rank") / F.col("_total")).alias("rank")), done, moved


def _inside(nodes: DataFrame, steps: DataFrame, g: Sequence[str]) -> DataFrame:
    """Positive steps between nodes, parallel ones added up.

    Every join is followed by a shuffle or the write, so adaptive execution may split a hub.
    """
    merged = steps.filter(F.col("weight") > 0).groupBy(*g, "src", "dst").agg(F.sum("weight").alias("weight"))
    for end in ("src", "dst"):
        merged = merged.join(nodes.select(*g, F.col("node").alias(end)), [*g, end], "left_semi")
    return merged.select(*g, "src", "dst", "weight")


def _constants(state: DataFrame, tol: float, g: Sequence[str]) -> DataFrame:
    """Per graph: its size, the rank stuck in nodes without a way out, and whether it has stopped."""
    return state.groupBy(*g).agg(
        F.expr("count(1) AS n"),
        F.expr("coalesce(sum(if(out IS NULL, rank, NULL)), 0D) AS lost"),
        F.expr(f"coalesce(sum(abs(rank - previous)) < {tol!r}D, false) AS done"),
    )


def _iterate(state: DataFrame, ways: DataFrame, g: Sequence[str], alpha: float, hot: DataFrame, constants: DataFrame) -> DataFrame:
    # Built again in every iteration, so expressions are short SQL text, quick to build.
    senders = state.selectExpr(*g, "node AS src", "out", "rank")
    sent = ways.join(replicate(senders, [*g, "src"], hot), [*g, "src", "slot"])
    received = sent.groupBy(*g, "dst").agg(
        F.expr("max(if(weight IS NULL, out, NULL)) AS out"),
        F.expr("max(if(weight IS NULL, rank, NULL)) AS previous"),
        F.expr("coalesce(sum(rank * weight / out), 0D) AS received"),
    )
    rank = f"if(done, previous, {alpha!r}D * (received + lost / n) + {1.0 - alpha!r}D / n)"
    return received.join(constants, list(g)).selectExpr(*g, "dst AS node", "out", f"{rank} AS rank", "previous")
