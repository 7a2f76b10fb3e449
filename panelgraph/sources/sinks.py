"""Sinks: tables, run metadata and graph JSON."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_table(
    df: DataFrame, path: str, *, partition_by: Sequence[str] = (), sort_by: Sequence[str] = (), total_order: bool = False
) -> None:
    """Parquet (snappy), replaced on each run.

    Rows are sorted inside files; ``total_order`` range-sorts the whole table instead.
    """
    if sort_by:
        df = df.orderBy(*sort_by) if total_order else df.sortWithinPartitions(*sort_by)
    writer = df.write.mode("overwrite").option("compression", "snappy")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def panel_metadata(panel: DataFrame, entity: str = "country_iso3") -> DataFrame:
    """One row about a panel: size, entities, period range and columns."""
    return panel.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.countDistinct(entity).alias("unique_entities"),
        F.min("year_month").alias("start_year_month"),
        F.max("year_month").alias("end_year_month"),
    ).withColumn("feature_columns", F.array(*[F.lit(c) for c in panel.columns]))


def write_metadata(summary: DataFrame, path: str, parameters: Mapping[str, object] | None = None) -> None:
    """A one-row JSON file: the summary plus run parameters and the run time (UTC)."""
    for name, value in (parameters or {}).items():
        summary = summary.withColumn(name, F.lit(value))
    summary.withColumn("created_timestamp_utc", F.current_timestamp()).coalesce(1).write.mode("overwrite").json(path)


def write_observed(df: DataFrame, path: str, **metrics) -> dict:
    """Write a table and return metrics over its rows from the same job, without a second pass."""
    seen = Observation()
    write_table(df.observe(seen, *[c.alias(n) for n, c in metrics.items()]), path)
    return seen.get


def write_graph(nodes: DataFrame, links: DataFrame, folder: str) -> None:
    """Node-link graph as two JSON-lines datasets, written in parallel at any size."""
    nodes.write.mode("overwrite").json(f"{folder}/nodes")
    links.write.mode("overwrite").json(f"{folder}/links")
