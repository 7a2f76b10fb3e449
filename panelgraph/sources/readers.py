"""Scans: raw files to DataFrames with declared schemas, never inferred ones."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelgraph.fixed_values import RAW_ARTICLE_COLUMNS, RAW_EVENT_COLUMNS

ARTICLE_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_ARTICLE_COLUMNS])


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Refuse a table that lacks required columns, before any job runs."""
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def existing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Project the listed columns that exist, in the listed order."""
    return df.select(*[c for c in columns if c in df.columns])


def csv_header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.csv(path, header=True, enforceSchema=False).limit(0).columns


def read_csv_text(spark: SparkSession, path: str | list[str], *, multi_line: bool = True) -> DataFrame:
    """CSV with a header, every column as text; quoted line breaks belong to the field.

    Without ``multi_line`` large files split over tasks; use it only for quoted line breaks.
    """
    first = path if isinstance(path, str) else path[0]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in csv_header(spark, first)])
    # a file whose header names other columns, or the same in another order, is an error, not a shift of values
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False, multiLine=multi_line, escape='"', encoding="UTF-8")


def read_raw_events(spark: SparkSession, path: str | list[str], *, multi_line: bool = True) -> DataFrame:
    return with_ingest_order(require_columns(read_csv_text(spark, path, multi_line=multi_line), RAW_EVENT_COLUMNS))


def read_raw_articles(spark: SparkSession, path: str | list[str], *, multi_line: bool = True) -> DataFrame:
    """JSON arrays of flat article objects (``multi_line``) or JSON lines; keys may be missing."""
    return with_ingest_order(spark.read.schema(ARTICLE_SCHEMA).json(path, multiLine=multi_line))


def with_ingest_order(df: DataFrame) -> DataFrame:
    """Add ``ingest_order``: file, split and row position, taken at the scan before any shuffle."""
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"),
    )
    return df.select("*", place.alias("ingest_order"))


def read_table(spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet, projected to ``columns`` so that the scan reads only those."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return df.select(*columns) if columns else df


def read_drifting_csv(spark: SparkSession, paths: Iterable[str]) -> tuple[DataFrame | None, DataFrame]:
    """Stack CSV files with different headers (lower-cased); also report files left out.

    Headers are found by one distributed pass, however many files there are; the driver sees distinct headers and their files'
    names. Files with one header are read in one scan, so the plan grows with the number of
    distinct headers. A file whose header names a column twice once lower-cased is left out and reported.
    """
    there = {p: _as_uri(spark, p) for p in paths}
    skipped = [(p, "no such file") for p, uri in there.items() if uri is None]
    uris = {uri: p for p, uri in there.items() if uri is not None}
    heads = read_heads(spark, list(uris.values())) if uris else []
    by_header: dict[tuple[str, ...], list[str]] = {}
    for header, files in heads:
        names = tuple(c.strip().lower() for c in header)
        twice = sorted({c for c in names if names.count(c) > 1})
        for uri in files:
            if twice:
                skipped.append((uris.get(uri, uri), f"columns named twice: {', '.join(twice)}"))
            else:
                by_header.setdefault(names, []).append(uris.get(uri, uri))
    found = {uri for _, files in heads for uri in files}
    skipped += [(p, "no header") for uri, p in uris.items() if uri not in found]
    parts = []
    for header, files in sorted(by_header.items()):
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        parts.append(spark.read.schema(schema).csv(sorted(files), header=True, multiLine=True, escape='"'))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None
    return stacked, spark.createDataFrame(sorted(skipped), "path string, reason string")


def _as_uri(spark: SparkSession, path: str) -> str | None:
    """The full name under which Spark reports a file, None if it is not there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return _plain(files.makeQualified(target).toUri().toString()) if files.exists(target) else None


def _plain(uri: str) -> str:
    """One slash after the scheme, however many a reader writes."""
    return re.sub(r"^(\w+):/+", r"\1:/", uri)


def read_heads(spark: SparkSession, files: list[str]) -> list[tuple[list[str], list[str]]]:
    """Distinct headers of CSV files, each with its files.

    One distributed pass over the lines keeps the first of each file, parsing nothing else: it costs a read of the files, but
    no job and no round trip per file.
    """
    rows = spark.read.text(files)
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row"), F.col("value"))
    first = rows.select(F.col("_metadata.file_path").alias("path"), place.alias("at")).groupBy("path").agg(F.min("at")["value"].alias("line"))
    parsed = first.where(F.trim("line") != "").select("path", F.split(F.regexp_replace("line", "^\ufeff", ""), ',(?=(?:[^"]*"[^"]*")*[^"]*$)').alias("cells"))
    clean = parsed.select("path", F.transform("cells", lambda c: F.replace(F.regexp_replace(F.trim(c), '^"|"$', ""), F.lit('""'), F.lit('"'))).alias("header"))
    return [(r["header"], [_plain(f) for f in r["files"]]) for r in clean.groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("files")).collect()]


def record_count(df: DataFrame) -> int:
    """Rows without the header; with ``multiLine`` a quoted line break starts no new row."""
    return df.count()


def file_manifest(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, length, SHA-256 of every raw file, one task per file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def new_files(manifest: DataFrame, processed: DataFrame) -> DataFrame:
    """Files whose path and content were not processed before."""
    return manifest.join(processed, ["path", "sha256"], "left_anti")
