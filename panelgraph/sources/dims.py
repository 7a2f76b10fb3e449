"""Dimension tables from constants: parameters of the operators, not hidden globals.

They are built as local relations, whose size the planner knows exactly, so it broadcasts
them by its own threshold check.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelgraph import fixed_values as fv


def local_table(spark: SparkSession, columns: Mapping[str, Sequence], types: Mapping[str, pa.DataType]) -> DataFrame:
    return spark.createDataFrame(pa.table({n: pa.array(list(v), types[n]) for n, v in columns.items()}))


def _pairs(spark: SparkSession, rows: Sequence[tuple[str, str]], key: str, value: str) -> DataFrame:
    """(key, value, ord): ``ord`` keeps the list order, which decides ties."""
    return local_table(
        spark,
        {key: [k for k, _ in rows], value: [v for _, v in rows], "ord": range(len(rows))},
        {key: pa.string(), value: pa.string(), "ord": pa.int32()},
    )


def state_codes(spark: SparkSession, codes: Mapping[int, str] = fv.STATE_CODES) -> DataFrame:
    return local_table(
        spark,
        {"state_code": list(codes), "iso3": list(codes.values()), "ord": range(len(codes))},
        {"state_code": pa.int32(), "iso3": pa.string(), "ord": pa.int32()},
    )


def event_country_names(spark: SparkSession, rows=fv.EVENT_COUNTRY_NAMES) -> DataFrame:
    return _pairs(spark, rows, "country_name", "iso3")


def government_names(spark: SparkSession, rows=fv.GOVERNMENT_NAMES) -> DataFrame:
    return _pairs(spark, rows, "government", "iso3")


def display_names(spark: SparkSession, names: Mapping[str, str] = fv.DISPLAY_NAMES) -> DataFrame:
    return _pairs(spark, list(names.items()), "country_iso3", "country_name").drop("ord")


def publisher_countries(spark: SparkSession, rows=fv.PUBLISHER_COUNTRIES) -> DataFrame:
    return _pairs(spark, rows, "publisher_country", "iso3")


def gazetteer(spark: SparkSession, rows=fv.GAZETTEER) -> DataFrame:
    return _pairs(spark, rows, "term", "iso3")


def taxonomy(spark: SparkSession, taxonomy: Mapping[str, Sequence[str]] = fv.TAXONOMY) -> DataFrame:
    flat = [(category, word) for category, words in taxonomy.items() for word in words]
    return _pairs(spark, flat, "category", "keyword")


def valences(spark: SparkSession, valences: Mapping[str, float] = fv.VALENCES) -> DataFrame:
    return local_table(
        spark,
        {"word": list(valences), "valence": list(valences.values())},
        {"word": pa.string(), "valence": pa.float64()},
    )


def archetypes(spark: SparkSession, rows=fv.ARCHETYPES) -> DataFrame:
    names = ["archetype", "tone_delta", "conflict_news_multiplier", "sever_dyadic_tie", "decay_factor", "propagation_depth"]
    kinds = [pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.float64(), pa.int32()]
    return local_table(spark, dict(zip(names, zip(*rows))), dict(zip(names, kinds)))


def status_bands(spark: SparkSession, rows=fv.STATUS_BANDS) -> DataFrame:
    """(domain, lower, upper, status): half-open score ranges."""
    upper: dict[str, float] = {}
    out = []
    for domain, lower, status in rows:
        out.append((domain, None if lower is None else float(lower), upper.get(domain), status))
        upper[domain] = None if lower is None else float(lower)
    names = ["domain", "lower", "upper", "status"]
    kinds = [pa.string(), pa.float64(), pa.float64(), pa.string()]
    return local_table(spark, dict(zip(names, zip(*out))), dict(zip(names, kinds)))


def horizons(spark: SparkSession, days: Sequence[int] = (30, 90, 180, 365)) -> DataFrame:
    return local_table(
        spark,
        {"horizon_days": days, "factor": [float(fv.HORIZON_FACTORS.get(d, fv.OTHER_HORIZON)) for d in days]},
        {"horizon_days": pa.int32(), "factor": pa.float64()},
    )


def stress_presets(spark: SparkSession, rows=fv.STRESS_PRESETS) -> DataFrame:
    names = ["shock_id", "gpr", "oil", "gold", "fx"]
    kinds = [pa.string()] + [pa.float64()] * 4
    return local_table(spark, dict(zip(names, zip(*rows))), dict(zip(names, kinds)))
