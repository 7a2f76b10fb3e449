"""Data-quality gates as rows (rule, passed, observed) instead of a stopped job; ``enforce`` turns failed rules into an error.

A rule is a name with two aggregates, whether it holds and what was seen. ``check`` fuses any number of rules of a table into one
aggregate, so the table is read once; ``write_checked`` has them observed by the job that writes the table, so it is not
read again at all. The functions named after one family of rules are ``check`` of that family.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelgraph.operators.dyads import SOURCE, TARGET
from panelgraph.sources.sinks import write_table

NUMERIC = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DecimalType)


Rules = Mapping[str, tuple[Column, Column]]


def _fused(rules: Sequence[Rules]) -> Rules:
    """All rules as one; a name that stands twice would hide a rule."""
    out: dict[str, tuple[Column, Column]] = {}
    for some in rules:
        if twice := out.keys() & some.keys():
            raise ValueError(f"rules named twice: {sorted(twice)}")
        out |= some
    return {name: (F.coalesce(passed, F.lit(False)), observed.cast("double")) for name, (passed, observed) in out.items()}


def check(df: DataFrame, *rules: Rules) -> DataFrame:
    """One row per rule from one aggregate over ``df``."""
    rows = [F.struct(F.lit(name).alias("rule"), passed.alias("passed"), observed.alias("observed")) for name, (passed, observed) in _fused(rules).items()]
    return df.agg(F.array(*rows).alias("_checks")).select(F.explode("_checks").alias("_c")).select("_c.*")


def write_checked(df: DataFrame, path: str, *rules: Rules, write: Callable[[DataFrame, str], None] = write_table) -> DataFrame:
    """Write ``df`` and return its rules' rows, observed while it is written; they are as few as the rules."""
    fused, seen = _fused(rules), Observation()
    metrics = [c.alias(f"{kind}{i}") for i, pair in enumerate(fused.values()) for kind, c in zip(("passed", "observed"), pair, strict=True)]
    write(df.observe(seen, *metrics) if metrics else df, path)
    got = seen.get if metrics else {}
    rows = [(name, got.get(f"passed{i}", False), got.get(f"observed{i}")) for i, name in enumerate(fused)]
    return df.sparkSession.createDataFrame(rows, "rule string, passed boolean, observed double")


def none(bad: Column) -> tuple[Column, Column]:
    """No row is ``bad``; NULL is not."""
    n = F.count_if(F.coalesce(bad, F.lit(False)))
    return n == 0, n


def rows_rule() -> Rules:
    rows = F.count(F.lit(1))
    return {"not empty": (rows > 0, rows)}


def null_rules(columns: Sequence[str]) -> Rules:
    return {f"no nulls in {c}": none(F.col(c).isNull()) for c in columns}


def finite_rules(df: DataFrame, *, allow_null: Sequence[str] | None = ()) -> Rules:
    """No NaN, infinity or NULL in any numeric column of ``df``; ``allow_null=None`` permits NULL everywhere."""

    def bad(c: str) -> Column:
        value = F.col(c).cast("double")
        odd = F.isnan(value) | (F.abs(value) == float("inf"))
        return odd | value.isNull() if allow_null is not None and c not in allow_null else odd

    return {f"finite {f.name}": none(bad(f.name)) for f in df.schema.fields if isinstance(f.dataType, NUMERIC)}


def bound_rules(bounds: Mapping[str, tuple[float | None, float | None]]) -> Rules:
    """Values outside [low, high] per column; NULL is not outside."""

    def outside(c: str, low: float | None, high: float | None) -> Column:
        out = F.lit(False)
        if low is not None:
            out = out | (F.col(c) < low)
        if high is not None:
            out = out | (F.col(c) > high)
        return out

    return {f"{c} in [{lo}, {hi}]": none(outside(c, lo, hi)) for c, (lo, hi) in bounds.items()}


def loop_rule() -> Rules:
    return {"no self loops": none(F.col(SOURCE) == F.col(TARGET))}


def sum_rule(column: str, total: float = 1.0, tolerance: float = 1e-3) -> Rules:
    value = F.sum(column)
    return {f"sum of {column} is {total}": (F.abs(value - total) < tolerance, value)}


def not_empty(df: DataFrame) -> DataFrame:
    return check(df, rows_rule())


def has_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Schema check only; no job reads the data."""
    rows = [(f"has {c}", c in df.columns, float(c in df.columns)) for c in required]
    return df.sparkSession.createDataFrame(rows, "rule string, passed boolean, observed double")


def no_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return check(df, null_rules(columns))


def finite_numbers(df: DataFrame, *, allow_null: Sequence[str] | None = ()) -> DataFrame:
    return check(df, finite_rules(df, allow_null=allow_null))


def in_bounds(df: DataFrame, bounds: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    return check(df, bound_rules(bounds))


def no_self_loops(dyads: DataFrame) -> DataFrame:
    return check(dyads, loop_rule())


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key sets of both sides are equal: ``exceptAll`` of the distinct keys is empty both ways."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    differing = a.exceptAll(b).unionByName(b.exceptAll(a))
    n = F.count(F.lit(1))
    return check(differing, {f"same keys {', '.join(keys)}": (n == 0, n)})


def same_count(left: DataFrame, right: DataFrame, name: str = "same row count") -> DataFrame:
    other = right.agg(F.count(F.lit(1))).scalar()
    both = left.agg(F.count(F.lit(1)).alias("_l")).withColumn("_r", other)
    difference = F.col("_l") - F.col("_r")
    return both.select(
        F.lit(name).alias("rule"), (difference == 0).alias("passed"), difference.cast("double").alias("observed")
    )


def conserved(df: DataFrame, column: str, total: float = 1.0, tolerance: float = 1e-3) -> DataFrame:
    return check(df, sum_rule(column, total, tolerance))


def boolean_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    rows = [(f"{c} is boolean", isinstance(kinds.get(c), T.BooleanType), None) for c in columns]
    return df.sparkSession.createDataFrame(rows, "rule string, passed boolean, observed double")


def missing_history_kept(panel: DataFrame, lags: Mapping[str, int], entity: str, month: str) -> DataFrame:
    """The first k months of every entity have no lag-k value: history is not made up."""
    start = panel.agg(F.min(month)).scalar()
    aged = panel.withColumn("_age", F.months_between(month, start))

    def rule(c: str, k: int) -> tuple[Column, Column]:
        n = F.count_if((F.col("_age") < k) & F.col(c).isNotNull())
        return n == 0, n

    return check(aged, {f"{c} missing before month {k + 1}": rule(c, k) for c, k in lags.items()})


def joinable(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    shared = left.select(*keys).join(right.select(*keys), list(keys), "left_semi")
    n = F.count(F.lit(1))
    return check(shared, {f"joinable on {', '.join(keys)}": (n > 0, n)})


def stack_checks(*checks: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), checks)


def enforce(checks: DataFrame) -> None:
    """Raise with the failed rules, if any. A check table has one row per rule."""
    failed = checks.filter(~F.col("passed")).collect()
    if failed:
        raise ValueError("; ".join(f"{r['rule']} (observed {r['observed']})" for r in failed))
