"""Keep-first deduplication with late materialisation."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of the order fields that fit a fixed-width key.
BITS = {T.BooleanType: 8, T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.DateType: 32, T.LongType: 64, T.TimestampType: 64, T.TimestampNTZType: 64}
WORD = 2**62
MOST = 10**38


def fixed_width(order: Column, kind: T.DataType) -> Column | None:
    """``order`` (a struct of numbers, dates and times, or one of them) as one number that compares like it, nulls first.

    None where a field is none of these or all of them don't fit 38 digits: seconds as ``decimal(12,0)`` take less room than times.

    A minimum over a number of fixed width is kept in place by a hash aggregate; over a string or a struct it needs a sort.
    """
    fields = [(order[f.name], f.dataType) for f in kind.fields] if isinstance(kind, T.StructType) else [(order, kind)]
    words: list[tuple[Column, int]] = []
    total = 1
    for c, t in fields:
        if isinstance(t, T.DecimalType) and t.scale == 0 and t.precision <= 18:
            half = 10**t.precision
        elif type(t) in BITS:
            half = 2 ** (BITS[type(t)] - 1)
        else:
            return None
        size = 2 * half + 1
        total *= size
        if isinstance(t, T.DateType):
            c = F.unix_date(c)
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.unix_micros(c.cast("timestamp"))
        exact = "long" if half < WORD else "decimal(20,0)"
        value = F.coalesce(c.cast(exact) + F.lit(Decimal(half + 1)).cast(exact), F.lit(0).cast(exact))
        if words and words[-1][1] * size < WORD:
            words[-1] = (words[-1][0] * F.lit(size).cast("long") + value, words[-1][1] * size)
        else:
            words.append((value, size))
    if total >= MOST:
        return None
    if len(words) == 1:
        return words[0][0]
    out = words[0][0].cast("decimal(38,0)")
    for value, size in words[1:]:
        out = (out * F.lit(Decimal(size)).cast("decimal(20,0)") + value.cast("decimal(20,0)")).cast("decimal(38,0)")
    return out


def keep_first(df: DataFrame, keys: Sequence[str | Column], order: Column, *then: Sequence[str | Column]) -> DataFrame:
    """The first row by ``order`` of every key; of those the first of every key in ``then``, and so on. Nulls are a key.

    Keys and order alone are aggregated; each task reduces its own copies before the shuffle, so a key with a third of all
    rows is no burden. The rows, with whatever long columns they have, are only then met by an equi join on key and order. Rows of
    one key that tie in ``order`` are told apart arbitrarily, so ``order`` should tell apart rows that differ.

    ``df`` is evaluated twice, the first time for keys and order only, so it must give the same rows both times.
    """
    lists = [[F.col(k) if isinstance(k, str) else k for k in ks] for ks in (keys, *then)]
    names = [[f"__key{i}_{j}" for j in range(len(ks))] for i, ks in enumerate(lists)]
    packed = fixed_width(order, df.select(order.alias("o")).schema["o"].dataType)
    marks = {n: c for ns, ks in zip(names, lists, strict=True) for n, c in zip(ns, ks, strict=True)}
    marked = df.withColumns(marks | {"__order": order if packed is None else packed})
    narrow = marked.select(*marks, "__order")
    for ns in names:
        first = narrow.groupBy(*ns).agg(F.min("__order").alias("__order"))
        narrow = first if ns is names[-1] and len(names) == 1 else _meet(narrow, first, ns)
    out = _meet(marked, narrow.select(*names[0], "__order").distinct() if then else narrow, names[0])
    for ns in names:
        place = F.row_number().over(Window.partitionBy(*ns).orderBy("__order"))
        out = out.withColumn("__place", place).where("__place = 1").drop("__place")
    return out.select(*[F.col(f"`{c}`") for c in df.columns])


def _meet(rows: DataFrame, first: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose key and order stand in ``first``. The order is part of the join's key, so no key is hot."""
    there = first.select(*[F.col(c).alias(f"__first_{c}") for c in (*keys, "__order")])
    same = F.lit(True)
    for c in (*keys, "__order"):
        same = same & F.col(c).eqNullSafe(F.col(f"__first_{c}"))
    return rows.join(there, same, "left_semi")
