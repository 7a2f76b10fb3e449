"""Best-fit packing of documents into sequences of bounded length, by one successor sweep over lengths.

Which documents of a length share a sequence is all the same, so a plan needs their number only. Lengths are
counted (at most ``capacity`` rows). The sweep goes from the longest to the shortest; the successor of a length
among the open gaps, the smallest that holds it, takes as many of its documents as go in, for all sequences with
that gap at once, and new sequences open once no gap is left. This is best fit by decreasing length. A range of
the plan says where the documents of a length from one rank on go; a document finds its place by its rank.
Ranks are counted inside a length and a salt, and a length has the more salts the more documents it has.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pieces
from .tables import Tables

#: Tokens of a sequence; documents of a length that are ranked together, about.
CAPACITY, TOGETHER = 4096, 4096


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, piece, start, length, ids_crc32: the ids of each text and ``end_id``, cut at ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, end = pieces.id_cache(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows, found = [], []
            at = 0
            for texts in pieces.groups(batch.column(len(keep)).to_pylist()):
                for code in cache.encode(texts):
                    view = memoryview(code + end)
                    for k, start in enumerate(range(0, len(view), 4 * capacity)):
                        one = view[start : start + 4 * capacity]
                        rows.append(at)
                        found.append((k, start // 4, len(one) // 4, zlib.crc32(one)))
                    at += 1
            if rows:
                k, start, length, crc = zip(*found, strict=True)
                kept = [c.take(pa.array(rows)) for c in batch.columns[: len(keep)]]
                new = [pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays([*kept, *new], [*keep, "piece", "start", "length", "ids_crc32"])

    schema = T.StructType([docs.schema[c] for c in keep] + [
        T.StructField("piece", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]
    ])
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def sweep(numbers: Iterable[tuple[int, int]], capacity: int = CAPACITY) -> Iterator[tuple[int, list[dict]]]:
    """length and ranges of its documents, for (length, number of documents), in falling order of length.

    Of a range, sequences from ``seq`` on take ``each`` documents, the first of them at ``offset``; it begins with the
    document of rank ``first`` and ends where the next begins. A length ends or a gap's sequences are used up
    at each step, so the ranges are bounded by ``capacity``, however many documents there are.
    """
    gaps: list[int] = []
    open_: dict[int, list[tuple[int, int]]] = {}  # gap: sequences with that gap, as first and number
    made = 0

    def leave(gap: int, seq: int, n: int) -> None:
        if gap and n:
            if gap not in open_:
                insort(gaps, gap)
            open_.setdefault(gap, []).append((seq, n))

    for length, number in sorted(numbers, reverse=True):
        first, ranges = 0, []
        while first < number:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                gap, seq, n = capacity, made, -(-(number - first) // (capacity // length))
                made += n
            else:
                gap = gaps[at]
                seq, n = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap], gaps[at]
            each = gap // length
            full = min(n, (number - first) // each)
            for take, some in ((each, full), (number - first - each * full, 1)):
                if n and take and some:
                    ranges.append({"first": first, "each": take, "seq": seq, "offset": capacity - gap})
                    leave(gap - take * length, seq, some)
                    first, seq, n = first + take * some, seq + some, n - some
            leave(gap, seq, n)
        yield length, ranges


PLAN = "length long, salts long, ranges array<struct<first: bigint, each: bigint, seq: bigint, offset: bigint>>"


def best_fit(tables: Tables, items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """items plus sequence_id and offset, by best fit in falling order of length; items: item (unique), length (1 to ``capacity``).

    The numbers of documents by length, at most ``capacity`` rows, are swept in one task; no more than that ever meets
    there, and nothing of it reaches the driver. All else is two passes over the items.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = dict(pair for batch in batches for pair in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        rows = [{"length": n, "salts": 1 + numbers[n] // TOGETHER, "ranges": ranges} for n, ranges in sweep(numbers.items(), capacity)]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("length", pa.int64()), ("salts", pa.int64()), (
                "ranges", pa.list_(pa.struct([(c, pa.int64()) for c in ("first", "each", "seq", "offset")]))
            )]))

    counts = items.groupBy(F.col("length").cast("long").alias("length")).agg(F.count("*").alias("n"))
    plan = tables.write("plan", counts.coalesce(1).mapInArrow(run, PLAN))
    salted = items.join(plan.select("length", "salts"), "length").withColumn("salt", F.pmod(F.xxhash64("item"), F.col("salts"))).drop("salts")
    earlier = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    bases = tables.write("bases", salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select(
        "length", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")
    ))
    inside = F.row_number().over(W.partitionBy("length", "salt").orderBy("item")) - 1
    ranked = salted.withColumn("inside", inside).join(bases, ["length", "salt"]).withColumn("nth", F.col("inside") + F.col("base"))
    placed = ranked.join(plan.select("length", "ranges"), "length").withColumn("range", F.expr("element_at(filter(ranges, r -> r.first <= nth), -1)"))
    within = F.col("nth") - F.col("range.first")
    return placed.select(
        *items.columns, F.expr("range.seq + (nth - range.first) div range.each").alias("sequence_id"),
        (F.col("range.offset") + within % F.col("range.each") * F.col("length")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, piece, start, length, ids_crc32, sequence_id, offset for every piece of every text.

    docs: text and what ``keep`` names; others are ignored. Null texts count as empty, a piece of
    ``end_id`` alone. Only texts longer than ``capacity`` ids are cut. Repeated rows are packed each;
    an empty table gives an empty result.
    """
    tables = Tables(docs.sparkSession, "pack")
    found = tables.write("pieces", token_pieces(docs, tokenizer, end_id, capacity, keep).withColumn("item", F.monotonically_increasing_id()))
    return best_fit(tables, found, capacity).select(*keep, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
