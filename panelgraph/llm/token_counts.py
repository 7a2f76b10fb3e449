"""Token counts by a two-tier lookup on the map side.

Tier one is a small table of the token counts of the most frequent pieces, broadcast to every worker;
tier two is a cache in each worker that encodes what the table misses. No piece is ever shuffled: to
find the frequent ones, each task sends one bounded summary of its pieces, and summaries are merged
in two steps of one row per group. The table only saves work; counts are those of the library
whatever it holds.
"""

from __future__ import annotations

import heapq
import math
import pickle
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pieces
from .tables import whole

#: Entries of the broadcast table. With keys of at most 64 characters it stays below 20 MB.
FREQUENT = 1 << 15


def _top(counts: Counter, most: int) -> list[tuple[str, int]]:
    """The most frequent pieces, ties by piece."""
    return heapq.nsmallest(most, counts.items(), key=lambda x: (-x[1], x[0]))


def frequent_pieces(docs: DataFrame, most: int = FREQUENT) -> list[str]:
    """Pieces that are frequent over all texts (text column), at most ``most``.

    A task keeps at most 8 x ``most`` counters: when more pile up, the rarer half goes.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(text.split(" ") if text else ())
                if len(counts) > 8 * most:
                    counts = Counter(dict(_top(counts, 4 * most)))
        best = [(p, n) for p, n in _top(counts, most) if n > 1 and len(p) <= pieces.LONGEST_PIECE]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(best)], pa.binary())], ["summary"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                for p, n in pickle.loads(blob):
                    counts[p] += n
                if len(counts) > 8 * most:
                    counts = Counter(dict(_top(counts, 4 * most)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(_top(counts, most))], pa.binary())], ["summary"])

    texts = docs.select(whole("text").alias("text"))
    groups = max(1, math.isqrt(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    summaries = texts.mapInArrow(summarise, "summary binary")
    merged = summaries.repartition(groups).mapInArrow(merge, "summary binary").repartition(1).mapInArrow(merge, "summary binary")
    rows = merged.collect()  # one row, bounded by ``most``
    return [p for row in rows for p, _ in pickle.loads(bytes(row["summary"]))]


def count_tokens(docs: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",), limit: int = 4096) -> DataFrame:
    """keep columns, n_bytes (UTF-8), n_tokens, over_limit for every document.

    docs: text and what ``keep`` names; others are ignored. ``model`` is a sentencepiece file at the same
    place on all machines. Null texts count as empty: no bytes, no tokens. Repeated rows are counted
    each; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    found = frequent_pieces(docs)
    lengths = pieces.LengthCache(model, {}).lengths(found)
    table = spark.sparkContext.broadcast({p: n for p, n in zip(found, lengths, strict=True) if n is not None})
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = pieces.length_cache(model, name, lambda: table.value)
        for batch in batches:
            counts = [n for texts in pieces.groups(batch.column(len(keep)).to_pylist()) for n in cache.count(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(counts, pa.int64()), batch.column(len(keep) + 1)], [*keep, "n_tokens", "n_bytes"])

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("n_tokens", T.LongType()), T.StructField("n_bytes", T.LongType())])
    counted = docs.select(*keep, F.col("text").alias("__text"), F.octet_length(whole("text")).cast("long").alias("__bytes")).mapInArrow(run, schema)
    return counted.select(*keep, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
