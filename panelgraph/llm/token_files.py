"""Token ids in files of directly addressable codes.

A block holds the ids of consecutive documents. Each id is cut into chunks of ``CHUNK`` bits, lowest
first. Level 0 has the first chunk of every id, level k the chunk k of those that need it; a bit per
entry tells whether the id goes on, and a directory counts the set bits before every ``RANK`` entries.
The id at place i is read by following its bits: one chunk and one rank per level, no block is decoded.

Files are Parquet, one row a block, so Spark's committer keeps half-written parts out, and blocks are
bounded: one closes with the document that fills it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pieces
from .tables import Tables, whole

CHUNK, RANK = 8, 512
#: Ids after which a block closes.
BLOCK_IDS = 1 << 18
_HEAD = "<4sII"  # mark, ids, levels


class Codes:
    """Directly addressable codes of one block."""

    def __init__(self, blob: bytes):
        mark, self.size, levels = struct.unpack_from(_HEAD, blob)
        if mark != b"DAC1":
            raise ValueError("not a block of directly addressable codes")
        at, n, self.levels = struct.calcsize(_HEAD), self.size, []
        for _ in range(levels):
            chunks = np.frombuffer(blob, np.uint8, n, at)
            at += n
            bits = np.frombuffer(blob, np.uint8, -(-n // 8), at)
            at += len(bits)
            ranks = np.frombuffer(blob, "<u4", -(-n // RANK), at)
            at += 4 * len(ranks)
            self.levels.append((chunks, bits, ranks))
            n = int(np.unpackbits(bits, count=n, bitorder="little").sum()) if n else 0

    @staticmethod
    def pack(ids: np.ndarray) -> bytes:
        rest, parts, levels = ids.astype("<u4"), [], 0
        while levels == 0 or len(rest):
            more = (rest >> CHUNK) > 0
            before = np.concatenate(([0], np.cumsum(more)))[: len(rest) : RANK]
            parts += [(rest & ((1 << CHUNK) - 1)).astype(np.uint8).tobytes(), np.packbits(more, bitorder="little").tobytes(), before.astype("<u4").tobytes()]
            rest, levels = rest[more] >> CHUNK, levels + 1
        return struct.pack(_HEAD, b"DAC1", len(ids), levels) + b"".join(parts)

    def __getitem__(self, i: int) -> int:
        """The id at place i, by one rank per level."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        out, shift = 0, 0
        for chunks, bits, ranks in self.levels:
            out |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            first = i // RANK * RANK
            i = int(ranks[i // RANK]) + int(np.unpackbits(bits[first >> 3 : (i >> 3) + 1], count=i - first, bitorder="little").sum())
            shift += CHUNK
        return out

    def all(self) -> np.ndarray:
        """Every id, level by level from the last."""
        out = None
        for chunks, bits, _ in reversed(self.levels):
            here = chunks.astype("<u4")
            if out is not None and len(out):
                here[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)] |= out << np.uint32(CHUNK)
            out = here
        return out


BLOCK = "part int, block int, n_ids long, codes binary, documents array<struct<doc_id: bigint, n_tokens: bigint>>"


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, tables: Tables, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Blocks of the ids of all whole texts in ascending doc_id order, as written and read back.

    docs: doc_id, text; others are ignored. ``tokenizer`` is a tokenizers file at the same place on all
    machines. A null text is an empty one: its ids are ``end_id`` alone, which ends every document.
    Null ids come first; rows with the same id stand by text. An empty table gives no block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, end = pieces.id_cache(tokenizer), np.array([end_id], "<u4").tobytes()
        block, ids, held, places, part = 0, [], 0, [], None

        def close():
            blob = Codes.pack(np.frombuffer(b"".join(ids), "<u4"))
            row = [{"part": part, "block": block, "n_ids": held, "codes": blob, "documents": places}]
            return pa.RecordBatch.from_pylist(row, schema=arrow)

        for batch in batches:
            if part is None and batch.num_rows:
                part = batch.column(2)[0].as_py()
            doc_ids, at = batch.column(0).to_pylist(), 0
            for texts in pieces.groups(batch.column(1).to_pylist()):
                for code in cache.encode(texts):
                    ids.append(code + end)
                    n = len(ids[-1]) // 4
                    places.append({"doc_id": doc_ids[at], "n_tokens": n})
                    held, at = held + n, at + 1
                    if held >= block_ids:
                        yield close()
                        block, ids, held, places = block + 1, [], 0, []
        if places:
            yield close()

    arrow = pa.schema([
        ("part", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int64()), ("codes", pa.binary()),
        ("documents", pa.list_(pa.struct([("doc_id", pa.int64()), ("n_tokens", pa.int64())]))),
    ])
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text"))
        .repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    )
    return tables.write("blocks", ordered.withColumn("part", F.spark_partition_id()).mapInArrow(run, BLOCK))


def starts(blocks: DataFrame) -> DataFrame:
    """part, block, first: the ids before each block. The window is over one row per block."""
    order = W.orderBy("part", "block").rowsBetween(W.unboundedPreceding, -1)
    return blocks.select("part", "block", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("first"))


def part_starts(blocks: DataFrame) -> DataFrame:
    """part, first: the ids before each part. One row per part, so the window is over few rows."""
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    return totals.select("part", F.coalesce(F.sum("n_ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"))


def read_documents(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids = Codes(batch.column(1)[row].as_py()).all().tobytes()
                found, at = [], 0
                start = batch.column(0)[row].as_py()
                for doc in batch.column(2)[row].as_py():
                    n = doc["n_tokens"]
                    found.append((doc["doc_id"], start + at, n, zlib.crc32(memoryview(ids)[4 * at : 4 * (at + n)])))
                    at += n
                columns = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])

    in_part = W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    local = blocks.select("part", "block", F.coalesce(F.sum("n_ids").over(in_part), F.lit(0)).alias("inside"))
    first = local.join(part_starts(blocks), "part").select("part", "block", (F.col("first") + F.col("inside")).alias("start"))
    placed = blocks.join(first, ["part", "block"]).select("start", "codes", "documents")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_places(blocks: DataFrame, places: DataFrame, cell: int = BLOCK_IDS) -> DataFrame:
    """place, id for the global token places asked for, by random access; places past the end give no row.

    A block meets the places of its cells of ``cell`` ids in an equi join, so no range is scanned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                codes, start = Codes(batch.column(1)[row].as_py()), batch.column(0)[row].as_py()
                wanted = batch.column(2)[row].as_py()
                found = [codes[p - start] for p in wanted]
                yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.int64()), pa.array(found, pa.int64())], ["place", "id"])

    at = blocks.join(starts(blocks), ["part", "block"]).select("part", "block", "first", "n_ids", F.explode(
        F.sequence(F.expr(f"first div {cell}"), F.expr(f"(first + n_ids - 1) div {cell}"))
    ).alias("cell"))
    asked = places.select(F.col("place").cast("long").alias("place"), F.expr(f"place div {cell}").alias("cell"))
    met = asked.join(at, "cell").where((F.col("place") >= F.col("first")) & (F.col("place") < F.col("first") + F.col("n_ids")))
    # many askings of one block are dealt in runs of places, each with its own copy of the codes
    runs = met.groupBy("part", "block", "first", F.expr("(place - first) div 65536").alias("run")).agg(F.collect_set("place").alias("wanted"))
    return runs.join(blocks.select("part", "block", "codes"), ["part", "block"]).select("first", "codes", "wanted").mapInArrow(run, "place long, id long")
