"""Document fingerprints as bottom-k sketches of shingle hashes.

A sketch holds the ``K`` smallest different 64-bit hashes of a text's 5-word shingles. The sketch of a
union is the K smallest of the sketches' union, so sketches of parts merge into that of the whole. Of
two sketches, the K smallest hashes of their union are a random sample of all shingles of both: the
share that both hold estimates the resemblance, from which containment follows with the sizes. The
K-th smallest hash tells the number of different shingles. Below K everything is exact.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import whole

K, WIDTH = 128, 5


def shingle_hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Hashes of a text's shingles; fewer words than ``width``: one shingle; none: empty."""
    words = (text or "").encode().split()
    if not words:
        return np.empty(0, "<u8")
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    digest = xxhash.xxh3_64_digest
    return np.frombuffer(b"".join([digest(s) for s in shingles]), ">u8").astype("<u8")


def smallest(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest different hashes, sorted."""
    if len(hashes) > 8 * k:  # the k smallest stand among these unless too many are equal
        near = np.unique(np.partition(hashes, 4 * k)[: 4 * k])
        if len(near) >= k:
            return near[:k]
    return np.unique(hashes)[:k]


def sketch(text: str | None, k: int = K, width: int = WIDTH) -> np.ndarray:
    """Sorted smallest hashes of a text's shingles; fewer words than ``width``: one shingle; none: empty."""
    return smallest(shingle_hashes(text, width), k)


def merge(*sketches: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of the union of the sets behind ``sketches``."""
    return np.unique(np.concatenate(sketches))[:k] if sketches else np.empty(0, "<u8")


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; two empty sets are alike, an empty and another one are not."""
    both = merge(a, b, k=k)
    if not len(both):
        return 1.0
    return len(np.intersect1d(np.intersect1d(a, b, assume_unique=True), both, assume_unique=True)) / len(both)


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of different shingles."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**64 / (float(a[k - 1]) + 1.0)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has, 1 for an empty a."""
    n = distinct(a, k)
    if not n:
        return 1.0
    r = resemblance(a, b, k)
    return min(1.0, r * (n + distinct(b, k)) / (1 + r) / n)


def encode(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def decode(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8")


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns and fingerprint (string) of every text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [encode(sketch(t)) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, pa.string())], [*keep, "fingerprint"])

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("fingerprint", T.StringType())])
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def merged(prints: DataFrame, group: str, most_groups: int = 10_000) -> DataFrame:
    """group (string), fingerprint: one sketch per group of rows, merged in tasks first.

    A group sends a row per task (or per ``most_groups`` other groups met there) and no more, so a group
    with a third of all rows is no burden.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, np.ndarray] = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(map(encode, held.values()), pa.string())], ["group", "fingerprint"])

        for batch in batches:
            for g, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[g] = merge(held[g], decode(f)) if g in held else decode(f)
                if len(held) >= most_groups:
                    yield out()
                    held = {}
        if held:
            yield out()

    def final(table: pa.Table) -> pa.Table:
        all_of_it = merge(*map(decode, table.column("fingerprint").to_pylist()))
        return pa.table({"group": table.column("group")[:1], "fingerprint": pa.array([encode(all_of_it)], pa.string())})

    schema = "group string, fingerprint string"
    parts = prints.select(F.col(group).cast("string").alias("group"), "fingerprint").mapInArrow(partial, schema)
    return parts.groupBy("group").applyInArrow(final, schema)


def _bucket(place: Column, bounds: list[int]) -> Column:
    """Number of ``bounds`` (sorted) that are above ``place``, by a coarse and a fine look-up."""
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    rows = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    lists = F.array(*[F.array(*[F.lit(b).cast("long") for b in row]) for row in rows])
    heads = F.array(*[F.lit(row[0]).cast("long") for row in rows])
    at = F.size(F.filter(heads, lambda b: b <= place))  # rows that begin at or below
    inside = F.when(at > 0, F.size(F.filter(F.element_at(lists, F.greatest(at, F.lit(1))), lambda b: b <= place))).otherwise(0)
    return F.lit(len(bounds)) - F.when(at > 0, (at - 1) * step + inside).otherwise(0)


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def against_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last third comes from the next document.

    docs: doc_id, text; others are ignored. Documents stand by descending doc_id (null last, equal ids by
    text); the last is followed by the first. The last floor(n / 3) code points give way to as many
    first ones of the next document, or to all it has. Null texts count as empty, repeated rows are
    documents of their own, an only document follows itself, an empty table gives an empty result.

    Texts are shuffled once: ids are cut into ranges, and the first document of a range is also sent to
    the range before, whose last document it follows.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    shares = [i / (4 * n) for i in range(1, 4 * n)]
    cuts = docs.select(place.alias("place")).agg(F.percentile_approx("place", shares, 10_000)).first()[0]
    bucket = _bucket(F.col("place"), sorted(set(cuts or [])))
    ids = docs.select(place.alias("place")).withColumn("bucket", bucket)
    firsts = sorted((r["bucket"], r["first"]) for r in ids.groupBy("bucket").agg(F.max("place").alias("first")).collect())  # 4 n rows at most
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}
    sent = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else F.create_map(F.lit(0), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), place.alias("place"), whole("text").alias("text")).withColumn("bucket", bucket)
    also = F.try_element_at(sent, F.col("place"))
    targets = F.filter(
        F.array(F.struct(F.col("bucket"), F.lit(0).alias("after")), F.struct(also.alias("bucket"), F.lit(1).alias("after"))),
        lambda t: t["bucket"].isNotNull(),
    )
    dealt = rows.select("doc_id", "place", "text", F.explode(targets).alias("t")).select("t.bucket", "t.after", "doc_id", "place", "text")
    ordered = dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "after", F.desc("place"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in EDITED.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        held, within = None, None

        def row(doc_id, text, own, following, theirs):
            cut = len(text) // 3
            edited = text[: len(text) - cut] + following[:cut]
            other = sketch(edited)
            return (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), encode(own), encode(other), resemblance(own, other), resemblance(own, theirs))

        for batch in batches:
            out = []
            for b, after, doc_id, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if b != within:
                    held, within = None, b
                if after and held is None:
                    continue  # the range's last document has met its successor
                own = sketch(text)
                if held is not None:
                    out.append(row(*held, text, own))
                held = None if after else (doc_id, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return ordered.mapInArrow(run, EDITED)
