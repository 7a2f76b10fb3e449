"""SimHash near-duplicates through an inverted index of byte positions.

A 64-bit fingerprint is eight positional bytes. Fingerprints that differ in at most 3 bits differ in at
most 3 bytes, so they share at least 5 of them. The index is kept on four positions at a time: the 14
sets {a, b, c, d} with a xor b xor c xor d = 0 are such that every five positions contain exactly one
of them, so a pair with five shared bytes meets once, in lists 2^24 times shorter than those of one
byte. For each pair that meets, the shared positional bytes are tallied, pairs below five are dropped,
and the rest is verified bit by bit.

Copies are one fingerprint, so lists hold different fingerprints only. A list longer than ``LONG`` is
split by a fifth position; if that is still too long, its members (five bytes equal, 24 bits free) are
linked exactly without pairs: two of them differ in at most 3 bits if, and only if, they agree once some
3 of the 24 bits are masked, so each masked value links its members to its smallest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sketches
from .components import connected
from .tables import Tables, whole

BITS_APART, SHARED_BYTES, LONG = 3, 5, 1000
BLOCKS = [c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]


def simhash(text: str | None, width: int = 3) -> int:
    """Signed 64-bit fingerprint of the ``width``-word shingles (repeats count) of a lower-cased text.

    XXH64 with seed 42 of each space-joined shingle; a bit is set if it is in over half of them.
    Fewer words: the whole sequence is the one shingle. No word: 0.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(s, 42) for s in shingles]), np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), width: int = 3) -> DataFrame:
    """keep columns and fingerprint (signed long); null texts count as empty."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("fingerprint", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array([simhash(t, width) for t in batch.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], prints], [*keep, "fingerprint"])

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def _mask(positions: tuple[int, ...]) -> int:
    """Signed 64-bit mask of whole bytes, position 0 the lowest."""
    return int.from_bytes(bytes(255 if i in positions else 0 for i in range(8)), "little", signed=True)


def shared_bytes(x: Column) -> Column:
    """Equal positional bytes of two fingerprints, given their xor."""
    return sum(((F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(255).cast("long")) == 0).cast("int") for i in range(8)), F.lit(0))


def _lists(prints: DataFrame, positions: list[tuple[int, ...]]) -> DataFrame:
    masks = [F.struct(F.lit(k).alias("list"), F.col("fp").bitwiseAND(F.lit(_mask(p)).cast("long")).alias("bytes")) for k, p in enumerate(positions)]
    return prints.select("fp", F.explode(F.array(*masks)).alias("m")).select("fp", "m.*")


def _paired(lists: DataFrame, keys: list[str]) -> DataFrame:
    a, b = lists.select(*keys, F.col("fp").alias("u")), lists.select(*keys, F.col("fp").alias("v"))
    x = F.col("u").bitwiseXOR(F.col("v"))
    close = (F.col("u") < F.col("v")) & (shared_bytes(x) >= SHARED_BYTES) & (F.bit_count(x) <= BITS_APART)
    return a.join(b, keys).where(close).select("u", "v")


def links(tables: Tables, prints: DataFrame, long: int = LONG) -> DataFrame:
    """u, v: links that join exactly the fingerprints (column fp, all different) that 3 bits or fewer part.

    Short lists give all their close pairs; long ones may give other links of the same components.
    """
    entries = _lists(prints, BLOCKS)
    sizes = tables.write("sizes", entries.groupBy("list", "bytes").agg(F.count("*").alias("n")).where("n > 1"))
    met = tables.write("met", entries.join(sizes, ["list", "bytes"]))
    found = [_paired(met.where(F.col("n") <= long), ["list", "bytes"])]
    if sizes.where(F.col("n") > long).limit(1).count():
        fifth = [(*b, p) for b in BLOCKS for p in range(8) if p not in b]
        deeper = met.where(F.col("n") > long).select("fp", F.explode(F.array(*[
            F.struct(F.lit(k).alias("five"), F.col("fp").bitwiseAND(F.lit(_mask(p)).cast("long")).alias("key"), F.lit(BLOCKS.index(p[:4])).alias("of"))
            for k, p in enumerate(fifth)
        ])).alias("m"), "list").where("m.of = list").select("fp", "m.five", "m.key")
        counted = tables.write("deeper", deeper.join(deeper.groupBy("five", "key").agg(F.count("*").alias("n")).where("n > 1"), ["five", "key"]))
        found.append(_paired(counted.where(F.col("n") <= long), ["five", "key"]))
        free = F.element_at(F.array(*[F.array(*[F.lit(8 * p + i) for p in range(8) if p not in five for i in range(8)]) for five in fifth]), F.col("five") + 1)
        picks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i, j, k in combinations(range(24), BITS_APART)])
        one = lambda b: F.expr(f"shiftleft(1L, get(free, pick.{b}))")
        hidden = counted.where(F.col("n") > long).withColumn("free", free).withColumn("pick", F.explode(picks)).withColumn(
            "rest", F.col("fp").bitwiseAND(F.bitwise_not(one("i").bitwiseOR(one("j")).bitwiseOR(one("k"))))
        )
        firsts = hidden.groupBy("five", "pick", "rest").agg(F.min("fp").alias("v"), F.count("*").alias("members")).where("members > 1")
        found.append(hidden.join(firsts.drop("members"), ["five", "pick", "rest"]).where("fp <> v").select(F.col("fp").alias("u"), "v"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def near_duplicates(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), width: int = 3) -> DataFrame:
    """keep columns, fingerprint (signed long) and component_id for every document.

    docs: doc_id, text and what ``keep`` names; others are ignored. Null and empty texts have
    fingerprint 0 and are linked like any other. component_id is the smallest doc_id that links
    reach (null only if all of them are null); repeated rows are kept, each with its component. An
    empty table gives an empty result.
    """
    tables = Tables(docs.sparkSession, "simhash")
    prints = tables.write("prints", fingerprints(docs, tuple(dict.fromkeys((*keep, "doc_id"))), width))
    different = tables.write("different", prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("first")))
    roots = connected(tables, links(tables, different.select("fp")))
    lowest = different.join(roots, F.col("fp") == F.col("node"))
    named = lowest.select("fp", "root").join(lowest.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    classes = tables.write("classes", different.join(named.withColumnRenamed("fp", "l_fp"), F.col("fp") == F.col("l_fp"), "left").select(
        "fp", F.coalesce("component_id", "first").alias("component_id")
    ))
    tables.drop("sizes", "met", "deeper", "stars", "different")
    return prints.join(classes, prints["fingerprint"] == classes["fp"]).select(*keep, "fingerprint", "component_id")


#: Near copies: signatures, the least resemblance of 5-word shingles, and the least estimate with which a pair is read.
#: The estimate's standard error is 0.035 at 0.8, so 0.65 is more than 4 of them below. Each of a signature's eight
#: bytes is that of a MinHash, equal with probability 0.8 or more at 0.8, whatever was edited and wherever: fewer than
#: ``SHARED_BYTES`` agree in 5.6 % of signatures, in all four of them for 1 pair in 100,000.
SEEDS, ALIKE, READ = 4, 0.8, 0.65
TURNS = [np.uint64(xxhash.xxh64_intdigest(bytes([i]), 42) | 1) for i in range(8 * SEEDS)]


def signatures(hashes: np.ndarray, seeds: int = SEEDS) -> list[int]:
    """Signed 64-bit signatures of a text's shingle hashes: bytes of MinHashes; all 0 without shingles."""
    if not len(hashes):
        return [0] * seeds
    least = np.array([(hashes * turn).min() for turn in TURNS[: 8 * seeds]], "<u8")
    return (least & np.uint64(255)).astype(np.uint8).view("<i8").tolist()


#: Words of a text's parities; with 512 bits they tell texts of up to about 600 shingles apart.
PARITIES = [f"parity{i}" for i in range(8)]


def parities(hashes: np.ndarray) -> list[int]:
    """For each of 512 slots whether an odd number of the different hashes falls there, as signed 64-bit words."""
    odd = np.bincount((hashes & np.uint64(511)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8").tolist()


def _shingles(text: str) -> set[bytes]:
    """Different shingles that ``sketches.sketch`` hashes."""
    words, width = text.encode().split(), sketches.WIDTH
    return set(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))) if len(words) >= width else {b" ".join(words)} - {b""}


def _alike(tables: Tables, name: str, pairs: DataFrame, prints: DataFrame, docs: DataFrame, alike: float) -> DataFrame:
    """u, v: those of the pairs (a, b) of nodes whose shingles are exactly ``alike`` or more; sketches only spare reading."""
    # the nodes are tables, so their true size tells Spark whether all sketches and texts must move to meet them
    ends = tables.write("ends", pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    held = tables.write("held", prints.select("node", "sketch").join(ends, "node", "left_semi").dropDuplicates(["node"]))
    both = pairs.join(held.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a").join(held.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")

    def worth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                i for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))
                if sketches.resemblance(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) >= min(READ, alike)
            ]
            yield pa.RecordBatch.from_arrays([c.take(pa.array(rows, pa.int64())) for c in batch.columns[:2]], ["a", "b"])

    read = tables.write("read", both.select("a", "b", "sa", "sb").mapInArrow(worth, "a long, b long"))
    ends = tables.write("ends", read.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    texts = tables.write("texts", docs.select(F.xxhash64(whole("text")).alias("node"), whole("text").alias("text")).join(ends, "node", "left_semi").dropDuplicates(["node"]))
    pair = read.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, set()
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                x, y = batch.column(3)[i].as_py(), _shingles(batch.column(2)[i].as_py())
                if x != last:
                    last, left = x, _shingles(x)
                shared = len(left & y)
                if not left and not y or shared >= alike * (len(left) + len(y) - shared):
                    rows.append(i)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(rows, pa.int64())) for c in batch.columns[:2]], ["u", "v"])

    return tables.write(name, pair.select("a", "b", "ta", "tb").mapInArrow(verify, "u long, v long"))


def _possible(u: str, v: str, n_u: str, n_v: str, alike: float) -> Column:
    """Signatures share enough bytes, and the numbers of different shingles allow the resemblance."""
    near = F.least(n_u, n_v) >= F.lit(alike - 1e-9) * F.greatest(n_u, n_v)
    return (shared_bytes(F.col(u).bitwiseXOR(F.col(v))) >= SHARED_BYTES) & near


def _allowed(tables: Tables, members: DataFrame, nodes: DataFrame, docs: DataFrame, alike: float) -> DataFrame:
    """a, b: pairs of members (node, root; of ``nodes``, which have parities) of different roots that can be ``alike``, among them all that are: a prefix filter.

    Each text's different shingles are put in one order, those of the fewest members first. Texts that share ``o`` shingles
    share the first of these at a place with at least ``o`` to go in both, and ``alike`` asks for at least
    ``alike`` / (1 + ``alike``) of both sizes. So the rarest fifth of the larger text and the rarest ninth of the smaller meet there
    (at 0.8), and members of a large group that differ by more than that from all others meet none of them.

    Copies of one lost original pass that: each has few shingles of its own, and then the original's. So those that meet are told apart
    by parities: a shingle that only one of two texts has turns one bit, so at least as many as there are different bits are not shared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a text without shingles has one of its own
            hashes = [np.unique(h) if len(h) else np.zeros(1, "<u8") for h in map(sketches.shingle_hashes, batch.column(1).to_pylist())]
            sizes = np.array([len(h) for h in hashes], np.int64)
            node = batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            yield pa.RecordBatch.from_arrays([node, pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate([*hashes, []], dtype="<u8", casting="unsafe").view("<i8"))], ["node", "n", "shingle"])

    # a table of nodes alone, so texts move to meet them only if these, and nothing beside them, are too many to send
    alone = tables.write("alone", members.select("node"))
    own = docs.select(F.xxhash64(whole("text")).alias("node"), whole("text").alias("text")).join(alone, "node", "left_semi")
    shingles = tables.write("shingles", own.dropDuplicates(["node"]).mapInArrow(run, "node long, n long, shingle long"))
    held = shingles.groupBy("shingle").agg(F.count("*").alias("held")).where("held > 1")
    mine = W.partitionBy("node")
    rank = F.row_number().over(mine.orderBy("held", "shingle")) - 1
    least = lambda share, n: F.ceil(F.lit(share) * n - 1e-6)
    n = F.col("n")
    placed = shingles.join(held, "shingle").withColumn("at", n - F.count("*").over(mine) + rank).where(F.col("at") <= n - least(alike, n))
    rare = tables.write("rare", placed.join(members, "node").join(nodes.select("node", *PARITIES), "node").select("node", "root", *PARITIES, "n", "shingle", "at", (F.col("at") <= n - least(2 * alike / (1 + alike), n)).alias("rarest")))
    side = lambda x: rare.select("shingle", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "root", *PARITIES, "n", "at", "rarest")])
    larger = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("node_a") > F.col("node_b")))
    to_go = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    both = F.col("n_a") + F.col("n_b")
    needed = least(alike / (1 + alike), both)
    apart = sum((F.bit_count(F.col(f"{p}_a").bitwiseXOR(F.col(f"{p}_b"))) for p in PARITIES), F.lit(0))
    met = side("a").join(side("b").where("rarest_b"), "shingle").where(
        larger & (F.col("root_a") != F.col("root_b")) & (to_go >= needed) & (apart <= both - 2 * needed)
    )
    return met.select(F.greatest("node_a", "node_b").alias("a"), F.least("node_a", "node_b").alias("b")).distinct()


def near_copies(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), seeds: int = SEEDS, alike: float = ALIKE) -> DataFrame:
    """keep columns and component_id: classes of texts whose 5-word shingles are 0.8 alike or more.

    A pair is found if one of ``seeds`` signatures has five bytes of MinHashes in common, through the same
    index of byte positions, and stays if the resemblance of the 5-word shingles, counted on the texts, is
    ``alike``. Equal texts are one node. The members of a list are held against one of them first; members of lists that
    hold several classes then against all others that their rarest shingles allow, however long the list is. docs: doc_id, text and what ``keep`` names; nulls
    and empty texts are one class. Repeated rows are kept. An empty table gives an empty result.
    """
    return _copies(docs, keep, seeds, alike).select(*keep, "component_id")


def _copies(docs: DataFrame, keep: tuple[str, ...], seeds: int = SEEDS, alike: float = ALIKE) -> DataFrame:
    """keep columns, node (hash of the text), root (smallest node of the class, never null) and component_id."""
    tables = Tables(docs.sparkSession, "copies")
    fields = [f"fp{s}" for s in range(seeds)]
    schema = T.StructType(
        [docs.schema[c] for c in keep] + [T.StructField("__id", T.LongType()), T.StructField("node", T.LongType())]
        + [T.StructField(f, T.LongType()) for f in ("shingles", *fields, *PARITIES)] + [T.StructField("sketch", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep) + 2).to_pylist()
            hashes = [sketches.shingle_hashes(t) for t in texts]
            prints = list(zip(*(signatures(h, seeds) for h in hashes), strict=True)) or [()] * seeds
            held = [sketches.smallest(h).tobytes() for h in hashes]
            different = [np.unique(h) for h in hashes]
            odd = np.array([parities(h) for h in different], np.int64).reshape(-1, len(PARITIES)).T
            sizes = pa.array([len(h) for h in different], pa.int64())
            columns = [*batch.columns[: len(keep) + 2], sizes, *[pa.array(p, pa.int64()) for p in prints], *map(pa.array, odd), pa.array(held, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    prints = tables.write("prints", docs.select(
        *keep, F.col("doc_id").cast("long").alias("__id"), F.xxhash64(whole("text")).alias("node"), whole("text").alias("__text")
    ).mapInArrow(run, schema))
    nodes = tables.write("nodes", prints.groupBy("node", "shingles", *fields, *PARITIES).agg(F.min("__id").alias("first")))
    places = [
        F.struct(F.lit(k).alias("list"), F.lit(k % len(BLOCKS)).alias("block"), F.col(f).alias("fp"), F.col(f).bitwiseAND(F.lit(_mask(b)).cast("long")).alias("bytes"))
        for k, (f, b) in enumerate((f, b) for f in fields for b in BLOCKS)
    ]
    entries = nodes.select("node", "shingles", F.explode(F.array(*places)).alias("m")).select("node", "shingles", "m.*")
    lists = entries.groupBy("list", "bytes").agg(F.count("*").alias("n")).where("n > 1")
    met = tables.write("met", entries.join(lists, ["list", "bytes"]))

    # first all members of a list against the one that stands in the longest lists: the original of many copies
    score = met.groupBy("node").agg(F.sum("n").alias("score"))
    leader = met.join(score, "node").groupBy("list", "bytes").agg(F.max(F.struct("score", "node", "fp", "shingles")).alias("l"))
    led = met.join(leader, ["list", "bytes"]).select(*met.columns, F.col("l.node").alias("v"), F.col("l.fp").alias("fv"), F.col("l.shingles").alias("sv"))
    pairs = tables.write("pairs", led.where((F.col("node") != F.col("v")) & _possible("fp", "fv", "shingles", "sv", alike)).select(
        F.greatest("node", "v").alias("a"), F.least("node", "v").alias("b")
    ).distinct())
    verified = _alike(tables, "first", pairs, prints, docs, alike)

    # then, among the members of lists that hold several classes still, the pairs of different classes that rare shingles allow
    so_far = connected(tables, verified)
    placed = met.join(so_far, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = placed.groupBy("list", "bytes").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("list", "bytes")
    members = tables.write("members", placed.join(several, ["list", "bytes"]).select("node", "root").distinct())
    rest = _allowed(tables, members, nodes, docs, alike)
    others = tables.write("others", rest.join(pairs, ["a", "b"], "left_anti"))
    verified = tables.write("verified", verified.unionByName(_alike(tables, "second", others, prints, docs, alike)))
    roots = connected(tables, verified)
    linked = nodes.select("node", "first").join(roots, "node")
    named = linked.select("node", "root").join(linked.groupBy("root").agg(F.min("first").alias("class_first")), "root").select("node", "root", "class_first")
    classes = tables.write("classes", nodes.select("node", "first").join(named, "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"), F.coalesce("class_first", "first").alias("component_id")
    ))
    tables.drop("nodes", "met", "pairs", "held", "ends", "read", "texts", "first", "members", "alone", "shingles", "rare", "others", "second", "verified", "stars")
    return prints.select(*keep, "node").join(classes, "node").select(*keep, "node", "root", "component_id")


def representatives(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One document of each class of near copies: the one with the smallest id, of several texts with that id the
    one with the smallest hash. Equal rows are one document.

    A document without an id stays only if its class has no id; every such class keeps one of its texts.
    """
    tables = Tables(docs.sparkSession, "chosen")
    found = tables.write("classes", _copies(docs, ("doc_id",)))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("one")
    chosen = found.groupBy("root").agg(first).select(F.col("one.doc_id").alias("__id"), F.col("one.node").alias("__node"))
    own = docs.select(*dict.fromkeys((*columns, "doc_id")), F.xxhash64(whole("text")).alias("__own"))
    kept = own.join(chosen, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__node")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__own"]).select(*columns)
