"""A quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into bins and has a table with one value a bin; some pairs of features have a
table over coarser bins of both. The log-odds of a document are an intercept plus one entry of each
table, so scoring is a look-up of bins and an addition of vectors, and every part of a score can be
read from a table. Tables are learned by cyclic boosting: in turn, each feature gets a shallow tree on
the histogram of what all tables still leave unexplained, and a fraction of it is added to its table.
After some rounds the pairs that explain most of the rest are chosen, and their tables join the cycle.

Features come from the text alone. The fit sees a bounded sample of the labelled rows (``MOST_ROWS``
by expectation, chosen by a hash) in one task; scoring covers all rows in the tasks that hold them.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import Tables

#: Labelled rows that a fit looks at, by expectation; more are thinned by a hash of id and features.
MOST_ROWS = 1 << 16
#: Bins of a feature alone and in a pair, rounds over all tables, rounds before pairs are chosen, share of a tree that is
#: added, leaves of a tree, number of pairs, labelled rows (as sum of p (1 - p)) that a leaf needs, pull of leaves towards zero.
BINS, PAIR_BINS, ROUNDS, ROUNDS_ALONE, RATE, LEAVES, PAIRS, LEAST_LEAF, PULL = 48, 12, 150, 30, 0.1, 4, 8, 0.5, 1.0

FEATURES = (
    "log_words", "mean_word", "long_words", "distinct_words", "repeated_threes", "mean_line", "copied_lines", "ended_lines",
    "capitals", "digits", "symbols", "sentence_marks", "exclamations", "commas", "other_marks", "spaces", "non_ascii", "letter_bits",
)

_CLASSES = {
    "capitals": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "symbols": b"#*$%&|<>", "sentence_marks": b".?",
    "exclamations": b"!", "commas": b",;:", "other_marks": b"-_/\\()[]{}\"'@^`~+=", "spaces": b" \t\n\v\f\r", "non_ascii": bytes(range(128, 256)),
}
_MASKS = np.zeros((256, len(_CLASSES)))
for _i, _bytes in enumerate(_CLASSES.values()):
    _MASKS[list(_bytes), _i] = 1.0


def measure(text: str | None) -> list[float]:
    """The features of a whole text; shares are 0 where there is nothing to share."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    sizes = np.fromiter(map(len, words), np.int64, n)
    lines = [x.strip() for x in raw.split(b"\n")]
    lines = [x for x in lines if x]
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    shares = counts @ _MASKS / len(raw)
    letters = counts[97:123] + counts[65:91]
    letters = letters[letters > 0] / max(1.0, letters.sum())
    threes = max(0, n - 2)
    return [
        float(np.log1p(n)),
        float(sizes.mean()),
        float((sizes > 12).mean()),
        len(set(words)) / n,
        1 - len(set(zip(words, words[1:], words[2:], strict=False))) / threes if threes else 0.0,
        float(np.log1p(n / len(lines))),
        1 - len(set(lines)) / len(lines),
        sum(x[-1:] in b".!?\"" for x in lines) / len(lines),
        *shares.tolist(),
        float(-(letters * np.log2(letters)).sum()) if len(letters) else 0.0,
    ]


@dataclass
class Model:
    """Bin edges by feature, tables by feature, coarse edges and tables by pair; all bounded by the parameters."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def log_odds(self, values: np.ndarray) -> np.ndarray:
        """values: rows x features."""
        out = np.full(len(values), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += table[np.searchsorted(edges, values[:, j], side="right")]
        if self.pairs:
            bins = {j: np.searchsorted(self.coarse[j], values[:, j], side="right") for j in {j for pair in self.pairs for j in pair}}
            for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
                out += table[bins[a], bins[b]]
        return out

    def score(self, values: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.log_odds(values), -500, 500)))

    def entries(self) -> list[tuple[str, str | None, int, int | None, float | None, float | None, float]]:
        """(feature, other feature of a pair, bin, other bin, the bins' lower edges (none for the lowest), value) of all tables."""
        low = lambda edges, i: float(edges[i - 1]) if i else None
        out = [(FEATURES[j], None, i, None, low(self.edges[j], i), None, float(v)) for j, t in enumerate(self.tables) for i, v in enumerate(t)]
        for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
            out += [(FEATURES[a], FEATURES[b], i, k, low(self.coarse[a], i), low(self.coarse[b], k), float(t[i, k])) for i, k in np.ndindex(*t.shape)]
        return out


def cut_points(values: np.ndarray, bins: int) -> np.ndarray:
    """Edges between bins of about equal numbers of rows, none for a constant feature."""
    edges = np.unique(np.quantile(values, np.arange(1, bins) / bins, method="inverted_cdf"))
    return edges[edges > values.min()] if len(values) else edges


def _gain(g, h):
    return g * g / (h + PULL)


def tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of at most ``LEAVES`` leaves on a histogram of gradients and weights by bin: its value in every bin."""
    sums_g, sums_h = np.append(0.0, np.cumsum(g)), np.append(0.0, np.cumsum(h))
    leaves = [(0, len(g))]

    def best(a, b):
        inner = np.arange(a + 1, b)
        if not len(inner):
            return 0.0, a
        lg, lh = sums_g[inner] - sums_g[a], sums_h[inner] - sums_h[a]
        rg, rh = sums_g[b] - sums_g[inner], sums_h[b] - sums_h[inner]
        gains = np.where((lh >= LEAST_LEAF) & (rh >= LEAST_LEAF), _gain(lg, lh) + _gain(rg, rh), 0.0) - _gain(sums_g[b] - sums_g[a], sums_h[b] - sums_h[a])
        at = int(np.argmax(gains))
        return float(gains[at]), int(inner[at])

    while len(leaves) < LEAVES:
        found = [(*best(a, b), i) for i, (a, b) in enumerate(leaves)]
        gain, at, i = max(found, key=lambda x: (x[0], -x[2]))
        if gain <= 1e-9:
            break
        a, b = leaves.pop(i)
        leaves += [(a, at), (at, b)]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = (sums_g[b] - sums_g[a]) / (sums_h[b] - sums_h[a] + PULL)
    return out


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of either axis of a two-way histogram into four leaves: what it gains and its value in every cell."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    corners = []
    for c in (cg, ch):
        upper_left = c[1:-1, 1:-1]
        left, upper, all_of_it = c[-1:, 1:-1], c[1:-1, -1:], c[-1, -1]
        corners.append([upper_left, upper - upper_left, left - upper_left, all_of_it - upper - left + upper_left])
    if not corners[0][0].size:
        return 0.0, np.zeros_like(g)
    ok = np.logical_and.reduce([x >= LEAST_LEAF for x in corners[1]])
    (g1, g2, g3, g4), (h1, h2, h3, h4) = corners
    # what the two cuts gain together over the better of them alone: the rest is for the features' own tables
    alone = np.maximum(_gain(g1 + g2, h1 + h2) + _gain(g3 + g4, h3 + h4), _gain(g1 + g3, h1 + h3) + _gain(g2 + g4, h2 + h4))
    gains = np.where(ok, sum(_gain(a, b) for a, b in zip(*corners, strict=True)) - alone, 0.0)
    i, k = np.unravel_index(int(np.argmax(gains)), gains.shape)
    values = [a[i, k] / (b[i, k] + PULL) for a, b in zip(*corners, strict=True)]
    out = np.empty_like(g)
    out[: i + 1, : k + 1], out[: i + 1, k + 1 :], out[i + 1 :, : k + 1], out[i + 1 :, k + 1 :] = values
    return float(gains[i, k]), out if gains[i, k] > 1e-9 else np.zeros_like(g)


def fit(values: np.ndarray, labels: np.ndarray) -> Model:
    """A model of ``labels`` (0 or 1). With no rows every score is 0.5; with one class the features tell nothing."""
    n, width = len(values), len(FEATURES)
    p = (labels.sum() + 1.0) / (n + 2.0)
    model = Model(float(np.log(p / (1 - p))), [], [], [], [], [])
    model.edges = [cut_points(values[:, j], BINS) if n else np.empty(0) for j in range(width)]
    model.coarse = [cut_points(values[:, j], PAIR_BINS) if n else np.empty(0) for j in range(width)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if not n or labels.min() == labels.max():
        return model
    bins = [np.searchsorted(e, values[:, j], side="right") for j, e in enumerate(model.edges)]
    odds = np.full(n, model.intercept)

    def left() -> tuple[np.ndarray, np.ndarray]:
        s = 1.0 / (1.0 + np.exp(-odds))
        return labels - s, s * (1 - s)

    coarse = [np.searchsorted(e, values[:, j], side="right") for j, e in enumerate(model.coarse)]

    def crossed(pair: tuple[int, int], g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = tuple(len(model.coarse[j]) + 1 for j in pair)
        cell = coarse[pair[0]] * shape[1] + coarse[pair[1]]
        return cell, *(np.bincount(cell, x, shape[0] * shape[1]).reshape(shape) for x in (g, h))

    for turn in range(ROUNDS):
        if turn == ROUNDS_ALONE:
            g, h = left()
            gains = {pair: quadrants(*crossed(pair, g, h)[1:])[0] for pair in itertools.combinations(range(width), 2)}
            model.pairs = [pair for pair, gain in sorted(gains.items(), key=lambda x: (-x[1], x[0]))[:PAIRS] if gain > 1e-9]
            model.pair_tables = [np.zeros(tuple(len(model.coarse[j]) + 1 for j in pair)) for pair in model.pairs]
        for j, table in enumerate(model.tables):
            if len(table) > 1:
                g, h = left()
                step = RATE * tree(np.bincount(bins[j], g, len(table)), np.bincount(bins[j], h, len(table)))
                table += step
                odds += step[bins[j]]
        for pair, table in zip(model.pairs, model.pair_tables, strict=True):
            cell, *histograms = crossed(pair, *left())
            step = RATE * quadrants(*histograms)[1]
            table += step
            odds += step.ravel()[cell]
    return model


def measured(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns and the array ``features`` of every text."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("features", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(rows, pa.list_(pa.float64()))], schema.names)

    return docs.select(*keep, "text").toDF(*keep, "__text").mapInArrow(run, schema)


def train(features: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = MOST_ROWS) -> Model:
    """Fit on the rows of ``features`` (doc_id, features) whose doc_id has a label.

    Null ids and null labels teach nothing; an id with several labels takes the more frequent one (1 on ties); several documents
    with one id all count. More than ``most_rows`` labelled rows are thinned to about as many, the same ones in every run.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(
        (F.avg(F.col(label).cast("double")) >= 0.5).cast("double").alias("label")
    )
    rows = features.where("doc_id is not null").join(known, "doc_id").select("doc_id", "features", "label")
    rows = rows.withColumn("key", F.xxhash64("doc_id", "features"))
    share = min(1.0, most_rows / max(1, rows.count()))
    sample = rows.where(F.col("key") < F.lit(int((2 * share - 1) * 2**63) if share < 1 else 2**63 - 1))

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        if not held:
            return
        table = pd.concat(held).sort_values("key", kind="stable")
        values = np.array(table["features"].tolist(), float).reshape(len(table), len(FEATURES))
        yield pd.DataFrame({"model": [pickle.dumps(vars(fit(values, table["label"].to_numpy(float))))]})

    fitted = sample.select("features", "label", "key").repartition(1).mapInPandas(learn, "model binary").first()
    return Model(**pickle.loads(fitted["model"])) if fitted else fit(np.empty((0, len(FEATURES))), np.empty(0))


def scored(features: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns and score, the probability of label 1."""
    schema = T.StructType([features.schema[c] for c in keep] + [T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(len(keep)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(model.score(values))], schema.names)

    return features.select(*keep, "features").mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, teaches: Column, keep: tuple[str, ...] = ("doc_id",), label: str = "quality") -> DataFrame:
    """keep columns and score of every text, by a model fitted where ``teaches`` (over keep columns, doc_id among them) is true.

    Null and empty texts have features of zero and are scored by them. Repeated rows get equal scores. No labelled rows: every
    score is 0.5. An empty table gives an empty result. A kept column may not be called features or score.
    """
    if clash := {"features", "score"} & set(keep):
        raise ValueError(f"rename the kept columns {sorted(clash)}: results bear these names")
    features = Tables(docs.sparkSession, "additive").write("features", measured(docs, keep))
    return scored(features, train(features.where(teaches), labels, label), keep)
