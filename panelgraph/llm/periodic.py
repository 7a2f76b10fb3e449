"""Periodic runs of words, found by an online sparse dynamic programme over the diagonals (lags) of a text.

A diagonal of lag p holds the places whose word equals the one p words before. Walking the words in
order, each earlier occurrence of the present word lengthens the match on the diagonal it lies on; a
diagonal that the next word does not lengthen ends there, and if it has become long enough its run is
emitted. Following every earlier occurrence takes the square of a frequent word, so occurrences are
those of contexts: the k words that end at a place, k = 1, 2, 4, ..., and of each context only the
nearest earlier one. That is exact: in a run of smallest period q, at least 4 q long, the nearest
earlier occurrence of a context of k >= q words, k < 2 q, is q words back (a nearer one would give
the run a smaller period), and the last context at lag q ends with the run. So every run is one
unbroken diagonal of the one k with k/2 < q <= k, its smallest period is certain, and no other k
emits it. Contexts that do not recur are dropped before k doubles, which leaves little of prose and
n log n of the most repetitive text, in arrays of a few bytes a word.

The steps of all words of a group of texts are taken together as array operations: sorting contexts
links each to its nearest earlier occurrence, and a diagonal's length is the number of consecutive
places with one lag.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: A run has at least this many words and this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words of the texts that share one group of array operations; a longer text is a group of its own.
GROUP_WORDS = 1 << 19

RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


def diagonals(words: np.ndarray, texts: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> np.ndarray:
    """Rows (first place, length, period) of all runs, by place and period.

    words: number of the word at each place; texts: number of its text, not falling. ``least_periods`` is 4 or more.
    """
    if least_periods < 4:
        raise ValueError("runs of fewer than four periods are not certain to be one diagonal")
    n, k, found = len(words), 1, []
    place = np.arange(n, dtype=np.int64)
    context = texts.astype(np.int64) * (int(words.max(initial=0)) + 1) + words
    number = np.full(n, -1, np.int64)  # of the recurring context that ends at a place
    while len(place):
        order = np.argsort(context, kind="stable")
        same = context[order[1:]] == context[order[:-1]]
        lag = np.zeros(len(place), np.int64)
        lag[order[1:]] = np.where(same, place[order[1:]] - place[order[:-1]], 0)
        # a diagonal: consecutive places of one lag
        starts = np.flatnonzero(np.diff(lag, prepend=-1) | (np.diff(place, prepend=-2) != 1))
        ends, period = np.append(starts[1:], len(place)), lag[starts]
        length = ends - starts + k - 1 + period
        enough = (2 * period > k) & (period <= k) & (length >= np.maximum(least_words, least_periods * period))
        first = place[starts] - (k - 1) - period
        found.append(np.stack([first[enough], length[enough], period[enough]], axis=1))
        # contexts of twice the length: both halves recur
        again = np.zeros(len(place), bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        names = np.empty(len(place), np.int64)
        names[order] = np.cumsum(np.append(True, ~same)[: len(place)])
        recurring = place[again]
        number[recurring] = names[again]
        ready = recurring[recurring >= k]
        ready = ready[(number[ready - k] >= 0) & (texts[ready - k] == texts[ready])]
        context = number[ready - k] * (n + 1) + number[ready]
        number[recurring] = -1
        place, k = ready, 2 * k
    runs = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def split(text: str | None) -> list[bytes]:
    """A text's words: what stands between ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def text_runs(texts: list[list[bytes]]) -> list[np.ndarray]:
    """The runs of each list of words, as ``diagonals`` gives them, places counted from the list's start."""
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = pa.array([w for t in texts for w in t], pa.binary())
    words = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    runs = diagonals(words, np.repeat(np.arange(len(texts)), sizes))
    bounds = np.append(0, np.cumsum(sizes))
    at = np.searchsorted(runs[:, 0], bounds)
    return [runs[a:b] - (s, 0, 0) for a, b, s in zip(at[:-1], at[1:], bounds[:-1], strict=True)]


def collapsed(words: list[bytes], runs: np.ndarray) -> str:
    """The words that no run holds after its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words).decode("utf-8", "surrogatepass")
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return b" ".join(w for w, inside in zip(words, np.cumsum(steps).tolist(), strict=False) if not inside).decode("utf-8", "surrogatepass")


def _groups(texts: list[str | None]) -> Iterator[list[list[bytes]]]:
    group, size = [], 0
    for text in texts:
        words = split(text)
        if group and size + len(words) > GROUP_WORDS:
            yield group
            group, size = [], 0
        group.append(words)
        size += len(words)
    if group:
        yield group


def periodic_runs(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, n_words, runs (array of start, length, period by start and period) and collapsed (text).

    docs: text and what ``keep`` names; others are ignored, and a kept column may not bear a result's name. Every text is
    looked at whole, in the task that reads it: nothing is shuffled. Null and empty texts have no words, no runs and an empty
    collapsed text. Repeated rows are judged alike, each by itself. An empty table gives an empty result.
    """
    results = [T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())]
    if clash := {f.name for f in results} & set(keep):
        raise ValueError(f"rename the kept columns {sorted(clash)}: results bear these names")
    schema = T.StructType([docs.schema[c] for c in keep] + results)
    struct = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for group in _groups(batch.column(len(keep)).to_pylist()):
                runs = text_runs(group)
                flat = np.concatenate(runs)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.append(0, np.cumsum([len(r) for r in runs])), pa.int32()),
                    pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(struct)),
                )
                columns = [
                    *(c.slice(at, len(group)) for c in batch.columns[: len(keep)]),
                    pa.array([len(t) for t in group], pa.int64()),
                    lists,
                    pa.array([collapsed(t, r) for t, r in zip(group, runs, strict=True)], pa.string()),
                ]
                at += len(group)
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select(*keep, "text").toDF(*schema.names[: len(keep)], "__text").mapInArrow(run, schema)
