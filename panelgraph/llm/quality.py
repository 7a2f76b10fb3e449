"""Quality rules as weak supervision.

Each rule looks at one feature of a document and votes good (+1), bad (-1) or abstains (0). No label is
read: expectation-maximisation over the counts of distinct vote patterns (at most 3^rules, whatever
the number of documents) estimates how each rule votes on good and on bad documents and how common
either is, and every document gets the posterior probability that it is good.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import Tables, let, whole, words

#: name -> (bad when, good when) over the feature columns; neither: the rule abstains.
RULES: dict[str, tuple[str, str]] = {
    "symbols": ("n_symbols > 0.10 * n_words", "n_symbols <= 0.02 * n_words"),
    "repeats": ("n_repeat_words > 0.20 * n_words", "n_repeat_words <= 0.05 * n_words"),
    "copied_lines": ("n_dup_lines > 0.30 * n_lines", "n_lines >= 4 and n_dup_lines = 0"),
    "word_length": ("word_chars < 3.0 * n_words or word_chars > 9.0 * n_words", "word_chars between 4.0 * n_words and 6.5 * n_words"),
    "capitals": ("n_capitals > 0.30 * word_chars", "n_capitals <= 0.08 * word_chars"),
    "line_ends": ("n_ended_lines < 0.30 * n_lines", "n_ended_lines >= 0.80 * n_lines"),
    "exclamations": ("n_exclamations > 0.20 * n_words", "n_exclamations <= 0.03 * n_words"),
}
#: First guess: share of good documents, and how either class makes a rule vote bad, abstain, good.
FIRST_GOOD = 0.8
FIRST_RATES = {"good": {-1: 0.05, 0: 0.25, 1: 0.70}, "bad": {-1: 0.30, 0: 0.30, 1: 0.40}}
#: Pseudo-documents behind the first guess, and when to stop.
PSEUDO, MOST_STEPS, TOLERANCE = 2.0, 40, 1e-4
KEEP_FROM = 0.5


#: Low bits of a sort key that hold the place of a window; a document has fewer words.
PLACE_BITS = 27


def repeat_words(ws: Column) -> Column:
    """Words covered by 3-word windows that occur at least twice among ``ws`` (an array).

    Windows are compared by 64-bit hash within one document. Equal ones meet by sorting longs made
    of the head of the hash and the place, and are then compared by the whole hash; the covered
    words of sorted places p1 < p2 < ... are the sum of min(3, gap).
    """
    n, mask = F.size(ws), F.lit((1 << PLACE_BITS) - 1).cast("long")

    def covered(hashes: Column) -> Column:
        def hash_at(key: Column) -> Column:
            return F.get(hashes, key.bitwiseAND(mask).cast("int"))

        def same(x: Column, y: Column) -> Column:
            return x.bitwiseXOR(y).between(0, mask) & (hash_at(x) == hash_at(y))

        keys = F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))))
        places = lambda s: F.sort_array(F.transform(
            F.filter(s, lambda x, j: same(x, F.get(s, j + 1)) | ((j > 0) & same(x, F.get(s, j - 1)))), lambda x: x.bitwiseAND(mask)
        ))
        spread = lambda p: F.aggregate(
            p, F.struct(F.lit(0).cast("long").alias("total"), F.lit(-3).cast("long").alias("last")),
            lambda acc, i: F.struct((acc["total"] + F.least(F.lit(3).cast("long"), i - acc["last"])).alias("total"), i.alias("last")),
            lambda acc: acc["total"],
        )
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            let(let(keys, places), spread)
        )

    # the words past the end give null, which the slice leaves out
    windows = F.slice(F.transform(ws, lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2))), 1, n - 2)
    return F.when(n < 3, F.lit(0).cast("long")).otherwise(let(windows, covered))


def features(text: Column) -> Column:
    """One struct of counts over the whole text; null counts as empty."""
    t = whole(text)
    gone = lambda pattern: (F.length(t) - F.length(F.regexp_replace(t, pattern, ""))).cast("long")
    by_words = let(words(t), lambda ws: F.struct(
        F.size(ws).cast("long").alias("n_words"),
        F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
        repeat_words(ws).alias("n_repeat_words"),
    ))
    with_word = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_lines = let(with_word, lambda ls: F.struct(
        F.size(ls).cast("long").alias("n_lines"),
        (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(ls, lambda x: F.substring(F.rtrim(x), -1, 1).isin(".", "!", "?", '"'))).cast("long").alias("n_ended_lines"),
    ))
    by_chars = F.struct(
        gone(r"[#*$%&|<>]+").alias("n_symbols"),
        gone("[A-Z]+").alias("n_capitals"),
        (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))).cast("long").alias("n_exclamations"),
    )
    return F.struct(by_words.alias("w"), by_lines.alias("l"), by_chars.alias("c"))


FEATURES = (
    "w.n_words", "w.word_chars", "c.n_symbols", "l.n_dup_lines", "w.n_repeat_words",
    "l.n_lines", "l.n_ended_lines", "c.n_capitals", "c.n_exclamations",
)
FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def vote(rule: str) -> Column:
    bad, good = RULES[rule]
    return F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0).cast("int")


Rates = dict[str, dict[str, dict[int, float]]]


def posterior(good: float, rates: Rates) -> Column:
    """Probability that a document with the array ``votes`` is good."""
    weights = F.array(*[
        F.array(*[F.lit(math.log(rates["good"][r][v] / rates["bad"][r][v])) for v in (-1, 0, 1)]) for r in RULES
    ])
    odds = F.aggregate(
        F.transform("votes", lambda v, i: F.get(F.get(weights, i), v + 1)), F.lit(math.log(good / (1 - good))), lambda a, b: a + b
    )
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def estimate(patterns: DataFrame) -> tuple[float, Rates]:
    """Share of good documents and each rule's vote rates in either class, by expectation-maximisation.

    patterns: the array ``votes`` and ``documents``, its count. A step brings 3 sums per rule to the driver.
    """
    good, rates = FIRST_GOOD, {c: {r: dict(FIRST_RATES[c]) for r in RULES} for c in FIRST_RATES}
    for _ in range(MOST_STEPS):
        weighed = patterns.coalesce(1).select("votes", "documents", posterior(good, rates).alias("p"))
        rows = weighed.select("documents", "p", F.posexplode("votes").alias("rule", "vote")).groupBy("rule", "vote").agg(
            F.sum(F.col("p") * F.col("documents")).alias("good"), F.sum((1 - F.col("p")) * F.col("documents")).alias("bad")
        ).collect()
        if not rows:
            break
        sums = {(c, list(RULES)[row["rule"]], row["vote"]): row[c] for row in rows for c in rates}
        every = {c: sum(x for (k, r, _), x in sums.items() if k == c and r == next(iter(RULES))) for c in rates}
        before = good
        good = (every["good"] + PSEUDO * FIRST_GOOD) / (every["good"] + every["bad"] + PSEUDO)
        rates = {
            c: {r: {v: (sums.get((c, r, v), 0.0) + PSEUDO * FIRST_RATES[c][v]) / (every[c] + PSEUDO) for v in (-1, 0, 1)} for r in RULES}
            for c in rates
        }
        if abs(good - before) < TOLERANCE:
            break
    return good, rates


def accuracies(good: float, rates: Rates) -> dict[str, float]:
    """How often each rule is right when it votes."""
    bad, out = 1 - good, {}
    for r in RULES:
        right = good * rates["good"][r][1] + bad * rates["bad"][r][-1]
        out[r] = right / (right + good * rates["good"][r][-1] + bad * rates["bad"][r][1])
    return out


def assess(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, the features, base_failed, votes (by rule), quality (posterior) and kept.

    docs: text and what ``keep`` names; others are ignored. Null and empty texts have no words and so
    fail the base test. Repeated rows are judged alike, each by itself. An empty table gives an empty
    result. The estimate sees the documents that pass the base test: the others are decided.
    """
    tables = Tables(docs.sparkSession, "quality")
    found = docs.select(*keep, features(F.col("text")).alias("f")).select(*keep, "f.w", "f.l", "f.c").select(*keep, *FEATURES)
    votes = tables.write("votes", found.withColumn("base_failed", F.expr(FAILED)).withColumn("votes", F.array(*map(vote, RULES))))
    patterns = tables.write("patterns", votes.where(~F.col("base_failed")).groupBy("votes").agg(F.count("*").alias("documents")).coalesce(1))
    good, rates = estimate(patterns)
    tables.drop("patterns")
    judged = votes.withColumn("quality", posterior(good, rates))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_FROM))
