"""Text expressions: ids, domains, tokens, gazetteer, taxonomy and tone, all JVM-side.

Lexicons enter as Python lists and become literals of the expression, so scoring text needs
no join and no shuffle. Word boundaries are Unicode-aware.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelgraph.fixed_values import (
    EXTREME_TONE,
    GAZETTEER,
    GOVERNMENT_NAMES,
    GOVERNMENT_PATTERN,
    NEGATIVE_TONE,
    PHRASE_CONFIDENCE,
    SHORT_WORD_CONFIDENCE,
    TAXONOMY,
    TOKEN_PATTERN,
    VALENCES,
    WHITE_SPACE,
    WORD_CONFIDENCE,
)
from panelgraph.functions.numbers import clip


def strip(c: Column) -> Column:
    """Trim all Unicode white space, not only blanks."""
    return F.trim(c, F.lit(WHITE_SPACE))


def article_id(url: Column, title: Column) -> Column:
    key = F.concat_ws("::", F.lower(strip(url)), F.lower(strip(title)))
    return F.substring(F.sha2(key, 256), 1, 16)


def canonical_domain(domain: Column) -> Column:
    """Trimmed, lower case, one leading ``www.`` removed; a missing one is 'unknown'."""
    clean = F.regexp_replace(F.lower(strip(domain)), r"^www\.", "")
    return F.when(F.coalesce(domain, F.lit("")) == "", F.lit("unknown")).otherwise(clean)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _lookup(pairs: Sequence[tuple[str, object]]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def target_entity(
    text: Column, words: Column, gazetteer: Sequence[tuple[str, str]] = GAZETTEER
) -> Column:
    """struct(entity, confidence) named in the text; (NULL, 0.0) when none is.

    ``words`` are the tokens of the text. The first phrase contained in the text wins.
    Otherwise the best single word does: long words before short ones, then list order. The
    publisher's country plays no part.
    """
    lowered = F.lower(text)

    def answer(code: str | None, confidence: float) -> Column:
        return F.struct(
            F.lit(code).cast("string").alias("entity"), F.lit(confidence).cast("double").alias("confidence")
        )

    phrases = [(term, code) for term, code in gazetteer if " " in term]
    singles = [(term, code) for term, code in gazetteer if " " not in term]
    # Best first: the position in this list is the rank of the word.
    ranked = [(t, c, WORD_CONFIDENCE) for t, c in singles if len(t) > 3]
    ranked += [(t, c, SHORT_WORD_CONFIDENCE) for t, c in singles if len(t) <= 3]
    candidates = [F.when(lowered.contains(term), answer(code, PHRASE_CONFIDENCE)) for term, code in phrases]
    if ranked:
        present = F.array_intersect(words, _strings([term for term, _, _ in ranked]))
        ranks = _lookup([(term, i) for i, (term, _, _) in enumerate(ranked)])
        best = F.array_min(F.transform(present, lambda t: F.try_element_at(ranks, t)))
        # get() gives NULL for a missing index, element_at() the last item.
        candidates.append(F.get(F.array(*[answer(code, conf) for _, code, conf in ranked]), best))
    return F.coalesce(*candidates, answer(None, 0.0))


def _layers(keywords: Sequence[str]) -> list[list[str]]:
    """Split keywords so that within a layer none starts with another one plus a boundary."""
    layers: list[list[str]] = []
    for word in sorted(set(keywords), key=len):
        depth = sum(other != word and re.match(re.escape(other) + r"\b", word) is not None for other in set(keywords))
        while len(layers) <= depth:
            layers.append([])
        layers[depth].append(word)
    return [layer for layer in layers if layer]


def keywords_found(text: Column, keywords: Sequence[str]) -> Column:
    """Distinct keywords present as whole words or phrases, found in one scan of the text.

    A look-ahead leaves the scan position at the start of a hit, so overlapping keywords
    ('border clash' and 'clash') are all found.
    """
    lowered = F.lower(text)
    scans = []
    for layer in _layers(keywords):
        choice = "|".join(r"\Q" + word + r"\E" for word in layer)
        scans.append(F.regexp_extract_all(lowered, F.lit(rf"(?U)\b(?=({choice})\b)"), F.lit(1)))
    return F.array_distinct(reduce(lambda a, b: F.concat(a, b), scans))


def taxonomy_hits(found: Column, taxonomy: Mapping[str, Sequence[str]] = TAXONOMY) -> dict[str, Column]:
    """Category -> number of distinct keywords of that category among ``found``."""
    return {
        category: F.when(F.size(found) == 0, F.lit(0)).otherwise(
            F.size(F.array_intersect(found, _strings(sorted(set(words)))))
        )
        for category, words in taxonomy.items()
    }


def primary_category(hits: Mapping[str, Column]) -> Column:
    """Category with the most hits, the first one on ties; 'none' without a hit."""
    ranked = F.array(
        *[
            F.struct(c.alias("hits"), F.lit(-i).alias("rank"), F.lit(name).alias("name"))
            for i, (name, c) in enumerate(hits.items())
        ]
    )
    best = F.array_max(ranked)
    return F.when(best["hits"] > 0, best["name"]).otherwise(F.lit("none"))


def known_words(words: Column, valences: Mapping[str, float] = VALENCES) -> Column:
    """Distinct scored words among the tokens."""
    return F.array_intersect(words, _strings(list(valences)))


def tone_score(words: Column, known: Column, valences: Mapping[str, float] = VALENCES) -> Column:
    """Mean valence over all occurrences of known words, in [-1, 1]; 0 without a known word.

    ``known`` must be a column of its own (from ``known_words``): inside the filter below an
    expression would be computed again for every token. The valences are added in text order,
    so equal texts give bit-equal scores.
    """
    values = _lookup(list(valences.items()))
    scored = F.transform(
        F.filter(words, lambda t: F.array_contains(known, t)), lambda t: F.try_element_at(values, t)
    )
    mean = F.aggregate(
        scored,
        F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("n")),
        lambda acc, v: F.struct((acc["total"] + v).alias("total"), (acc["n"] + 1).alias("n")),
        lambda acc: acc["total"] / acc["n"],
    )
    return F.when(F.size(known) > 0, F.least(F.greatest(mean, F.lit(-1.0)), F.lit(1.0))).otherwise(F.lit(0.0))


def is_negative(tone: Column) -> Column:
    return tone < NEGATIVE_TONE


def is_extreme(tone: Column) -> Column:
    return F.abs(tone) >= EXTREME_TONE


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda t: t != F.lit("")))


def conflict_intensity(hit_count: Column, text: Column) -> Column:
    return clip(hit_count / F.greatest(word_count(text), F.lit(1)), high=1.0)


def government_codes(text: Column, names: Sequence[tuple[str, str]] = GOVERNMENT_NAMES) -> Column:
    """Codes of every 'Government of X' in the text, first mention first, each once."""
    named = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(GOVERNMENT_PATTERN), F.lit(1))
    codes = F.transform(named, lambda n: F.try_element_at(_lookup(names), strip(n)))
    return F.array_distinct(F.filter(codes, lambda c: c.isNotNull()))
