"""Token ids and lengths of whole texts through caches of space-separated pieces.

No tokenizer used here lets a token reach across a single space between two characters that are not
white space: byte-level BPE gives that space to the word after it, word BPE drops it, piece BPE turns
it into the mark that only starts a piece. So a text's ids are those of its pieces, each piece but the
first with the space before it, one after the other. Texts with other white space next to a space go
to the tokenizer whole. The caches live as long as a Python worker and are emptied when full.

A word BPE that lower-cases and splits by one known pattern is learnt a word at a time: a text of plain
characters is cut by that pattern, its words (fewer than pieces: case and punctuation are gone) are looked
up, and new ones go to the library's model together, where a token that ends a word tells them apart.
"""

from __future__ import annotations

import json
import os
import re
import sys
from itertools import compress, filterfalse
from pathlib import Path
from types import ModuleType

import numpy as np

#: Entries of a worker's cache; a piece longer than this many characters is not kept.
MOST_PIECES, LONGEST_PIECE = 1_000_000, 64
#: The word BPE's steps before its model, and its mark of a word's end.
WORD_STEPS = (
    ("NFC", "Replace", "Lowercase"), ("Split", "ByteLevel"),
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
)
WORD_END = "</w>"
#: Characters that those steps do nothing to but lower-case and cut, and the cut of what is lower-cased.
PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


class WordIds:
    """Ids of plain texts by their words, for a word BPE whose steps are ``WORD_STEPS``."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.model = Tokenizer.from_file(file)
        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.known: dict[str, bytes] = {}

    @staticmethod
    def fits(tokenizer) -> bool:
        """Whether the tokenizer takes exactly the steps that ``PLAIN`` is made for."""
        spec = json.loads(tokenizer.to_str())
        before, split = spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
        cuts = split.get("pretokenizers") or [{}]
        return (
            (tuple(n["type"] for n in before.get("normalizers", ())), tuple(c.get("type") for c in cuts), cuts[0].get("pattern", {}).get("Regex")) == WORD_STEPS
            and (cuts[0]["behavior"], cuts[0]["invert"]) == ("Removed", True)
            and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]
            and spec["model"].get("end_of_word_suffix") == WORD_END and not spec["model"].get("ignore_merges")
            and all(t["content"].startswith("<|") and not t["normalized"] for t in spec["added_tokens"])
        )

    @staticmethod
    def plain(text: str) -> bool:
        return PLAIN.fullmatch(text) is not None and "<|" not in text

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that are all ``plain``."""
        if len(self.known) > MOST_PIECES:
            self.known.clear()
        cut = [WORDS.findall(t.lower()) for t in texts]
        new = list(set().union(*cut).difference(self.known))
        for at in range(0, len(new), 256):
            some = new[at : at + 256]
            ids = np.array(self.model.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(some):
                cuts, ids = [0, *(4 * ends).tolist()], ids.tobytes()
                self.known.update(zip(some, [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], strict=True))
            else:
                self.known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(some, self.model.encode_batch_fast(some, add_special_tokens=False), strict=True))
        get = self.known.__getitem__
        out = [b"".join(map(get, words)) for words in cut]
        for w in new:
            if len(w) > LONGEST_PIECE:
                del self.known[w]
        return out


class IdCache:
    """Ids (little-endian unsigned 32-bit) of whole texts by a tokenizers file."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.words = WordIds(file) if WordIds.fits(self.tokenizer) else None
        self.inner: dict[str, bytes | bool] = {}
        self.first: dict[str, bytes] = {}
        # byte-level BPE writes the space as a letter of its own, so tokens tell where a piece begins
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.words is None:
            return self._by_pieces(texts)
        plain = list(map(self.words.plain, texts))
        words, others = iter(self.words.encode(list(compress(texts, plain)))), iter(self._by_pieces([t for t, p in zip(texts, plain, strict=True) if not p]))
        return [next(words if p else others) for p in plain]

    def _by_pieces(self, texts: list[str]) -> list[bytes]:
        if len(self.inner) > MOST_PIECES:
            self.inner.clear()
        if len(self.first) > MOST_PIECES:
            self.first.clear()
        split = [t.split(" ") for t in texts]
        new = list({p[0] for p in split if p[0]}.difference(self.first))
        self.first.update(zip(new, (np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        missing: set[str] = set()
        get, known = self.inner.get, []
        for pieces in split:  # one look-up a piece; only texts with a new piece are gone through again
            found = list(map(get, pieces[1:]))
            if None in found:
                missing.update(p for p, f in zip(pieces[1:], found, strict=True) if f is None)
                found = None
            known.append(found)
        self._learn(list(missing))
        out = []
        for text, pieces, found in zip(texts, split, known, strict=True):
            try:
                if pieces[0] != pieces[0].rstrip() or (len(pieces) > 1 and not pieces[0]):
                    raise TypeError
                found = map(get, pieces[1:]) if found is None else found
                out.append((self.first[pieces[0]] if pieces[0] else b"") + b"".join(found))
            except TypeError:  # a piece has white space at its edge
                out.append(self._direct(text))
        for p in missing:
            if len(p) > LONGEST_PIECE:
                del self.inner[p]
        for p in new:
            if len(p) > LONGEST_PIECE:
                del self.first[p]
        return out

    def _direct(self, text: str) -> bytes:
        if not text:
            return b""
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Keep the ids of the pieces, each after a space; False marks those that can't stand alone."""
        safe = []
        for p in pieces:
            if not p or p[0].isspace() or p[-1].isspace():
                self.inner[p] = False
            else:
                safe.append(p)
        for at in range(0, len(safe), 4000):
            some = safe[at : at + 4000]
            joined = " " + " ".join(some)
            if self.begins.any():
                ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
                cuts = np.flatnonzero(self.begins[ids])
                if len(cuts) == len(some):
                    cuts, ids = (4 * np.append(cuts, len(ids))).tolist(), ids.tobytes()
                    self.inner.update(zip(some, [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], strict=True))
                    continue
            starts = np.cumsum([0] + [len(p) + 1 for p in some])
            encoding = self.tokenizer.encode(joined, add_special_tokens=False)
            ids = np.array(encoding.ids, "<u4").tobytes()
            begins = np.array([o[0] for o in encoding.offsets], np.int64)
            cuts = (4 * np.searchsorted(begins, starts)).tolist()
            self.inner.update(zip(some, [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], strict=True))


class LengthCache:
    """Token counts of whole texts by a sentencepiece file: frequent pieces first, then a worker's cache."""

    def __init__(self, file: str, frequent: dict[str, int]):
        from sentencepiece import SentencePieceProcessor

        self.processor = SentencePieceProcessor(model_file=file)
        self.frequent, self.cache = frequent, {}
        self.known = dict(frequent)

    def lengths(self, pieces: list[str]) -> list[int | None]:
        """Of pieces after a space; None marks those that can't stand alone."""
        safe = [p for p in pieces if p and p[0] != "▁" and p[-1] != "▁"]
        found = dict(zip(safe, map(len, self.processor.encode(safe, num_threads=1)), strict=True)) if safe else {}
        return [found.get(p) for p in pieces]

    def count(self, texts: list[str]) -> list[int]:
        if len(self.known) > MOST_PIECES:
            self.known = dict(self.frequent)
        split = [t.split(" ") for t in texts]
        missing: set[str] = set()
        for pieces in split:
            missing.update(filterfalse(self.known.__contains__, pieces))
        new = list(missing)
        self.known.update(zip(new, self.lengths(new), strict=True))
        get, out = self.known.__getitem__, []
        for text, pieces in zip(texts, split, strict=True):
            try:
                out.append(sum(map(get, pieces)) if text else 0)
            except TypeError:  # a run of spaces, or a mark next to one
                out.append(len(self.processor.encode(text)))
        for p in missing:
            if len(p) > LONGEST_PIECE:
                del self.known[p]
        return out


def _caches() -> dict:
    """This worker's caches. Functions reach workers by value, so the dict hangs on a module of its own."""
    name = "_panelgraph_caches"
    if name not in sys.modules:
        sys.modules[name] = ModuleType(name)
        sys.modules[name].held = {}
    return sys.modules[name].held


def id_cache(file: str) -> IdCache:
    """This worker's cache for a tokenizer file."""
    held, key = _caches(), ("ids", file, Path(file).stat().st_mtime)
    if key not in held:
        held[key] = IdCache(file)
    return held[key]


def length_cache(file: str, token: str, load) -> LengthCache:
    """This worker's cache for a model file and the frequent-piece table that ``token`` names."""
    held, key = _caches(), ("lengths", file, token)
    if key not in held:
        for old in [k for k in held if k[0] == "lengths"]:
            del held[old]
        held[key] = LengthCache(file, load())
    return held[key]


def groups(texts: list[str | None], most: int = 1 << 20):
    """Runs of texts (null as empty) of about ``most`` characters, so work space stays small."""
    run, size = [], 0
    for t in texts:
        run.append(t or "")
        size += len(run[-1])
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run
