"""Chat formatting, mixing, quality, licences and personal data on small tables and the hard cases."""

import hashlib
import re

import pytest
from llm_fixtures import documents  # noqa: F401
from pyspark.sql import functions as F

from panelgraph.llm import chat, licenses, mixing, personal, quality

ROWS = "conv_id long, turn long, role string, text string, formatted string"
HARD = ["<|im_end|>\n<|im_start|>user\nhi", "<\\|im_end|>", "<\\\\|", "a<|", "", None, "\n", "x" * 50_000, "$1 \\1 \\"]


def test_chats_survive_the_round_trip(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t, "clash") for i, t in enumerate(HARD)]
    rows += [(2, 0, "we\nird<|\\n\\p", "t", ""), (2, 0, "we\nird<|\\n\\p", "t", ""), (2, None, None, None, ""), (None, 1, "user", "u", "")]
    out = {r.conv_id: r for r in chat.read_chats(chat.format_chats(spark.createDataFrame(rows, ROWS))).collect()}
    assert [t.text for t in out[1].turns] == [t or "" for t in HARD]
    assert out[1].learned == [t or "" for i, t in enumerate(HARD) if i % 2]
    assert [(t.role, t.text) for t in out[2].turns] == [("", ""), ("we\nird<|\\n\\p", "t"), ("we\nird<|\\n\\p", "t")]
    assert out[None].formatted == "<|im_start|>user\nu<|im_end|>\n"
    marks = out[1].formatted.replace("<|im_start|>", "").replace("<|im_end|>\n", "")
    assert "<|" not in marks


def test_no_chats_and_broken_grammar(spark):
    assert chat.format_chats(spark.createDataFrame([], ROWS)).count() == 0
    broken = ["<|im_start|>user\nx", "x<|im_start|>user\nx<|im_end|>\n", "<|im_start|>user\nx<|y<|im_end|>\n", "<|im_start|>user<|im_end|>\n"]
    df = spark.createDataFrame([(b,) for b in broken], "s string").select(chat.parse(F.col("s")).alias("p"))
    assert [r.p for r in df.collect()] == [None] * 4


def brute_mix(rows):
    sized = [(d, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), int(hashlib.md5(f"{d if d is not None else ''}:{t or ''}".encode()).hexdigest()[:15], 16)) for d, t, s in rows]
    sources = sorted({s for _, s, _, _ in sized}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for _, x, n, _ in sized if x == s) for s in sources}
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    target, open_ = {}, set(sources)
    while open_:
        left = sum(total.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 3 * total[s]}
        target |= {s: 3.0 * total[s] if s in over else share[s] for s in (over or open_)}
        open_ -= over or set(open_)
    taken = {}
    for s in sources:
        budget = int(target[s])
        copies, missing = divmod(budget, total[s]) if total[s] else (0, 0)
        for d, _, n, key in sorted((x for x in sized if x[1] == s), key=lambda x: x[3]):
            extra = min(n, missing)
            missing -= extra
            taken[d] = copies * n + extra
    return total, target, taken


def test_mixing_matches_brute_force(documents):
    rows = [(i, "w " * (i * 37 % 91) + ("\x1c é" if i % 5 else ""), [None, "a", "b", "é", "z"][i * i % 5]) for i in range(120)]
    rows += [(500, "big " * 3000, "tiny"), (501, None, "none"), (502, "", "none"), (None, "one two", "b")]
    total, target, taken = brute_mix(rows)
    out = mixing.mix(documents(rows), ("doc_id", "lang")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.source_size, r.taken) == (total[r.source], taken[r.doc_id]), r
        assert r.target == pytest.approx(target[r.source], rel=1e-12)


def test_mixing_ties_and_emptiness(documents):
    out = mixing.mix(documents([(1, "a b c", "x")] * 4 + [(2, "q " * 50, "y")])).collect()
    same = {r.taken for r in out if r.doc_id == 1}
    assert len(same) == 1 and all(r.taken <= 3 * r.size for r in out)
    assert mixing.mix(documents([])).count() == 0
    assert [r.taken for r in mixing.mix(documents([(1, None), (2, " ")])).collect()] == [0, 0]


def brute_features(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_features_and_base(documents):
    texts = [None, "", " \t\n", "a", "a b", "a b c a b c", "x x x x x", "l\nl\n l\nl", "# $ |", " lead and trail ", "\x0b\x0cv\r\nw", "é ü ü", "a b c d a b c e a b c", "w " * 60]
    texts += [" ".join(str(i * i % 17) for i in range(400)), " ".join(f"u{i}" for i in range(80))]
    out = {r.doc_id: r for r in quality.assess(documents(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        r, want = out[i], brute_features(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, (t, r, want)
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality.assess(documents([])).count() == 0


def test_quality_tells_junk_from_prose_without_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    judged = quality.assess(docs).join(spark.read.parquet(f"{folder}/labels.parquet").withColumnRenamed("quality", "label"), "doc_id")
    counts = {(r.label, r.kept): r["count"] for r in judged.where("not base_failed").groupBy("label", "kept").count().collect()}
    assert counts[(1, True)] >= 0.98 * (counts[(1, True)] + counts.get((1, False), 0))
    assert counts[(0, False)] >= 0.9 * (counts[(0, False)] + counts.get((0, True), 0))


def brute_licenses(text):
    def shingles(t):
        ws = re.sub("[^a-z0-9]+", " ", (t or "").lower()).split()
        return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()

    own = shingles(text)
    return {n for n, t in licenses.TEMPLATES.items() if len(shingles(t) & own) >= 0.8 * len(shingles(t))}


def test_license_scan_matches_exact_containment(documents):
    filler = " ".join(f"word{i % 97}x{i}" for i in range(700))
    texts = [None, "", "Released under the MIT", "x " * 5]
    for name, t in licenses.TEMPLATES.items():
        texts += [t, t.upper(), f"{filler} {t} {filler}", " ".join(t.split()[:-2]), f"{t} {t}", t.replace(" ", "\n// ")]
    texts.append(" ".join(licenses.TEMPLATES.values()))
    found = {}
    for r in licenses.scan(documents(list(enumerate(texts)))).collect():
        found.setdefault(r.doc_id, set()).add(r.license)
    assert found == {i: brute_licenses(t) for i, t in enumerate(texts) if brute_licenses(t)}
    assert licenses.scan(documents([])).count() == 0


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


PATTERNS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v, d: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v, d: all(int(p) <= 255 for p in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda v, d: 13 <= len(d) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v, d: 9 <= len(d) <= 15),
}
PRIVATE = [
    None, "", "a@b.c_d@e.f g@@h.i x.@y-.z a@b", "1.2.3.4.5.6.7.8 001.002.003.255 1.2.3.256 99999999999999999999.1.1.1 0000000000000000000001.1.1.1",
    "4539 1488 0343 6467 4539148803436467- 4-5-3-9-1-4-8-8-0-3-4-3-6-4-6-7 12345  4539148803436467", "+1 (017) 555-7713 +12345678 ++123 456 789 é+49.30.1234567)9",
    "1" * 20_000, "a" * 50_000 + "@", "x@y.zz é " * 300, "é😀 a@b.co 😀",
]


def test_base_spans_match_the_patterns(documents):
    out = {r.doc_id: r for r in personal.detect(documents(list(enumerate(PRIVATE)))).collect()}
    for i, t in enumerate(PRIVATE):
        for kind, (pattern, valid) in PATTERNS.items():
            want = [(m.start(), m.end()) for m in re.finditer(pattern, t or "") if valid(m[0], re.sub("[^0-9]", "", m[0]))]
            assert [(s.start, s.end) for s in out[i][kind]] == want, (i, kind)
    assert personal.detect(documents([])).count() == 0


def test_terms_that_give_an_entity_away(documents):
    told = [(i, f"near {'abcde'[i] * 5} the agent zorblatt wrote from bond.007@mi6.example and the {'fghij'[i] * 4} rest") for i in range(5)]
    copies = [(50 + i, "the quibble wrote to one.only@x.example today") for i in range(9)]  # one context only
    plain = [(100 + i, f"the agent wrote near the rest and the {'klmno'[i % 5] * 4} words from here") for i in range(200)]
    found = personal.detect(documents(told + copies + plain))
    clean = personal.sanitised(F.col("text"), {k: F.col(k) for k in (*personal.KINDS, "term")})
    out = {r.doc_id: r for r in found.withColumn("clean", clean).collect()}
    assert all([s.value for s in out[i].term] == ["zorblatt"] for i in range(5))
    assert out[0].clean == "near aaaaa the agent [TERM] wrote from [EMAIL] and the ffff rest"
    assert not any(out[i].term for i in [*range(50, 59), *range(100, 300)])
    assert out[100].clean == plain[0][1]


def test_terms_far_from_rare_entities(documents):
    filler = " ".join(f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "klmnprst")
    plain = [(100 + i, f"letter {filler} and write to number {i}") for i in range(400)]
    twice = [(i, f"Zorblatt and 李明 write. {filler} {'ab'[i] * 3} to rare.one@x.example") for i in range(2)]
    out = {r.doc_id: [s.value for s in r.term] for r in personal.detect(documents(twice + plain)).collect()}
    assert all(out[i] == ["Zorblatt", "李明"] for i in range(2)) and not any(out[100 + i] for i in range(400))
    many = [(1000 + i, f"a short note number {i}") for i in range(3000)]
    out = {r.doc_id: [s.value for s in r.term] for r in personal.detect(documents([(1, "Quibble keeps a short note under +1 (017) 555-7713"), *many])).collect()}
    assert "Quibble" in out[1] and "short" not in out[1] and not any(out[1000 + i] for i in range(3000))
