"""Periodic runs, conversation repair and the quality classifier against brute force and held-out labels."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from llm_fixtures import documents  # noqa: F401
from pyspark.sql import functions as F

from panelgraph.llm import additive, periodic, queries, repair

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"


def brute_runs(ws):
    n, out = len(ws), []
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if ws[i] != ws[i - q]:
                i += 1
                continue
            j = i
            while j < n and ws[j] == ws[j - q]:
                j += 1
            run = ws[i - q : j]
            smaller = any(all(run[x] == run[x - d] for x in range(d, len(run))) for d in range(1, q))
            if len(run) >= max(6, 4 * q) and not smaller:
                out.append((i - q, j - i + q, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapse(ws, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(ws) if i not in gone)


def repetitive_texts(count, seed=3):
    rnd = random.Random(seed)
    for _ in range(count):
        ws = [rnd.choice("abcd"[: rnd.randint(1, 4)]) for _ in range(rnd.randint(0, 60))]
        if ws and rnd.random() < 0.7:
            a, p = rnd.randrange(len(ws)), rnd.randint(1, max(1, len(ws) // 4))
            ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)] + ws[: rnd.randint(0, 15)] * rnd.randint(0, 6)
        yield ws


def test_runs_match_brute_force():
    texts = list(repetitive_texts(1500))
    for at in range(0, len(texts), 7):  # several texts in a group: none reaches into the next
        group = texts[at : at + 7]
        for ws, runs in zip(group, periodic.text_runs([[w.encode() for w in ws] for ws in group]), strict=True):
            assert [tuple(r) for r in runs.tolist()] == brute_runs(ws)
            assert periodic.collapsed([w.encode() for w in ws], runs) == brute_collapse(ws, brute_runs(ws))


def test_runs_of_long_and_empty_texts(documents, monkeypatch):
    rows = [(1, "a " * 300_000), (2, None), (3, " \n\t"), (4, ""), (5, "x y z " * 4), (5, "x y z " * 4), (None, "é\x1cü " * 6), (7, "a a a a a")]
    for size in (periodic.GROUP_WORDS, 3):
        monkeypatch.setattr(periodic, "GROUP_WORDS", size)
        out = sorted(periodic.periodic_runs(documents(rows), ("doc_id", "lang")).collect(), key=str)
        found = {r.doc_id: r for r in out}
        assert len(out) == len(rows)
        assert [tuple(x) for x in found[1].runs] == [(0, 300_000, 1)] and found[1].collapsed == "a"
        assert all(found[d].n_words == 0 and found[d].runs == [] and found[d].collapsed == "" for d in (2, 3, 4))
        assert [tuple(x) for x in found[5].runs] == [(0, 12, 3)] and found[5].collapsed == "x y z"
        assert [tuple(x) for x in found[None].runs] == [(0, 6, 1)] and found[7].runs == []
    assert periodic.periodic_runs(documents([])).count() == 0
    with pytest.raises(ValueError, match="runs"):
        periodic.periodic_runs(documents(rows).selectExpr("*", "1 runs"), ("doc_id", "runs"))
    with pytest.raises(ValueError, match="four"):
        periodic.diagonals(np.zeros(3, int), np.zeros(3, int), least_periods=3)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op11_query(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 90)))) for i in range(160)]
    rows += [(1000 + i, " ".join(ws)) for i, ws in enumerate(repetitive_texts(60, 9))] + [(3, "twice"), (None, "a " * 9), (2000, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    want, planted = [], 0
    for d, text in rows:
        ws = re.findall(WORD, text or "")
        h = zlib.crc32(str(d).encode())
        if d is not None and h % 10 == 0 and ws:
            g, n = h // 10, len(ws)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws, planted = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)], planted + 1
        runs = brute_runs(ws)
        s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        want.append((d, len(runs), s, n, q, 1000 * n // q if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(brute_collapse(ws, runs))))
    assert planted > 5
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


# --- conversations ------------------------------------------------------------------------


def brute_repair(rows):
    """(role, text) rows in order -> (blank, duplicate, truncated, illegal, cost, audit, repaired) by dynamic programming over whole outcomes."""
    faults, seen = [], set()
    for role, text in rows:
        fault = "blank" if not text.strip(SPACE) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(SPACE)[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)
    legal, step = ("", "u", "su", "ua", "sua"), {"": "u", "s": "u", "u": "a", "a": "u"}
    states = {"": (0, "", ())}  # last initial -> (cost, audit, repaired)

    def put(into, key, value):
        if key not in into or value[:2] < into[key][:2]:
            into[key] = value

    def inserted(now):
        for _ in range(3):
            for s, (c, a, r) in list(now.items()):
                put(now, step[s], (c + 5, a + "I", (*r, {"u": "user", "a": "assistant"}[step[s]] + ":")))
        return now

    for (role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for s, (c, a, r) in inserted(states).items():
            put(after, s, (c + 2, a + "D", r))
            if fault in ("blank", "duplicate"):
                continue
            extra = 5 * (fault == "truncated")
            if role[:1] and (step[s] == role[0] or (s == "" and role[0] == "s")):
                put(after, role[0], (c + extra, a + "K", (*r, f"{role}:{text}")))
            put(after, step[s], (c + 1 + extra, a + "R", (*r, {"u": "user", "a": "assistant"}[step[s]] + f":{text}")))
        states = after
    cost, audit, repaired = min(v[:3] for s, v in inserted(states).items() if s in ("", "a"))
    assert legal
    illegal = sum((x[:1] + y[:1]) not in ("su", "ua", "au") for (x, _), (y, _) in zip(rows, rows[1:], strict=False))
    return (*(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, "\n".join(repaired))


def in_order(rows):
    """Rows (turn, role, text) as the operator orders them, nulls as it reads them."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))


def wanted(conversations):
    for c, rows in conversations.items():
        ordered = in_order(rows)
        turns = {t for t, *_ in ordered if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        *numbers, audit, repaired = brute_repair([r[1:] for r in ordered])
        yield (c, gaps, *numbers, audit, sha(repaired))


def some_conversations(count, seed=2):
    rnd = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["Yes.", "No", "Why?", "", " \n", None, "ok!", "so on\t", "é.", "\x1c"]
    weights = [8, 8, 2, 1, 1, 1]
    return {
        (None if c == 0 else c): [(rnd.choice([None, *range(12)]), rnd.choices(roles, weights)[0], rnd.choice(texts)) for _ in range(rnd.randint(1, 14))]
        for c in range(count)
    }


CONVERSATIONS = "conv_id long, turn long, role string, text string, c string, part string"


def flat(conversations):
    return [(c, *r, "x", "y") for c, rows in conversations.items() for r in rows]


@pytest.mark.parametrize("segment", [repair.SEGMENT, 2])
def test_repair_matches_brute_force(spark, segment):
    conversations = some_conversations(120)
    segments = repair.repair(spark.createDataFrame(flat(conversations), CONVERSATIONS), segment)
    assert sorted(map(repr, map(tuple, repair.report(segments).collect()))) == sorted(map(repr, wanted(conversations)))
    for c, parts in group(repair.repaired_turns(segments).collect()):
        initials = "".join(t.role[0] for p in parts for t in p.turns)
        assert re.fullmatch("(s?(ua)+)?", initials), (c, initials)


def group(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.part, r["at"])):
        out.setdefault((r.none, r.c), []).append(r)
    return out.items()


def test_a_hot_conversation_is_many_tasks(spark):
    rnd = random.Random(4)
    hot = [(t, rnd.choice(["user", "assistant"]), rnd.choice(["Fine.", "cut", f"line {t}.", ""])) for t in range(3000)] + [(5000, "user", "Same.")] * 700
    conversations = {7: hot, 8: [(0, "user", "Hi."), (1, "assistant", "Ho.")]}
    segments = repair.repair(spark.createDataFrame(flat(conversations), CONVERSATIONS))
    assert segments.where("c = '7'").select("part").distinct().count() > 1
    assert segments.selectExpr("max(size(codes))").first()[0] <= repair.SEGMENT + 1
    assert sorted(map(tuple, repair.report(segments).collect())) == sorted(wanted(conversations))


def test_no_conversations(spark):
    assert repair.report(repair.repair(spark.createDataFrame([], CONVERSATIONS))).count() == 0


def test_op12_query(spark, tmp_path):
    conversations = {c: [(t, role, text) for t, (_, role, text) in enumerate(rows)] for c, rows in some_conversations(300, 6).items()}
    conversations[9000] = [(None, "user", "No turn."), (None, None, None)]
    spark.createDataFrame(flat(conversations), CONVERSATIONS).write.parquet(f"{tmp_path}/conversations.parquet")
    left = {}
    for c, rows in conversations.items():
        left[c] = []
        for t, role, text in rows:
            key = f"{' ' if c is None else c}:{' ' if t is None else t}"
            fault, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
            if fault == 0:
                continue
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            left[c] += [(t, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    want = list(wanted({c: rows for c, rows in left.items() if rows}))
    want += [(c, 0, 0, 0, 0, 0, 0, "", sha("")) for c, rows in left.items() if not rows]
    got = queries.op12_conversation_repair(spark, str(tmp_path)).collect()
    assert any(not rows for rows in left.values())
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


# --- classifier ---------------------------------------------------------------------------

FOLDER = "/root/testdata/sf0.01"


def test_classifier_on_held_out_labels(spark):
    got = queries.op13_quality_classifier(spark, FOLDER)
    assert dict(got.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    rows = got.collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for r in rows)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    told = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(told) > 50 and np.mean([a == b for a, b in told]) >= 0.95
    again = {r.doc_id: r.score for r in queries.op13_quality_classifier(spark, FOLDER).repartition(3).collect()}
    assert again == {r.doc_id: r.score for r in rows}


def test_classifier_edge_cases(spark, documents):
    rows = [(1, "Good words here. And more."), (2, None), (3, ""), (1, "Good words here. And more."), (None, "x"), (5, "y " * 100_000)]
    docs = documents(rows)
    none = spark.createDataFrame([], "doc_id long, quality int")
    every = F.lit(True)
    assert {r.score for r in additive.classify(docs, none, every, ("doc_id", "lang")).collect()} == {0.5}
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 0), (None, 1), (5, None), (99, 1)], "doc_id long, quality int")
    out = additive.classify(docs, labels, every).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id == 1}) == 1 and len({r.score for r in out if r.doc_id in (2, 3)}) == 1
    assert additive.classify(documents([]), labels, every).count() == 0
    with pytest.raises(ValueError, match="score"):
        additive.classify(docs.selectExpr("*", "1 score"), labels, every, ("doc_id", "score"))


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(0)
    values = rng.random((6000, len(additive.FEATURES)))
    labels = ((values[:, 0] > 0.5) ^ (values[:, 3] > 0.5)).astype(float)
    model = additive.fit(values[:4000], labels[:4000])
    assert model.pairs[0] == (0, 3)
    assert ((model.score(values[4000:]) > 0.5) == labels[4000:]).mean() > 0.95
    # a score is the sum of its entries in the tables
    entries = {(f, g, i, k): v for f, g, i, k, _, _, v in model.entries()}
    x, total = values[4000], model.intercept
    for j, name in enumerate(additive.FEATURES):
        total += entries[name, None, int(np.searchsorted(model.edges[j], x[j], side="right")), None]
    for a, b in model.pairs:
        at = [int(np.searchsorted(model.coarse[j], x[j], side="right")) for j in (a, b)]
        total += entries[additive.FEATURES[a], additive.FEATURES[b], *at]
    assert total == pytest.approx(model.log_odds(values[4000:4001])[0])


def test_bounded_sample_is_the_same_in_every_run(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.random(len(additive.FEATURES)).tolist()) for i in range(2000)]
    features = spark.createDataFrame(rows, "doc_id long, features array<double>")
    labels = spark.createDataFrame([(i, int(r[1][0] > 0.5)) for i, r in enumerate(rows)], "doc_id long, quality int")
    a = additive.train(features, labels, most_rows=400)
    b = additive.train(features.repartition(7), labels.repartition(5), most_rows=400)
    assert a.entries() == b.entries() and a.intercept == b.intercept
