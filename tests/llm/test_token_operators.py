"""Token files, token counts, packing, fingerprints, near-duplicates and the pipeline against brute force."""

import bisect
import hashlib
import itertools
import os
import random
import zlib

import numpy as np
import pytest
from llm_fixtures import documents  # noqa: F401
from pyspark.sql import functions as F

os.environ["TOKENIZERS_PARALLELISM"] = "false"
public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from panelgraph.llm import packing, pieces, simhash, sketches, token_counts, token_files  # noqa: E402
from panelgraph.llm.components import connected  # noqa: E402
from panelgraph.llm.tables import Tables  # noqa: E402

HARD = [
    None, "", " ", "  a  b \n c\t<|endoftext|> d  e", "x<|startoftext|>y <|endoftext|>", " lead", "trail ", "a\n b ▁ c▁ d ▁e", "don't  we'll 's 're",
    "é ́a Aİ Σ ÀÉ", "word " * 5000, "q" * 3000, "a b  c \x1cd", "😀 😀😀", "same text", "same text",
]
SENTENCES = [" ".join(random.Random(i).choices("the of and thing tion er in on re, at. (x) 12 é ß".split(), k=20 + i * 7 % 300)) for i in range(40)]
TEXTS = HARD + SENTENCES


def ids_of(name, text, end):
    from tokenizers import Tokenizer

    return np.array(Tokenizer.from_file(public_tokenizers.path(name)).encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_codes_give_any_token():
    rnd = np.random.default_rng(3)
    for ids in ([], [0], [255, 256, 65535, 65536, 2**32 - 1], rnd.integers(0, 70_000, 3000), rnd.integers(0, 200, 1025)):
        ids = np.array(ids, "<u4")
        codes = token_files.Codes(token_files.Codes.pack(ids))
        assert codes.all().tolist() == ids.tolist()
        assert [codes[i] for i in range(0, len(ids), 7)] == ids[::7].tolist()


def test_token_files_round_trip(spark, documents):
    file = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(3 * i - 10, t) for i, t in enumerate(TEXTS)] + [(None, "null id")]
    blocks = token_files.write_tokens(documents(rows), file, 2, Tables(spark, "t"), block_ids=500)
    out = {r.doc_id: r for r in token_files.read_documents(blocks).collect()}
    start, every = 0, []
    for d, t in sorted(rows, key=lambda r: -(10**9) if r[0] is None else r[0]):
        ids = ids_of("byte_bpe_50k.json", t, 2)
        assert (out[d].start, out[d].n_tokens, out[d].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes())), d
        start += len(ids)
        every += ids.tolist()
    places = [0, 1, len(every) - 1, len(every), *range(5, len(every), 501)]
    read = {r.place: r.id for r in token_files.read_places(blocks, spark.createDataFrame([(p,) for p in places], "place long"), cell=300).collect()}
    assert read == {p: every[p] for p in places if p < len(every)}
    assert token_files.read_documents(token_files.write_tokens(documents([]), file, 2, Tables(spark, "t"))).count() == 0


def test_token_counts_are_the_library_s(documents):
    from sentencepiece import SentencePieceProcessor

    model = public_tokenizers.path("piece_bpe_32k.model")
    sp = SentencePieceProcessor(model_file=model)
    out = token_counts.count_tokens(documents(list(enumerate(TEXTS))), model, limit=100).collect()
    assert len(out) == len(TEXTS)
    for r in out:
        t = TEXTS[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(sp.encode(t))), t[:40]
        assert r.over_limit == (r.n_tokens > 100)
    assert token_counts.count_tokens(documents([]), model).count() == 0


def test_packing_places_every_piece_once(documents):
    file = public_tokenizers.path("word_bpe_49k.json")
    out = packing.pack(documents(list(enumerate(TEXTS))), file, 1, capacity=512).collect()
    want = {i: ids_of("word_bpe_49k.json", t, 1) for i, t in enumerate(TEXTS)}
    sequences, seen = {}, set()
    for r in out:
        piece = want[r.doc_id][512 * r.piece : 512 * (r.piece + 1)]
        assert (r.start, r.length, r.ids_crc32) == (512 * r.piece, len(piece), zlib.crc32(piece.tobytes()))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        seen.add((r.doc_id, r.piece))
    assert len(seen) == len(out) == sum(-(-len(ids) // 512) for ids in want.values())
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 512
    assert len(sequences) <= 1.1 * -(-sum(map(len, want.values())) // 512) + 1
    assert packing.pack(documents([]), file, 1).count() == 0


def test_packing_is_best_fit_in_a_few_jobs(spark):
    rnd = random.Random(4)
    lengths = [min(512, 1 + int(rnd.expovariate(1 / 90))) for _ in range(1500)] + [17] * 9000
    gaps, opened = [], 0
    for n in sorted(lengths, reverse=True):  # plain best fit, one by one
        at = bisect.bisect_left(gaps, n)
        gap = gaps.pop(at) if at < len(gaps) else 512
        opened += gap == 512
        bisect.insort(gaps, gap - n)
    spark.sparkContext.setJobGroup("packing", "packing")
    items = spark.createDataFrame(list(enumerate(lengths)), "item long, length long")
    out = packing.best_fit(Tables(spark, "bins"), items, 512).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("packing"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted((r.item, r.length) for r in out) == list(enumerate(lengths)) and jobs < 30
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
    full = [512 - sum(n for _, n in places) for places in sequences.values()]
    assert len(full) == opened and sorted(full) == sorted(gaps)


def shingles(text, k=5):
    ws = (text or "").encode().split()
    return {b" ".join(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()


def test_fingerprints_against_the_next(documents):
    rows = [(7 * i % 101, t) for i, t in enumerate(TEXTS)] + [(None, "last of all")]
    out = {r.doc_id: r for r in sketches.against_next(documents(rows)).collect()}
    order = sorted(rows, key=lambda r: -(10**9) if r[0] is None else r[0], reverse=True)
    for i, (d, t) in enumerate(order):
        t, following = t or "", order[(i + 1) % len(order)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + following[:cut]
        assert (out[d].n_chars, out[d].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert out[d].fingerprint == sketches.encode(sketches.sketch(t)) and out[d].edited_fingerprint == sketches.encode(sketches.sketch(edited))
        for found, other in ((out[d].near_edited, edited), (out[d].near_next, following)):
            a, b = shingles(t), shingles(other)
            assert found == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0, abs=0.15)
    assert sketches.against_next(documents([])).count() == 0
    assert [r.near_next for r in sketches.against_next(documents([(1, "only one")])).collect()] == [1.0]


def test_sketches_merge_and_estimate(documents):
    parts = [" ".join(f"w{i}" for i in range(a, a + 3000)) for a in (0, 1500, 9000)]
    whole = sketches.merge(*map(sketches.sketch, parts))
    assert whole.tolist() == sorted(set().union(*[set(sketches.sketch(p, k=10**6).tolist()) for p in parts]))[: sketches.K]
    assert sketches.distinct(whole) == pytest.approx(7500, rel=0.3)
    a, b = sketches.sketch(parts[0]), sketches.sketch(parts[1])
    assert sketches.resemblance(a, b) == pytest.approx(1 / 3, abs=0.15) and sketches.containment(a, b) == pytest.approx(0.5, abs=0.2)
    empty = sketches.sketch("")
    assert sketches.resemblance(empty, empty) == 1.0 and sketches.resemblance(empty, a) == 0.0 and sketches.containment(empty, a) == 1.0
    prints = sketches.fingerprints(documents([(i, p, "g" if i < 2 else None) for i, p in enumerate(parts)]).repartition(3), ("source",))
    got = {r.group: r.fingerprint for r in sketches.merged(prints, "source").collect()}
    assert got == {"g": sketches.encode(sketches.merge(a, b)), None: sketches.encode(sketches.sketch(parts[2]))}


def classes(values, close):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(values), 2):
        if close(a, b):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_every_five_positions_hold_one_block():
    assert len(simhash.BLOCKS) == 14
    assert all(sum(set(b) <= set(five) for b in simhash.BLOCKS) == 1 for five in itertools.combinations(range(8), 5))


def test_near_duplicates_match_brute_force(documents):
    rnd, rows = random.Random(4), []
    for i, t in enumerate(TEXTS):
        rows.append((100 - i, t))
        if t and len(t.split()) > 60:
            ws = t.split()
            ws[rnd.randrange(len(ws))] = "new"
            rows.append((200 + i, " ".join(ws)))
    out = {r.doc_id: r for r in simhash.near_duplicates(documents(rows)).collect()}
    prints = {d: simhash.simhash(t) for d, t in rows}
    roots = classes(prints, lambda a, b: ((prints[a] ^ prints[b]) & (2**64 - 1)).bit_count() <= 3)
    assert {d: (r.fingerprint, r.component_id) for d, r in out.items()} == {d: (prints[d], roots[d]) for d in prints}
    assert simhash.simhash(None) == simhash.simhash(" \n") == 0
    assert simhash.near_duplicates(documents([])).count() == 0


@pytest.mark.parametrize("long", [1000, 4])
def test_long_lists_lose_no_link(spark, long):
    rnd = random.Random(5)
    values = {rnd.getrandbits(64)}
    while len(values) < 14:
        v = rnd.choice(sorted(values))
        for _ in range(rnd.randint(1, 4)):
            v ^= 1 << rnd.randrange(16)
        values.add(v)
    signed = {(v ^ (1 << 63)) - (1 << 63) for v in values}
    tables = Tables(spark, "long")
    found = connected(tables, simhash.links(tables, spark.createDataFrame([(v,) for v in signed], "fp long"), long))
    got = {r.node: r.root for r in found.collect()}
    want = classes(signed, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
    assert all(got.get(v, v) == r for v, r in want.items())


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 60)] + [(5, 5)]
    got = {r.node: r.root for r in connected(Tables(spark, "cc"), spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(1000, 1060), 1000)}


def test_near_copies_of_four_fifths(documents):
    rnd = random.Random(9)
    base = [" ".join(f"{rnd.choice('abcdefgh')}{rnd.randrange(4000)}" for _ in range(300)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base):
        ws = t.split()
        for k in (60, 180, 240):
            ws[k] = "edit"
        rows += [(100 + i, " ".join(ws)), (200 + i, t)]
    rows += [(900, None), (901, "")]
    out = {r.doc_id: r.component_id for r in simhash.near_copies(documents(rows)).collect()}
    assert sum(out[100 + i] == i for i in range(12)) >= 11 and all(out[200 + i] == out[i] == i for i in range(12))
    assert out[900] == out[901] == 900
    kept = simhash.representatives(documents([*rows, rows[0]]), ("doc_id", "text")).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(out.values()))
    assert simhash.near_copies(documents([])).count() == 0


def test_representatives_without_or_with_repeated_ids(documents):
    text = lambda name, *edits: " ".join("edit" if i in edits else f"{name}{i}" for i in range(200))
    rows = [(None, text("a")), (None, text("b")), (None, text("b", 9)), (None, text("c")), (3, text("c", 90)), (5, text("d")), (5, text("e")), (None, None), (5, text("e"))]
    kept = simhash.representatives(documents(rows), ("doc_id", "text")).collect()
    names = sorted((r.doc_id or 0, (r.text or "-")[0]) for r in kept)
    assert names == [(0, "-"), (0, "a"), (0, "b"), (3, "c"), (5, "d"), (5, "e")]


def test_near_copies_are_decided_on_whole_shingle_sets(documents):
    rows, want = [], {}
    for i, cut in enumerate([120, 150, 170, 199, 200, 201, 203, 210, 230, 250] * 3):  # 1 - cut / 1000 of 1000 shingles
        base = [f"t{i}w{j}" for j in range(1004)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[: 1004 - cut]))]
        want |= {2 * i: 2 * i, 2 * i + 1: 2 * i if cut <= 200 else 2 * i + 1}
    docs = documents(rows)
    tables, node = Tables(docs.sparkSession, "alike"), {r.doc_id: r.node for r in docs.select("doc_id", F.xxhash64("text").alias("node")).collect()}
    pairs = [(node[2 * i], node[2 * i + 1]) for i in range(len(rows) // 2)]
    held = docs.sparkSession.createDataFrame([(node[d], bytearray(sketches.sketch(t).tobytes())) for d, t in rows], "node long, sketch binary")
    found = {(r.u, r.v) for r in simhash._alike(tables, "found", docs.sparkSession.createDataFrame(pairs, "a long, b long"), held, docs, 0.8).collect()}
    assert found == {p for i, p in enumerate(pairs) if want[2 * i + 1] == 2 * i}


def test_passages_replaced_appended_and_cut_are_found(documents):
    rows = []
    for i in range(60):
        ws = [f"d{i}w{j}" for j in range(504)]
        new = [f"n{i}w{j}" for j in range(120)]
        edits = [ws[:-50] + new[:50], ws + new, ws[:-95], new[:50] + ws[50:], ws[:200] + new[:46] + ws[246:]]  # 0.81 to 0.83
        rows += [(10 * i + k, " ".join(t)) for k, t in enumerate([ws, *edits])]
    found = {r.doc_id: r.component_id for r in simhash.near_copies(documents(rows)).collect()}
    for d, t in rows:
        a, b = shingles(rows[d // 10 * 6][1]), shingles(t)
        assert len(a & b) >= 0.8 * len(a | b)
    assert found == {d: d // 10 * 10 for d, _ in rows}


def test_pairs_of_a_large_group_are_not_all_compared(documents, monkeypatch):
    rnd = random.Random(11)
    base = [f"b{j}" for j in range(400)]
    rows = [(0, " ".join(base)), (1, None), (2, "  "), (3, "one"), (4, "one  ")]
    for i in range(80):
        ws = list(base)
        for k in rnd.sample(range(400), 14 if i % 8 else 4):  # far from the original and from one another, or near both
            ws[k] = f"e{i}w{k}"
        rows += [(10 + i, " ".join(ws))] + [(200 + i, " ".join(ws[:-6]))] * (i % 10 == 1)  # some have a near copy of their own
    compared, alike = [], simhash._alike
    monkeypatch.setattr(simhash, "_alike", lambda tables, name, pairs, *rest: compared.append(pairs.count()) or alike(tables, name, pairs, *rest))
    found = {r.doc_id: r.component_id for r in simhash.near_copies(documents(rows)).collect()}
    sets = {d: shingles(t) for d, t in rows}
    assert found == classes(sets, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert sum(compared) < 5 * len(rows)


def test_copies_of_a_lost_original_are_not_all_compared(documents, monkeypatch):
    rnd = random.Random(12)
    rows = []
    for i in range(240):  # each near the original, which is missing, and most of them far from one another
        ws = [f"b{j}" for j in range(150)]
        for k in rnd.sample(range(2, 148, 5), 3 - (i % 20 == 0)):
            ws[k] = f"e{i}w{k}"
        rows.append((i, " ".join(ws)))
    compared, alike = [], simhash._alike
    monkeypatch.setattr(simhash, "_alike", lambda tables, name, pairs, *rest: compared.append(pairs.count()) or alike(tables, name, pairs, *rest))
    found = {r.doc_id: r.component_id for r in simhash.near_copies(documents(rows)).collect()}
    sets = {d: shingles(t) for d, t in rows}
    assert found == classes(sets, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert sum(compared) < 5 * len(rows)


def test_parities_differ_by_no_more_than_the_shingles():
    rnd = random.Random(13)
    for n in (0, 1, 40, 146, 400, 3000):
        a = np.array([rnd.getrandbits(64) for _ in range(n)], "<u8")
        for own in (0, 1, 15, 60):
            b = np.concatenate([a[min(own, n):], np.array([rnd.getrandbits(64) for _ in range(own)], "<u8")])
            turned = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(simhash.parities(a), simhash.parities(b), strict=True))
            assert turned <= len(set(a.tolist()) ^ set(b.tolist())) and (turned or not own)


def test_strangers_of_the_same_words_do_not_hide_copies(documents):
    sentence = [" ".join(f"s{k}w{j}" for j in range(40)) for k in range(30)]
    swapped = [*sentence[1::-1], *sentence[2:]]
    rows = [(1, " ".join(sentence).upper()), (2, " ".join(sentence)), (3, " ".join(swapped)), (4, " ".join(sentence[::-1]).upper()), (5, None), (6, " \n")]
    chain = [f"c{j}" for j in range(700)]
    rows += [(10 + k, " ".join(chain[60 * k : 60 * k + 400])) for k in range(6)]  # near the neighbours only: 0.74
    rows += [(20 + k, " ".join(chain[40 * k : 40 * k + 400])) for k in range(7)]  # 0.82 with the neighbours, 0.66 beyond
    found = {r.doc_id: r.component_id for r in simhash.near_copies(documents(rows)).collect()}
    sets = {d: shingles(t) for d, t in rows}
    assert found == classes(sets, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))


def test_pipeline_stages_take_effect(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen, columns = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES[:4]:
        path = Tables(spark, "stage").path(name)
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        seen.append(docs.count())
        if name == "personal_data":
            assert not docs.where(F.col("text").rlike(r"[a-z]\.[0-9]+@mail[0-9]")).count()
    assert seen[0] > seen[1] > seen[2] == seen[3]
    packed = corpus_pipeline.run(spark, folder)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
    assert packed.where("piece = 0").count() == seen[4]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_words_of_plain_texts_are_learnt_once():
    cache = pieces.IdCache(public_tokenizers.path("word_bpe_49k.json"))
    odd = [
        "It's 'S thing, DON'T we'LL .'s x's'd a_b __ 12 3.4e5 'rev'em", "", " ", "\t\r\n", "  two  spaces\nLine ", "Ünïcöde STRASSE straße ÿÀÖØ", "a<b <| c", "x<|endoftext|>y",
        "<|startoftext|>", "×÷ªº¿ soft­hyphen", "no break", "é é", "İI ſ ẞ ΣΑΣ", "日本 語 text", "\x0b\x0c\x1c\x85", "q" * 200 + " " + "'" * 100, "!?..,;'\"#$%&()*+-/:=@[]^`{}~|\\",
    ]
    for _ in range(2):
        for text, code in zip(odd, cache.encode(odd), strict=True):
            assert np.frombuffer(code, "<u4").tolist() == cache.tokenizer.encode(text, add_special_tokens=False).ids, text
    cache = pieces.IdCache(public_tokenizers.path("word_bpe_49k.json"))
    asked, model = [], cache.words.model

    class Counted:
        def encode_batch_fast(self, texts, **options):
            asked.extend(w for t in texts for w in t.split(" "))
            return model.encode_batch_fast(texts, **options)

    cache.words.model = Counted()
    cache.encode(["Word word, WORD. word\nWord", "(word) 'word'"])  # eight pieces, one word
    assert sorted(asked) == sorted(["word", ",", ".", "(", ")", "'"]) and not cache.inner and not cache.first
