"""Each operator against brute force, an exact round trip or held-out accuracy, and on awkward rows."""

from __future__ import annotations

import base64
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import bloom_lookup, components, hmm, langid, licences, minhash, packing, suffixes, token_store, warc, winnowing
from gridloom.llm.common import held_out, words_of
from gridloom.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, keys string"
LONG = " ".join(f"word{k % 977} Tail{k}" for k in range(9000))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "en", "s", 0, "clash", "clash") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and blank texts, repeated rows, an id of two texts, null ids and one very long text."""
    rng = random.Random(3)
    base = " ".join(rng.choice(["Alpha", "beta", "gamma", "delta", "épsilon", "zeta", "42"]) + str(rng.randrange(40)) for _ in range(300)) + ".\nNext line. And more"
    near = base.replace("zeta", "eta", 1)
    rows = [(1, base), (2, base), (2, base), (3, near), (4, None), (5, ""), (6, " \t\n"), (7, "one"), (8, "one two"), (9, LONG), (9, "other text of the id"), (None, base), (None, None), (10, "ONE"), (11, "<|endoftext|> _x_ ½ ² a_b"), (12, "é" * 500), (13, "x" + "é" * 500)]
    return frame(spark, rows).cache(), rows


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [])


# ------------------------------------------------------------------ 1: language


def test_language_held_out(spark):
    rng = random.Random(1)
    stems = {"aa": ["kal", "tor", "min", "sak"], "bb": ["eau", "oui", "lle", "que"]}
    word = lambda s: "".join(rng.choice(stems[s]) for _ in range(rng.randrange(1, 4)))
    rows = [(k, " ".join(word(s) for _ in range(12)), s) for k in range(400) for s in [rng.choice(["aa", "bb"])]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held_out", held_out("doc_id", 4))
    model = langid.fit(docs.where("not held_out"))
    found = langid.identify(docs, model).where("held_out").collect()
    assert found and all(r.lang == r.lang_pred and 0 <= r.score <= 1 for r in found)
    scorer = langid.Scorer(model)
    assert scorer.predict("Minkaltorx")[0] == "aa" and scorer.predict("ouiqueeau zz")[0] == "bb"


def test_language_awkward(awkward, nothing):
    docs, rows = awkward
    model = langid.fit(docs)
    found = langid.identify(docs.withColumn("score", F.lit("clash")), model).collect()
    assert len(found) == len(rows)
    assert {r.lang_pred for r in found if not any(c.isalpha() for c in r.text or "")} == {"und"}
    none = langid.fit(nothing)
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(nothing, model).count() == 0


def test_letters_are_letters_and_marks_stay_inside():
    assert langid.words("½ 3 ²² Ⅷ ① 12") == []
    assert langid.words("हिन्दी भाषा-İx") == ["हिन्दी", "भाषा", "i\u0307x"]


def test_language_fit_counts_terms_as_plain_code_does(spark):
    rows = [(1, "aab ab", "x"), (2, "ab b " + "q" * 9000, "x"), (3, "ba", "y"), (3, "ba", "y"), (4, "zz", None), (5, None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole, part = langid.fit_subsets(docs, [F.lit(True), F.col("doc_id") != 2])
    for model, own in ((whole, rows), (part, [r for r in rows if r[0] != 2])):
        for kind in (0, *langid.ORDERS):
            counts = {}
            for _, text, lang in own:
                for w in langid.words(text) if lang else []:
                    for term in [w] if kind == 0 else langid.grams(w, kind):
                        counts[lang, term] = counts.get((lang, term), 0) + 1
            below = {g: sum(n for (lang, _), n in counts.items() if lang == g) + 0.5 * len(counts) for g in ("x", "y")}
            assert set(model["rows"][kind]) == {t for _, t in counts}
            for term, k in model["rows"][kind].items():
                want = [np.log((counts.get((g, term), 0) + 0.5) / below[g]) for g in ("x", "y")]
                assert np.allclose(model["tables"][kind][k], want, atol=1e-5)


def test_language_of_long_texts_in_chunks_and_small_memo(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "kal tor min", "aa"), (2, "eau oui lle", "bb")], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    text = "kal tor ouiz 5 min " * 400
    want = langid.Scorer(model, known=True).predict(text)
    monkeypatch.setattr(langid, "CHUNK", 7)
    monkeypatch.setattr(langid, "MEMO_BYTES", 300)
    got = langid.Scorer(model, known=True).predict(text)
    assert got[0] == want[0] == "aa" and np.allclose(got[1:], want[1:])


# ------------------------------------------------------------------ 2: language model


def test_hidden_markov_model_is_exact():
    rng = np.random.default_rng(2)
    k = hmm.STATES
    emit = rng.random((3, k))
    move = rng.random((k, k))
    model = hmm.Model(np.full(k, 1 / k), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    sequences = [rng.integers(0, 3, n) for n in (1, 4, 3, 4)]
    for s, got in zip(sequences, model.score(sequences)):
        total = 0.0
        for path in itertools.product(range(k), repeat=len(s)):
            p = model.start[path[0]] * model.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= model.move[path[t - 1], path[t]] * model.emit[s[t], path[t]]
            total += p
        assert abs(np.log10(total) - got) < 1e-9
    # All texts of one length together have probability one.
    assert abs(sum(10 ** x for x in model.score([np.asarray(s) for s in itertools.product(range(3), repeat=4)])) - 1) < 1e-9
    start, _, counted, _ = model.expect(sequences)
    assert abs(start.sum() - 4) < 1e-9 and abs(counted.sum() - 12) < 1e-9


def test_likelihood_rises():
    rng = np.random.default_rng(4)
    vocab = hmm.Vocabulary([(b"a", 50), (b"b", 50), (hmm.END, 20)], 120, 3, np.zeros(hmm.ENDINGS), np.zeros(hmm.ENDINGS))
    sequences = [rng.integers(1, 3, 30) if k % 2 else np.full(30, 1) for k in range(20)]
    model, seen = hmm.Model.first(vocab), []
    for _ in range(5):
        start, move, emit, likelihood = model.expect(sequences)
        seen.append(likelihood)
        model = hmm.Model.of(np.concatenate([start, move.reshape(-1), emit.reshape(-1)]), vocab)
    assert seen[-1] > seen[0]


def test_scores(awkward, nothing):
    docs, rows = awkward
    marked = docs.withColumn("held_out", held_out("doc_id", 7))
    got = hmm.score_documents(marked).collect()
    assert len(got) == len(rows)
    counts: dict = {}
    for doc, text in rows:
        if zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 != 2:
            for w in [*words_of(text), b""]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted((len(words_of(t)) + 1, sum(counts.get(w, 0) > 0 for w in [*words_of(t), b""]), round(float(sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in [*words_of(t), b""])), 4)) for _, t in rows)
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
    assert all(r.train_tokens == n and r.score <= 1e-9 for r in got)
    untrained = hmm.score_documents(docs.withColumn("held_out", F.lit(True))).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in untrained)
    assert hmm.score_documents(nothing.withColumn("held_out", F.lit(False))).count() == 0


# ------------------------------------------------------------------ 3: near-duplicates


def brute_components(rows, width, percent):
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({tuple(w[k : k + min(width, len(w))]) for k in range(len(w) - min(width, len(w)) + 1)} if w else set())
    group = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = group[a], group[b]
            group = [min(x, y) if g in (x, y) else g for g in group]
    least = {}
    for g, (doc, _), s in zip(group, rows, sets):
        if doc is not None:
            least[g] = min(least.get(g, doc), doc)
    return sorted(((doc, len(s), doc if not s else least.get(g)) for g, (doc, _), s in zip(group, rows, sets)), key=str)


def test_near_duplicates_awkward(awkward, nothing):
    docs, rows = awkward
    got = minhash.near_duplicates(docs, 3, 85).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows, 3, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert minhash.near_duplicates(nothing).count() == 0


def test_near_duplicates_large_group(spark):
    """Groups beyond one task's share go the block path and lose no link."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    base = [rng.choice(words) for _ in range(150)]
    rows = []
    for k in range(90):
        own = list(base)
        for _ in range(rng.randrange(9)):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, 3, 85)
    assert len({w[2] for w in want}) > 1
    for group in (1500, 8):
        got = minhash.near_duplicates(docs, 3, 85, group=group).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want


def test_circulant_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    a = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:300], rng.integers(0, 1 << 63, 100, dtype=np.uint64)]))
    sign = minhash.signatures([a, b], 512)
    assert abs((sign[0] == sign[1]).mean() - 300 / 500) < 0.08
    assert minhash.bands_for(85) >= 20


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(50, 40), (60, 60), (40, 50)], "u long, v long")
    assert {(r.node, r.root) for r in components.components(edges).collect()} == {(k, 0) for k in range(21)} | {(40, 40), (50, 40)}
    assert components.components(edges.where("u < 0")).count() == 0


# ------------------------------------------------------------------ 4: token files


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 3000])
def test_simple8b_round_trip(n):
    rng = np.random.default_rng(n)
    for top in (1, 2, 300, 50_257, 1 << 32):
        ids = rng.integers(0, top, n).astype("<u4")
        words, first = token_store.encode_words(ids)
        assert (token_store.decode_words(words, first, n) == ids).all()


def test_token_files(awkward, nothing, spark):
    docs, rows = awkward
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    library.encode_special_tokens = True
    ids = [[*library.encode(t or "", add_special_tokens=False).ids, 0] for _, t in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, rows[k][1] is not None, (rows[k][1] or "").encode()))
    start, want = 0, []
    for k in order:
        want.append((rows[k][0], start, len(ids[k]), zlib.crc32(np.asarray(ids[k], "<u4").tobytes())))
        start += len(ids[k])
    got = sorted((tuple(r) for r in token_store.token_file_round_trip(docs, tokenizer_path()).collect()), key=lambda r: r[1])
    assert got == want
    assert token_store.token_file_round_trip(nothing, tokenizer_path()).count() == 0
    with pytest.raises(ValueError):
        token_store.unpack_file(b"nope")


def test_queries_read_added_tokens_as_the_file_does(awkward, spark, tmp_path):
    """op4 and op7 against an untouched tokenizer, with texts that hold the end marker."""
    from tokenizers import Tokenizer

    from gridloom.llm.queries import QUERIES

    rows = awkward[1] + [(20, "a <|endoftext|> b"), (21, "<|endoftext|>"), (22, "é<|endoftext|>x <|endoftex"), (23, "plain a_b 12")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(tokenizer_path())
    ids = [np.asarray([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for _, t in rows]
    assert ids[len(awkward[1])].tolist() == [64, 220, 50256, 275, 0]
    got = QUERIES["op4_token_files"](spark, str(tmp_path)).collect()
    want = [(d, len(x), zlib.crc32(x.tobytes())) for (d, _), x in zip(rows, ids)]
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    for r in QUERIES["op7_retrieval_packing"](spark, str(tmp_path)).collect():
        assert any(d == r.doc_id and len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for (d, _), x in zip(rows, ids))


# ------------------------------------------------------------------ 5: repeated passages


def test_difference_cover():
    assert {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.PERIOD))


def test_repeats_against_brute_force(spark, awkward, nothing):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    shared = [text(n) for n in (399, 400, 401, 650, 1500)]
    rows = [(k, text(rng.randrange(900)) + rng.choice(shared)[rng.randrange(40) :] + text(rng.randrange(500)) + rng.choice(shared)) for k in range(60)]
    rows += [(60, "ab" * 700), (61, shared[4]), (62, shared[4])]
    for docs, own, block in ((spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows, 9_000), (awkward[0], awkward[1], suffixes.BLOCK)):
        got = sorted(((r.doc_id, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffixes.remove_repeats(docs, block_bytes=block, bucket_bytes=20_000).collect()), key=str)
        want = suffixes.brute_force([(t or "").encode() for _, t in own])
        assert got == sorted(((d, *w) for (d, _), w in zip(own, want)), key=str)
    assert suffixes.remove_repeats(nothing).count() == 0


# ------------------------------------------------------------------ 6: archives


def test_archives(spark):
    rows = [(1, "http://a", "same"), (2, "http://b", "same"), (3, None, None), (4, "u", ""), (5, "u\r\nX: y", "é" * 9), (None, "u", "same"), (6, "u", "x" * 300_000), (6, "u", "x" * 300_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, size string")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_round_trip(pages).where("gap is null").collect()), key=str)
    top: dict = {}
    for p, _, h in rows:
        if p is not None:
            top[h or ""] = max(top.get(h or "", p), p)
    want = []
    for p, _, h in rows:
        data = (h or "").encode()
        again = top[h or ""] != p
        want.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", top[h or ""] if again else None))
    assert got == sorted(want, key=str)
    assert warc.archive_round_trip(pages.where("page_id > 100")).count() == 0
    assert warc.archive_round_trip(pages, min_bytes=10).where("record_type = 'revisit'").count() == 0


def test_salvage():
    made = [warc.record(k, "http://x", b"payload %d " % k * 30, warc.digest(b"payload %d " % k * 30), 300 + k, k, False, "2024-01-01T00:00:00Z") for k in range(6)]
    import gzip

    for packed in (True, False):
        members = [gzip.compress(m) for m in made] if packed else made
        whole = b"".join(members)
        assert [h["warc-record-id"] for _, _, h, _, _ in warc.salvage(whole)] == [f"<urn:x-page:{k}>" for k in range(6)]
        hurt = bytearray(whole)
        at = len(members[0]) + len(members[1]) - 12
        hurt[at : at + 4] = b"\xff\xfe\xfd\xfc"
        hurt = bytes(hurt) + b"trailing junk"
        found = list(warc.salvage(hurt))
        assert [h["warc-record-id"] for _, _, h, _, _ in found if h] == [f"<urn:x-page:{k}>" for k in (0, 2, 3, 4, 5)]
        assert sum(n for at, n in {(at, n) for at, n, *_ in found}) == len(hurt)
        assert [at for at, _, h, _, _ in found if h is None] == [len(members[0]), len(whole)]
        assert all(why for *_, h, _, why in found if h is None)
    assert list(warc.salvage(b"")) == []


def test_salvage_inside_a_member():
    import gzip

    rng = random.Random(4)
    bodies = [rng.randbytes(60_000) for _ in range(5)]
    made = [warc.record(k, "http://x", b, warc.digest(b), 300 + k, k, False, "2024-01-01T00:00:00Z") for k, b in enumerate(bodies)]
    name = lambda data: [int(h["warc-record-id"][12:-1]) for _, _, h, _, _ in warc.salvage(data) if h]
    for bad in (0, 2, 4):
        hurt = [bytes(m[:-1000]) + b"?" * 500 + m[-500:] if k == bad else m for k, m in enumerate(made)]
        assert name(gzip.compress(b"".join(hurt))) == [k for k in range(5) if k != bad]
    packed = bytearray(gzip.compress(b"".join(made)))
    cut = bytes(packed[: len(packed) * 7 // 10]) + gzip.compress(made[0])
    assert name(cut) == [0, 1, 2, 0]
    found = list(warc.salvage(cut))
    assert sum(n for at, n in {(at, n) for at, n, *_ in found}) == len(cut) and sum(h is None for _, _, h, _, _ in found) == 1


# ------------------------------------------------------------------ 7: packing


def test_packing(awkward, nothing):
    docs, rows = awkward
    enc = token_store.encoder(tokenizer_path())
    ids = {}
    for doc, text in rows:
        ids.setdefault(doc, []).append(np.frombuffer(enc.encode(text) + b"\0\0\0\0", "<u4"))
    got = packing.pack(docs, tokenizer_path(), window=64, shard_ids=2000).collect()
    assert sum(r.length for r in got) == sum(len(x) for own in ids.values() for x in own)
    for r in got:
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    whole: dict = {}
    for r in got:
        whole.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in whole.values():
        parts.sort()
        assert all(o == sum(n for _, n in parts[:k]) for k, (o, _) in enumerate(parts)) and sum(n for _, n in parts) <= 64
    assert packing.pack(nothing, tokenizer_path()).count() == 0


def test_seed_takes_its_lexical_neighbour():
    idf = packing.inverse_frequency(np.full(100, 2), 50)
    rests = [(k, 10, 0, np.asarray(x, "<u4")) for k, x in enumerate(([1, 2, 3, 4], [50, 51, 52, 53], [1, 2, 3, 60], [50, 51, 70, 71]))]
    windows = list(packing.Shard(rests, idf, 4.0, 8).fill())
    assert [[k for k, _, _ in w] for w in windows] == [[0, 2], [1, 3]]


def test_seed_searches_all_its_terms():
    """The neighbour of rest 0 shares its lightest term only; repeated searches agree with brute force while rests are used up."""
    df = np.full(100, 2)
    df[40] = 30
    idf = packing.inverse_frequency(df, 50)
    rests = [(k, 10, 0, np.asarray(x, "<u4")) for k, x in enumerate((list(range(30)) + [40], [50, 51], [40, 60]))]
    shard = packing.Shard(rests, idf, 10.0, 64)
    shard.free[0] = False
    assert shard.neighbours(0).tolist() == [2]
    rng = np.random.default_rng(7)
    idf = packing.inverse_frequency(np.arange(1, 401), 500)
    rests = [(k, 60, 0, (400 * rng.random(60) ** 3).astype("<u4")) for k in range(90)]
    shard, bm25 = packing.Shard(rests, idf, 60.0, 64), np.zeros((90, 400))
    for k, (*_, ids) in enumerate(rests):
        tf = np.bincount(ids, minlength=400)
        bm25[k] = idf * tf * (packing.K1 + 1) / (tf + packing.K1)
    for seed in rng.permutation(90).tolist():
        shard.free[seed] = False
        score = np.where(shard.free, bm25[:, np.unique(rests[seed][3])].sum(axis=1), 0)
        got = shard.neighbours(seed)
        assert set(got.tolist()) == set(np.flatnonzero(score).tolist()) and (np.diff(score[got]) < 1e-4).all()


# ------------------------------------------------------------------ 8: licences


def test_licences(spark, nothing):
    model = licences.fit(["the cat sat on the mat", "general public was there", "a driving licence is needed to drive", "version 3 of the story"] * 40)
    for family, templates in licences.TEMPLATES.items():
        for t in templates:
            assert model.predict(licences.tokens(f"{t} Copyright 2021"))[0] == family
    rng = random.Random(8)
    rows = [(1, "Hello there.\nReleased under the MIT License.\nBye"), (2, None), (3, ""), (4, "The license of poets is large."), (5, "Licensed under the Apache License, Version 2.0\nThis work is licensed under the GNU General Public License, version 3.")]
    rows += [(6, " ".join(rng.choice(["under", "license", "the", "general", "version", "public"]) for _ in range(30)))]
    got = {r.doc_id: r for r in licences.scan(frame(spark, rows), model).collect()}
    assert [got[k].families for k in range(1, 7)] == ["mit", "", "", "", "apache-2.0,gpl", ""]
    assert got[1].paragraph == 1 and got[5].n_licensed == 2 and got[2].n_paragraphs == 0
    assert licences.scan(nothing, model).count() == 0


def test_wrapped_licences(spark):
    """Every template wrapped at 70 columns, bare and as a comment between other lines."""
    import textwrap

    model = licences.fit(["the cat sat on the mat", "general public was there", "a driving licence is needed to drive", "version 3 of the story"] * 40)
    wrapped = [(family, textwrap.wrap(t, 70)) for family, templates in licences.TEMPLATES.items() for t in templates]
    rows, want = [], []
    for family, lines in wrapped:
        for text in ("\n".join(lines), "int x;\n/*\n" + "\n".join(f" * {x}" for x in lines) + "\n */\nint y;", "# cats sat here\n" + "\n".join(f"# {x}" for x in lines) + "\nfor a in b: run(a)" * 9):
            rows.append((len(rows), text))
            want.append(family)
    got = {r.doc_id: r for r in licences.scan(frame(spark, rows), model).collect()}
    assert [got[k].families for k in range(len(rows))] == want
    assert all(got[k].n_licensed == 1 for k in range(len(rows)))
    apart = "\n\n".join(textwrap.wrap(licences.TEMPLATES["mit"][2], 70))
    assert [r.n_licensed for r in licences.scan(frame(spark, [(1, apart)]), model).collect()] == [0]


# ------------------------------------------------------------------ 9: fingerprints


def test_fingerprints(awkward, nothing):
    docs, rows = awkward
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), (r[1] or "").encode()))
    parts = lambda t: {p.strip(" ") for p in re.split(bloom_lookup.PARAGRAPH_END, t) if p.strip(" ")}
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    want = []
    for k, (doc, text) in enumerate(order):
        t, n = text or "", order[(k + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        want.append((doc, len(t), hashlib.sha256(e.encode()).hexdigest(), round(alike(parts(t), parts(e)), 9), round(alike(parts(t), parts(n)), 9)))
    for ranges in (1, 4):
        got = bloom_lookup.document_fingerprints(docs, ranges).collect()
        assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got), key=str) == sorted(want, key=str)
    assert len({r.fingerprint for r in got if r.doc_id in (1, 2)}) == 1
    assert bloom_lookup.document_fingerprints(nothing, 4).count() == 0


def test_peeling_retries(spark):
    """Differences far beyond the first table are still counted exactly."""
    rows = [(k, list(range(1, n + 1)), list(range(1 + n // 2, n + m))) for k, (n, m) in enumerate([(0, 1), (1, 5), (40, 9), (900, 600), (3000, 10)])]
    df = spark.createDataFrame(rows, "k long, a array<long>, b array<long>").select("k", "a", "b", *(F.transform(c, lambda x: F.xxhash64(x)).alias(f"h{c}") for c in "ab"))
    for r in df.select("a", "b", bloom_lookup.difference("ha", "hb").alias("d")).collect():
        assert r.d == len(set(r.a) ^ set(r.b))


# ------------------------------------------------------------------ 10: decontamination


def brute_hits(text, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own, hit, named = words(text), set(), set()
    for item, t in items:
        w = words(t)
        n = min(window, len(w))
        wins = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
        for k in range(len(own) - n + 1):
            if n and tuple(own[k : k + n]) in wins:
                hit |= set(range(k, k + n))
                named.add(str(item))
    return len(own), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)


def test_decontamination(spark, awkward, nothing):
    rng = random.Random(12)
    word = lambda: rng.choice(["Red", "blue", "Über", "7", "green", "été"]) + rng.choice(["", "x", "YY"])
    items = [(k, " ".join(word() for _ in range(rng.choice([3, 9, 10, 11, 25])))) for k in range(12)] + [(100, None), (101, "..."), (102, "one"), (11, "again the same id")]
    items.append((103, items[0][1]))
    rows = [(k, " ".join(word() for _ in range(rng.randrange(20))) + ", " + (rng.choice(items)[1] or "") + "; " + " ".join(word() for _ in range(8))) for k in range(50)]
    bench = spark.createDataFrame([(*i, "clash") for i in items], "item_id long, text string, fp string")
    for docs, own in ((frame(spark, rows), rows), awkward):
        got = winnowing.decontaminate(docs, bench).drop("text_hash").collect()
        assert sorted(map(tuple, got), key=str) == sorted(((d, *brute_hits(t, items)) for d, t in own), key=str)
    assert winnowing.decontaminate(nothing, bench).count() == 0
    assert not any(r.contaminated for r in winnowing.decontaminate(awkward[0], bench.limit(0)).collect())


# ------------------------------------------------------------------ memory and calls of a worker


def test_encoder_sends_new_pieces_together_and_agrees_with_the_library(monkeypatch):
    monkeypatch.setattr(token_store, "MEMO", 60)
    enc = token_store.Encoder(tokenizer_path())
    library, calls = enc.library, []

    class Counted:
        def encode(self, text, **options):
            calls.append(text)
            return library.encode(text, **options)

    enc.library = Counted()
    rng = random.Random(8)
    parts = ["  ", " ", "\n", "\t", "\r", " \n", "a", "'s", "'ll", "'", "42", "_", ".", ",é", "Ab", "word", " x", "ß"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert enc.encode(text) == np.asarray(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
    assert len(enc.memo) <= 60
    calls.clear()
    text = "first " + " ".join(f"{a}novel{b}" for a in "abcdefgh" for b in "stuvwxyz")
    assert enc.encode(text) == np.asarray(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes() and len(calls) <= 2


def test_worker_keeps_one_large_object():
    from gridloom.llm import common

    scorer = common.kept("scores", lambda: langid.Scorer({"langs": [], "rows": {}, "tables": {0: np.zeros(0)}, "floors": np.zeros(0)}))
    assert common.kept("scores", lambda: None) is scorer
    enc = token_store.encoder(tokenizer_path())
    assert token_store.encoder(tokenizer_path()) is enc and list(common._KEPT.values()) == [enc]
    common.let_go()
    assert not common._KEPT


def test_tasks_turn_few_texts_into_objects_at_a_time():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(3000)), "text": [f"text {k}" for k in range(3000)]})
    out = list(packing._pieces(tokenizer_path(), 64)(iter([batch])))
    assert max(b.num_rows for b in out) <= 512 and sum(b.num_rows for b in out) == 3001
