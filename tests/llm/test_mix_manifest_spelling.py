"""Source mixing, Merkle manifests and spelling variants against brute force and on awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import merkle, mixing, ordering, queries, spelling
from tests.compare import compare, connect

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, word string, n long, g string, pos long, copies long, _key long"
LONG = " ".join(f"word{k % 977} Tail{k}" for k in range(9000))


def rows_of():
    rng = random.Random(5)
    pick = lambda: rng.choice(["Letters", "lettres", "letterz", "gardens", "Garden", "gardns", "été", "ÉTÉONS", "étéons", "window"])
    rows = [(k, " ".join(pick() for _ in range(rng.randrange(1, 60))) + ("\nmore\n" if k % 3 else ""), "en", f"s{k % 4}", k) for k in range(120)]
    rows += [(200, LONG, "en", "s1", 1), (201, None, None, None, None), (202, "", "", "", 0), (203, " \t\n", "x", None, 3), (204, "Letters\n" * 40, "e|n", "été", 9)]
    rows += [(205, "same text here", "en", "s0", 1)] * 3 + [(205, "other\ntext", "en", "s0", 1), (None, "no id\n", "en", "s0", 1), (None, None, None, "s0", None), (206, "a" * 5000 + " " + "a" * 5000, "en", "one", 1), (207, ("é" * 300 + " ") * 6, "en", "one", 1)]
    return rows


@pytest.fixture(scope="module")
def awkward(spark):
    rows = rows_of()
    return spark.createDataFrame([(*r, 7, "clash", 7, "clash", 7, 7, 7) for r in rows], SCHEMA).repartition(5).cache(), rows


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_places_in_order(spark):
    rows = [(None if k % 7 == 0 else f"g{k % 3}", k % 50) for k in range(400)]
    df = spark.createDataFrame(rows, "grp string, v long")
    got = ordering.ranked(ordering.sorted_rows(df, F.col("grp").asc_nulls_first(), F.col("v").asc()), "grp").collect()
    groups = defaultdict(list)
    for g, v in rows:
        groups[g].append(v)
    assert len(got) == len(rows)
    for g, vs in groups.items():
        assert [r.v for r in sorted((r for r in got if r.grp == g), key=lambda r: r.pos)] == sorted(vs)
        assert {r.total for r in got if r.grp == g} == {len(vs)} and {r.pos for r in got if r.grp == g} == set(range(len(vs)))


# ------------------------------------------------------------------ 11: mixing


def targets_of(sizes: dict, weights=(1, 2, 3), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, left, total = {}, set(names), sum(sizes.values())
    while True:
        share = (total - sum(out.values())) / max(1, sum(w[s] for s in left))
        over = {s for s in left if cap * sizes[s] < share * w[s]}
        if not over:
            return out | {s: share * w[s] for s in left}
        out |= {s: cap * sizes[s] for s in over}
        left -= over


def test_pivots_keep_words_and_chances():
    rng = np.random.default_rng(1)
    size = np.sort(rng.integers(1, 900, 40))[::-1]
    p = np.where(np.arange(40) < 30, 0.4, rng.random(40))
    taken = np.zeros(40)
    for _ in range(4000):
        out, left = mixing.pivot(p, size, rng.random(40))
        assert abs((out * size).sum() - (p * size).sum()) < 1e-6
        assert all(x in (0, 1) for k, x in enumerate(out) if k != left)
        taken += out
    assert np.abs(taken / 4000 - p).max() < 0.05


def test_mix(awkward):
    docs, rows = awkward
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, longest = Counter(), Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += count(text)
        longest[source] = max(longest[source], count(text))
    want = targets_of(sizes)
    for group in (4096, 4):  # one level of the tree and several
        got = mixing.mix(docs, group=group)
        seen = got.collect()
        assert sorted(map(str, seen)) == sorted(map(str, mixing.mix(docs.repartition(3), group=group).collect()))
        assert sorted(((r.doc_id is None, r.doc_id or 0), r.size) for r in seen) == sorted(((d is None, d or 0), count(t)) for d, t, *_ in rows)
        assert all(r.taken == r.size * r.copies and 0 <= r.copies <= 3 for r in seen)
        source = {(d, count(t)): s for d, t, _, s, _ in rows}
        taken = Counter()
        for r in seen:
            s = source[r.doc_id, r.size]
            taken[s] += r.taken
            assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert all(abs(taken[s] - want[s]) <= longest[s] for s in sizes)
    whole = mixing.mix(docs, weights=(5, 1), cap=2, seed=9).collect()
    assert max(r.copies for r in whole) <= 2


def test_mix_large_sources_come_near(spark):
    rng = random.Random(2)
    rows = [(k, "w " * min(4000, int(rng.paretovariate(1.1) * 20)), "big" if k % 3 else f"s{k % 5}") for k in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), group=100)
    per = got.groupBy("source_size").agg(F.first("target").alias("t"), F.sum("taken").alias("k")).collect()
    assert len(per) == 6 and all(abs(r.k - r.t) <= 0.01 * r.t for r in per)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert mixing.mixture(docs, got).count() == got.agg(F.sum("copies")).first()[0]


def test_mix_nothing(spark, nothing):
    assert mixing.mix(nothing).count() == 0
    wordless = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {(r.doc_id, r.size, r.target, r.taken) for r in mixing.mix(wordless).collect()} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}


# ------------------------------------------------------------------ 12: manifest


def up(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([hashlib.sha256("".join(now[k : k + 3]).encode()).hexdigest() for k in range(0, len(now), 3)])
    return levels


def way(levels, k):
    for now in levels[:-1]:
        first = k - k % 3
        yield now[first:k], now[k + 1 : first + 3]
        k //= 3


def manifest_of(rows):
    def leaf(doc, text, lang, source, n):
        part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
        return hashlib.sha256("".join(map(part, (doc, source, lang, n, text))).encode()).hexdigest()

    groups = defaultdict(list)
    for doc, text, lang, source, n in rows:
        torn = text is not None and zlib.crc32(("" if doc is None else str(doc)).encode()) % 2 == 0
        groups[source].append((doc is not None, doc or 0, leaf(doc, text, lang, source, n), leaf(doc, text.replace("\n", "") if torn else text, lang, source, n)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: up([g[2] for g in sorted(groups[s])]) for s in names}
    top = up([trees[s][-1][0] for s in names])
    for at, s in enumerate(names):
        for k, (known, doc, own, shown) in enumerate(sorted(groups[s])):
            node, proof = shown, ""
            for left, right in [*way(trees[s], k), *way(top, at)]:
                proof += "".join(left + right)
                node = hashlib.sha256("".join([*left, node, *right]).encode()).hexdigest()
            yield doc if known else None, own, trees[s][-1][0], top[-1][0], hashlib.sha256(proof.encode()).hexdigest(), node, node == top[-1][0]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27, 28, 100])
def test_places_in_the_log(n):
    leaves = [f"leaf{k}" for k in range(n)]
    levels = up(leaves)
    log, width = merkle.append_log(leaves), merkle.widths(n)
    assert len(log) == sum(map(len, levels)) and log[-1] == levels[-1][0]
    assert all(log[merkle.place(level, k, width)] == node for level, nodes in enumerate(levels) for k, node in enumerate(nodes))
    for k in range(n):
        path = merkle.siblings(log, k, width)
        assert merkle.fold(leaves[k], path) == log[-1]
        assert path == [("".join(a), "".join(b)) for a, b in way(levels, k)]


def test_manifest(awkward, spark):
    docs, rows = awkward
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    got = merkle.document_manifest(docs).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(key, got)) == sorted(map(key, manifest_of(rows)))
    assert {r.verified for r in got} == {True, False}


@pytest.mark.parametrize("size", [3, 9])
def test_manifest_of_several_tiers(spark, size):
    rows = [(k, f"s{k % 2 if k % 10 else k % 7}", hashlib.sha256(str(k).encode()).hexdigest()) for k in range(230)]
    leaves = spark.createDataFrame(rows, "doc_id long, source string, leaf string").withColumn("shown", F.when(F.col("doc_id") % 5 == 0, "0" * 64))
    log, proofs = merkle.prove(leaves, size)
    assert len(log.tiers) > 2
    groups = defaultdict(list)
    for k, s, leaf in rows:
        groups[s].append((k, leaf))
    trees = {s: up([leaf for _, leaf in groups[s]]) for s in sorted(groups)}
    top = up([trees[s][-1][0] for s in trees])
    at = {k: (s, i) for s in groups for i, (k, _) in enumerate(groups[s])}
    seen = proofs.collect()
    assert len(seen) == len(rows) and {r.root for r in seen} == {top[-1][0]}
    for r in seen:
        s, i = at[r.doc_id]
        proof = "".join("".join(a + b) for a, b in [*way(trees[s], i), *way(top, list(trees).index(s))])
        assert r.proof_sha256 == hashlib.sha256(proof.encode()).hexdigest() and r.subroot == trees[s][-1][0]
        assert r.verified == (r.doc_id % 5 != 0)


def test_manifest_of_nothing(nothing):
    assert merkle.document_manifest(nothing).count() == 0


# ------------------------------------------------------------------ 13: spelling


def variants_of(rows):
    counts = Counter()
    for doc, text, *_ in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    cuts = lambda w: {w[:k] + w[k + 1 :] for k in range(len(w))}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return abs(len(a) - len(b)) == 1 and min(a, b, key=len) in cuts(max(a, b, key=len))

    close = {a: [b for b in n if near(a, b)] for a in n}
    form = {}
    for a in n:
        best = min(close[a], key=lambda b: (-n[b], b), default=None)
        form[a] = best if best is not None and n[best] >= 5 * n[a] else None
    for a in n:
        root = a
        while form[root]:
            root = form[root]
        yield a, form[a], root, n[a], len(close[a]), n[form[a]] if form[a] else None


def test_spelling(awkward):
    docs, rows = awkward
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    got = spelling.spelling_variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(key, got)) == sorted(map(key, variants_of(rows)))


def test_spelling_of_random_words(spark):
    rng = random.Random(8)
    rows = []
    for k in range(150):
        words = ["".join(rng.choice("abÀé") for _ in range(rng.randrange(5, 9))) for _ in range(60)] + ["abÀéab"] * 9 + ["aabÀéab"] * 60
        rows.append((k, " ".join(words * rng.choice([1, 2, 9])).replace("a", "A", 3)))
    got = spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).select("word", "form", "root", "n", "n_near", "form_n").collect()
    want = set(variants_of(rows))
    assert set(map(tuple, got)) == want and len(got) == len(want)
    assert any(r.form for r in got) and any(r.n_near > 3 for r in got)


def test_trie_nodes_are_prefixes(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(500)} | {"a" * 400})
    for backwards in (False, True):
        got = spelling.trie(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), backwards).collect()
        node = {}
        for r in got:
            for k, x in enumerate(r.path):
                node.setdefault(r.word[::-1][: k + 1] if backwards else r.word[: k + 1], set()).add(x)
        assert all(len(v) == 1 for v in node.values())
        assert {min(v) for v in node.values()} == set(range(1, len(node) + 1))


def test_spelling_of_nothing(nothing):
    assert spelling.spelling_variants(nothing).count() == 0


@pytest.mark.parametrize("name", ["op12_merkle_manifest", "op13_spelling_variants"])
def test_same_as_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    if not Path(sf).exists():
        pytest.skip("no tables")
    assert compare(spark, connect(sf), queries.QUERIES[name], queries.ORACLES[name], sf)[0] == "same"
