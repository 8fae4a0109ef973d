"""The near-dedup stage against all pairs by brute force."""

import re

import numpy as np

import corpus_pipeline
from passages.llm import shingle_dedup


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def kept_by_all_pairs(docs):
    ids, sets, root = sorted(docs), {i: shingles(t) for i, t in docs.items()}, {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, b in enumerate(ids):
        for a in ids[:k]:
            x, y = sets[a], sets[b]
            if 5 * len(x & y) >= 4 * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i for i in ids if find(i) == i}


def near_copies(bases=25, copies=12, seed=3):
    """Texts with up to a tenth of their words replaced, a common line in many, short and empty ones."""
    rng = np.random.default_rng(seed)
    line = " ".join(f"common{i}" for i in range(12))
    texts = [None, "", " ", "One", "one", "a b c d e", "A b c d e f", "a b c d e f"]
    for k in range(bases):
        base = [f"w{x}" for x in rng.integers(0, 3000, int(rng.integers(20, 200)))]
        for _ in range(copies):
            w = list(base)
            for at in rng.choice(len(w), int(rng.integers(0, max(2, len(w) // 40))), replace=False):
                w[at] = f"x{rng.integers(0, 1 << 30)}"
            texts.append(f"{line} {' '.join(w)}" if k % 2 else " ".join(w).upper())
    return {int(i): t for i, t in zip(rng.permutation(len(texts)), texts, strict=True)}


def stage(spark, docs):
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    return {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()}


def test_stage_equals_all_pairs(spark):
    docs = near_copies()
    assert stage(spark, docs) == kept_by_all_pairs(docs)


def test_large_groups_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(shingle_dedup, "BLOCK", 2)
    monkeypatch.setattr("passages.llm.common.BROADCAST_ROWS", 0)
    docs = near_copies(6, 25, 4)
    assert stage(spark, docs) == kept_by_all_pairs(docs)


def test_rows_are_judged_one_by_one(spark):
    x, y, z = ("some text that is long enough to be its own", "another one with different words in all its places", "and a third that nobody else has in this table")
    rows = [(1, x), (2, x.upper()), (2, y), (2, y), (None, z), (None, z), (None, y), (3, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], r["text"] or "") for r in corpus_pipeline.near_duplicates(spark, df, "").collect()]
    assert sorted(got, key=str) == sorted([(1, x), (2, y), (None, z), (3, "")], key=str)


def test_fingerprints_and_their_trees_find_links(spark, monkeypatch):
    """Long texts that differ in a word or two are linked by BK-trees over SimHash fingerprints, before any shingle is shared out."""
    rng = np.random.default_rng(8)
    docs = {}
    for k in range(6):
        base = [f"w{x}" for x in rng.integers(0, 3000, 1500)]
        for i in range(4):
            docs[10 * k + i] = " ".join([*base[: 700 + i], f"x{i}", *base[701 + i :]])
    sets = {i: sorted(t) for i, t in ((i, shingle_dedup.hasher()(t)) for i, t in docs.items())}
    for h in sets.values():
        bits = np.array([[int(x) >> b & 1 for b in range(63, -1, -1)] for x in h]).sum(axis=0)
        assert shingle_dedup.simhash(np.array(h, np.uint64)) == int("".join("1" if 2 * n > len(h) else "0" for n in bits), 2)
    fp = {i: shingle_dedup.simhash(np.array(h, np.uint64)) for i, h in sets.items()}
    texts = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in fp.items()], "node long, fp long")
    near = {(a, b) for a in docs for b in docs if a < b and (fp[a] ^ fp[b]).bit_count() <= 4}
    assert len(near) > 20 and all(a // 10 == b // 10 for a, b in near)
    found = {(r["a"], r["b"]) for r in shingle_dedup._simhash_pairs(texts).collect()}

    def roots(pairs):
        at = {i: i for i in docs}
        for _ in docs:
            for a, b in pairs:
                at[a] = at[b] = min(at[a], at[b])
        return at

    assert roots(found) == roots(near)
    seen = []
    verified = shingle_dedup._verified
    monkeypatch.setattr(shingle_dedup, "_verified", lambda pairs, *rest: (seen.append({(r["a"], r["b"]) for r in pairs.collect()}), verified(pairs, *rest))[1])
    assert stage(spark, docs) == kept_by_all_pairs(docs)
    assert len(seen[0]) == len(found)


def test_pairs_of_a_shingle_grow_with_its_texts(spark):
    """Where many texts meet and may all be similar, fewer pairs are made than there are texts, and they connect what all pairs connect."""
    n, names = 40, "h long, node long, n int, p int, c long"
    mixed = spark.createDataFrame([(h, i, 100, 0, i // 2) for h in (7, 8) for i in range(n)], names)
    odd = {i: (bytes(64), b"\xff" * 64)[i % 4 // 2] for i in range(n)}
    bits = spark.createDataFrame([(i, 100, bytearray(x)) for i, x in odd.items()], "node long, n int, bits binary")
    every = {(a, b) for a in range(n) for b in range(a + 1, n) if a // 2 != b // 2 and odd[a] == odd[b]}
    assert {(r["a"], r["b"]) for r in shingle_dedup._other_pairs(mixed, bits, True).collect()} == every
    found = shingle_dedup._other_pairs(mixed, bits, False).collect()
    few = [(r["a"], r["b"]) for r in found if r["a"] is not None]
    assert set(few) <= every and len(few) < 2 * n
    assert {(r["h"], r["node"]) for r in found if r["h"] is not None} == {(h, i) for h in (7, 8) for i in range(n)}
    at = list(range(n))
    for a, b in few * n:
        for x, y in ((a, b), (a ^ 1, a), (b ^ 1, b)):
            at[x] = at[y] = min(at[x], at[y])
    assert len(set(at)) == 2


def test_texts_that_parities_set_apart_are_not_compared(spark, monkeypatch):
    texts = {i: " ".join(f"{'common' if j < 30 else f'own{i}'}{j}" for j in range(100)) for i in range(4)}
    rows = spark.createDataFrame(list(texts.items()), f"{shingle_dedup._ROW} long, text string")
    sets = {i: shingle_dedup.hasher()(t) for i, t in texts.items()}
    bits = spark.createDataFrame([(i, len(h), bytearray(shingle_dedup.parities(h))) for i, h in sets.items()], "node long, n int, bits binary")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "a long, b long")
    sizes = []
    monkeypatch.setattr(shingle_dedup, "cut", lambda df, f=shingle_dedup.cut: (got := f(df), sizes.append((got[0].columns, got[0].count())))[0])
    assert shingle_dedup._verified(pairs, rows, bits)[0].count() == 0
    assert (["node", "own"], 0) in sizes
