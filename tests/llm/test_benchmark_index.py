"""The fingerprint index of benchmark decontamination, and the stage that drops rows."""

from collections import Counter

import numpy as np

from passages.llm import decontamination as dc


def weighted(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def shingles(words):
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def test_blocks_hold_every_fingerprint_within_the_radius_and_few_others():
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    index, some = dc.BlockIndex(fps, dc.RADIUS), 0
    for q in rng.integers(0, 1 << 63, 50, dtype=np.uint64).tolist() + [int(f) ^ sum(1 << int(b) for b in rng.choice(63, k % (dc.RADIUS + 1), replace=False)) for k, f in enumerate(fps[:60])]:
        near = np.flatnonzero(np.bitwise_count(fps ^ np.uint64(q)) <= dc.RADIUS)
        assert index.near(q).tolist() == near.tolist()
        some += len(near)
    assert some > 60
    passed = [len(set().union(*({int(r) for x, rows in by.items() if (x ^ (q >> 16 * i & 0xFFFF)).bit_count() <= dc.RADIUS // 4 for r in rows} for i, by in enumerate(index.blocks)))) for q in rng.integers(0, 1 << 63, 20, dtype=np.uint64).tolist()]
    assert np.mean(passed) < 0.2 * len(fps)


def test_recall_of_the_radius_against_weighted_similarity():
    """Items with words replaced down to a similarity of 0.8: at least 99 of 100 lie within the radius."""
    rng = np.random.default_rng(6)
    met = found = 0
    while met < 400:
        n = int(rng.integers(20, 120))
        item = [int(x) for x in rng.integers(0, 5000, n)]
        own = list(item)
        for at in rng.choice(n, int(rng.integers(1, 4)), replace=False):
            own[at] = 10_000 + int(at)
        if weighted(shingles(item), shingles(own)) >= dc.LEAST:
            met += 1
            a, b = (dc._simhash(dc.shingle_hashes(np.array(x, np.uint64))) for x in (item, own))
            found += (a ^ b).bit_count() <= dc.RADIUS
    assert found >= 0.99 * met


def test_stage_judges_rows_by_their_own_text(spark):
    item = "which of the seven rivers in the old kingdom carries the least water in a dry summer"
    rows = [(1, f"before {item} after", "a"), (1, "a clean text with the same number as another", "b"), (None, f"{item}", "c"), (None, "clean", "d"), (2, None, "e"), (3, "", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(7, item), (8, "another item of a benchmark that nobody has in any document at all")], "item_id long, text string")
    for options in ({}, {"block_chars": 10}):
        got = dc.without_contaminated(docs, bench, **options)
        assert sorted(r["item_id"] for r in got.collect()) == ["b", "d", "e", "f"] and got.schema == docs.schema
    assert dc.without_contaminated(docs, bench.limit(0)).count() == len(rows)
