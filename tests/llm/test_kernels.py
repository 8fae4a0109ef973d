"""The string kernel, the discriminant and the BK-trees against brute force."""

from collections import Counter
from itertools import combinations

import numpy as np

from passages.llm import quality_classifier as qc
from passages.llm import simhash_dedup, toxicity


def slow_features(word):
    """Four-letter subsequences of span six at most, with the word's start and end as letters."""
    w, out = f"{{{word}`", Counter()
    for at in combinations(range(len(w)), 4):
        if at[3] - at[0] < toxicity.SPAN:
            out["".join(w[i] for i in at)] += toxicity.DECAY ** (at[3] - at[0] + 1)
    return out


def test_kernel_against_all_subsequences():
    words = ["idiot", "idiiot", "i", "", "clown", "clooown", "abcabcabc", "banana" * 3]
    features = [slow_features(w) for w in words]
    expected = [[sum(a[k] * b[k] for k in a) for b in features] for a in features]
    assert np.allclose(toxicity.kernel(words, words), expected, rtol=1e-5, atol=1e-6)
    assert toxicity.kernel(["x" * 50_000], ["xxxx"]).shape == (1, 1)


def test_gapped_and_inserted_letters_are_tolerated():
    rng = np.random.default_rng(8)
    plain = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(n))) for n in rng.integers(3, 9, 400)]
    text = lambda *extra: " ".join([*rng.choice(plain, 30), *extra])
    insults = ["blarghead", "snorkfool"]
    texts = [text(insults[i % 2]) for i in range(60)] + [text() for _ in range(240)]
    model = toxicity.train(texts, [1] * 60 + [0] * 240)
    changed = ["blarghead", "BLARGHEAD", "bl.arg.head", "b-l-a-r-g-h-e-a-d", "b l a r g h e a d", "blarrghead", "blarghxead", "8larghead", "snorkfoool", "snorkkfool", "sn0rkf00l"]
    scores = dict(zip(changed, model.scores([text(x) for x in changed]), strict=True))
    clean = model.scores([text() for _ in range(200)])
    assert sum(s >= 0.7 for s in scores.values()) >= 0.9 * len(changed), scores
    assert (clean >= 0.7).mean() <= 0.02


def test_folded_machine_equals_sums_over_subsequences():
    rng = np.random.default_rng(9)
    weights = rng.normal(size=toxicity._TABLE_SIZE).astype(np.float32)
    words = ["idiot", "clown", "a", "xyzzyxyz"]
    rows, keys, values = toxicity.subsequences(words)
    expected = [float((weights[keys[rows == i]] * values[rows == i]).sum()) for i in range(len(words))]
    assert np.allclose(toxicity.Letters([" ".join(words)]).word_scores(weights), expected, atol=1e-4)


def test_discriminant_against_plain_densities():
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(size=(80, 4)) @ rng.normal(size=(4, 4)), rng.normal(1.0, 0.5, (50, 4))]
    y = np.r_[np.zeros(80, int), np.ones(50, int)]
    model = qc.fit(x, y)
    z = np.clip((x - x.mean(axis=0)) / x.std(axis=0), -8, 8)
    groups = [z[y == c] for c in (0, 1)]
    spread = [np.cov(g.T, bias=True) for g in groups]
    pooled = sum(len(g) * s for g, s in zip(groups, spread, strict=True)) / len(z)
    logs = []
    for g, s in zip(groups, spread, strict=True):
        a = qc.SHRINK + (1 - qc.SHRINK) * min(1, 4 / len(g))
        cov = (1 - a) * s + a * (0.5 * pooled + 0.5 * np.diag(np.diag(pooled))) + 0.02 * np.eye(4)
        d = z - g.mean(axis=0)
        logs.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) + np.log(np.linalg.det(cov))))
    assert np.allclose(model.margins(x), logs[1] - logs[0])
    assert ((model.scores(x) >= 0.5) == (y == 1)).mean() > 0.8


def test_trees_find_all_pairs_and_follow_few_edges():
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 1 << 63, 25, dtype=np.uint64)
    fps = {int(s) ^ sum(1 << int(b) for b in rng.choice(63, int(rng.integers(0, 9)), replace=False)) for s in seeds for _ in range(9)}
    fps = np.array(sorted(fps), np.uint64)
    assert len(fps) <= simhash_dedup.SMALL_TREE
    expected = {(j, i) for i in range(len(fps)) for j in range(i) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 4}
    tree = simhash_dedup.SmallTree()
    assert {(j, i) for i, fp in enumerate(fps.tolist()) for j in tree.add(fp, 4)} == expected
    assert tree.compared < 0.6 * len(fps) * (len(fps) - 1) / 2 and sum(map(len, tree.children)) == len(fps) - 1
    large = simhash_dedup.BKTree(fps)
    assert {(int(m), int(q)) for qs, ms in large.near(fps, 4) for q, m in zip(qs, ms, strict=True) if m < q} == expected
