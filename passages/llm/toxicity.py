"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two words is the inner product of their four-letter subsequences, each weighted by ``DECAY`` to the power
of the span it covers (6 letters at most; a word's start and its end count as letters).  Gapped and inserted letters therefore only
weaken a match.  Symbols inside a word are dropped, letters spaced out one by one are joined, and digits read as the
letters they imitate.

Labels are of documents, and the machine is trained on words, not on sentences: every word of a clean document is clean, and
each toxic document has one word at least that is toxic, its highest-scoring one (re-chosen in every round).  A document is
as toxic as its worst word, so an insult made of several harmless words is not seen.  The machine is trained on Nyström
features over landmark words; since the kernel is an inner product, the trained machine folds exactly into one weight for
each subsequence, and scoring is a table look-up along the text.

Training takes at most ``max_toxic`` and ``max_clean`` labelled documents, the first by a hash of their doc_id, and of their
words at most ``max_witnesses`` (the commonest toxic ones), ``max_pool`` (clean ones at random) and in each round
``max_hard`` (the clean ones that score highest) more.  Scoring takes whole words of whole texts.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passages.llm.common import bounded_batches, groups_by_size, held_out, id_and_text, training_rows

DECAY = 0.7
SPAN = 6
MAX_TOXIC = 1000
MAX_CLEAN = 4000
LANDMARKS = 384
MAX_POOL = 4000
MAX_WITNESSES = 1500
MAX_HARD = 3000
#: Letters that are scored at a time.
_PART = 1 << 18
#: Codes past the 26 letters: a word's start, and letters with acute, grave, other marks, and the rest; a word's end is 0.
_BREAK, _ACUTE, _GRAVE, _MARKED, _OTHER = 27, 28, 29, 30, 31
_GAPS = [(a, b, c) for a in range(1, SPAN) for b in range(1, SPAN) for c in range(1, SPAN) if a + b + c < SPAN]
_TABLE_SIZE = 1 << 20


def _letters() -> np.ndarray:
    table = np.zeros(1 << 16, np.uint8)
    for i in range(1 << 16):
        c = chr(i)
        if c.isspace():
            table[i] = _BREAK
        elif c.isalpha():
            base, *marks = unicodedata.normalize("NFD", c.lower())
            if "a" <= base <= "z":
                table[i] = {"": ord(base) - 96, "\u0301": _ACUTE, "\u0300": _GRAVE, "\u0308": _OTHER}.get("".join(marks), _MARKED)
            else:
                table[i] = _OTHER
    for c, base in zip("013457", "oieast", strict=True):
        table[ord(c)] = ord(base) - 96
    return table


_TABLE: list[np.ndarray] = []


def _scores_of(c: np.ndarray, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sums over the words that start at ``at`` in the codes."""
    n = len(c)
    word = np.zeros(n, np.int32)
    word[at] = 1
    word = np.cumsum(word, dtype=np.int32)
    c1, c2, c3 = c << 15, c << 10, c << 5
    total = np.zeros(n, np.float32)
    for span in range(4, SPAN + 1):
        m = n - span + 1
        if m < 1:
            break
        part = np.zeros(m, np.float32)
        for x, y, z in _GAPS:
            if x + y + z == span - 1:
                part += weights[c1[:m] | c2[x : x + m] | c3[x + y : x + y + m] | c[span - 1 :]]
        total[:m] += part * (word[:m] == word[span - 1 :]) * np.float32(DECAY**span)
    return np.add.reduceat(total, at)


class Letters:
    """Letter codes of some texts, word by word; each word starts with a break and ends with a 0, which belong to it."""

    def __init__(self, texts: list[str]):
        if not _TABLE:
            _TABLE.append(_letters())
        raw = np.frombuffer(("\n" + "\n".join(texts)).encode("utf-32-le", "surrogatepass"), "<u4")
        lengths = np.array([len(t) + 1 for t in texts])
        codes = _TABLE[0][np.minimum(raw, 65535)] * (raw < 65536)
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
        keep = codes > 0
        codes, doc = codes[keep], doc[keep]
        is_break = codes == _BREAK
        last = np.ones(len(codes), bool)  # a break right before another of the same text is no word
        last[:-1] = ~(is_break[:-1] & is_break[1:] & (doc[:-1] == doc[1:]))
        last[-1:] = ~is_break[-1:]
        keep = last | ~is_break
        codes, doc = codes[keep], doc[keep]
        at = np.flatnonzero(codes == _BREAK)
        size = np.diff(np.r_[at, len(codes)]) - 1
        owner = doc[at]
        joined = np.zeros(len(at), bool)
        joined[1:] = (size[1:] == 1) & (size[:-1] == 1) & (owner[1:] == owner[:-1])
        if joined.any():
            keep = np.ones(len(codes), bool)
            keep[at[joined]] = False
            codes = codes[keep]
            at = np.flatnonzero(codes == _BREAK)
            owner = owner[~joined]
        if len(at):
            codes = np.insert(codes, np.r_[at[1:], len(codes)], 0)
            at = at + np.arange(len(at))
        self.codes, self.at, self.owner, self.n = codes, at, owner, len(texts)

    def word(self, k: int) -> str:
        end = self.at[k + 1] if k + 1 < len(self.at) else len(self.codes)
        return "".join(chr(96 + c) for c in self.codes[self.at[k] + 1 : end - 1].tolist())

    def word_scores(self, weights: np.ndarray) -> np.ndarray:
        """Sum of the weights of each word's subsequences."""
        out, end, a = np.empty(len(self.at), np.float32), np.r_[self.at[1:], len(self.codes)], 0
        while a < len(out):  # whole words, a part at a time
            z = max(a + 1, int(np.searchsorted(end, self.at[a] + _PART, "right")))
            out[a:z] = _scores_of(self.codes[self.at[a] : end[z - 1]].astype(np.int32), self.at[a:z] - self.at[a], weights)
            a = z
        return out

    def text_scores(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The highest word score of each text (-inf without words), and all word scores."""
        words = self.word_scores(weights)
        out = np.full(self.n, -np.inf, np.float32)
        if len(words):
            first = np.flatnonzero(np.r_[True, self.owner[1:] != self.owner[:-1]])
            out[self.owner[first]] = np.maximum.reduceat(words, first)
        return out, words


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers, subsequence numbers and weights of all words."""
    size = np.array([len(w) + 2 for w in words], np.int64)
    c = np.frombuffer("".join(f"{{{w}`" for w in words).encode("latin-1"), np.uint8).astype(np.int64) - 96
    row = np.repeat(np.arange(len(words)), size)
    rows, keys, values = [], [], []
    for x, y, z in _GAPS:
        m = len(c) - x - y - z
        if m > 0:
            ok = np.flatnonzero(row[:m] == row[x + y + z :])
            rows.append(row[ok])
            keys.append(c[ok] << 15 | c[ok + x] << 10 | c[ok + x + y] << 5 | c[ok + x + y + z])
            values.append(np.full(len(ok), DECAY ** (x + y + z + 1)))
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    rows, keys, values = map(np.concatenate, (rows, keys, values))
    order = np.argsort(rows, kind="stable")
    return rows[order], keys[order], values[order]


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    rows, keys, values = subsequences(landmarks)
    known = np.unique(keys)
    phi = np.zeros((len(known) + 1, len(landmarks)), np.float32)
    np.add.at(phi, (np.searchsorted(known, keys), rows), values)
    out = np.zeros((len(words), len(landmarks)))
    if not len(known):
        return out
    for at, end in groups_by_size(words, 4000):
        rows, keys, values = subsequences(words[at:end])
        where = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        some = np.flatnonzero(known[where] == keys)
        for part in np.array_split(some, len(some) // 20_000 + 1):  # long words too in bounded parts
            if len(part):
                first = np.flatnonzero(np.r_[True, rows[part][1:] != rows[part][:-1]])
                out[at + rows[part][first]] += np.add.reduceat(phi[where[part]] * values[part, None].astype(np.float32), first)
    return out


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Squared-hinge support vector machine by Newton steps on the violating rows."""
    x = np.c_[z, np.ones(len(z))]
    w = np.zeros(x.shape[1])
    r = np.full(len(w), ridge)
    r[-1] = 1e-6
    for _ in range(40):
        bad = y * (x @ w) < 1
        a = x[bad] * weight[bad, None]
        new = np.linalg.solve(a.T @ x[bad] + np.diag(r * weight.sum() / 100), a.T @ y[bad])
        if np.abs(new - w).max() < 1e-9:
            break
        w = new if _ < 5 else (w + new) / 2
    return w[:-1], float(w[-1])


class StringKernelSvm:
    """The folded machine: a weight for each subsequence, an offset, and a logistic calibration."""

    def __init__(self, weights: np.ndarray, offset: float, slope: float, shift: float):
        self.weights, self.offset, self.slope, self.shift = weights.astype(np.float32), offset, slope, shift

    def scores(self, texts: list[str]) -> np.ndarray:
        top, _ = Letters(texts).text_scores(self.weights)
        margin = np.where(np.isfinite(top), top + self.offset, -1.0).astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def _first_guess(words: list[set[str]], clean: list[set[str]]) -> list[str]:
    """For each toxic text the words with the letters (their first 3 to 8, or any 5) that set the toxic texts apart most."""
    grams = lambda w: {f"^{w[:i]}" for i in range(3, 9)} | {w[i : i + 5] for i in range(len(w) - 4)}
    count = lambda texts: Counter(g for t in texts for g in set().union(*map(grams, t)))
    toxic_n, clean_n = count(words), count(clean)

    def score(g: str) -> float:
        n = toxic_n[g]
        return n * float(np.log((n / len(words)) / ((clean_n[g] + 0.5) / (len(clean) + 1))))

    def pure(g: str) -> bool:
        return toxic_n[g] >= 5 and toxic_n[g] / len(words) > 50 * clean_n[g] / len(clean)

    out = []
    for t in words:
        scores = {w: max(map(score, grams(w))) for w in sorted(t)}
        best = max(scores.values(), default=0.0)
        out += [w for w, x in scores.items() if x == best > 0 or x >= 0.4 * best > 0 and any(map(pure, grams(w)))]
    return out


def train(texts: list[str], toxic: list[int], landmarks: int = LANDMARKS, rounds: int = 5, seed: int = 7, max_pool: int = MAX_POOL, max_witnesses: int = MAX_WITNESSES, max_hard: int = MAX_HARD) -> StringKernelSvm:
    """Fit on labelled texts.  Without both classes every text scores the share of toxic ones.

    The last three bound the words that the machine is fitted on: clean ones at random, toxic ones, and clean ones of a round that score highest.
    """
    y = np.array(toxic)
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6))
        return StringKernelSvm(np.zeros(_TABLE_SIZE), 0.0, 0.0, float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    bad, good = Letters([t for t, x in zip(texts, y, strict=True) if x]), Letters([t for t, x in zip(texts, y, strict=True) if not x])

    def by_text(own: Letters) -> list[set[str]]:
        out: list[set[str]] = [set() for _ in range(own.n)]
        for k, d in enumerate(own.owner.tolist()):
            out[d].add(own.word(k))
        return [{w for w in t if w} for t in out]

    bad_words, good_words = by_text(bad), by_text(good)
    every = sorted(set().union(*good_words))
    pool = [every[i] for i in rng.permutation(len(every))[:max_pool]]
    guess = witness = _first_guess(bad_words, good_words)
    hard: list[str] = []
    for _ in range(rounds):
        positive = [w for w, _n in Counter(witness).most_common(max_witnesses)]
        negative = sorted((set(pool) | set(hard)) - set(positive))
        marks = [*positive[: landmarks // 2], *negative[:: max(1, len(negative) // (landmarks - min(len(positive), landmarks // 2)))]][:landmarks]
        kmm = kernel(marks, marks)
        values, vectors = np.linalg.eigh(kmm)
        root = vectors / np.sqrt(np.maximum(values, 1e-3 * values.max())) @ vectors.T
        own = positive + negative
        z = kernel(own, marks) @ root
        sign = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
        w, offset = _svm(z, sign, np.where(sign > 0, len(negative) / len(positive) / 4, 1.0))
        rows, keys, values = subsequences(marks)
        weights = np.zeros(_TABLE_SIZE)
        np.add.at(weights, keys, values * (root @ w)[rows])
        top_bad, word_bad = bad.text_scores(weights.astype(np.float32))
        top_good, word_good = good.text_scores(weights.astype(np.float32))
        witness = guess + [bad.word(k) for k in np.flatnonzero((word_bad == top_bad[bad.owner]) | (word_bad + offset > 1))]
        hard = sorted({*hard, *(good.word(int(k)) for k in np.argsort(-word_good)[:max_hard])} - {""})
    margin = np.r_[top_bad, top_good] + offset
    margin = np.where(np.isfinite(margin), margin, -1.0)
    t = np.r_[np.full(len(top_bad), (len(top_bad) + 1) / (len(top_bad) + 2)), np.full(len(top_good), 1 / (len(top_good) + 2))]
    weight = np.r_[np.full(len(top_bad), 0.5 / len(top_bad)), np.full(len(top_good), 0.5 / len(top_good))]
    x, ab = np.c_[margin, np.ones(len(margin))], np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        ab = ab - np.clip(np.linalg.solve(h, x.T @ (weight * (p - t)) + 1e-4 * ab), -2, 2)
    return StringKernelSvm(weights, offset, float(ab[0]), float(ab[1]))


def train_on(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> StringKernelSvm:
    """Fit on the labelled documents that are not held out: at most the two bounds, first by a hash of doc_id."""
    rows = training_rows(docs, labels, "toxic", {1: max_toxic, 0: max_clean}).collect()  # bounded
    rows.sort(key=lambda r: (-r["label"], r["doc_id"]))
    return train([r["text"] for r in rows], [r["label"] for r in rows])


def toxicity(docs: DataFrame, model: StringKernelSvm, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from ``threshold``) of each row.

    Null, empty and wordless texts score as a text far on the clean side; a null doc_id has held_out null; repeated rows
    are scored one by one; an empty table gives no rows; further columns of ``docs`` are not read.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            parts = [model.scores(texts[a:b]) for a, b in groups_by_size(texts, 1 << 19)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts) if parts else np.empty(0))], names=["doc_id", "score"])

    scored = id_and_text(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
