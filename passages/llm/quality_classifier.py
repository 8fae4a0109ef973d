"""Document quality by regularised quadratic discriminant analysis.

Each text becomes a vector of transformed statistics.  Each class has a mean and a covariance shrunk towards the pooled
one and towards its diagonal; the Cholesky factors are computed once and cached in the model.  The score is the
difference of the two Gaussian log-densities (from Mahalanobis distances by triangular solves), put through a logistic
function whose slope and shift are fitted on the training rows.

Training takes at most ``max_rows`` labelled documents of each class, the first by a hash of their doc_id.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passages.llm.common import bounded_batches, held_out, id_and_text, training_rows, words_of

MAX_ROWS = 2000
SHRINK = 0.15
_CLASSES = ("upper", "lower", "digit", "symbol", "end", "punctuation", "line", "space", "bang", "other")


def _char_classes() -> np.ndarray:
    table = np.full(1 << 16, _CLASSES.index("other"), np.uint8)
    for i in range(1 << 16):
        c = chr(i)
        kind = unicodedata.category(c)
        name = "line" if c == "\n" else "space" if c in " \t\r\x0b\x0c" else "symbol" if c in "#*$%&|<>=@^~{}[]\\_" else "bang" if c in "!?" else "end" if c == "." else "upper" if kind == "Lu" else "lower" if kind[0] == "L" else "digit" if kind == "Nd" else "punctuation" if kind[0] == "P" else None
        if name:
            table[i] = _CLASSES.index(name)
    return table


_TABLE: list[np.ndarray] = []
N_FEATURES = 18


def statistics(text: str) -> np.ndarray:
    """Transformed statistics of one text; all zero but for the logs if it has no word."""
    if not _TABLE:
        _TABLE.append(_char_classes())
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    n = dict(zip(_CLASSES, np.bincount(_TABLE[0][np.minimum(raw, 65535)], minlength=len(_CLASSES)).tolist(), strict=True))
    chars, words = max(1, len(raw)), words_of(text)
    k = max(1, len(words))
    letters = max(1, n["upper"] + n["lower"])
    lines = [x for x in text.split("\n") if x.strip()]
    m = max(1, len(lines))
    h = np.fromiter(map(hash, words), np.int64, len(words))
    ordered = np.sort(h)
    distinct = 1 + int((ordered[1:] != ordered[:-1]).sum()) if len(h) else 0
    repeats = 0.0
    if len(h) >= 5:
        five = np.zeros(len(h) - 4, np.int64)
        for j in range(5):
            five = five * 1000003 + h[j : len(h) - 4 + j]
        five.sort()
        repeats = float((five[1:] == five[:-1]).sum()) / len(five)
    log = lambda x: float(np.log(x + 0.003))
    return np.array([
        np.log1p(len(raw)), np.log1p(len(words)), np.log1p(sum(map(len, words)) / k),
        log(n["upper"] / letters), log(n["digit"] / chars), log(n["symbol"] / k), log(n["bang"] / k), log(n["end"] / k), log(n["punctuation"] / k),
        log(n["other"] / chars), np.log1p(len(words) / m), log(1 - distinct / k if len(words) else 0.0), log(float((h[1:] == h[:-1]).sum()) / k), log(repeats),
        log(1 - len(set(lines)) / m if lines else 0.0), log(sum(x.rstrip()[-1:] in ".!?:;\"”»)" for x in lines) / m), log(sum(len(x) < 30 for x in lines) / m), log(text.count("|") / k),
    ])


class Qda:
    """Two Gaussians with cached Cholesky factors."""

    def __init__(self, centre: np.ndarray, scale: np.ndarray, means: list[np.ndarray], factors: list[np.ndarray], slope: float, shift: float):
        self.centre, self.scale, self.means, self.factors, self.slope, self.shift = centre, scale, means, factors, slope, shift
        self.inverses = [np.linalg.inv(f) for f in factors]
        self.log_dets = [2 * float(np.log(np.diag(f)).sum()) for f in factors]

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log-density of the good class less that of the bad one."""
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        d = [((z - m) @ inv.T) ** 2 for m, inv in zip(self.means, self.inverses, strict=True)]
        return 0.5 * (d[0].sum(axis=1) + self.log_dets[0] - d[1].sum(axis=1) - self.log_dets[1])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.arcsinh(self.margins(x)) + self.shift, -30, 30)))


class Constant:
    """For training rows of one class only (or none): their share of good ones, a half without any."""

    def __init__(self, score: float):
        self.score = score

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.score)


def fit(x: np.ndarray, y: np.ndarray, shrink: float = SHRINK) -> Qda | Constant:
    if not len(y) or y.min() == y.max():
        return Constant(float(y.mean()) if len(y) else 0.5)
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = np.clip((x - centre) / scale, -8, 8)
    groups = [z[y == c] for c in (0, 1)]
    means = [g.mean(axis=0) for g in groups]
    spread = [(g - m).T @ (g - m) for g, m in zip(groups, means, strict=True)]
    pooled = sum(spread) / len(z)
    factors = []
    for s, g in zip(spread, groups, strict=True):
        a = shrink + (1 - shrink) * min(1.0, x.shape[1] / len(g))  # small classes lean on the pooled covariance
        cov = (1 - a) * s / len(g) + a * (0.5 * pooled + 0.5 * np.diag(np.diag(pooled)))
        factors.append(np.linalg.cholesky(cov + 0.02 * np.eye(len(cov))))
    model = Qda(centre, scale, means, factors, 1.0, 0.0)
    t, ab = np.arcsinh(model.margins(x)), np.array([1.0, 0.0])
    design, weight = np.c_[t, np.ones(len(t))], np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ ab, -30, 30)))
        h = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        ab = ab - np.clip(np.linalg.solve(h, design.T @ (weight * (p - y)) + 1e-3 * (ab - [1.0, 0.0])), -1, 1)
    model.slope, model.shift = float(max(ab[0], 1e-3)), float(ab[1])
    return model


def _with_statistics(rows: DataFrame) -> DataFrame:
    """doc_id, label, x: the statistics of each row of (doc_id, label, text)."""
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t).tolist() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    return rows.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, x array<double>")


def train_on(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Qda | Constant:
    """Fit on the labelled documents that are not held out, at most ``max_rows`` of each class; the driver gets only their statistics."""
    rows = _with_statistics(training_rows(docs, labels, "quality", {0: max_rows, 1: max_rows})).collect()  # bounded
    rows.sort(key=lambda r: (r["label"], r["doc_id"]))
    x, y = [r["x"] for r in rows], [r["label"] for r in rows]
    return fit(np.array(x).reshape(-1, N_FEATURES), np.array(y))


def quality_scores(docs: DataFrame, model: Qda | Constant, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from ``threshold``) of each row.

    Null and empty texts have the statistics of no word and a score like any other; a null doc_id has held_out null;
    repeated rows are scored one by one; an empty table gives no rows; further columns of ``docs`` are not read.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(1).to_pylist()]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x), pa.float64())], names=["doc_id", "score"])

    scored = id_and_text(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
