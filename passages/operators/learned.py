"""Learned segmenters: recurrent scorers with given weights, and a trained boundary classifier."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passages.functions.text import stable_hash, words
from passages.operators.segments import gold, sentence_arrays
from passages.shared import shared_folder
from passages.ship import ship


#: Words that are encoded, and sentences that are run through the document encoder, at a time.
WORDS_A_PART, SENTENCES_A_PART = 30_000, 30_000
#: Word vectors that a task holds.
MOST_VECTORS = 500_000


class Packed:
    """Sequences, longest first, laid out step by step without padding: a step holds those that are long enough, in their order."""

    def __init__(self, lengths: np.ndarray):
        self.counts = np.searchsorted(-lengths, -np.arange(lengths[0]))
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.step = np.repeat(np.arange(lengths[0]), self.counts)
        self.row = np.arange(self.starts[-1]) - np.repeat(self.starts[:-1], self.counts)
        self.turned = self.starts[lengths[self.row] - 1 - self.step] + self.row  # the same sequences from their ends
        self.ends = self.starts[lengths - 1] + np.arange(len(lengths))


def lstm(x: np.ndarray, at: Packed, w: dict[str, np.ndarray], reverse: bool = False) -> np.ndarray:
    """Hidden states of one LSTM layer for packed sequences (feature, place); gates in the order input, forget, cell, output;
    zero start.  A sigmoid is taken as half a hyperbolic tangent of the half, so that a step takes one for all gates."""
    size, n = w["hidden"].shape[1], at.counts[0]
    half = np.full((4 * size, 1), 0.5)
    half[2 * size : 3 * size] = 1
    hidden, own = w["hidden"] * half, (w["input"] * half) @ x + w["bias"][:, None] * half
    own = own[:, at.turned] if reverse else own
    h, c, out = np.zeros((size, n)), np.zeros((size, n)), np.empty((size, x.shape[1]))
    for n, start in zip(at.counts.tolist(), at.starts.tolist(), strict=False):
        z = hidden @ h[:, :n]
        z += own[:, start : start + n]
        np.tanh(z, out=z)
        i, f, g, o = z[:size], z[size : 2 * size], z[2 * size : 3 * size], z[3 * size :]
        z[: 2 * size] = z[: 2 * size] * 0.5 + 0.5
        c[:, :n] = f * c[:, :n] + i * g
        h[:, :n] = (o * 0.5 + 0.5) * np.tanh(c[:, :n])
        out[:, start : start + n] = h[:, :n]
    return out[:, at.turned] if reverse else out


def _parts(lengths: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """The numbers of the sequences, longest first, in parts of about ``most`` elements."""
    order = np.argsort(-lengths, kind="stable")
    part = (np.cumsum(lengths[order]) - 1) // most
    yield from np.split(order, np.flatnonzero(np.diff(part)) + 1)


class BiLstm:
    """A sentence encoder (``pool`` "max" or "last") and a document encoder of LSTM layers, and a linear head of two logits."""

    def __init__(self, encoder: list[list[dict]], document: list[list[dict]], head: tuple[np.ndarray, np.ndarray], size: int, pool: str = "max"):
        self.encoder, self.document, self.head, self.size, self.pool = encoder, document, head, size, pool

    @classmethod
    def seeded(cls, size: int, hidden: int, seed: int, layers: int = 2, pool: str = "max", both_ways: bool = True) -> BiLstm:
        rng, ways = np.random.default_rng(seed), 2 if both_ways else 1
        layer = lambda n: [{"input": rng.normal(0, 0.3, (4 * hidden, n)), "hidden": rng.normal(0, 0.3, (4 * hidden, hidden)), "bias": np.zeros(4 * hidden)} for _ in range(ways)]
        stack = lambda n: [layer(n if i == 0 else ways * hidden) for i in range(layers)]
        encoded = ways * hidden if pool == "max" else layers * ways * hidden
        return cls(stack(size), stack(encoded), (rng.normal(0, 0.3, (2, ways * hidden)), np.zeros(2)), size, pool)

    @staticmethod
    def _run(x: np.ndarray, at: Packed, layers: list[list[dict]]) -> tuple[np.ndarray, np.ndarray]:
        last, firsts = [], np.arange(at.counts[0])
        for ways in layers:
            outs = [lstm(x, at, w, i == 1) for i, w in enumerate(ways)]
            last += [o[:, firsts if i == 1 else at.ends] for i, o in enumerate(outs)]
            x = np.concatenate(outs)
        return x, np.concatenate(last)

    def _encode(self, vectors: np.ndarray, words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sentence codes (feature, sentence).  Sentences of like length are run together."""
        starts, codes = np.cumsum(lengths) - lengths, None
        for part in _parts(lengths, WORDS_A_PART):
            at = Packed(lengths[part])
            out, code = self._run(vectors.T[:, words[starts[part][at.row] + at.step]], at, self.encoder)
            if self.pool == "max":
                code = out[:, : len(part)].copy()
                for n, start in zip(at.counts.tolist(), at.starts.tolist(), strict=False):
                    np.maximum(code[:, :n], out[:, start : start + n], out=code[:, :n])
            codes = np.empty((len(code), len(lengths))) if codes is None else codes
            codes[:, part] = code
        return codes

    def probabilities(self, vectors: np.ndarray, words: np.ndarray, lengths: np.ndarray, sentences: np.ndarray) -> np.ndarray:
        """Boundary probability of each sentence of many documents: ``words`` are rows of ``vectors``, ``lengths`` the words of
        each sentence and ``sentences`` the sentences of each document, none of them 0.  Documents do not touch each other."""
        if not len(sentences):
            return np.empty(0)
        codes, starts, p = self._encode(vectors, words, lengths), np.cumsum(sentences) - sentences, np.empty(len(lengths))
        for part in _parts(sentences, SENTENCES_A_PART):
            at = Packed(sentences[part])
            own = starts[part][at.row] + at.step
            out, _ = self._run(codes[:, own], at, self.document)
            logits = self.head[0] @ out + self.head[1][:, None]
            p[own] = 1 / (1 + np.exp(np.clip(logits[0] - logits[1], -40, 40)))
        return p

    def boundary_probabilities(self, sentences: list[np.ndarray]) -> np.ndarray:
        """For all sentences but the last; a sentence is an array (word, feature)."""
        lengths = np.array([len(s) for s in sentences])
        return self.probabilities(np.concatenate(sentences), np.arange(lengths.sum()), lengths, np.array([len(sentences)]))[:-1]


def _vector(word: str, size: int) -> np.ndarray:
    """A fixed pseudo-random vector for a word."""
    import hashlib

    return np.frombuffer(hashlib.shake_128(word.encode()).digest(2 * size), "<u2") / 32768.0 - 1.0


class _Words(dict):
    """Numbers of words as they are first asked for, and their vectors in that order."""

    def __init__(self, size: int):
        self.size, self.vectors = size, []

    def __missing__(self, word: str) -> int:
        self.vectors.append(_vector(word, self.size))
        self[word] = n = len(self.vectors) - 1
        return n


#: Scorers by name; each makes a model from (vector size, hidden size, seed).
SCORERS = {
    "max_pool": lambda size, hidden, seed: BiLstm.seeded(size, hidden, seed),
    "last_state": lambda size, hidden, seed: BiLstm.seeded(size, hidden, seed, pool="last"),
    "one_way": lambda size, hidden, seed: BiLstm.seeded(size, hidden, seed, layers=4, pool="last", both_ways=False),
}


def score_documents(arrays: DataFrame, model: BiLstm) -> DataFrame:
    """doc_id, p: boundary probabilities of all sentences but the last."""
    ship(arrays.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words(model.size)
        for batch in batches:
            if len(known) > MOST_VECTORS:
                known = _Words(model.size)
            words_, lengths, sentences, texts = array("i"), array("q"), array("q"), iter(batch.column(1).flatten().to_pylist())
            for n in batch.column(1).value_lengths().fill_null(0).to_pylist():
                before = len(lengths)
                for text in islice(texts, n):
                    if own := text.split():
                        words_.extend(map(known.__getitem__, own))
                        lengths.append(len(own))
                sentences.append(len(lengths) - before)
            counts = np.array(sentences, np.int64)
            p = model.probabilities(np.array(known.vectors), np.array(words_, np.int64), np.array(lengths, np.int64), counts[counts > 0])
            inner = np.ones(len(p), bool)
            inner[np.cumsum(counts[counts > 0]) - 1] = False
            ends = np.concatenate([[0], np.cumsum(np.maximum(counts - 1, 0))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.round(p[inner], 6)))], names=["doc_id", "p"])

    texts = arrays.select(F.col("doc_id").cast("long"), F.transform("s", lambda x: x["text"]).alias("t"))
    return texts.mapInArrow(run, "doc_id long, p array<double>")


def boundary_counts(docs: DataFrame) -> DataFrame:
    """doc_id, pos, n, label, own, next, both of each sentence but the last: sentences of its document, distinct words of its own, of the next and of both."""
    own = sentence_arrays(docs).select("doc_id", "s", gold(F.col("s")).alias("g"))
    own = own.select("doc_id", "g", F.transform("s", lambda x: F.array_distinct(words(F.lower(x["text"])))).alias("w"), F.size("s").alias("n"))
    inner = F.when(F.col("n") > 1, F.sequence(F.lit(0), F.col("n") - 2))  # a filter would make the sentences once more
    rows = own.select("doc_id", "n", F.posexplode(F.transform(inner, lambda i: F.struct(F.get("g", i).alias("label"), F.size(F.get("w", i)).alias("own"), F.size(F.get("w", i + 1)).alias("next"), F.size(F.array_intersect(F.get("w", i), F.get("w", i + 1))).alias("both")))).alias("pos", "x"))
    return rows.select("doc_id", "pos", "n", "x.label", "x.own", "x.next", "x.both")


def boundary_features(counts: DataFrame) -> DataFrame:
    """doc_id, pos, label and features of counts: lengths, word overlap with the next, place."""
    share = F.col("both") / F.greatest(F.lit(1), F.least("own", "next"))
    return counts.select("doc_id", "pos", F.col("label").cast("double").alias("label"), F.log1p("own").alias("f_own"), F.log1p("next").alias("f_next"), share.alias("f_overlap"), (F.col("pos") / F.col("n")).alias("f_place"))


def trained_segmenter(docs: DataFrame, seed_share: int = 80) -> DataFrame:
    """doc_id, pos, label, p: a logistic boundary classifier, trained on the hashed training share and applied to all.

    The texts are read once: the counts are written, and training and application read those.
    """
    path = shared_folder(docs.sparkSession, "boundaries")
    boundary_counts(docs).write.parquet(path)
    names = ["f_own", "f_next", "f_overlap", "f_place"]
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(boundary_features(docs.sparkSession.read.parquet(path)))
    train = rows.where(stable_hash(F.col("doc_id").cast("string")) % 100 < seed_share)
    model = LogisticRegression(maxIter=20, regParam=0.01).fit(train)
    return model.transform(rows).select("doc_id", "pos", "label", F.round(vector_to_array("probability")[1], 6).alias("p"))


def early_stop(scores: list[float], patience: int | None) -> int | None:
    """The epoch (from 0) after which training stops: ``patience`` epochs in a row without a lower score."""
    best, since = float("inf"), 0
    for i, s in enumerate(scores):
        best, since = (s, 0) if s < best else (best, since + 1)
        if patience and since >= patience:
            return i
    return None
