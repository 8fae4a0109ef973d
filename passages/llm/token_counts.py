"""Count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's matches in a word; dynamic programming over their end positions
carries the best score and the number of pieces of the best path, and no path is kept.  Ties go as in the unigram
tokenizers: start positions are visited from the left and a later start replaces an earlier one only if it scores
higher, so of equal paths the one with the longer last piece stays.  A character that no piece matches costs the lowest
score less ten and counts as many pieces as it has bytes (byte fallback).

The vocabulary is that of a SentencePiece file: its normal pieces with their scores.  (The file at hand was made for
merges, so its scores are merge ranks; read as a unigram vocabulary they give other counts than the merges would.)
No piece has the word mark anywhere but in front, so the best path of a text is that of its words one after another,
and words are remembered.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from passages.llm.common import bounded_batches, id_and_text

MARK = "▁"
UNKNOWN_PENALTY = 10.0


def unigram_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece file, without control, unknown and byte pieces and those scored never to be used."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in own if sp.get_score(i) > -1e8]


class ViterbiCounter:
    """Best score and piece count of texts; words are remembered up to ``most``."""

    def __init__(self, vocabulary: list[tuple[str, float]], most: int = 500_000):
        import ahocorasick

        if any(MARK in piece[1:] for piece, _ in vocabulary):
            raise ValueError("a piece has the word mark inside")
        self.machine = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.most, self.words = most, {}

    def word(self, word: str) -> tuple[int, float, int]:
        """Pieces, score and unknown characters of one marked word."""
        n = len(word)
        at: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.machine.iter(word):
            at[end].append(match)
        score, count, odd = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        for end in range(n):
            best = None
            for length, own in sorted(at[end], reverse=True):  # longest first: the earliest start
                s = score[end + 1 - length] + own
                if best is None or s > best:
                    best, start, pieces, o = s, end + 1 - length, 1, 0
            if (c := word[end]) not in self.single and (best is None or score[end] + self.unknown > best):
                best, start, pieces, o = score[end] + self.unknown, end, len(c.encode("utf-8", "surrogatepass")), 1
            score[end + 1], count[end + 1], odd[end + 1] = best, count[start] + pieces, odd[start] + o
        return count[n], score[n], odd[n]

    def text(self, text: str) -> tuple[int, float, int]:
        if not text:
            return 0, 0.0, 0
        if len(self.words) > self.most:
            self.words = {}
        words, known = text.replace(MARK, " ").split(" "), self.words
        for w in set(words).difference(known):
            known[w] = self.word(MARK + w)
        n, s, o = zip(*map(known.__getitem__, words), strict=True)
        return sum(n), sum(s), sum(o)


_COUNTERS: dict[str, ViterbiCounter] = {}


def _counter(path: str) -> ViterbiCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = ViterbiCounter(unigram_vocabulary(path))
    return _COUNTERS[path]


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, score (of the best path) and n_unknown (characters that no piece matches) of each row.

    ``model_path`` is read on the executors.  Null and empty texts have no token and score 0; a null doc_id stays null;
    repeated rows are counted one by one; further columns of ``docs`` are not read.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model_path)
        for batch in batches:
            n, s, o = zip(*map(counter.text, batch.column(1).to_pylist()), strict=True) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(s, pa.float64()), pa.array(o, pa.int64())], names=["doc_id", "n_tokens", "score", "n_unknown"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, score double, n_unknown long")
