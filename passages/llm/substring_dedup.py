"""Exact removal of repeated 13-word windows, behind a count-min prefilter.

Documents are read in batches of consecutive rows (about ``batch_chars`` characters).  A batch reduces its windows to
distinct ones with their smallest doc_id, so a passage in very many documents is one entry a batch.

1. Every task counts its batches' windows in a count-min sketch of two rows and sends the occupied cells, split into
   slices; the slices are summed, and one bit for each cell tells whether the cell was met twice or more.  The sketch is
   broadcast.  Its size follows the corpus up to ``most_bits`` (128 MB), which bounds the broadcast; beyond that it
   overestimates more often, which costs shuffle but loses nothing.
2. Windows that the sketch estimates in two batches or more go, as 96-bit keys, to slices of the key space.  There equal
   keys are grouped exactly and the smallest doc_id goes back to each batch that had a larger one.
3. Each batch, joined with its answers, marks the covered words.  Batches are named by their content, and an answer
   that finds no batch stops the job.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passages.llm.common import bounded_batches, cut, id_and_text, words_of

WINDOW = 13
BATCH_CHARS = 4 << 20
SLICE_CELLS = 1 << 20
BITS_A_WINDOW = 6
MOST_BITS = 1 << 30
#: Keys that one slice of the exact pass is planned for.
SLICE_KEYS = 1_000_000
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_32 = np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)


class _Digests(dict):
    def __missing__(self, word: str) -> bytes:
        own = self[word] = xxhash.xxh3_128_digest(word.encode("utf-8", "surrogatepass"))
        return own


class WordHashes:
    """128-bit hashes of words, remembered up to a bound."""

    def __init__(self, most: int = 600_000):
        self.most, self.known = most, _Digests()

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.known) > self.most:
            self.known = _Digests()
        return np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.uint64).reshape(-1, 2)


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(29)
    return h


class Batch:
    """Windows of some documents: distinct keys, their smallest doc_id, and the key of each window."""

    def __init__(self, hashes: WordHashes, ids: list[int | None], texts: list[str], window: int):
        self.ids, self.window = ids, window
        self.words = [words_of(t) for t in texts]
        ones, twos, docs, starts = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)], []
        at = 0
        for doc_id, words in zip(ids, self.words, strict=True):
            n = len(words) - window + 1 if doc_id is not None else 0
            starts.append((at, max(n, 0)))
            if n < 1:
                continue
            h = hashes.of(words)
            a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            first, second = np.ascontiguousarray(h[:, 0]), np.ascontiguousarray(h[:, 1])
            for j in range(window):
                a *= _B1
                a += first[j : j + n]
                b *= _B2
                b += second[j : j + n]
            ones.append(_mixed(a))
            twos.append(_mixed(b) & _LOW)
            docs.append(np.full(n, doc_id, np.int64))
            at += n
        h1, h2, doc = np.concatenate(ones), np.concatenate(twos), np.concatenate(docs)
        order = np.argsort(h1)
        h1, h2 = h1[order], h2[order]
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        first = np.flatnonzero(new)
        self.h1, self.h2 = h1[first], h2[first]
        self.least = np.minimum.reduceat(doc[order], first) if len(first) else np.empty(0, np.int64)
        self.key = np.empty(len(h1), np.int64)
        self.key[order] = np.cumsum(new) - 1
        self.starts = starts

    def results(self, least: np.ndarray) -> list[tuple]:
        """doc_id, n_words, n_removed, sha256 and spans of each document; least: smallest doc_id by key."""
        out = []
        for doc_id, words, (at, n) in zip(self.ids, self.words, self.starts, strict=True):
            cover = np.zeros(len(words) + 1, np.int32)
            if n:
                hit = np.flatnonzero(least[self.key[at : at + n]] < doc_id)
                np.add.at(cover, hit, 1)
                np.add.at(cover, hit + self.window, -1)
            gone = np.cumsum(cover[:-1]) > 0
            kept = words if not gone.any() else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
            out.append((doc_id, len(words), len(words) - len(kept), " ".join(kept), edges.tolist()))
        return out


def _stream(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, list]]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(doc_id)
            texts.append(text)
            size += len(text) + 8
            if size >= most:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _name(ids: list, texts: list) -> bytes:
    digest = hashlib.blake2b(repr(ids).encode(), digest_size=16)
    for t in texts:
        digest.update(len(t).to_bytes(8, "little"))
        digest.update(t.encode("utf-8", "surrogatepass"))
    return digest.digest()


def _cells(h1: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The window's cell in each of the two rows, which lie one after the other."""
    w = np.uint64(width)
    return ((h1 >> _32) * w >> _32, ((h1 & _LOW) * w >> _32) + w)


def _packed(cells: np.ndarray) -> bytes:
    """Sorted distinct cells as gaps of a byte each; 255 carries on."""
    gaps = np.diff(cells.astype(np.int64), prepend=0)
    more = gaps // 255
    ends = np.cumsum(more + 1) - 1
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 255, np.uint8)
    out[ends] = gaps % 255
    return out.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    gaps = np.frombuffer(data, np.uint8)
    return np.cumsum(gaps, dtype=np.int64)[gaps < 255]


def _sketch(docs: DataFrame, width: int, window: int, batch_chars: int) -> np.ndarray:
    """Bits of the merged sketch: cells that two batches or more have met.  The driver gets 2 * width bits."""
    slices = -(-2 * width // SLICE_CELLS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        met, held = [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            cells = np.sort(np.concatenate(met))
            new = np.ones(len(cells), bool)
            new[1:] = cells[1:] != cells[:-1]
            again = np.zeros(len(cells), bool)
            again[1:] = ~new[1:]
            firsts = np.flatnonzero(new)
            twice = np.logical_or.reduceat(again, firsts)
            cells = cells[firsts]
            edges = np.searchsorted(cells, np.arange(slices + 1, dtype=np.uint32) * np.uint32(SLICE_CELLS))
            part, one, two = [], [], []
            for k in np.flatnonzero(np.diff(edges)).tolist():
                own = slice(edges[k], edges[k + 1])
                local = cells[own] - np.uint32(k * SLICE_CELLS)
                part.append(k)
                one.append(_packed(local[~twice[own]]))
                two.append(_packed(local[twice[own]]))
            for a in range(0, len(part), 64):
                yield pa.RecordBatch.from_arrays([pa.array(part[a : a + 64], pa.int32()), pa.array(one[a : a + 64], pa.binary()), pa.array(two[a : a + 64], pa.binary())], names=["slice", "one", "two"])

        for ids, texts in _stream(batches, batch_chars):
            own = Batch(hashes, ids, texts, window)
            for row in _cells(own.h1, width):
                met.append(row.astype(np.uint32))
                held += len(row)
            if held > 8_000_000:
                yield from sent()
                met, held = [], 0
        if held:
            yield from sent()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen = -1, np.zeros(SLICE_CELLS, np.uint8)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(seen > 1).tobytes()], pa.binary())], names=["slice", "bits"])

        for batch in batches:
            for k, one, two in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
                if k != at:
                    if at >= 0:
                        yield done()
                    at, seen = k, np.zeros(SLICE_CELLS, np.uint8)
                cells = _unpacked(one)
                seen[cells] = np.minimum(seen[cells] + 1, 2)
                seen[_unpacked(two)] = 2
        if at >= 0:
            yield done()

    counted = docs.mapInArrow(count, "slice int, one binary, two binary")
    merged = counted.repartition("slice").sortWithinPartitions("slice").mapInArrow(merge, "slice int, bits binary")
    bits = np.zeros(slices * SLICE_CELLS // 8, np.uint8)
    for row in merged.toLocalIterator():  # one partition at a time; 2 * width bits in all, which most_bits bounds
        bits[row["slice"] * SLICE_CELLS // 8 :][: SLICE_CELLS // 8] = np.frombuffer(row["bits"], np.uint8)
    return bits


def _deltas(x: np.ndarray) -> bytes:
    return zlib.compress(np.diff(x.astype(np.int64), prepend=0).tobytes(), 1)


def _undeltas(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), np.int64))


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a slice stand together.  To each batch: which of its keys another batch has in a smaller doc_id, and that doc_id."""
    at, rows = None, []

    def done() -> Iterator[pa.RecordBatch]:
        h1 = np.concatenate([np.frombuffer(r[1], np.uint64) for r in rows])
        h2 = np.concatenate([np.frombuffer(r[2], np.uint32) for r in rows])
        doc = np.concatenate([_undeltas(r[3]) for r in rows])
        sizes = [len(r[1]) // 8 for r in rows]
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        least = np.empty(len(doc), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(doc[order], first), np.diff(np.r_[first, len(doc)]))
        start = 0
        names, keys, docs = [], [], []
        for r, n in zip(rows, sizes, strict=True):
            hit = np.flatnonzero(least[start : start + n] < doc[start : start + n])
            if len(hit):
                names.append(r[0])
                keys.append(_deltas(np.frombuffer(zlib.decompress(r[4]), np.uint32)[hit]))
                docs.append(_deltas(least[start : start + n][hit]))
            start += n
        for x in range(0, len(names), 256):
            yield pa.RecordBatch.from_arrays([pa.array(c[x : x + 256], pa.binary()) for c in (names, keys, docs)], names=["name", "keys", "docs"])

    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        for k, *row in zip(*cols, strict=True):
            if k != at and rows:
                yield from done()
                rows = []
            at = k
            rows.append(row)
    if rows:
        yield from done()


def _marked(docs: DataFrame, window: int, batch_chars: int, slice_keys: int, bits_a_window: float, most_bits: int) -> DataFrame:
    spark = docs.sparkSession
    bounded_batches(spark)
    own = id_and_text(docs)
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():  # rows that a shuffle deals out may change places between two reads
        own, _ = cut(own)
    chars = own.agg(F.sum(F.length("text"))).head()[0] or 0
    width = int(min(most_bits, max(1 << 16, bits_a_window * chars / 6)) // 2)
    bits = spark.sparkContext.broadcast(_sketch(own, width, window, batch_chars))
    parts = int(max(8, chars / 6 * 0.35 // slice_keys + 1))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sketch = WordHashes(), bits.value
        for ids, texts in _stream(batches, batch_chars):
            b = Batch(hashes, ids, texts, window)
            name, hit = _name(ids, texts), np.ones(len(b.h1), bool)
            for cell in _cells(b.h1, width):
                hit &= (sketch[cell >> np.uint64(3)] >> (np.uint8(7) - (cell & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
            keys = np.flatnonzero(hit)
            part = (b.h2[keys] * np.uint64(parts) >> _32).astype(np.int64)
            order = np.argsort(part, kind="stable")
            keys, part = keys[order], part[order]
            edges = np.searchsorted(part, np.arange(parts + 1))
            out = []
            for k in np.flatnonzero(np.diff(edges)).tolist():
                x = keys[edges[k] : edges[k + 1]]
                out.append((k, name, b.h1[x].tobytes(), b.h2[x].astype(np.uint32).tobytes(), _deltas(b.least[x]), zlib.compress(x.astype(np.uint32).tobytes(), 1)))
            for a in range(0, len(out), 256):
                cols = [*zip(*out[a : a + 256], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["slice", "name", "h1", "h2", "doc", "key"])

    sent = own.mapInArrow(candidates, "slice int, name binary, h1 binary, h2 binary, doc binary, key binary")
    answers = sent.repartition(parts, "slice").sortWithinPartitions("slice").mapInArrow(_answers, "name binary, keys binary, docs binary")

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _stream(batches, batch_chars):
            blob = zlib.compress(pickle.dumps((ids, texts)), 1)
            yield pa.RecordBatch.from_arrays([pa.array([_name(ids, texts)], pa.binary()), pa.array([blob], pa.binary())], names=["name", "blob"])

    told = answers.groupBy("name").agg(F.collect_list(F.struct("keys", "docs")).alias("told"))  # at most a row for each slice and batch
    return own.mapInArrow(blobs, "name binary, blob binary").join(told, "name", "full").select("blob", "told")


def _least(b: Batch, told: list[dict] | None) -> np.ndarray:
    least = b.least.copy()
    for row in told or ():
        keys = _undeltas(row["keys"])
        least[keys] = np.minimum(least[keys], _undeltas(row["docs"]))
    return least


def remove_repeats(docs: DataFrame, window: int = WINDOW, digest: bool = False, batch_chars: int = BATCH_CHARS, slice_keys: int = SLICE_KEYS, bits_a_window: float = BITS_A_WINDOW, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, n_words, n_removed, and the kept text with the removed word spans (or kept_sha256 if ``digest``).

    A word goes if it lies in a window of ``window`` words that also starts in a document with a smaller doc_id; windows
    are judged on the input.  Null and empty texts and texts shorter than a window lose nothing.  A null doc_id is
    neither smaller nor larger than any other.  Rows that repeat a doc_id don't count against each other but are both
    held against smaller ones; an empty table gives no rows; further columns of ``docs`` are not read.
    removed_spans holds word numbers: start, end (exclusive), start, end, and so on.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for row in range(batch.num_rows):
                blob, told = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                if blob is None:
                    raise RuntimeError("the documents changed between two reads")
                b = Batch(hashes, *pickle.loads(zlib.decompress(blob)), window)
                results = b.results(_least(b, told))
                for a in range(0, len(results), 512):
                    ids, n, gone, text, spans = zip(*results[a : a + 512], strict=True)
                    cols = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())]
                    if digest:
                        cols += [pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in text], pa.string())]
                    else:
                        cols += [pa.array(text, pa.string()), pa.array(spans, pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", *(["kept_sha256"] if digest else ["kept_text", "removed_spans"])])

    schema = "doc_id long, n_words long, n_removed long, " + ("kept_sha256 string" if digest else "kept_text string, removed_spans array<long>")
    marked = _marked(docs, window, batch_chars, slice_keys, bits_a_window, most_bits)
    return marked.mapInArrow(run, schema)
