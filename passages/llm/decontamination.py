"""Benchmark decontamination: item-sized windows found by SimHash, verified by exact weighted shingles.

For an item of n words every run of n words of a document is a window.  Only windows that share a five-word shingle with
some item can be similar at all, so windows are fingerprinted around such shingles and nowhere else.  A window's
fingerprint is looked up among the items' in a multi-index: of four 16-bit blocks one differs by at most a quarter of
the radius, so the blocks' neighbourhoods hold every fingerprint within the radius.  Candidates are verified by the exact
weighted similarity of their shingle multisets, sum of minima over sum of maxima.

Two texts of similarity 0.8 differ by 10 of 64 bits on average (deviation 3).  The radius of 19 lies three deviations away
and is the largest that neighbourhoods of four bits a block guarantee; one item in seven passes them by chance.  The items
go to the executors in blocks of bounded size, each built once in a Python worker; a benchmark beyond one block takes more
passes over the documents.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passages.llm.common import bounded_batches, give_back, groups_by_size, id_and_text

SHINGLE = 5
LEAST = 0.8
RADIUS = 19
#: Characters of items that one pass sends to every executor.
BLOCK_CHARS = 16 << 20
_WORDS = re.compile(r"[^\W_]+").findall
_M = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(31), np.uint64(29))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _M[2])
    h = h * _M[1]
    return h ^ (h >> _M[3])


def shingle_hashes(codes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """One hash for each run of ``size`` word codes; shorter sequences are one shingle."""
    n = max(1, len(codes) - size + 1) if len(codes) else 0
    h = np.full(n, len(codes) if len(codes) < size else size, np.uint64)
    for j in range(min(size, len(codes))):
        h = h * _M[0] + codes[j : j + n]
    return _mix(_mix(h))


def _simhash(h: np.ndarray) -> int:
    ones = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view(">u8")[0])


class BlockIndex:
    """Fingerprints within ``radius`` of a query, by the neighbourhoods of four 16-bit blocks."""

    def __init__(self, fps: np.ndarray, radius: int):
        self.fps, self.radius = fps, radius
        near = radius // 4
        self.masks = np.array([sum(1 << b for b in bits) for k in range(near + 1) for bits in combinations(range(16), k)], np.uint32)
        self.blocks: list[dict[int, np.ndarray]] = []
        for i in range(4):
            by: dict[int, list[int]] = defaultdict(list)
            for row, v in enumerate((fps >> np.uint64(16 * i) & np.uint64(0xFFFF)).tolist()):
                by[v].append(row)
            self.blocks.append({v: np.array(r) for v, r in by.items()})

    def near(self, query: int) -> np.ndarray:
        rows = []
        for i, by in enumerate(self.blocks):
            v = query >> 16 * i & 0xFFFF
            if len(by) <= len(self.masks):  # fewer block values than neighbours: hold each against the query
                rows += [r for x, r in by.items() if (x ^ v).bit_count() <= self.radius // 4]
            else:
                rows += [by[x] for x in (self.masks ^ v).tolist() if x in by]
        if not rows:
            return np.empty(0, int)
        rows = np.unique(np.concatenate(rows))
        return rows[np.bitwise_count(self.fps[rows] ^ np.uint64(query)) <= self.radius]


class Benchmark:
    """The items of one block, ready for search."""

    def __init__(self, items: list[tuple[int, str]], size: int = SHINGLE, least: float = LEAST, radius: int = RADIUS):
        self.size, self.least = size, least
        self.code: dict[str, int] = {}
        rows = [(item_id, w) for item_id, text in items if (w := _WORDS((text or "").lower()))]
        self.ids = [r[0] for r in rows]
        self.lengths = np.array([len(w) for _, w in rows], np.int64)
        codes = [np.array([self.code.setdefault(x, len(self.code) + 1) for x in w], np.uint64) for _, w in rows]
        hashes = [shingle_hashes(c, size) for c in codes]
        self.counts = [Counter(h.tolist()) for h in hashes]
        self.known = np.unique(np.concatenate(hashes)) if rows else np.empty(0, np.uint64)
        self.short = sorted({len(w) for _, w in rows if len(w) < size})
        self.index = BlockIndex(np.array([_simhash(h) for h in hashes], np.uint64), radius)
        self.by_length = {n: set(np.flatnonzero(self.lengths == n).tolist()) for n in set(self.lengths.tolist())}
        owners: dict[int, set[int]] = defaultdict(set)
        for i, h in enumerate(hashes):
            for x in h.tolist():
                owners[x].add(int(self.lengths[i]))
        self.owners = owners

    def _windows(self, codes: np.ndarray) -> dict[int, np.ndarray]:
        """By length: starts of the windows that share a shingle with an item of that length."""
        n, starts = len(codes), defaultdict(list)
        inside = codes > 0
        if n >= self.size:
            run = np.flatnonzero(np.convolve(inside, np.ones(self.size, np.int8), "valid") == self.size)
            if len(run):
                h = np.zeros(len(run), np.uint64) + np.uint64(self.size)
                for j in range(self.size):
                    h = h * _M[0] + codes[run + j]
                h = _mix(_mix(h))
                at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
                for p, x in zip(run[hit := self.known[at] == h].tolist(), h[hit].tolist(), strict=True):
                    for length in self.owners[x]:
                        if length >= self.size:
                            starts[length].append((max(0, p + self.size - length), min(p, max(0, n - length))))
        out = {}
        for length, spans in starts.items():
            if length <= n:
                edge = np.zeros(n + 2, np.int32)
                a, b = np.array(spans).T
                ok = a <= b
                np.add.at(edge, a[ok], 1)
                np.add.at(edge, b[ok] + 1, -1)
                out[length] = np.flatnonzero(np.cumsum(edge) > 0)
            else:  # a document shorter than the item is one window
                out[length] = np.array([0])
        for length in self.short:
            if n >= length:
                full = np.flatnonzero(np.convolve(inside, np.ones(length, np.int8), "valid") == length)
                if len(full):
                    h = np.zeros(len(full), np.uint64) + np.uint64(length)
                    for j in range(length):
                        h = h * _M[0] + codes[full + j]
                    out[length] = full[np.isin(_mix(_mix(h)), self.known)]
        return out

    def suspects(self, texts: list[str]) -> list[int]:
        """Numbers of the texts that share a shingle with some item (or are as short as a short item)."""
        words, edges = [], [0]
        for t in texts:
            words += _WORDS(t.lower())
            edges.append(len(words))
        codes = np.fromiter(map(self.code.get, words, repeat(0)), np.uint64, len(words))
        known, size, edge = (codes > 0).astype(np.int32), self.size, np.array(edges)
        out = set()
        if len(codes) >= size:
            total = np.cumsum(known, dtype=np.int32)
            run = np.flatnonzero(total[size - 1 :] - np.concatenate([[0], total[:-size]]) == size)
            doc = np.searchsorted(edge, run, "right") - 1
            whole = run + size <= edge[doc + 1]
            run, doc = run[whole], doc[whole]
            h = np.zeros(len(run), np.uint64) + np.uint64(size)
            for j in range(size):
                h = h * _M[0] + codes[run + j]
            h = _mix(_mix(h))
            out.update(doc[self.known[np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)] == h].tolist())
        if self.short:  # such items are found by any run of their length
            out.update(np.flatnonzero(np.diff(edge) > 0).tolist())
        return sorted(out)

    def matches(self, text: str) -> list[tuple[int, int, int, float]]:
        """Best window for each item found: item_id, first word, words, similarity."""
        words = _WORDS(text.lower())
        get = self.code.get
        codes = np.array([get(w, 0) for w in words], np.uint64)
        if not codes.any():
            return []
        windows = self._windows(codes)
        if not windows:
            return []
        own = codes.copy()
        other: dict[str, int] = {}
        for i in np.flatnonzero(codes == 0).tolist():  # words that no item has
            own[i] = other.setdefault(words[i], len(self.code) + 1 + len(other))
        found: dict[int, tuple[float, int, int]] = {}
        for length, starts in windows.items():
            if not len(starts):
                continue
            take = min(length, len(own))
            shingles = max(1, take - self.size + 1)
            low, high = int(starts[0]), int(starts[-1]) + take
            h = shingle_hashes(own[low:high], min(self.size, take))
            bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            total = np.zeros((len(h) + 1, 64), np.int32)
            np.cumsum(bits, axis=0, dtype=np.int32, out=total[1:])
            at = starts - low
            fps = np.packbits(2 * (total[at + shingles] - total[at]) > shingles, axis=1).view(">u8").astype(np.uint64)[:, 0]
            same = self.by_length[length]
            for s, x, f in zip(starts.tolist(), at.tolist(), fps.tolist(), strict=True):
                near = [i for i in self.index.near(f).tolist() if i in same]
                if near:
                    mine = Counter(h[x : x + shingles].tolist())
                    for i in near:
                        both = sum((mine & self.counts[i]).values())
                        sim = both / (shingles + sum(self.counts[i].values()) - both)
                        if sim >= self.least and (sim, -s) > (found[i][0], -found[i][1]) if i in found else sim >= self.least:
                            found[i] = (sim, s, take)
        return [(self.ids[i], s, n, sim) for i, (sim, s, n) in sorted(found.items())]


def _blocks(items: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    held, size = [], 0
    for row in items.toLocalIterator():
        held.append((row["item_id"], row["text"]))
        size += len(row["text"] or "") + 16
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


_BUILT: dict[tuple, Benchmark] = {}


def _built(sent, least: float, radius: int) -> Benchmark:
    """The block's index, built once in a Python worker; the last two are kept."""
    key = (sent.id, least, radius)
    if key not in _BUILT:
        while len(_BUILT) > 1:
            _BUILT.pop(next(iter(_BUILT)))
        _BUILT[key] = Benchmark(sent.value, least=least, radius=radius)
    return _BUILT[key]


class _Sent:
    """A broadcast block of items with a name of its own."""

    def __init__(self, spark: SparkSession, block: list[tuple[int, str]]):
        self.id, self._sent = uuid.uuid4().hex, spark.sparkContext.broadcast(block)

    @property
    def value(self) -> list[tuple[int, str]]:
        return self._sent.value


def _item_rows(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, radius: int = RADIUS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, first_word, n_words, similarity: the best window (the first of equals) for each document and item.

    Words are maximal runs of letters and digits of the lower-cased text.  Null, empty and wordless texts and items match
    nothing; an item of under five words is one shingle, and so is a text.  Null ids stay null; repeated rows are
    searched one by one; empty tables give no rows; further columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    schema, own, out = "doc_id long, item_id long, first_word long, n_words long, similarity double", id_and_text(docs), None
    for block in _blocks(_item_rows(benchmark), block_chars):
        sent = _Sent(spark, block)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = _built(sent, least, radius)
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                some = [a + k for a, z in groups_by_size(texts) for k in items.suspects(texts[a:z])] if items.ids else []
                rows = [(ids[k], *m) for k in some for m in items.matches(texts[k])]
                cols = [*zip(*rows, strict=True)] or [()] * 5
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.float64())], names=["doc_id", "item_id", "first_word", "n_words", "similarity"])

        found = own.mapInArrow(search, schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, radius: int = RADIUS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without the rows that hold a benchmark item.

    Each row is judged by its own text, whatever its doc_id: rows with a null doc_id or one that others have too go or
    stay by themselves.  Null and empty texts stay; empty tables give no rows or drop none.  Rows stay where they are:
    there is no shuffle.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    at, out = docs.columns.index("text"), docs
    for block in _blocks(_item_rows(benchmark), block_chars):
        sent = _Sent(spark, block)

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = _built(sent, least, radius)
            for batch in batches:
                texts = [t or "" for t in batch.column(at).to_pylist()]
                clean = np.ones(len(texts), bool)
                if items.ids:
                    for a, z in groups_by_size(texts):
                        for k in items.suspects(texts[a:z]):
                            clean[a + k] = not items.matches(texts[a + k])
                yield batch.filter(pa.array(clean))
            give_back()

        out = out.mapInArrow(keep, docs.schema)
    return out
