"""Best-fit packing of tokenised documents into sequences of bounded length.

Only the histogram of piece lengths reaches the driver: at most ``capacity`` counts,
however many documents there are.  The linear grouping scheme is planned on it:

1. lengths above ``capacity * small`` are ranked and cut into groups of equal cardinality,
   and every length in a group is rounded up to the group's largest;
2. the few rounded sizes are combined into configurations, each filled as far as an exact
   subset sum over the sizes still in stock allows;
3. the group's actual documents take the places of the rounded sizes;
4. the small lengths, longest first, go to the fullest sequence that still holds them.

The plan is a list of runs ("ranks a to b of length n lie in sequences s, s+1, ..."), so it
has a bounded size too.  Executors only rank the pieces of a length, in buckets, and look
their places up.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passages.llm.common import bounded_batches, cut, drop_cut, give_back, id_and_text

CAPACITY = 4096
END_ID = 1
#: Pieces of one length that are ranked by one task.
BUCKET_ROWS = 50_000
#: Characters of a text that are split into words at a time.
PART_CHARS = 1 << 20


class WordTokenizer:
    """Ids of a ``word_bpe`` tokenizer, remembered by word.

    White space always separates its tokens, so a text's ids are those of its words in turn.  Words of the
    Latin blocks are split by the tokenizer's own pattern and their parts sent to its model; any other word
    goes through the whole tokenizer.  The memory holds ``most`` words; when full it steps back behind a new one, which
    takes from it the words that come again, so words in use are not split anew.
    """

    _PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str, most: int = 150_000):
        import regex
        from tokenizers import Tokenizer

        self.tok, self.most = Tokenizer.from_file(path), most
        self.model, self.parts = self.tok.model, regex.compile(self._PARTS).findall
        self.words: dict[str, bytes] = {"": b""}
        self.before: dict[str, bytes] = {}
        self.bits: dict[str, bytes] = {}
        self.odd = regex.compile(r"<\||[\x00-\x20\x7f-\xa0]|[^\x00-\u024f]").search
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in keep]
        self.byte = {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def _part(self, part: str) -> bytes:
        if (got := self.bits.get(part)) is None:
            own = part if part.isascii() else "".join(map(self.byte.__getitem__, part.encode()))
            ids = [t.id for t in self.model.tokenize(own)]
            got = self.bits[part] = struct.pack(f"<{len(ids)}I", *ids)
        return got

    def _word(self, word: str) -> bytes:
        if word.isascii():
            if word.isalpha():
                return self._part(word.lower())
            if word[-1] in ".," and word[:-1].isalpha():
                return self._part(word[:-1].lower()) + self._part(word[-1])
        if self.odd(word):
            return np.array(self.tok.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if word.isascii():
            low = word.lower()
        else:
            low = "".join(c.lower() for c in unicodedata.normalize("NFC", word))
            if self.odd(low):
                return np.array(self.tok.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self._part, self.parts(low)))

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids.  Long texts go in parts that end before a blank."""
        if len(text) <= PART_CHARS:
            return self._encode(text)
        out, at = [], 0
        while at < len(text):
            end = text.find(" ", at + PART_CHARS)
            end = len(text) if end < 0 else end
            out.append(self._encode(text[at:end]))
            at = end + 1
        return b"".join(out)

    def _encode(self, text: str) -> bytes:
        if len(self.words) > self.most:
            self.words, self.before = {"": b""}, self.words
        if len(self.bits) > self.most:
            self.bits = {}
        split = text.replace("\n", " ").split(" ")
        known, before = self.words, self.before
        for w in set(split).difference(known):
            known[w] = self._word(w) if (got := before.get(w)) is None else got
        return b"".join(map(known.__getitem__, split))


_TOKENIZERS: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for the life of a Python worker."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian bytes, if asked for) of every document's pieces.

    A null text is empty: its document is the end id alone.
    """
    bounded_batches(docs.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end, step = word_tokenizer(tokenizer_path), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = tok.encode(text) + end
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    out.append((doc_id, at // step, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
            cols = [*zip(*out, strict=True)] or [()] * 6
            arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:5])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.array(cols[5], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
        give_back()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return id_and_text(docs).mapInArrow(pieces, schema)


class _Fill:
    """Runs of alike sequences by free room; best fit takes the least room that suffices."""

    def __init__(self, capacity: int):
        self.capacity, self.next, self.rooms = capacity, 0, []
        self.by_room: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, sequences)
        self.ranks: dict[int, int] = defaultdict(int)
        self.plan: list[tuple[int, int, int, int, int, int]] = []  # length, first rank, items, first sequence, items a sequence, offset

    def open(self, n: int) -> int:
        self.next += n
        return self.next - n

    def put(self, length: int, items: int, first: int, each: int, offset: int) -> None:
        self.plan.append((length, self.ranks[length], items, first, each, offset))
        self.ranks[length] += items

    def leave(self, first: int, n: int, used: int) -> None:
        room = self.capacity - used
        if n and room:
            if room not in self.by_room:
                self.by_room[room] = []
                insort(self.rooms, room)
            self.by_room[room].append((first, n))

    def take(self, length: int) -> tuple[int, int, int] | None:
        at = bisect_left(self.rooms, length)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        first, n = self.by_room[room].pop()
        if not self.by_room[room]:
            del self.by_room[room], self.rooms[at]
        return room, first, n

    def fit(self, length: int, items: int) -> None:
        while items:
            got = self.take(length)
            room, first, n = got or (self.capacity, -1, 0)
            each = room // length
            if got is None:
                n = -(-items // each)
                first = self.open(n)
            full = min(n, items // each)
            used = self.capacity - room
            if full:
                self.put(length, full * each, first, each, used)
                self.leave(first, full, used + each * length)
                items -= full * each
                first, n = first + full, n - full
            if n and items and items < each:  # the last sequence of this length
                self.put(length, items, first, items, used)
                self.leave(first, 1, used + items * length)
                first, n, items = first + 1, n - 1, 0
            if n:
                self.leave(first, n, used)


def _best_sum(sizes: list[int], stock: list[int], room: int) -> list[int]:
    """How many of each size fill ``room`` best; exact, within the stock."""
    reach = np.zeros(room + 1, bool)
    reach[0] = True
    steps = []
    for s, n in zip(sizes, stock, strict=True):
        used = np.zeros(room + 1, np.int16)
        if s <= room:
            for k in range(1, min(n, room // s) + 1):
                new = np.zeros(room + 1, bool)
                new[s:] = reach[:-s] & (used[:-s] == k - 1)
                new &= ~reach
                if not new.any():
                    break
                used[new] = k
                reach |= new
        steps.append(used)
        if reach[room]:
            break
    at, out = int(np.flatnonzero(reach)[-1]), [0] * len(sizes)
    for i in range(len(steps) - 1, -1, -1):
        out[i] = int(steps[i][at])
        at -= out[i] * sizes[i]
    return out


def linear_grouping(lengths: dict[int, int], capacity: int = CAPACITY, groups: int = 16, small: float = 0.125) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, items, first sequence, items a sequence, offset) that place all items of the histogram."""
    fill = _Fill(capacity)
    large = sorted(((n, c) for n, c in lengths.items() if n > capacity * small), reverse=True)
    whole = sum(c for _, c in large)
    stock: list[list[list[int]]] = []  # by group: [length, count] runs, longest first
    taken = 0
    for n, c in large:
        while c:
            edge = -(-whole * len(stock) // groups) if stock else 0
            if taken >= edge and len(stock) < groups:
                stock.append([])
                continue
            part = min(c, edge - taken) if len(stock) < groups else c
            stock[-1].append([n, part])
            c, taken = c - part, taken + part
    stock = [g for g in stock if g]
    merged: dict[int, list[list[int]]] = {}
    for g in stock:
        merged.setdefault(g[0][0], []).extend(g)
    sizes = sorted(merged, reverse=True)
    left = [sum(c for _, c in merged[s]) for s in sizes]
    while any(left):
        top = next(i for i, c in enumerate(left) if c)
        rest = [c - (i == top) for i, c in enumerate(left)]
        some = [i for i in range(len(sizes)) if rest[i]]
        config = [0] * len(sizes)
        for i, k in zip(some, _best_sum([sizes[i] for i in some], [rest[i] for i in some], capacity - sizes[top]), strict=True):
            config[i] = k
        config[top] += 1
        times = min(left[i] // k for i, k in enumerate(config) if k)
        first = fill.open(times)
        slots = [i for i, k in enumerate(config) for _ in range(k)]
        runs = [(first, times, 0)]  # sequences alike so far
        for i in slots:
            queue, out = merged[sizes[i]], []
            for at, n, used in runs:
                while n:
                    length, c = queue[0]
                    now = min(n, c)
                    fill.put(length, now, at, 1, used)
                    out.append((at, now, used + length))
                    at, n = at + now, n - now
                    queue[0][1] -= now
                    if not queue[0][1]:
                        queue.pop(0)
            runs = out
        for at, n, used in runs:
            fill.leave(at, n, used)
        for i, k in enumerate(config):
            left[i] -= k * times
    for n in sorted((n for n in lengths if n <= capacity * small), reverse=True):
        fill.fit(n, lengths[n])
    return fill.plan


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """pieces with sequence_id and offset.  ``pieces`` should be a written table: it is read three times.

    Pieces of one length are ranked in buckets of about ``bucket_rows``, so a length that many pieces
    share (the full pieces, say) is ranked by many tasks.  Pieces that are alike in all columns may swap places.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = linear_grouping(counts, capacity)
    by_length: dict[int, np.ndarray] = {}
    for run in plan:
        by_length.setdefault(run[0], []).append(run[1:])
    by_length = {n: np.array(sorted(runs), np.int64) for n, runs in by_length.items()}
    buckets = F.element_at(F.array(*(F.lit(-(-counts.get(n, 1) // bucket_rows)) for n in range(1, capacity + 1))), F.col("length").cast("int"))
    if not any(n > bucket_rows for n in counts.values()):
        buckets = F.lit(1)
    spread = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), buckets).cast("int"))
    at = spread.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    at = at.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = spread.withColumn("_row", F.row_number().over(within)).join(at, ["length", "_bucket"])
    names = [c for c in pieces.columns]
    ranked = ranked.select(*names, (F.col("_from") + F.col("_row") - 1).cast("long").alias("_rank"))
    bounded_batches(spread.sparkSession, 8192)
    where = names.index("length")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (where, len(names)))
            seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order], prepend=-1)) if len(order) else []
            for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
                rows, runs = order[a:b], by_length[int(length[order[a]])]
                run = runs[np.searchsorted(runs[:, 0], rank[rows], "right") - 1]
                past = rank[rows] - run[:, 0]
                seq[rows] = run[:, 2] + past // run[:, 3]
                off[rows] = run[:, 4] + past % run[:, 3] * length[rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(look_up, f"{schema}, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids if asked for).

    Documents longer than ``capacity`` tokens are cut into pieces; no other is.  Null and empty texts are a piece of
    the end id alone; a null doc_id stays null; repeated rows are packed one by one; an empty table gives no rows;
    further columns of ``docs`` are not read.  The pieces are written to the shared folder first, because their
    lengths decide the plan by which they are then placed.
    """
    pieces, _ = cut(token_pieces(docs, tokenizer_path, capacity, end_id, with_ids))
    return place_pieces(pieces, capacity)


__all__ = ["best_fit_packing", "drop_cut", "linear_grouping", "place_pieces", "token_pieces", "word_tokenizer", "WordTokenizer"]
