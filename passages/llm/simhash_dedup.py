"""SimHash near-duplicates: sharded BK-trees over distinct fingerprints, then connected components.

Two 64-bit fingerprints within 4 bits differ in at most 4 of 5 blocks, so they agree on one block (12 bits or more).
Each fingerprint joins 5 shards, one for each block; a shard's fingerprints form a BK-tree whose children are keyed by
integer Hamming distance to the parent, and a search follows only the edges within the radius.
Trees are built where their shard lies: to be broadcast they would have to pass through the driver, which is not to hold
the fingerprints of all documents.  A shard of over ``tree_rows`` fingerprints is split by the same rule on the bits that
its members do not share yet, so no link is lost and no tree outgrows its task.  A tree emits links that span its groups,
never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passages.llm.common import bounded_batches, cut, drop_cut, id_and_text, small, words_of

RADIUS = 4
WORDS = 4
TREE_ROWS = 20_000
#: Trees of more fingerprints are built and searched for many at a time.
SMALL_TREE = 256
_UPPER = {c: c + 32 for c in range(65, 91)}


def lower_ascii(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_UPPER)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set, most significant first."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        total += np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: str, words: int = WORDS, seed: int = 42) -> int:
    """Bit b is set if it is set in over half the XXH64 values of the word shingles, repeats included; no words: 0."""
    import xxhash

    w = [x.encode() for x in words_of(lower_ascii(text))]
    if not w:
        return 0
    if len(w) <= words:
        h = np.array([xxhash.xxh64_intdigest(b" ".join(w), seed)], np.uint64)
    else:
        line, hash64 = b" ".join(w), xxhash.xxh64_intdigest
        starts = np.zeros(len(w) + 1, np.int64)
        np.cumsum([len(x) + 1 for x in w], out=starts[1:])
        h = np.array([hash64(line[a:b], seed) for a, b in zip(starts[:-words].tolist(), (starts[words:] - 1).tolist(), strict=True)], np.uint64)
    return int(np.packbits(2 * bit_counts(h) > len(h)).view(">u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) for each row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _sub_masks(mask: int, radius: int) -> list[int]:
    """Masks that share all of ``mask``; fingerprints within the radius that agree on it agree on one of these too."""
    free = [b for b in range(64) if not mask >> b & 1]
    blocks = [sum(1 << b for b in free[i :: radius + 1]) for i in range(radius + 1)]
    return [mask | b for b in blocks]


class SmallTree:
    """A BK-tree that grows by one fingerprint at a time: children keyed by Hamming distance to the parent."""

    def __init__(self) -> None:
        self.fps: list[int] = []
        self.children: list[dict[int, int]] = []
        self.compared = 0

    def add(self, fp: int, radius: int) -> list[int]:
        """Put a fingerprint in; the places of those before it within the radius."""
        new, found = len(self.fps), []
        self.fps.append(fp)
        self.children.append({})
        stack = [0] if new else []
        while stack:
            at = stack.pop()
            d = (self.fps[at] ^ fp).bit_count()
            self.compared += 1
            if d <= radius:
                found.append(at)
            stack += [child for edge, child in self.children[at].items() if d - radius <= edge <= d + radius]
        at = 0
        while new:
            d = (self.fps[at] ^ fp).bit_count()
            if d not in self.children[at]:
                self.children[at][d] = new
                break
            at = self.children[at][d]
        return found


class BKTree:
    """Children keyed by Hamming distance to the parent.  Built and searched for many fingerprints at a time."""

    LEAF = 8

    def __init__(self, fps: np.ndarray):
        self.fps = fps
        self.root = self._build(np.arange(len(fps)))

    def _build(self, members: np.ndarray) -> tuple:
        stack: list = []
        top: list = [None]
        stack.append((members, top, 0))
        while stack:
            rows, holder, at = stack.pop()
            if len(rows) <= self.LEAF:
                holder[at] = (None, rows, None)
                continue
            pivot, rest = rows[0], rows[1:]
            d = np.bitwise_count(self.fps[rest] ^ self.fps[pivot])
            edges = np.unique(d)
            children: list = [None] * len(edges)
            holder[at] = (pivot, edges, children)
            stack.extend((rest[d == e], children, i) for i, e in enumerate(edges))
        return top[0]

    def near(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query rows, member rows) within the radius, a part at a time."""
        stack = [(self.root, np.arange(len(queries)))]
        while stack:
            (pivot, edges, children), q = stack.pop()
            if pivot is None:
                for part in np.array_split(q, max(1, len(q) * len(edges) >> 20)):
                    a, b = np.nonzero(np.bitwise_count(queries[part][:, None] ^ self.fps[edges][None, :]) <= radius)
                    yield part[a], edges[b]
                continue
            d = np.bitwise_count(queries[q] ^ self.fps[pivot]).astype(np.int16)
            yield (hit := q[d <= radius]), np.full(len(hit), pivot)
            for e, child in zip(edges, children, strict=True):
                if len(follow := q[np.abs(d - int(e)) <= radius]):
                    stack.append((child, follow))


def spanning_links(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, root) that connect just what pairs within the radius connect; fps are distinct."""
    n = len(fps)
    label = np.arange(n)

    def merge(a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            la, lb = label[a], label[b]
            differ = la != lb
            if not differ.any():
                return
            a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while not np.array_equal(up := label[label], label):
                label[:] = up

    if n <= SMALL_TREE:
        tree = SmallTree()
        pairs = [(i, j) for i, fp in enumerate(fps.tolist()) for j in tree.add(fp, radius)]
        if pairs:
            merge(*np.array(pairs).T)
    else:
        for b in range(64):  # the closest pairs first: whole clusters become one before the trees are searched
            rest = fps & ~np.uint64(1 << b)
            order = np.argsort(rest, kind="stable")
            same = rest[order][1:] == rest[order][:-1]
            merge(order[1:][same], order[:-1][same])
        tree = BKTree(fps)
        for at in range(0, n, 1024):
            for q, m in tree.near(fps[at : at + 1024], radius):
                merge(q + at, m)
    linked = np.flatnonzero(label != np.arange(n))
    return linked, label[linked]


def _tree_links(radius: int):
    """Links of each run of equal (path, key) in partitions sorted by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3

        def links(cols: list[np.ndarray]) -> pa.RecordBatch | None:
            path, key, fp = cols
            edges = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (key[1:] != key[:-1]), True])
            a_out, b_out = [], []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b - a > 1:
                    own = np.unique(fp[a:b].view(np.uint64))
                    x, y = spanning_links(own, radius)
                    if len(x):
                        a_out.append(own[x].view(np.int64))
                        b_out.append(own[y].view(np.int64))
            if a_out:
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_out)), pa.array(np.concatenate(b_out))], names=["a", "b"])
            return None

        for batch in batches:
            cols = [np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held)]
            if not len(cols[0]):
                continue
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            split = int(last[-1]) + 1 if len(last) else 0
            held = [c[split:] for c in cols]
            if split and (out := links([c[:split] for c in cols])):
                yield out
        if len(held[0]) and (out := links(held)):
            yield out

    return run


def near_links(fps: DataFrame, radius: int = RADIUS, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Links (a, b) between distinct values of column fp; their components are those of all pairs within the radius."""
    bounded_batches(fps.sparkSession, 8192)
    masks, found = {0: 0}, []
    rows = fps.select(F.lit(0).cast("long").alias("path"), F.lit(0).cast("long").alias("key"), "fp")
    fan = radius + 1
    while True:
        below = {p: _sub_masks(m, radius) for p, m in masks.items()}
        masks = {p * fan + i + 1: m for p, ms in below.items() for i, m in enumerate(ms)}
        first = min(below)
        table = F.array(*(F.lit(_signed(m)) for p in sorted(below) for m in below[p]))
        ways = F.explode(F.transform(F.sequence(F.lit(0), F.lit(fan - 1)), lambda i: F.struct((F.col("path") * fan + i + 1).alias("path"), F.col("fp").bitwiseAND(F.get(table, ((F.col("path") - first) * fan + i).cast("int"))).alias("key"))))
        shards = rows.select("fp", ways.alias("s")).select("s.path", "s.key", "fp")
        free = max(64 - m.bit_count() for m in masks.values())
        large = None
        if 1 << free > tree_rows:
            counts = shards.groupBy("path", "key").agg(F.count("*").alias("n")).where(F.col("n") > tree_rows).select("path", "key")
            large, _ = cut(counts)
            if not large.head(1):
                large = None
        here = shards if large is None else shards.join(large, ["path", "key"], "left_anti")
        ordered = here.repartition("path", "key").sortWithinPartitions("path", "key")
        found.append(ordered.mapInArrow(_tree_links(radius), "a long, b long"))
        if large is None:
            break
        rows, _ = cut(shards.join(large, ["path", "key"], "left_semi").select("path", "key", "fp"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root for every node of the links (a, b); nodes of one component share a root, itself one of them.

    Each round every node takes as parent the neighbour (or itself) that comes first in a hashed order, follows two
    more parents, and the links are contracted to those between parents; a hashed order makes chains of parents short,
    so the rounds grow with the logarithm of the number of nodes.  Each round is written to the shared folder.
    """
    spark = links.sparkSession
    edges, at = cut(links.select("a", "b").where("a <> b"))
    roots, held = None, None
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    for _ in range(rounds):
        if not edges.head(1):
            break
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        first = both.groupBy("u").agg(F.min(rank("v")).alias("m"))
        parent, at_parent = cut(first.select("u", F.least(F.col("m"), rank("u"))["n"].alias("p")))
        up = lambda col, name: parent.select(F.col("u").alias(col), F.col("p").alias(name))
        parents, at_up = cut(parent.join(up("p", "p2"), "p").join(up("p2", "p3"), "p2").select("u", F.col("p3").alias("p")))
        to = lambda col, name: parents.select(F.col("u").alias(col), F.col("p").alias(name))
        now = parents.select(F.col("u").alias("node"), F.col("p").alias("root"))
        if roots is not None:
            moved = roots.join(to("root", "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
            now = moved
        new_roots, at_roots = cut(now)
        new_edges, at_edges = cut(edges.join(to("a", "pa"), "a").join(to("b", "pb"), "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        drop_cut(spark, at, at_parent, at_up, *([held] if held else []))
        edges, at, roots, held = new_edges, at_edges, new_roots, at_roots
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = WORDS, tree_rows: int = TREE_ROWS) -> DataFrame:
    """doc_id, fp, fingerprint (16 hex digits), component_id for each row of docs.

    component_id is the smallest doc_id that links reach, the row's own included.  Null and empty texts have the
    fingerprint zero and link like any other.  A null doc_id takes part as any row does but never names a component, so
    component_id is null only where all its doc_ids are.  Rows that repeat a doc_id are rows of their own; an empty
    table gives no rows; further columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    own, _ = cut(fingerprints(docs, words))
    distinct, at = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(near_links(distinct.select("fp"), radius, tree_rows))
    named, at_named = cut(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels, _ = cut(named.select("fp", "root").join(least, "root").select("fp", "component_id"))
    drop_cut(spark, at, at_named)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return own.join(small(labels), "fp").select("doc_id", "fp", hexed.alias("fingerprint"), "component_id")
