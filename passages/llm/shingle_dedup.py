"""Near copies by five-word shingles: every pair of texts of Jaccard similarity 0.8 or more, then connected components.

The shingles of all texts are put in one order, rare ones first.  Two sets of similarity s share a shingle among the
first n - ceil(s n) + 1 of each ("prefix filter"), whatever the order, so texts are candidates where their prefixes meet,
their sizes allow s and enough shingles are left after the place where they meet.  Candidates are verified by the exact
Jaccard similarity of their sets of 64-bit shingle hashes.  The order comes from counts in a sample of the texts, which
decides how many candidates there are, never which pairs are found.

The first candidates are the links that BK-trees find between the texts' SimHash fingerprints over the same shingles, within
the radius of ``simhash_dedup``; they are verified like all others.  A similarity of 0.8 leaves fingerprints about 10 bits
apart, for which the trees' blocks get too wide, so what the trees cannot reach is left to the prefixes.

Of the texts that meet at one shingle one is the star, the first in a hashed order, and every text is held against the star
that it meets most often; shingles whose texts the links connect are done with.  Of the texts that are not connected after
that, pairs are compared but for those that the parities of their hashes in ``BINS`` bins set apart: where k parities differ,
the sets differ in k hashes at least, and sets of similarity s differ in at most (1 - s) / (1 + s) of their hashes together.
At each shingle first only as many pairs are made as connect its texts, fewer than it has texts; all pairs that are left
are made only where those have not connected them.  What is left out cannot change the components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passages.llm.common import bounded_batches, cut, drop_cut, give_back, small, words_of
from passages.llm.decontamination import shingle_hashes
from passages.llm.simhash_dedup import bit_counts, components, lower_ascii, near_links

WORDS = 5
#: Least similarity as a fraction.
NUM, DEN = 4, 5
#: One text in so many is counted for the order; at most so many common shingles go to every executor.
SAMPLE = 8
MOST_COMMON = 1 << 19
#: Bins whose parities are compared.
BINS = 512
#: Texts of one shingle that are held together.
BLOCK = 2000
_CODES = 1 << 17
_ROW = "_near_copy_row"


def hasher() -> Callable[[str], np.ndarray]:
    """A function that gives the sorted distinct hashes of a text's shingles; none for a text without words."""
    import xxhash

    codes: dict[str, int] = {}

    def hashes(text: str) -> np.ndarray:
        own = words_of(lower_ascii(text))
        if len(codes) > _CODES:
            codes.clear()
        for w in own:
            if w not in codes:
                codes[w] = xxhash.xxh64_intdigest(w.encode())
        return np.unique(shingle_hashes(np.fromiter((codes[w] for w in own), np.uint64, len(own)), WORDS))

    return hashes


def parities(h: np.ndarray) -> bytes:
    """One bit for each bin: whether an odd number of the hashes fall into it."""
    return np.packbits((np.bincount((h & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS) & 1).astype(np.uint8)).tobytes()


def simhash(h: np.ndarray) -> int:
    """The 64-bit fingerprint of a set: a bit is set if it is set in over half of the hashes; no hashes: 0."""
    return int(np.packbits(2 * bit_counts(h) > len(h)).view(">u8")[0])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the least similarity."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both)


def _common(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that three or more texts of the sample have, sorted, and how many have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = hasher()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(hashes(t).view(np.int64))], names=["h"])

    sample = rows.where(F.pmod(F.xxhash64(_ROW), F.lit(SAMPLE)) == 0).select("text")
    counts = sample.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 2")
    got = counts.orderBy(F.desc("n"), "h").limit(MOST_COMMON).toArrow()
    h = got.column("h").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], got.column("n").to_numpy()[order]


def _prefixes(rows: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """row, doc_id, sig (of the set), n (its size), bits (its parities), fp (its SimHash as a signed long), prefix of each row."""
    told = rows.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes, (known, count) = hasher(), told.value
        for batch in batches:
            sig, size, bits, fp, prefix = [], [], [], [], []
            for t in batch.column(2).to_pylist():
                h = hashes(t)
                weight = np.zeros(len(h), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    weight = np.where(known[at] == h, count[at], 0)
                n = len(h)
                sig.append(xxhash.xxh128_digest(h.tobytes()))
                size.append(n)
                bits.append(parities(h))
                fp.append(simhash(h))
                prefix.append(h[np.lexsort((h, weight))[: n - -(-NUM * n // DEN) + 1]].view(np.int64))
            arrays = [batch.column(0), batch.column(1), pa.array(sig, pa.binary()), pa.array(size, pa.int32()), pa.array(bits, pa.binary()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(prefix, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "doc_id", "sig", "n", "bits", "fp", "prefix"])
        give_back()

    return rows.mapInArrow(run, "row long, doc_id long, sig binary, n int, bits binary, fp long, prefix array<long>")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns of whole runs of equal first column, and the runs' edges."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        edges = np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1], True])
        held = [c[edges[-2] :] for c in cols]
        if len(edges) > 2:
            yield [c[: edges[-2]] for c in cols], edges[:-1]
    if held is not None and len(held[0]):
        yield held, np.array([0, len(held[0])])


def _may_be_similar(n: Column, p: Column, n2: Column, p2: Column) -> Column:
    """Whether the sizes, and what is left after the places where two prefixes meet, allow the similarity."""
    return (DEN * F.least(n, n2) >= NUM * F.greatest(n, n2)) & ((NUM + DEN) * F.least(n - p, n2 - p2) >= NUM * (n + n2))


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _simhash_pairs(texts: DataFrame) -> DataFrame:
    """Pairs of the texts (node, fp): those of one fingerprint with the first of them, and firsts whose fingerprints BK-trees link."""
    first, _ = cut(texts.groupBy("fp").agg(F.min("node").alias("s")))
    to = lambda end, name: first.select(F.col("fp").alias(end), F.col("s").alias(name))
    near = near_links(first.select("fp")).join(to("a", "node"), "a").join(to("b", "s"), "b").select("node", "s")
    alike = texts.join(first, "fp").where("node <> s").select("node", "s")
    return near.unionByName(alike).select(*_pair("node", "s")).distinct()


def _mixed(shared: DataFrame) -> DataFrame:
    """The rows of ``shared`` (h, node, n, p, c) at shingles whose texts are not all of one component c."""
    at = Window.partitionBy("h")
    return shared.withColumn("low", F.min("c").over(at)).withColumn("high", F.max("c").over(at)).where("low <> high").drop("low", "high")


def _named(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with c, a name of the component that the links put the text ``node`` into."""
    return rows.join(small(components(links)), "node", "left").withColumn("c", F.coalesce("root", "node")).drop("root")


def _star_pairs(mixed: DataFrame, order: int) -> DataFrame:
    """Each text with the star that it meets most often, of those that are not connected to it yet."""
    first = F.min(F.struct(F.xxhash64(F.lit(order), "node").alias("rank"), F.col("node").alias("s"), F.col("n").alias("sn"), F.col("p").alias("sp"), F.col("c").alias("sc"))).over(Window.partitionBy("h"))
    met = mixed.withColumn("f", first).select("node", "n", "p", "c", "f.s", "f.sn", "f.sp", "f.sc").where("c <> sc").where(_may_be_similar(*map(F.col, ("n", "p", "sn", "sp"))))
    times = met.groupBy("node", "s").agg(F.count("*").alias("k"))
    best = times.groupBy("node").agg(F.max(F.struct("k", F.xxhash64(F.lit(order), "s").alias("rank"), "s"))["s"].alias("s"))
    return best.select(*_pair("node", "s")).distinct()


def _apart(odd: np.ndarray, other: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether the parities of sets of n and m hashes rule the similarity out."""
    return (NUM + DEN) * np.bitwise_count(odd ^ other).sum(axis=1, dtype=np.int64) > (DEN - NUM) * (n + m)


def _spanning(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Places of the pairs (i, j) that connect labels which nothing connects yet; ``label`` follows."""
    taken, at = [np.empty(0, np.int64)], np.arange(len(i))
    while len(at := at[label[i[at]] != label[j[at]]]):
        x, y = label[i[at]], label[j[at]]
        high, first = np.unique(np.maximum(x, y), return_index=True)
        label[high] = np.minimum(x, y)[first]
        taken.append(at[first])
        while not np.array_equal(up := label[label], label):
            label[:] = up
    return np.concatenate(taken)


def _other_pairs(mixed: DataFrame, bits: DataFrame, whole: bool) -> DataFrame:
    """Pairs (a, b) of texts that meet at a shingle, have different c and may be similar; ``bits``: n and parities of each node.

    With ``whole`` all of them.  Else of each shingle only as many as connect what all of them would connect, and with a and
    b null the rows (h, node, n, p) of the texts that have such pairs: what the pairs do not connect is to be looked for there.
    ``BLOCK`` texts of a shingle at most are held together with as many others.
    """
    many = F.ceil(F.count("*").over(Window.partitionBy("h")) / BLOCK).cast("int")
    own = mixed.withColumn("k", many).join(bits.select("node", "bits"), "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    keyed = own.select("h", "node", "n", "p", "c", "bits", "own", others.alias("other")).select(F.xxhash64("h", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "h", "own", (F.col("own") == F.col("other")).alias("alike"), "node", "n", "p", "c", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "h", "node", "n", "p"]
        types = [pa.int64()] * 4 + [pa.int32()] * 2
        rows = lambda *cols: pa.RecordBatch.from_arrays([pa.nulls(len(cols[0] if cols[0] is not None else cols[2]), t) if c is None else pa.array(c.astype(t.to_pandas_dtype())) for c, t in zip(cols, types, strict=True)], names=names)
        for cols, edges in _runs(batches):
            h, block, alike, node, n, p, c = (x.astype(np.int64) for x in cols[1:-1])
            odd = np.frombuffer(b"".join(cols[-1].tolist()), np.uint64).reshape(len(h), BINS // 64)
            part = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            order = np.lexsort((c, part))
            new = np.r_[True, (c[order][1:] != c[order][:-1]) | (part[order][1:] != part[order][:-1])]
            label = np.empty(len(h), np.int64)
            label[order] = order[new][np.cumsum(new) - 1]
            has = np.zeros(len(h), bool)
            for i, j in _later(np.repeat(edges[1:], np.diff(edges))):
                less, great = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
                left = np.minimum(n[i] - p[i], n[j] - p[j])
                ok = (h[i] == h[j]) & (DEN * less >= NUM * great) & ((NUM + DEN) * left >= NUM * (n[i] + n[j])) & (c[i] != c[j])
                ok &= (alike[i] == alike[j]) & ((alike[i] == 1) == (block[i] == block[j]))
                i, j = i[ok], j[ok]
                ok = ~_apart(odd[i], odd[j], n[i], n[j])
                i, j = i[ok], j[ok]
                has[i] = has[j] = True
                if not whole:
                    few = _spanning(label, i, j)
                    i, j = i[few], j[few]
                if len(i):
                    a, b = node[i], node[j]
                    pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                    yield rows(pair[0], pair[1], None, None, None, None)
            if not whole and has.any():
                yield rows(None, None, h[has], node[has], n[has], p[has])

    dealt = keyed.withColumn("_order", F.xxhash64("node")).repartition("key").sortWithinPartitions("key", "_order").drop("_order")
    return dealt.mapInArrow(run, "a long, b long, h long, node long, n int, p int")


def _later(ends: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each place with every later one of its run, about ``most`` pairs at a time."""
    here, step, held, size = np.arange(len(ends)), 1, [], 0
    while len(here := here[here + step < ends[here]]):
        held.append((here, here + step))
        size += len(here)
        step += 1
        if size >= most:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _verified(pairs: DataFrame, rows: DataFrame, bits: DataFrame) -> tuple[DataFrame, str]:
    """The pairs (a, b) of rows, written, whose texts are similar; pairs that parities set apart are not looked at further."""
    spark = rows.sparkSession
    ends = lambda pairs: pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 4))
            odd, other = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(batch.num_rows, BINS // 64) for i in (3, 5))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(~_apart(odd, other, n, m)))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = hasher()
        for batch in batches:
            own = [hashes(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["node", "own"])
        give_back()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(i).to_pylist() for i in (2, 3))
            good = pa.array([similar(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)) for s, t in zip(x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(good)

    all_ends, at_all = cut(ends(pairs))
    known = bits.join(small(all_ends), "node", "left_semi")
    to = lambda own, end, *names: own.select(F.col("node").alias(end), *(F.col(c).alias(name) for c, name in zip(own.columns[1:], names, strict=True)))
    told = pairs.join(to(known, "a", "n", "x"), "a").join(to(known, "b", "m", "y"), "b").select("a", "b", "n", "x", "m", "y")
    left, at_left = cut(told.mapInArrow(near, "a long, b long"))
    need, at_need = cut(ends(left))
    own, at_own = cut(rows.select(_ROW, "text").join(small(need.withColumnRenamed("node", _ROW)), _ROW, "left_semi").mapInArrow(sets, "node long, own binary"))
    firsts = own.join(small(left.select(F.col("a").alias("node")).distinct()), "node", "left_semi")
    seconds = own.join(small(left.select(F.col("b").alias("node")).distinct()), "node", "left_semi")
    both = left.join(to(firsts, "a", "x"), "a").join(to(seconds, "b", "y"), "b").select("a", "b", "x", "y")
    out = cut(both.mapInArrow(check, "a long, b long"))
    drop_cut(spark, at_all, at_left, at_need, at_own)
    return out


def _near_copies(keyed: DataFrame) -> DataFrame:
    """row, doc_id, root of each row of ``keyed``, whose rows have a key; near copies share a root."""
    spark = keyed.sparkSession
    bounded_batches(spark)
    rows = keyed.select(_ROW, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    own, at_own = cut(_prefixes(rows, _common(rows)))
    sets, at_sets = cut(own.groupBy("sig").agg(F.min("row").alias("node")))
    firsts = own.join(small(sets.select(F.col("node").alias("row"))), "row", "left_semi").withColumnRenamed("row", "node")
    bits = own.select(F.col("row").alias("node"), "n", "bits")
    tested, at_tested = cut(_simhash_pairs(firsts.select("node", "fp")))
    links, at_links = _verified(tested, rows, bits)
    gone = [at_tested, at_links]

    def hold(pairs: DataFrame) -> None:
        nonlocal links, tested
        pairs, at_pairs = cut(pairs.distinct().join(tested, ["a", "b"], "left_anti"))
        more, at_more = _verified(pairs, rows, bits)
        gone.extend([at_pairs, at_more])
        links, tested = links.unionByName(more), tested.unionByName(pairs)

    posts = _named(firsts.select("node", "n", "prefix"), links).select("node", "n", "c", F.posexplode("prefix").alias("p", "h"))
    for step in range(3):
        shared, at_shared = cut(_mixed(posts.select("h", "node", "n", "p", "c")))
        gone.append(at_shared)
        if not shared.head(1):
            break
        if step == 0:
            hold(_star_pairs(shared, step))
            posts = _named(shared.drop("c"), links)
        else:
            found, at_found = cut(_other_pairs(shared, bits, step == 2))
            gone.append(at_found)
            hold(found.where("a is not null").select("a", "b"))
            posts = _named(found.where("h is not null").select("h", "node", "n", "p").distinct(), links)
    roots = components(links)
    named = sets.join(roots, "node", "left").select("sig", F.coalesce("root", "node").alias("root"))
    out, _ = cut(own.select("row", "doc_id", "sig").join(named, "sig").select("row", "doc_id", "root"))
    drop_cut(spark, at_own, at_sets, *gone)
    return out


def keep_one_each(docs: DataFrame) -> DataFrame:
    """docs without all but the first row (smallest doc_id, null last) of each group that near copies connect.

    Texts without words are copies of each other.  Rows are judged one by one, whatever doc_ids they repeat or lack.
    """
    keyed, _ = cut(docs.withColumn(_ROW, F.monotonically_increasing_id()))
    found = _near_copies(keyed)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("first"))
    gone, _ = cut(found.join(first, "root").where("row <> first").select(F.col("row").alias(_ROW)))
    return keyed.join(small(gone), _ROW, "left_anti").drop(_ROW)
