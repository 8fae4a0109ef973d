"""Document assembly, chunks, vectors and nearest neighbours."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passages.functions.text import let, one_line, sentence_count, stable_hash, words
from passages.operators.ranks import with_total_before
from passages.ship import ship

#: Vectors that one pass sends to every executor as queries.
QUERY_BLOCK = 4096


def distinct_contexts(rows: DataFrame, title: str, context: str, order: str) -> DataFrame:
    """First row of each (title, context), with its place in the title."""
    first = rows.groupBy(title, context).agg(F.min(order).alias("row_no"))
    return with_total_before(first, "place", ["row_no"], [title]).withColumn("place", F.col("place") + 1)


def assembled(rows: DataFrame, title: str, context: str, order: str, max_titles: int | None = None, clean: bool = False) -> DataFrame:
    """doc_id (1..n by first appearance), title, content (distinct contexts by line), n_contexts, n_rows, num_sentences.

    ``max_titles`` keeps the titles that appear first.  ``clean`` takes tags and line ends out of the content.
    """
    contexts = rows.groupBy(title, context).agg(F.min(order).alias("at"), F.count("*").alias("n"))
    firsts = with_total_before(rows.groupBy(title).agg(F.min(order).alias("first")), "doc_id", ["first"]).select(F.col(title).alias("_title"), (F.col("doc_id") + 1).alias("doc_id"))
    if max_titles:
        firsts = firsts.where(F.col("doc_id") <= max_titles)
    docs = contexts.groupBy(title).agg(F.array_sort(F.collect_list(F.struct("at", context))).alias("c"), F.sum("n").alias("n_rows"))
    docs = docs.join(firsts, F.col(title).eqNullSafe(F.col("_title")))
    content = F.array_join(F.transform("c", lambda x: x[context]), "\n")
    out = docs.select("doc_id", F.col(title).alias("title"), (one_line(content) if clean else content).alias("content"), F.size("c").cast("long").alias("n_contexts"), "n_rows")
    return out.withColumn("num_sentences", sentence_count(F.col("content")).cast("long"))


def one_per_title(rows: DataFrame, title: str, text: str, order: str, max_chars: int = 150_000) -> DataFrame:
    """The first row of each title whose text is not too long."""
    fit = rows.where(F.length(text) <= max_chars)
    return fit.groupBy(title).agg(F.min_by(F.struct(*fit.columns), order).alias("r")).select("r.*")


def question_documents(rows: DataFrame, doc_id: str, order: str, question: Column, context: Column, answer: Column) -> DataFrame:
    """id, qas (array of question, context, answers) of each document, in order."""
    qa = F.struct(question.alias("question"), context.alias("context"), F.array(answer).alias("answers"))
    own = rows.groupBy(F.col(doc_id).alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), qa.alias("qa")))).alias("q"))
    return own.select("id", F.transform("q", lambda x: x["qa"]).alias("qas"))


def question_counts(docs: DataFrame) -> DataFrame:
    """id, n_questions of question documents."""
    return docs.select("id", F.size("qas").cast("long").alias("n_questions"))


def fixed_chunks(docs: DataFrame, budget: int = 256) -> DataFrame:
    """doc_id, chunk_idx, chunk, n_words, chunk_id: greedy chunks that close once the words and their blanks reach ``budget`` characters."""

    def chunks(text: str) -> Iterator[list[str]]:
        words_ = text.split()
        sizes, start, before = list(accumulate(len(w) + 1 for w in words_)), 0, 0
        while start < len(words_):
            end = min(bisect_left(sizes, before + budget, start), len(words_) - 1) + 1
            yield words_[start:end]
            start, before = end, sizes[end - 1]

    return _chunk_rows(docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text")), chunks)


def segment_chunks(arrays: DataFrame, flags: str, budget: int = 256, level: str = "word") -> DataFrame:
    """Chunks that also close after a sentence with flag 1.  ``arrays``: doc_id, s (text, ...) and the flags' array.

    level "sentence" tests the budget in characters after whole sentences; "word" keeps each chunk under ``budget`` words.
    """
    full = max(budget - 1, 1)

    def by_sentence(texts: list[str], cuts: list[bool]) -> Iterator[list[str]]:
        held, size = [], 0
        for text, cut in zip(texts, cuts, strict=True):
            own = text.split()
            held += own
            size += sum(map(len, own)) + len(own)
            if cut or size >= budget:
                size = 0
                if own:
                    yield held
                    held = []
        if held:
            yield held

    def by_word(texts: list[str], cuts: list[bool]) -> Iterator[list[str]]:
        held: list[str] = []
        for i, (text, cut) in enumerate(zip(texts, cuts, strict=True)):
            held += (own := text.split())
            if (cut and own) or i == len(texts) - 1:
                yield from (held[k : k + full] for k in range(0, len(held), full))
                held = []

    own = arrays.select(F.col("doc_id").cast("long"), F.zip_with("s", flags, lambda x, f: F.struct(F.coalesce(x["text"], F.lit("")).alias("text"), (F.coalesce(f, F.lit(0)) == 1).alias("cut"))).alias("s"))
    return _chunk_rows(own.where("s is not null").select("doc_id", F.transform("s", lambda x: x["text"]).alias("texts"), F.transform("s", lambda x: x["cut"]).alias("cuts")), by_sentence if level == "sentence" else by_word)


def _chunk_rows(docs: DataFrame, chunks: Callable[..., Iterator[list[str]]]) -> DataFrame:
    """Rows of the chunks, as lists of words, that ``chunks`` makes of the columns after doc_id.  A document takes time linear
    in its words, which folds over arrays in SQL did not."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places, texts, counts = [], [], [], []
            for doc_id, *own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k, c in enumerate(chunks(*own)):
                    ids.append(doc_id)
                    places.append(k)
                    texts.append(" ".join(c))
                    counts.append(len(c))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int64()), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], names=["doc_id", "chunk_idx", "chunk", "n_words"])

    made = docs.mapInArrow(run, "doc_id long, chunk_idx long, chunk string, n_words long")
    return made.withColumn("chunk_id", F.sha2(F.concat_ws(":", "doc_id", "chunk_idx"), 256))


def chunk_table(chunks: DataFrame, encode: Callable[[Column], Column] | None = None) -> DataFrame:
    """id, doc_id, chunk, embedding of chunks; ``encode`` makes a vector of a text."""
    return chunks.select(F.col("chunk_id").alias("id"), "doc_id", "chunk", (encode or hashed_vector)(F.col("chunk")).alias("embedding"))


def write_index(table: DataFrame, path: str) -> None:
    """The exact index is the table itself, ordered by id within files so that look-ups read few row groups."""
    table.sortWithinPartitions("id").write.parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, doc_id long, chunk string, embedding array<double>").parquet(path)


def hashed_vector(text: Column, size: int = 16) -> Column:
    """Word counts hashed into ``size`` places, at unit length: a stand-in for a trained encoder."""
    places = F.transform(words(F.lower(text)), lambda w: stable_hash(w) % size)
    counts = let(places, lambda p: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.size(F.filter(p, lambda x: x == k)).cast("double")))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
    at_unit = lambda c: let(norm(c), lambda n: F.transform(c, lambda x: F.round(F.when(n > 0, x / n).otherwise(0.0), 9)))
    return let(counts, at_unit)


def squared_l2(a: Column, b: Column) -> Column:
    square = lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    return F.aggregate(F.zip_with(a, b, square), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Exact L2 neighbours: query_id, neighbour_id, distance, rank.  Queries go out in blocks of bounded size; each task
    keeps its best k for a query, and those are merged."""
    spark, out = vectors.sparkSession, None
    ship(spark)
    schema = "query_id long, neighbour_id long, distance double"
    held: list = []

    def block(rows: list) -> DataFrame:
        sent = spark.sparkContext.broadcast(([r[0] for r in rows], np.array([r[1] for r in rows], np.float64)))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            best: list[list[tuple[float, int]]] = [[] for _ in ids]
            for batch in batches:
                own = np.array(batch.column(0).to_pylist(), np.int64)
                if not len(own):
                    continue
                x = np.array(batch.column(1).to_pylist(), np.float64)
                for j in range(len(ids)):
                    d = ((x - q[j]) ** 2).sum(axis=1)
                    d[own == ids[j]] = np.inf
                    top = np.lexsort((own, d))[:k]
                    best[j] = sorted(best[j] + [(float(d[i]), int(own[i])) for i in top if np.isfinite(d[i])])[:k]
            rows = [(ids[j], n, d) for j, b in enumerate(best) for d, n in b]
            cols = [*zip(*rows, strict=True)] or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "neighbour_id", "distance"])

        return vectors.select(F.col(id_col).cast("long"), vector).mapInArrow(search, schema)

    for row in queries.select(F.col(id_col).cast("long"), vector).toLocalIterator():
        held.append(row)
        if len(held) == QUERY_BLOCK:
            out, held = block(held) if out is None else out.unionByName(block(held)), []
    if held:
        out = block(held) if out is None else out.unionByName(block(held))
    if out is None:
        out = spark.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbour_id"))
    return out.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)
