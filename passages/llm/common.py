"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passages.ship import ship

#: ASCII white space; the word rule of most contracts is "everything else".
SPACES = " \t\n\x0b\x0c\r"
#: Row groups of written tables: what a task that writes holds before it is compressed.
ROW_GROUP_BYTES = 16 << 20
#: Rows of a few numbers that are sent to every executor at most.
BROADCAST_ROWS = 1_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 512) -> None:
    """Keep Arrow batches small (Spark also holds them to 64 MB) and let executors import this package."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only the two columns that most operators read; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def held_out(doc_id: str = "doc_id") -> Column:
    """True where no label may be learnt: crc32 of the id as text, modulo 3, is 1."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int]) -> DataFrame:
    """doc_id, label, text of at most ``most[value]`` documents that ``labels`` marks with each value and that are not held out, first by a hash of doc_id.

    The ids are chosen without the texts, so that texts are read once and only of the few documents that were chosen.  A
    repeated doc_id counts once for each of its labels, with the smallest of its texts.
    """
    spark = docs.sparkSession
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(*most)).where(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), "label").distinct()
    there, at = cut(known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    chosen = [tuple(r) for value, n in most.items() for r in there.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()]  # bounded by ``most``
    drop_cut(spark, at)
    ids = spark.createDataFrame(chosen, "doc_id long, label int")
    return id_and_text(docs).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a session on one machine that names none gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="passages-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def _hadoop_path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def cut(df: DataFrame) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: a short lineage that outlives executors.

    What is not dropped before goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    where, files = _hadoop_path(spark, path)
    files.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path), path


def drop_cut(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        where, files = _hadoop_path(spark, path)
        files.delete(where, True)


def small(df: DataFrame, most: int | None = None) -> DataFrame:
    """df, to be broadcast if it has at most ``most`` rows.  df should be a written table of a few numbers a row."""
    most = BROADCAST_ROWS if most is None else most
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def give_back() -> None:
    """Return freed memory to the system; a Python worker lives on for later stages."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not on this platform
        pass


def flat(text: str) -> str:
    """The text with every ASCII white space turned into a blank."""
    for c in SPACES[1:]:
        if c in text:
            text = text.replace(c, " ")
    return text


def words_of(text: str) -> list[str]:
    """Maximal runs of characters other than ASCII white space."""
    return [w for w in flat(text).split(" ") if w]


def groups_by_size(texts: Iterable[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``most`` characters; a longer text stands alone."""
    first = size = n = 0
    for i, t in enumerate(texts):
        n = i + 1
        if size and size + len(t) > most:
            yield first, i
            first, size = i, 0
        size += len(t)
    if n > first:
        yield first, n
