"""Readers and writers of the corpus formats."""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passages.functions.text import clean_paragraph, content_words, escape_basic, let, running_total, split_sections, split_sentences, without_preface, words
from passages.operators.corpus import article_path
from passages.operators.ranks import with_total_before
from passages.ship import ship

PAGE_SCHEMA = "title string, ns int, id bigint, redirect struct<_title:string>, revision struct<id:bigint,text:string>"  # a text of blanks alone is lost where attributes are asked for
QA_SCHEMA = "id int, title string, qas array<struct<question:string,context:string,answers:array<string>>>, content string, num_sentences int, segmented_sentences array<int>"
TEMPLATE_NAMESPACES = (10, 828)
#: Words that a task joins with their vectors.
ROWS_A_TASK = 2_000_000


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """page_id, title, ns, text of a page dump (.xml or .xml.bz2), without redirects; of rows that repeat an id the one with the smallest revision stays."""
    rows = spark.read.format("xml").option("rowTag", "page").option("ignoreSurroundingSpaces", "false").schema(PAGE_SCHEMA).load(path).where("redirect is null")
    page = F.struct("title", "ns", F.col("revision.text").alias("text"))
    own = rows.groupBy(F.col("id").alias("page_id")).agg(F.min_by(page, F.col("revision.id")).alias("p"))
    return own.select("page_id", "p.title", "p.ns", "p.text")


def page_element(page_id: Column, title: Column, ns: Column, text: Column) -> Column:
    """A page as an element of a dump, without the element of what is null."""
    escaped = lambda value: F.replace(escape_basic(value.cast("string")), F.lit("\r"), F.lit("&#13;"))  # noqa: E731  a parser makes \n of \r
    own = lambda name, value: F.coalesce(F.concat(F.lit(f"<{name}>"), escaped(value), F.lit(f"</{name}>")), F.lit(""))
    return F.concat(F.lit("<page>"), own("title", title), own("ns", ns), own("id", page_id), F.lit("<revision>"), own("id", page_id), own("text", text), F.lit("</revision></page>"))


def write_dump(elements: DataFrame, path: str, bytes_a_file: int = 16 << 20) -> None:
    """Elements (value) as dumps of about ``bytes_a_file`` bytes, each a file with a root of its own: a file is read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = lambda own: pa.RecordBatch.from_arrays([pa.array(["\n".join(["<mediawiki>", *own, "</mediawiki>"])])], names=["value"])
        held, size = [], 0
        for batch in batches:
            for x in batch.column(0):
                held.append(x.as_py())
                size += len(x.as_buffer())
                if size >= bytes_a_file:
                    yield whole(held)
                    held, size = [], 0
        if held:
            yield whole(held)

    elements.select("value").mapInArrow(run, "value string").write.option("maxRecordsPerFile", 1).text(path)


def read_siteinfo(spark: SparkSession, path: str) -> tuple[str, dict[int, str]]:
    """URL base and namespaces by number."""
    schema = "base string, namespaces struct<namespace:array<struct<_VALUE:string,_key:int>>>"
    row = spark.read.format("xml").option("rowTag", "siteinfo").schema(schema).load(path).first()
    names = (row and row["namespaces"] and row["namespaces"]["namespace"]) or []
    return (row["base"].rpartition("/")[0] if row and row["base"] else ""), {n["_key"]: n["_VALUE"] for n in names}


def articles(pages: DataFrame, most: int | None = None) -> DataFrame:
    own = pages.where(~F.col("ns").isin(*TEMPLATE_NAMESPACES))
    return own.orderBy("page_id").limit(most) if most else own


def templates(pages: DataFrame) -> DataFrame:
    """title, text of the template and module pages, as clean_pages takes them."""
    return pages.where(F.col("ns").isin(*TEMPLATE_NAMESPACES)).select("title", "text")


def write_templates(pages: DataFrame, path: str) -> None:
    templates(pages).write.json(path)


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("title string, text string").json(path)


def read_article(spark: SparkSession, path: str, page_id: int = 0) -> DataFrame:
    """One page's markup in a file of its own: page_id, title (the file's name), text."""
    return read_texts(spark, path).select(F.lit(page_id).cast("long").alias("page_id"), F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("title"), "text")


def read_texts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, text of all files below a folder."""
    own = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    return own.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """id, url, title, body of article blocks that end with </doc>."""
    own = spark.read.option("recursiveFileLookup", "true").option("lineSep", "</doc>").text(path)
    get = lambda p: F.regexp_extract("value", p, 1)
    rows = own.where(F.col("value").contains("<doc ")).select(get(r'<doc id="(\d+)"').cast("long").alias("id"), get(r'url="([^"]*)"').alias("url"), get(r'title="([^"]*)"').alias("title"), F.trim(F.regexp_replace("value", r"(?s)^\s*<doc [^>]*>", ""), ).alias("body"))
    return rows


def segmented_file(text: Column, separator: str = "==========", least: int = 6, by_lines: bool = True) -> Column:
    """Segments of a segmented text file as arrays of sentences with a word; pieces of under ``least`` characters are none.

    Sentences are lines, or found in the text if ``by_lines`` is off.
    """
    pieces = F.filter(F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), f"\\Q{separator}\\E"), lambda p: F.length(p) >= least)
    inside = lambda p: F.split(clean_paragraph(p), "\n") if by_lines else split_sentences(F.regexp_replace(clean_paragraph(p), r"\n+", " "))
    return F.filter(F.transform(pieces, lambda p: F.filter(inside(p), lambda x: F.size(words(x)) > 0)), lambda s: F.size(s) > 0)


def with_targets(segments: Column) -> Column:
    """Struct of sentences and targets (place of each segment's last sentence) of an array of segments."""
    ends = lambda s: F.transform(running_total(F.transform(s, F.size)), lambda n: (n - 1).cast("int"))
    return let(segments, lambda s: F.struct(F.flatten(s).alias("sentences"), ends(s).alias("targets")))


def read_segmented(spark: SparkSession, path: str, separator: str = "==========", by_lines: bool = True) -> DataFrame:
    """path, sentences, targets of .ref files."""
    own = read_texts(spark, path, "*.ref").select("path", with_targets(segmented_file(F.col("text"), separator, by_lines=by_lines)).alias("x"))
    return own.select("path", "x.sentences", "x.targets")


def article_sections(text: Column, low_granularity: bool = False, keep_preface: bool = False) -> Column:
    """Sections of a processed article as arrays of its lines; list tokens are no sentence."""
    parts = split_sections(F.regexp_replace(text, r"^\s+|\s+$", ""), low_granularity)
    kept = F.filter(parts, lambda x: F.regexp_replace(x, "\n", "") != "") if keep_preface else without_preface(parts)
    lines = lambda x: F.filter(F.split(x, "\n"), lambda y: F.size(content_words(y)) > 0)
    return F.filter(F.transform(kept, lines), lambda s: F.size(s) > 0)


def read_articles(spark: SparkSession, path: str, low_granularity: bool = False, keep_preface: bool = False) -> DataFrame:
    """path, sentences, targets of processed article files."""
    own = read_texts(spark, path).select("path", with_targets(article_sections(F.col("text"), low_granularity, keep_preface)).alias("x"))
    return own.select("path", "x.sentences", "x.targets")


def shuffled_segments(segments: Column, seed: Column) -> Column:
    """The segments in an order that a hash of the seed and their place gives, as training wants them."""
    keyed = F.transform(segments, lambda x, i: F.struct(F.md5(F.concat_ws(":", seed.cast("string"), i.cast("string"))).alias("h"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda x: x["x"])


def question_targets(content: Column, remove_special_tokens: bool = False) -> Column:
    """Struct of sentences and targets of a question document, which is one segment: its only target is the last sentence.

    Without a sentence there is no target.  A sentence of special tokens alone is none if they are removed.
    """
    own = F.filter(split_sentences(content), lambda x: F.size(content_words(x) if remove_special_tokens else words(x)) > 0)
    return let(own, lambda s: F.struct(s.alias("sentences"), F.when(F.size(s) > 0, F.array(F.size(s) - 1)).otherwise(F.array().cast("array<int>")).alias("targets")))


def segment_folder(path: Column) -> Column:
    """Segment length folder (like 3-11) and file number of a path .../length/set/file."""
    return F.struct(F.regexp_extract(path, r"/(\d+-\d+)/", 1).alias("length"), F.regexp_extract(path, r"/([^/]+)\.ref$", 1).alias("name"))


def topic_rows(lines: DataFrame, delimiter: str = "\x01") -> DataFrame:
    """doc_id, line_no, topic, level, starts, sentence of lines (line_no, value) "doc,x,topic<delimiter>sentence"."""
    head = F.split(F.substring_index("value", delimiter, 1), ",", 3)
    rows = lines.select(F.get(head, 0).alias("doc_id"), "line_no", F.get(head, 2).alias("topic"), F.regexp_extract("value", f"(?s){delimiter}(.*)", 1).alias("sentence"))
    return _with_starts(rows)


def _with_starts(rows: DataFrame) -> DataFrame:
    before = F.lag("topic").over(Window.partitionBy("doc_id").orderBy("line_no"))
    return rows.select("*", F.when(F.col("topic") == "TOP-LEVEL SEGMENT", 1).otherwise(2).alias("level"), (before.isNull() | (before != F.col("topic"))).alias("starts"))


def aligned_topic_rows(sentences: DataFrame, segments: DataFrame) -> DataFrame:
    """As topic_rows, from two line-aligned frames (line_no, value), which must have as many lines."""
    if (a := sentences.count()) != (b := segments.count()):
        raise ValueError(f"{a} sentences and {b} segment lines")
    head = F.split(F.col("g.value"), ",", 3)
    both = sentences.alias("s").join(segments.alias("g"), "line_no", "full")
    return _with_starts(both.select(F.get(head, 0).alias("doc_id"), "line_no", F.get(head, 2).alias("topic"), F.col("s.value").alias("sentence")))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, value of one file in order.  The blocks of the file are numbered by the lines before them; no line leaves its block."""
    rows = spark.read.text(path).select(F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), "value")
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("_block").agg(F.count("*").alias("_n")).select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # a row a block
    place = F.row_number().over(Window.partitionBy("_block").orderBy("_at"))
    return rows.withColumn("_place", place).join(blocks, "_block").select((F.col("_before") + F.col("_place") - 1).alias("line_no"), "value")


def read_qa(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Question documents, one a file or, with ``lines``, one a line as write_documents has them."""
    return spark.read.schema(QA_SCHEMA).json(path, multiLine=not lines)


def _word_vectors(stream: BinaryIO) -> Iterator[pa.RecordBatch]:
    """word, vec of a word2vec binary stream, some thousand at a time."""
    n, size = map(int, stream.readline().split())
    held, at, words_, vectors = b"", 0, [], []
    for left in range(n, 0, -1):
        while (end := held.find(b" ", at)) < 0 or len(held) < end + 1 + 4 * size:
            more = stream.read(1 << 20)
            if not more:
                raise ValueError(f"the file ends {left} words early")
            held, at = held[at:] + more, 0
        words_.append(held[at:end].lstrip(b"\n").decode("utf-8", "replace"))
        vectors.append(np.frombuffer(held, "<f4", size, end + 1))
        at = end + 1 + 4 * size
        if len(words_) == 4096 or left == 1:
            flat = pa.array(np.concatenate(vectors), pa.float32())
            yield pa.RecordBatch.from_arrays([pa.array(words_), pa.ListArray.from_arrays(pa.array(np.arange(len(words_) + 1) * size, pa.int32()), flat)], names=["word", "vec"])
            words_, vectors = [], []


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """word, vec of word2vec binary files.  The format has no seams, so a file is one task, which reads it as a stream of
    bounded size; write the rows as Parquet once and read those."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for where in batch.column(0).to_pylist():
                system, own = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", where))
                with system.open_input_stream(own) as raw:
                    yield from _word_vectors(io.BufferedReader(raw, 1 << 20))

    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(run, "word string, vec array<float>")


def with_vectors(words: DataFrame, vectors: DataFrame, unknown: str = "UNK", counts: DataFrame | None = None) -> DataFrame:
    """words (with a column word) and their vectors; a missing word has that of ``unknown``, and is an error where there is none.

    ``counts`` (word, count) of the words are made if they are not given.  Common words are dealt over several parts, each with
    a copy of the vector, and the parts over as many tasks as hold ``ROWS_A_TASK`` rows each.
    """
    spark, row = words.sparkSession, vectors.where(F.col("word") == unknown).select("vec").head()
    fallback = F.array(*map(F.lit, row["vec"])).cast(vectors.schema["vec"].dataType) if row else F.raise_error(F.concat(F.lit(f"no vector for {unknown!r}, nor for "), "word")).cast(vectors.schema["vec"].dataType)
    counts, most = words.groupBy("word").count() if counts is None else counts, max(1, ROWS_A_TASK // 8)
    parts = F.when(F.col("count") > most, F.struct("word", F.ceil(F.col("count") / most).cast("int").alias("_parts")))
    total, common = counts.agg(F.sum("count"), F.collect_list(parts)).head()  # common: less than one word for each ``most`` rows
    on, tasks = ["word"], -(-(total or 0) // ROWS_A_TASK)
    if common:
        common = F.broadcast(spark.createDataFrame(common, "word string, _parts int"))
        number, on = F.coalesce("_parts", F.lit(1)), ["word", "_part"]
        words = words.join(common, "word", "left").withColumn("_part", (F.monotonically_increasing_id() % number).cast("int")).drop("_parts")
        vectors = vectors.join(common, "word", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), number - 1))).drop("_parts")
    if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
        words, vectors = words.repartition(tasks, *on), vectors.repartition(tasks, *on)
    return words.join(vectors, on, "left").drop("_part").withColumn("vec", F.when(F.col("vec").isNotNull(), F.col("vec")).otherwise(fallback))


def write_corpus(rows: DataFrame, path: str) -> None:
    """Rows with partition and doc_id, by partition folder, with the article path as a column."""
    rows.withColumn("path", article_path(F.col("doc_id"))).write.partitionBy("partition").parquet(path)


def write_rolling(rows: DataFrame, path: str, order: str, bytes_a_file: int = 1 << 20, compress: bool = False) -> None:
    """Text files of about ``bytes_a_file`` bytes in folders of a hundred: folder=AA/file=wiki_00 and so on.

    ``rows``: value and a number ``order``; a row stands in the file where the rows before it end.
    """
    placed = with_total_before(rows.select("value", order), "_before", [order], amount=(F.octet_length("value") + 1).cast("long"))
    n = F.floor(F.col("_before") / bytes_a_file).cast("long")
    folder = F.concat(F.chr(65 + F.floor(n / 2600) % 26), F.chr(65 + F.floor(n / 100) % 26))
    named = placed.select("value", order, folder.alias("folder"), F.format_string("wiki_%02d", n % 100).alias("file"))
    named.repartition("folder", "file").sortWithinPartitions("folder", "file", order).select("value", "folder", "file").write.partitionBy("folder", "file").option("compression", "bzip2" if compress else "none").text(path)


def write_documents(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def size_in_bytes(text: str, least: int = 200 * 1024) -> int:
    """"500K", "1M", "2G" or a plain number of bytes; under ``least`` is an error."""
    m = re.fullmatch(r"(\d+)([KMG]?)", text.strip().upper())
    if not m or (n := int(m[1]) << {"": 0, "K": 10, "M": 20, "G": 30}[m[2]]) < least:
        raise ValueError(f"not a size of {least} bytes or more: {text!r}")
    return n


def delimited_cuts(text: Column, separator: str = "==========") -> Column:
    """Array of (sentence, cut) of a file with one sentence a line: a separator marks the line before it; the last line is a cut."""
    lines = F.filter(F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), "\n"), lambda x: x != "")
    is_cut = lambda a, i: F.when(F.coalesce(F.get(a, i + 1) == separator, F.lit(True)), 1).otherwise(0)
    return let(lines, lambda a: F.filter(F.transform(a, lambda x, i: F.struct(x.alias("sentence"), is_cut(a, i).alias("cut"))), lambda x: x["sentence"] != separator))


def read_delimited(spark: SparkSession, path: str, separator: str = "==========") -> DataFrame:
    """path, sent_idx, sentence, cut of an external segmenter's files."""
    rows = read_texts(spark, path).select("path", F.posexplode(delimited_cuts(F.col("text"), separator)).alias("sent_idx", "x"))
    return rows.select("path", F.col("sent_idx").cast("long").alias("sent_idx"), "x.sentence", "x.cut")


_CSV = {"header": "true", "escape": '"', "multiLine": "true"}


def write_template(sentences: DataFrame, path: str) -> None:
    """CSV files for annotators, a folder for each document: sent_idx, cut (0), sentence."""
    sentences.select("doc_id", "sent_idx", F.lit(0).alias("cut"), "sentence").repartition("doc_id").sortWithinPartitions("doc_id", "sent_idx").write.partitionBy("doc_id").options(**_CSV).csv(path)


def read_annotations(spark: SparkSession, path: str, annotator: str) -> DataFrame:
    """annotator, doc_id, sent_idx, cut, sentence of files that an annotator filled in; an empty cut is none."""
    rows = spark.read.options(**_CSV).schema("sent_idx long, cut int, sentence string, doc_id long").csv(path)
    return rows.select(F.lit(annotator).alias("annotator"), "doc_id", "sent_idx", F.coalesce("cut", F.lit(0)).alias("cut"), "sentence")


def write_results(scores: DataFrame, path: str) -> None:
    """Scores as CSV with a header."""
    scores.write.options(**_CSV).csv(path)


def write_plain(sentences: DataFrame, path: str) -> None:
    """Text files with one sentence a line, a folder for each document."""
    sentences.select("doc_id", "sent_idx", F.col("sentence").alias("value")).repartition("doc_id").sortWithinPartitions("doc_id", "sent_idx").select("doc_id", "value").write.partitionBy("doc_id").text(path)


def merged_config(*layers: dict) -> dict:
    """Settings of several layers, later before earlier; nested ones are merged, nulls do not replace."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            if isinstance(v, dict) and isinstance(out.get(k), dict):
                out[k] = merged_config(out[k], v)
            elif v is not None or k not in out:
                out[k] = v
    return out


def read_config(path: str, base: dict | None = None) -> dict:
    """A JSON file of settings over ``base``."""
    with open(path, encoding="utf-8") as f:
        return merged_config(base or {}, json.load(f))


def sample_rows(rows: DataFrame, k: int, key: str, seed: int = 0) -> DataFrame:
    """k rows, the first by a seeded hash of their key."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), key)), key).limit(k)
