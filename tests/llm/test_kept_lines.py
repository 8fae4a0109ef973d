"""The quality stage removes failing lines from the documents it keeps."""

from pyspark.sql import functions as F

import corpus_pipeline
from passages.llm import quality_rules
from tests.compare import DATA


def test_stage_writes_the_kept_lines(spark):
    line, other = "A sentence with quite a few words that ends as it should.", "Another one says something else but ends in the same way!"
    rows = [(1, f"{line}\n\nAll rights reserved.\n{other}\n%%%%\n", 999, "x"), (2, f"{line} {other}", 5, "y"), (3, None, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, lang string")
    got = corpus_pipeline.rules(spark, df, "")
    clean = f"{line}\n\n{other}\n"
    assert got.schema == df.schema
    assert sorted(map(tuple, got.collect())) == [(1, clean, len(clean), "x"), (2, f"{line} {other}", len(f"{line} {other}"), "y")]


def test_no_failing_line_is_left(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.rules(spark, docs, "").collect()}
    lines = spark.createDataFrame([(x,) for t in got.values() for x in t.split("\n") if x.strip(" \t\x0b\x0c\r")], "line string")
    assert lines.where(~quality_rules.line_is_kept(F.col("line"))).count() == 0
    assert set(got) == {r["doc_id"] for r in quality_rules.quality_rules(docs).collect() if r["kept"]}
