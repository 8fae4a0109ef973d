"""Arriving documents: a stateless clean and split over a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passages.operators.segments import sentences


def document_stream(spark: SparkSession, path: str, files_a_trigger: int = 100) -> DataFrame:
    """Parquet files of documents as they arrive in a folder."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def sentence_stream(spark: SparkSession, path: str) -> DataFrame:
    return sentences(document_stream(spark, path))
