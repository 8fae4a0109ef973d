"""Training-corpus pipeline: rules, near-duplicates, decontamination, pseudonyms, packing.

Each stage takes what its predecessor kept, as Parquet.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from passages.llm import decontamination, packing, pii, quality_rules, shingle_dedup
from passages.llm.common import cut, drop_cut, read_table
from passages.llm.queries import tokenizer_path


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, and so do the failing lines of the others; n_chars follows the text.

    A null or empty text fails.  Rows are judged one by one, whatever doc_ids they repeat or lack; an empty table stays empty.
    """
    return quality_rules.clean_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word Jaccard of 0.8 or more) the row with the smallest doc_id stays, null last.

    Texts without words are copies of each other; of rows that repeat a doc_id in a group one stays; an empty table stays empty.
    """
    return shingle_dedup.keep_one_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item go.

    Null and empty texts stay, rows are judged one by one, and an empty benchmark drops none.
    """
    return decontamination.without_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms; n_chars follows the text.

    All rows stay, null texts too.  The key is what the session has under ``pii.KEY_SETTING``.
    """
    return pii.with_pseudonyms(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece, with its sequence and its place there.

    A null or empty text is a piece of the end id alone; null and repeated doc_ids are packed like any other.
    """
    return packing.best_fit_packing(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", rules),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("pii_pseudonyms", pseudonyms),
    ("best_fit_packing", pack),
]

#: SQL has neither the tokenizer nor the fingerprints of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what a stage wrote goes once the next one has read it."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs, at = cut(docs)
            if before:
                drop_cut(spark, before)
            before = at
    return docs
