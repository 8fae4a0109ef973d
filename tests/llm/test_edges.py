"""Nulls, empty and very long texts, repeated rows, empty tables and clashing column names, for operators and stages."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from passages.llm import decontamination, license_scan, packing, pii, quality_classifier, quality_rules, simhash_dedup, substring_dedup, token_counts, toxicity
from passages.llm.queries import tokenizer_path

TEXTS = ["", " \n\t ", "one", "You are an idiot and a clown. " * 3, "Mixed Ünïcode \U0001f600   text, with 4111 1111 1111 1111 and a@b.org.", "word " * 60_000, "unbroken" * 5_000, "the quick brown fox jumps over the lazy dog near the river bank today"]
CLASHING = "fp component_id fingerprint _words _lines _n _text piece length slice name blob told score label n_words held_out _label _bucket _row sequence_id offset item_id key path u h".split()


def table(spark, empty=False):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(TEXTS)]
    rows += [(3, TEXTS[3], "en", "s", 1), (3, TEXTS[3], "en", "s", 1), (None, "a text without an id that is long enough to keep", None, None, None), (50, None, None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame([] if empty else rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHING))


def labels(spark):
    return spark.createDataFrame([(0, 0, 0), (2, 0, 0), (3, 0, 1), (3, 0, 1), (4, 1, 0), (7, 1, 0), (None, 1, 1), (50, None, None), (999, 1, 1)], "doc_id long, quality int, toxic int")


def bench(spark):
    return spark.createDataFrame([(1, TEXTS[7]), (2, None), (None, "one"), (4, "")], "item_id long, text string")


OPERATORS = {
    "token_counts": lambda s, d: token_counts.token_counts(d, tokenizer_path("piece_bpe_32k.model")),
    "license_scan": lambda s, d: license_scan.license_scan(d),
    "quality": lambda s, d: quality_classifier.quality_scores(d, quality_classifier.train_on(d, labels(s))),
    "near_duplicates": lambda s, d: simhash_dedup.near_duplicates(d),
    "toxicity": lambda s, d: toxicity.toxicity(d, toxicity.train_on(d, labels(s))),
    "pii": lambda s, d: pii.pseudonymise(d),
    "repeats": lambda s, d: substring_dedup.remove_repeats(d, digest=True),
    "quality_rules": lambda s, d: quality_rules.quality_rules(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_each_row_gives_a_row(spark, name):
    df = table(spark)
    got = OPERATORS[name](spark, df)
    assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(str(r["doc_id"]) for r in df.collect())
    assert OPERATORS[name](spark, table(spark, empty=True)).count() == 0


def test_near_duplicates_of_null_ids_and_empty_texts(spark):
    got = simhash_dedup.near_duplicates(table(spark)).collect()
    empty = [r for r in got if r["fingerprint"] == "0" * 16]
    assert {r["doc_id"] for r in empty} == {0, 1, 50, None} and {r["component_id"] for r in empty} == {0}


def test_repeats_do_not_count_against_their_own_id(spark):
    got = {(r["doc_id"], r["n_removed"]) for r in substring_dedup.remove_repeats(table(spark), digest=True).where("doc_id = 3").collect()}
    assert got == {(3, 0)}


def test_decontamination_of_odd_tables(spark):
    df = table(spark)
    got = decontamination.contaminated(df, bench(spark))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(7, 1), (2, None)}
    assert decontamination.contaminated(df, bench(spark).limit(0)).count() == 0
    assert decontamination.contaminated(table(spark, empty=True), bench(spark)).count() == 0


def test_packing_of_odd_tables(spark):
    got = packing.best_fit_packing(table(spark), tokenizer_path("word_bpe_49k.json")).collect()
    assert {r["doc_id"] for r in got} == {*range(len(TEXTS)), 50, None}
    assert sum(r["piece"] == 0 for r in got) == table(spark).count()
    assert packing.best_fit_packing(table(spark, empty=True), tokenizer_path("word_bpe_49k.json")).count() == 0


def test_one_class_or_no_label_gives_a_constant(spark):
    df, few = table(spark), labels(spark).where("toxic = 0")
    assert len({r["score"] for r in quality_classifier.quality_scores(df, quality_classifier.train_on(df, few.limit(0))).collect()}) == 1
    assert len({r["score"] for r in toxicity.toxicity(df, toxicity.train_on(df, few)).collect()}) == 1


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
@pytest.mark.parametrize("empty", [False, True])
def test_stage_of_odd_tables(spark, tmp_path, stage, empty):
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    df = table(spark, empty)
    got = corpus_pipeline.STAGES[stage][1](spark, df, str(tmp_path))
    n = got.count()
    assert n == 0 if empty else n > 0
    if stage < len(corpus_pipeline.STAGES) - 1:
        assert got.columns == df.columns


def test_pipeline_is_its_stages_one_after_another(spark):
    """The quality stage's texts (test_kept_lines has its own test), then every further stage by brute force."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.rules(spark, docs, folder).collect()}
    from tests.llm.test_near_copies import kept_by_all_pairs
    from tests.llm.test_operators import check_packing, slow_matches

    first = kept_by_all_pairs(kept)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    kept = {i: t for i, t in kept.items() if i in first and not slow_matches(t, items)}
    from tokenizers import Tokenizer

    tok, own = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), pii.Pseudonyms(pii.DEFAULT_KEY)
    expected = {i: [*tok.encode(own.text(t)[0], add_special_tokens=False).ids, 1] for i, t in kept.items()}
    check_packing(corpus_pipeline.run(spark, folder).collect(), expected)
