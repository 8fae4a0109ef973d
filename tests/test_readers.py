"""Readers and writers over small files in their formats."""

import bz2
import json
from collections import Counter

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from passages.functions import markup
from passages.operators import segments as sg
from passages.plans import registry
from passages.sources import readers
from tests.compare import spark_rows, sql_rows

DUMP = """<mediawiki><siteinfo><base>http://e/wiki/Main</base><namespaces><namespace key="10">Template</namespace><namespace key="0"/></namespaces></siteinfo>
<page><title>A</title><ns>0</ns><id>12</id><revision><id>99</id><text bytes="9">==H==
* x
body {{n|q}} &amp; more</text></revision></page>
<page><title>A again</title><ns>0</ns><id>12</id><revision><id>100</id><text>later</text></revision></page>
<page><title>B</title><ns>0</ns><id>13</id><redirect title="Q"/><revision><id>98</id><text>t</text></revision></page>
<page><title>Template:N</title><ns>10</ns><id>14</id><revision><id>97</id><text>[{{{1}}}]</text></revision></page>
</mediawiki>
"""


@pytest.mark.parametrize("packed", [False, True])
def test_dump_to_lines(spark, tmp_path, packed):
    path = tmp_path / ("d.xml.bz2" if packed else "d.xml")
    path.write_bytes(bz2.compress(DUMP.encode()) if packed else DUMP.encode())
    assert readers.read_siteinfo(spark, str(path)) == ("http://e/wiki", {10: "Template", 0: None})
    pages = readers.read_dump(spark, str(path))
    assert {(r["page_id"], r["title"], r["ns"]) for r in pages.collect()} == {(12, "A", 0), (14, "Template:N", 10)}
    got = markup.clean_pages(readers.articles(pages), readers.templates(pages)).collect()
    assert [(r["page_id"], r["body"], r["error"]) for r in got] == [(12, "========,2,H.\n***LIST***. \nbody [q] & more", None)]


def test_pages_of_any_text_come_back_from_dumps_of_bounded_size(spark, tmp_path):
    texts = ["", " ", "\n", " \n\t ", None, "a\r\nb\rc", " lead and trail ", "]]> <!-- c --> &amp; <b>", "</page><page>", "null", "é😀" * 9]
    rows = [(i, None if i == 9 else f"T {i} & <", 0, t) for i, t in enumerate(texts * 9)]
    pages = spark.createDataFrame(rows, "page_id long, title string, ns int, text string").repartition(2)
    readers.write_dump(pages.select(readers.page_element(*map(F.col, pages.columns)).alias("value")), str(tmp_path / "d"), 2000)
    sizes = [p.stat().st_size for p in (tmp_path / "d").glob("*.txt")]
    assert len(sizes) > 5 and max(sizes) < 3000
    assert sorted(map(tuple, readers.read_dump(spark, str(tmp_path / "d")).select(pages.columns).collect())) == rows


def test_targets_of_question_documents(spark):
    texts = ["", ".", None, "One. Two! Three", "***LIST***. a. ***LIST***."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    get = lambda *a: [r["x"]["sentences"] and (len(r["x"]["sentences"]), r["x"]["targets"]) for r in docs.select("doc_id", readers.question_targets(F.col("text"), *a).alias("x")).sort("doc_id").collect()]
    assert get() == [[], [], None, (3, [2]), (3, [2])] and get(True)[4] == (1, [0])


@pytest.mark.parametrize("name", ["l10_question_targets", "s01_dump", "s06_templates"])
def test_texts_that_are_empty_or_missing_equal_their_sql(spark, tmp_path, name):
    texts = ["", " ", "\n", ".", None, "a\rb\r\nc", "***LIST***. a.", "***formula***", "One. Two!"]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(t for t in texts for _ in range(15))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "d"))
    next((tmp_path / "d").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    assert spark_rows(registry.queries()[name](spark, str(tmp_path))) == sql_rows(registry.oracle_sql()[name], tmp_path)


def test_templates_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(markup, "TEMPLATE_BYTES", 10)
    pages = spark.createDataFrame([(1, "T", "x")], "page_id long, title string, text string")
    with pytest.raises(ValueError):
        markup.clean_pages(pages, {"a": "x" * 20})


def test_a_page_that_fails_is_kept_with_its_error(spark):
    pages = spark.createDataFrame([(1, "T", "{{x}}" * 3), (2, None, None), (3, "T", "")], "page_id long, title string, text string")
    assert [(r["page_id"], r["body"]) for r in sorted(markup.clean_pages(pages, {"X": "y"}).collect())] == [(1, "yyy"), (2, ""), (3, "")]
    assert markup.clean_pages(pages.limit(0), {"X": "y"}).count() == 0


def test_deep_and_long_markup_ends():
    loops = markup.Templates({"A": "{{b}}x", "B": "{{a}}y"})
    assert set(loops.expand("{{a}}")) <= {"x", "y"}
    assert markup.clean("{{" * 20_000 + "x") and markup.clean("[[" * 20_000 + "x") and markup.balanced("{" * 50_000, r"\{\{", r"\}\}") == []


def test_single_article_and_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "Some page.txt").write_text("==H==\ntext")
    page = readers.read_article(spark, str(tmp_path / "in"), 5)
    assert [tuple(r) for r in markup.clean_pages(page).select("page_id", "body").collect()] == [(5, "========,2,H.\ntext")]


def test_segmented_files(spark, tmp_path):
    folder = tmp_path / "3-5" / "x"
    folder.mkdir(parents=True)
    (folder / "7.ref").write_text("==========\nThe first sentence .\n``The'' second 's .\n==========\nAnother topic .\n\n...\n==========\nabc\n==========\n abcde\n==========\n")
    (folder / "8.txt").write_text("no ref file")
    (row,) = readers.read_segmented(spark, str(tmp_path)).collect()
    assert (row["sentences"], row["targets"]) == (["The first sentence .", "The second's .", "Another topic .", " abcde"], [1, 2, 3])
    names = readers.read_segmented(spark, str(tmp_path)).select(readers.segment_folder(F.col("path")).alias("x")).head()["x"]
    assert (names["length"], names["name"]) == ("3-5", "7")


def test_processed_articles(spark, tmp_path):
    (tmp_path / "12").write_text("========,1,preface.\nintro one.\n========,2,History.\nfirst.\nsecond.\n***LIST***.\n========,3,Early years.\nthird.\n")
    high, low = (readers.read_articles(spark, str(tmp_path), g).head() for g in (False, True))
    assert (high["sentences"], high["targets"]) == (["first.", "second.", "third."], [1, 2])
    assert low["targets"] == [2] and readers.read_articles(spark, str(tmp_path), keep_preface=True).head()["targets"] == [0, 2, 3]


def word2vec(path, rows, size):
    with path.open("wb") as f:
        f.write(f"{len(rows)} {size}\n".encode())
        for word, v in rows:
            f.write(word.encode() + b" " + np.array(v, "<f4").tobytes() + b"\n")


def test_word_vectors_of_any_size_are_read_as_a_stream(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(f"wörd{i}", rng.normal(size=50).astype("f4").tolist()) for i in range(9000)] + [("UNK", [0.5] * 50)]  # more than one read and one batch
    word2vec(tmp_path / "v.bin", rows, 50)
    vectors = readers.read_word_vectors(spark, str(tmp_path / "v.bin"))
    assert {r["word"]: r["vec"] for r in vectors.collect()} == dict(rows)
    words = spark.createDataFrame([("wörd3",), ("nobody",)], "word string")
    assert {r["word"]: r["vec"] for r in readers.with_vectors(words, vectors).collect()} == {"wörd3": rows[3][1], "nobody": [0.5] * 50}
    known = readers.with_vectors(words.where("word <> 'nobody'"), vectors.where("word <> 'UNK'"))
    assert known.count() == 1
    with pytest.raises(PySparkException):
        readers.with_vectors(words, vectors.where("word <> 'UNK'")).collect()


def test_common_words_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(readers, "ROWS_A_TASK", 80)
    rows = [(i, "the" if i % 2 else None if i % 10 == 0 else f"w{i % 40}") for i in range(2000)]
    words = spark.createDataFrame(rows, "doc_id long, word string").repartition(3)
    vectors = spark.createDataFrame([("the", [1.0], 7), ("UNK", [0.5], 0)] + [(f"w{i}", [float(i)], 7) for i in range(20)], "word string, vec array<float>, known int")
    got = readers.with_vectors(words, vectors).select("doc_id", "word", "vec", "known", F.spark_partition_id().alias("task")).collect()
    known = {"the": 1.0} | {f"w{i}": float(i) for i in range(20)}
    want = sorted((i, w or "", [known.get(w, 0.5)], 7 if w in known else None) for i, w in rows)
    assert sorted((r["doc_id"], r["word"] or "", r["vec"], r["known"]) for r in got) == want
    assert max(Counter(r["task"] for r in got if r["word"] == "the").values()) < 300  # of 1000 in one task before


def test_aligned_files_must_have_as_many_lines(spark):
    lines = spark.createDataFrame([(0, "a"), (1, "b")], "line_no long, value string")
    with pytest.raises(ValueError):
        readers.aligned_topic_rows(lines, lines.limit(1))


def test_external_segmenter_output(spark, tmp_path):
    (tmp_path / "a.txt").write_text("s1\ns2\n==========\ns3\n")
    (tmp_path / "b.txt").write_text("t1\n==========\nt2\n==========\n")
    got = {}
    for r in readers.read_delimited(spark, str(tmp_path)).orderBy("path", "sent_idx").collect():
        got.setdefault(r["path"][-5:], []).append((r["sentence"], r["cut"]))
    assert got == {"a.txt": [("s1", 0), ("s2", 1), ("s3", 1)], "b.txt": [("t1", 1), ("t2", 1)]}


def test_annotators_with_gaps_and_other_lengths(spark):
    gold = spark.createDataFrame([(1, [0, 1, 0, 1]), (2, [0, 1])], "doc_id long, gold array<int>")
    rows = [("a", 1, 0, 0), ("a", 1, 1, None), ("a", 1, 2, 1), ("a", 1, 3, None), ("b", 1, 0, 1), ("b", 2, 0, None), ("b", 2, 1, 0)]
    cuts = spark.createDataFrame(rows, "annotator string, doc_id long, sent_idx long, cut int")
    got = {(r["annotator"], r["doc_id"]): (r["matched"], r["n"], r["windows"], r["pk_errors"]) for r in sg.annotator_scores(cuts, gold).collect()}
    assert got == {("a", 1): (True, 4, 2, 1), ("b", 1): (False, 1, 0, 0), ("b", 2): (True, 2, 0, 0)}


def test_annotators_are_scored_in_one_reading_of_each_side(spark):
    gold = spark.createDataFrame([(1, [0, 1]), (2, [1])], "doc_id long, gold array<int>")
    cuts = spark.createDataFrame([("a", 1, 0, 0), ("a", 1, 1, 1), ("a", 2, 0, 0), ("a", 2, 1, 0)], "annotator string, doc_id long, sent_idx long, cut int")
    plan = sg.annotator_scores(cuts, gold)._jdf.queryExecution().optimizedPlan()
    assert plan.collectLeaves().size() == 2 and "Window" not in plan.toString()
    assert sorted(map(tuple, sg.annotator_scores(cuts, gold).collect())) == [("a", 1, 2, 2, 0, 0, True), ("a", 2, 2, None, 0, 0, False)]


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"a": {"y": 3}, "b": None}))
    assert readers.read_config(str(tmp_path / "c.json"), {"a": {"x": 1, "y": 2}, "b": 5}) == {"a": {"x": 1, "y": 3}, "b": 5}
    assert readers.size_in_bytes("1M") == 1 << 20
    for bad in ("1", "x", "100K"):
        with pytest.raises(ValueError):
            readers.size_in_bytes(bad)
