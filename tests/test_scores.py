"""Scores, chunks and scorers against brute force and pinned values; odd documents; streaming."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from passages.functions import text as tx
from passages.operators import corpus, learned, rag, timers
from passages.operators import segments as sg
from passages.operators.ranks import with_total_before
from passages.streaming import ingest


def flags(masses):
    return [int(i == m - 1) for m in masses for i in range(m)]


def slow_errors(gold, hyp, k):
    cut = lambda f, i: sum(f[i : i + k])
    at = range(len(gold) - k)
    return sum((cut(gold, i) > 0) != (cut(hyp, i) > 0) for i in at), sum(cut(gold, i) != cut(hyp, i) for i in at)


PINNED = [([5, 4], [9], 3, (3, None, 6)), ([5, 4], [9], 2, (2, None, 7)), ([5, 1, 12], [6, 3, 9], 3, (None, 6, 15)), ([5, 1, 12], [6, 3, 9], 5, (None, 8, 13))]


@pytest.mark.parametrize(("gold", "hyp", "k", "expected"), PINNED)
def test_pinned_windows(spark, gold, hyp, k, expected):
    df = spark.createDataFrame([(1, flags(gold), flags(hyp))], "doc_id long, gold array<int>, hyp array<int>")
    row = sg.window_scores(df, k).head()
    assert row["windows"] == expected[2] and all(e is None or e == g for e, g in zip(expected, (row["pk_errors"], row["wd_errors"])))


def test_windows_and_sweep_against_brute_force(spark):
    rng = np.random.default_rng(1)
    docs = []
    for i in range(40):
        n = int(rng.integers(1, 60))
        gold = [int(x) for x in rng.random(n) < 0.3][:-1] + [1]
        p = [float(x) for x in np.round(rng.random(n), 2)]
        docs.append((i, gold, p))
    docs += [(100, flags([30, 1, 1]), [0.0] * 32), (101, [1], [1.0]), (102, flags([50]), [k * 0.05 for k in range(20)] + [1.0] * 30)]
    df = spark.createDataFrame(docs, "doc_id long, gold array<int>, p array<double>")
    size = lambda g: max(2, math.floor(len(g) / (2 * sum(g)) + 0.5))
    expected = []
    for t in range(20):
        errors = windows = 0
        for _, g, p in docs:
            hyp = [int(x > t * 0.05) for x in p][:-1] + [1]
            errors += slow_errors(g, hyp, size(g))[0]
            windows += max(0, len(g) - size(g))
        expected.append((t, errors, windows))
    assert sorted((r["t"], r["errors"], r["windows"]) for r in sg.threshold_sweep(df).collect()) == expected
    scored = sg.window_scores(df.withColumn("hyp", F.transform("p", lambda x, i: F.when((i == F.size("p") - 1) | (x > 0.4), 1).otherwise(0))))
    for r in scored.collect():
        hyp = [int(x > 0.4) for x in r["p"]][:-1] + [1]
        assert (r["pk_errors"], r["wd_errors"]) == slow_errors(r["gold"], hyp, r["k"])


def test_a_document_of_many_sentences_takes_linear_time(spark):
    df = spark.range(1).select(F.lit(1).alias("doc_id"), F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda i: F.when(i == 100_000, 1).otherwise(0)).alias("gold"), F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda i: F.when(i % 7 == 0, 1).otherwise(F.when(i == 100_000, 1).otherwise(0))).alias("hyp"))
    row = sg.window_scores(df).head()
    assert (row["k"], row["windows"], row["pk_errors"]) == (50_000, 50_000, 50_000)


def test_odd_documents(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (4, "..."), (5, "One."), (5, "One."), (None, "A b. C d.\nE f.")], "doc_id long, text string")
    scores = sg.window_scores(sg.pairs(docs))
    assert sorted(str(r["doc_id"]) for r in scores.collect()) == ["5", "5", "None"] and {r["windows"] for r in scores.collect()} <= {0, 1}
    assert rag.fixed_chunks(docs).count() == 4 and sg.sentences(docs).count() == 5
    none = docs.limit(0)
    for empty in (sg.window_scores(sg.pairs(none)), rag.fixed_chunks(none), sg.sentences(none), sg.threshold_sweep(sg.probabilities(none)), corpus.ranked_split(none.withColumn("s", F.lit("x")), "s")):
        assert empty.count() == 0


def test_pruned_headers_and_scan_against_a_loop(spark):
    rng = np.random.default_rng(2)
    docs = [(i, [(None if rng.random() < 0.4 else int(rng.integers(2, 6)), f"l{j}") for j in range(int(rng.integers(0, 30)))]) for i in range(50)]

    def slow(lines):
        out = []
        for i, (level, t) in enumerate(lines):
            stop = next((j for j in range(i + 1, len(lines)) if level is not None and lines[j][0] is not None and lines[j][0] <= level), len(lines))
            if level is None or any(x is None for x, _ in lines[i + 1 : stop]):
                out.append(t)
        return out

    df = spark.createDataFrame(docs, "doc_id long, h array<struct<level:int,text:string>>")
    got = {r["doc_id"]: [x["text"] for x in r["k"]] for r in df.select("doc_id", corpus.pruned_headers(F.col("h")).alias("k")).collect()}
    assert got == {i: slow(h) for i, h in docs}
    long = spark.range(1).select(tx.running_total(F.sequence(F.lit(1), F.lit(5000))).alias("t")).head()["t"]
    assert long == np.cumsum(np.arange(1, 5001)).tolist()


def test_ranks_across_cuts(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), int(x), i) for i, (g, x) in enumerate(zip(rng.integers(0, 3, 500), rng.integers(0, 50, 500)))]
    df = spark.createDataFrame([*rows, (None, 7, 1000)], "g int, x int, i long").repartition(5)
    for cuts in (1, 4, 64):
        got = {r["i"]: r["n"] for r in with_total_before(df, "n", ["x", "i"], ["g"], cuts=cuts).collect()}
        assert got == {i: sum((h, y, j) < (h, x, i) for h, y, j in rows if h == g) for g, x, i in rows} | {1000: 0}


def test_chunks_of_long_documents_take_linear_time(spark):
    took = []
    for n in (1_000, 4_000_000):
        docs = spark.createDataFrame([(1, "word " * n)], "doc_id long, text string")
        arrays = docs.selectExpr("doc_id", f"transform(sequence(1, {n // 100}), i -> named_struct('text', repeat('word ', 100))) as s", f"transform(sequence(1, {n // 100}), i -> int(i % 5 = 0)) as flags")
        began = time.monotonic()
        got = [x.agg(F.count("*"), F.sum("n_words"), F.max("n_words")).head() for x in (rag.fixed_chunks(docs), rag.segment_chunks(arrays, "flags", 64), rag.segment_chunks(arrays, "flags", 256, "sentence"))]
        took.append(time.monotonic() - began)
        assert [tuple(r) for r in got] == [(-(-n // 52), n, 52), (n // 500 * 8, n, 63), (n // 100, n, 100)]
    assert took[1] < 60  # minutes when folded over arrays


@pytest.mark.parametrize("level", ["word", "sentence"])
def test_segment_chunks_against_a_plain_loop(spark, level):
    rng = np.random.default_rng(3)
    rows = [(d, [(" ".join("w" * int(k) for k in rng.integers(1, 9, rng.integers(0, 30))),) for _ in range(rng.integers(0, 9))]) for d in range(40)]
    rows = [(d, s, [int(x) for x in rng.integers(0, 2, len(s))]) for d, s in rows]
    want = []
    for d, s, flags in rows:
        held, size, made = [], 0, []
        for (text,), flag in zip(s, flags, strict=True):
            own = text.split()
            for i, w in enumerate(own):
                held, size = [*held, w], size + (len(w) + 1 if level == "sentence" else 1)
                if level == "word" and ((i == len(own) - 1 and flag) or size >= 19):
                    made, held, size = [*made, held], [], 0
            if level == "sentence" and (flag or size >= 20):
                made, held, size = ([*made, held], [], 0) if own else (made, held, 0)
        want += [(d, k, " ".join(c), len(c)) for k, c in enumerate([*made, held] if held else made)]
    got = rag.segment_chunks(spark.createDataFrame(rows, "doc_id long, s array<struct<text:string>>, flags array<int>"), "flags", 20, level)
    assert sorted(map(tuple, got.drop("chunk_id").collect())) == want


def lstm_one(x, w, reverse):
    size = w["hidden"].shape[1]
    h, c, out = np.zeros(size), np.zeros(size), [None] * len(x)
    for t in reversed(range(len(x))) if reverse else range(len(x)):
        i, f, g, o = (w["input"] @ x[t] + w["bias"] + w["hidden"] @ h).reshape(4, size)
        s = lambda v: 1 / (1 + np.exp(-v))
        c = s(f) * c + s(i) * np.tanh(g)
        h = s(o) * np.tanh(c)
        out[t] = h
    return np.array(out)


def slow_probabilities(model, sentences):
    def stack(x, layers):
        last = []
        for ways in layers:
            outs = [lstm_one(x, w, k == 1) for k, w in enumerate(ways)]
            last += [o[0] if k == 1 else o[-1] for k, o in enumerate(outs)]
            x = np.concatenate(outs, axis=1)
        return x, np.concatenate(last)

    codes = [out.max(axis=0) if model.pool == "max" else last for out, last in (stack(s, model.encoder) for s in sentences)]
    out, _ = stack(np.array(codes), model.document)
    logits = out[:-1] @ model.head[0].T + model.head[1]
    return 1 / (1 + np.exp(logits[:, 0] - logits[:, 1]))


@pytest.mark.parametrize("name", learned.SCORERS)
def test_recurrent_scorers_against_a_plain_loop(name):
    rng = np.random.default_rng(4)
    model = learned.SCORERS[name](6, 5, 11)
    sentences = [rng.normal(size=(int(n), 6)) for n in rng.integers(1, 9, 12)]
    assert np.allclose(model.boundary_probabilities(sentences), slow_probabilities(model, sentences), atol=1e-9)


def test_documents_are_scored_together(spark, monkeypatch):
    rows = [(d, [("word " * (1 + (d * i) % 7) + "x",) for i in range(d % 5)]) for d in range(60)]
    arrays, model = spark.createDataFrame(rows, "doc_id long, s array<struct<text:string>>"), learned.SCORERS["max_pool"](4, 3, 2)
    alone = lambda s: [np.array([learned._vector(w, 4) for w in t.split()]) for (t,) in s]
    got = {r["doc_id"]: r["p"] for r in learned.score_documents(arrays, model).collect()}
    assert {d: len(p) for d, p in got.items()} == {d: max(0, len(s) - 1) for d, s in rows}
    assert all(np.allclose(got[d], slow_probabilities(model, alone(s)), atol=1e-6) for d, s in rows if len(s) > 1)
    passes, lstm = [], learned.lstm
    monkeypatch.setattr(learned, "lstm", lambda *a: passes.append(1) or lstm(*a))
    model.probabilities(np.ones((1, 4)), np.zeros(900, int), np.full(300, 3), np.full(60, 5))
    assert len(passes) == 8  # two layers both ways, of words and of sentences, however many documents there are


def test_trained_segmenter_reads_the_texts_once(spark):
    reads = spark.sparkContext.accumulator(0)
    rows = [(d, "\n".join(f"Word {i} of {d % 7}. Then {i % 3} more! Last" for i in range(d % 5 + 1))) for d in range(200)]

    def count(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    docs = spark.createDataFrame(rows, "doc_id long, text string").mapInArrow(count, "doc_id long, text string")
    got = learned.trained_segmenter(docs).collect()
    assert reads.value == len(rows) and len(got) == sum(3 * (d % 5 + 1) - 1 for d, _ in rows) and all(0 < r["p"] < 1 for r in got)


def test_early_stop():
    assert learned.early_stop([5, 4, 4, 4.5, 3], 2) == 3 and learned.early_stop([5, 4, 3], 2) is None and learned.early_stop([1, 2, 3], None) is None


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"One {i}. Two.\nThree.", "en", "s", 5) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    query = ingest.sentence_stream(spark, str(tmp_path / "in"), ).writeStream.format("memory").queryName("sentences").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("sentences").collect())) == sorted(map(tuple, sg.sentences(docs).collect()))


def test_stage_timers(spark):
    own = timers.StageTimers(spark)
    for _ in range(2):
        with own.stage("count"):
            assert spark.range(5).count() == 5
    with pytest.raises(ZeroDivisionError), own.stage("fails"):
        1 / 0
    assert list(own.seconds) == ["count", "fails"] and own.report().startswith("count: ")
