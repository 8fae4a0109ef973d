"""Sentences, boundaries, segmenters and their scores.

A document's sentences stay in one array until a query needs them as rows, so splitting, labelling, predicting and
scoring are one narrow stage without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passages.functions.text import let, split_sentences, stable_hash, words

AVERAGE_SEGMENT = 13


def sentence_arrays(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, s: array of (section_idx, text, n_words) of the sentences with a word; a line is a section."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    parts = F.flatten(F.transform(lines, lambda line, i: F.transform(split_sentences(line), lambda x: F.struct(i.alias("section_idx"), x.alias("text"), F.size(words(x)).alias("n_words")))))
    return docs.select("doc_id", *keep, F.filter(parts, lambda x: x["n_words"] > 0).alias("s"))


def sentences(docs: DataFrame) -> DataFrame:
    """One row for each sentence: doc_id, pos, section_idx, sentence, n_words, is_boundary (last of its section)."""
    own = sentence_arrays(docs).select("doc_id", "s", gold(F.col("s")).alias("g"))
    rows = own.select("doc_id", F.posexplode(F.arrays_zip("s", "g")).alias("pos", "x"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("x.s.section_idx").cast("long").alias("section_idx"), F.col("x.s.text").alias("sentence"), F.col("x.s.n_words").cast("long").alias("n_words"), F.col("x.g").cast("long").alias("is_boundary"))


def gold(s: Column) -> Column:
    """1 for the last sentence of each section."""
    return let(s, lambda s: F.transform(s, lambda x, i: F.when(F.get(s, i + 1)["section_idx"] == x["section_idx"], 0).otherwise(1)))


def naive(doc_id: Column, n: Column, average: int = AVERAGE_SEGMENT) -> Column:
    """Independent cuts of chance 1/average from a hash of document and place; the last sentence is a cut."""

    def cuts(n: Column) -> Column:
        own = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when((i == n - 1) | (stable_hash(doc_id.cast("string"), i.cast("string")) % average == 0), 1).otherwise(0))
        return F.when(n > 0, own).otherwise(F.array().cast("array<int>"))

    return let(n, cuts)


def pairs(docs: DataFrame, average: int = AVERAGE_SEGMENT, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, gold and hyp (arrays of 0 and 1, last 1), n_words (of each sentence)."""
    own = sentence_arrays(docs, keep)
    return own.select("doc_id", *keep, gold(F.col("s")).alias("gold"), naive(F.col("doc_id"), F.size("s"), average).alias("hyp"), F.transform("s", lambda x: x["n_words"]).alias("n_words"))


def masses(flags: Column) -> Column:
    """Lengths of the segments that the 1s end."""
    ends = F.filter(F.transform(flags, lambda x, i: F.when(x == 1, i)), lambda i: i.isNotNull())
    return let(ends, lambda e: F.transform(e, lambda x, i: x - F.coalesce(F.get(e, i - 1), F.lit(-1))))


def window_size(gold_flags: Column) -> Column:
    """Half the mean gold mass, rounded half up, 2 at least."""
    segments = F.aggregate(gold_flags, F.lit(0), lambda a, x: a + x)
    return F.greatest(F.lit(2), F.floor(F.size(gold_flags) / (2 * segments) + 0.5)).cast("int")


def segment_ids(flags: Column) -> Column:
    """Of each sentence, how many cuts are before it."""
    ended = F.when(F.element_at(flags, -1) == 1, flags).otherwise(F.concat(F.slice(flags, 1, F.size(flags) - 1), F.array(F.lit(1))))
    return F.when(F.size(flags) > 0, F.flatten(F.transform(masses(ended), lambda m, j: F.array_repeat(j, m)))).otherwise(F.array().cast("array<int>"))


def window_errors(gold_flags: Column, hyp: Column, k: Column, differ: str = "pk") -> Column:
    """Windows (i, i+k) in which gold and hyp disagree: on a cut in between ("pk") or on the number of cuts ("wd").  Time is linear in the sentences, whatever k."""

    def count(ids: Column) -> Column:
        def wrong(x: Column, i: Column) -> Column:
            far = F.get(ids, i + k)
            g, h = far["g"] - x["g"], far["h"] - x["h"]
            return (g > 0) != (h > 0) if differ == "pk" else g != h

        return F.size(F.filter(ids, lambda x, i: F.coalesce(wrong(x, i), F.lit(False))))

    both = F.zip_with(segment_ids(gold_flags), segment_ids(hyp), lambda g, h: F.struct(g.alias("g"), h.alias("h")))
    return F.when(F.size(gold_flags) > k, let(both, count)).otherwise(0)


def window_scores(scored: DataFrame, k: int | None = None) -> DataFrame:
    """doc_id, n, k, windows, pk_errors, wd_errors from doc_id, gold, hyp.  ``k`` overrides the window of each document."""
    size = F.lit(k) if k else window_size(F.col("gold"))
    out = scored.where(F.size("gold") > 0).select("*", size.alias("k"), F.size("gold").alias("n"))
    counts = [window_errors(F.col("gold"), F.col("hyp"), F.col("k"), d).cast("long").alias(f"{d}_errors") for d in ("pk", "wd")]
    return out.select("*", F.greatest(F.lit(0), F.col("n") - F.col("k")).cast("long").alias("windows"), *counts)


def corpus_score(scores: DataFrame, errors: str = "pk_errors", *by: str) -> DataFrame:
    """Errors over windows of all documents together; -1 without windows."""
    rate = F.coalesce(F.try_divide(F.sum(errors), F.sum("windows")), F.lit(-1.0))
    return scores.groupBy(*by).agg(F.sum(errors).alias("errors"), F.sum("windows").alias("windows"), F.round(rate, 9).alias("score"))


def word_masses(scored: DataFrame) -> DataFrame:
    """gold and hyp spread over words: each sentence's flag stands at its last word."""
    spread = lambda flags: F.flatten(F.zip_with(flags, F.col("n_words"), lambda f, n: F.concat(F.array_repeat(F.lit(0), (n - 1).cast("int")), F.array(f))))
    return scored.withColumns({"gold": spread(F.col("gold")), "hyp": spread(F.col("hyp"))})


def confusion(scored: DataFrame, *by: str) -> DataFrame:
    """tp, fp, fn, tn over all sentences but the last of each document, with precision, recall, F1 and accuracy.

    Undefined precision and recall are -1, an undefined F1 is 0.
    """
    inner = lambda c: F.slice(c, 1, F.greatest(F.lit(0), F.size(c) - 1))
    flags = scored.where(F.size("gold") > 1).select(*by, F.explode(F.arrays_zip(inner("gold").alias("g"), inner("hyp").alias("h"))).alias("x")).select(*by, "x.g", "x.h")
    n = lambda g, h: F.sum(((F.col("g") == g) & (F.col("h") == h)).cast("long"))
    out = flags.groupBy(*by).agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))
    ratio = lambda a, b, none: F.coalesce(F.try_divide(a, b), F.lit(none))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return out.select("*", F.round(ratio(tp, tp + fp, -1.0), 9).alias("precision"), F.round(ratio(tp, tp + fn, -1.0), 9).alias("recall"), F.round(ratio(2 * tp, 2 * tp + fp + fn, 0.0), 9).alias("f1"), F.round(ratio(tp + tn, tp + tn + fp + fn, 0.0), 9).alias("accuracy"))


def multiclass_f1(rows: DataFrame, gold_class: str, predicted: str, excluded: int, *by: str) -> DataFrame:
    """class, tp, fp, fn, precision, recall, f1 of each class, and a row with class null for all classes but ``excluded`` together.

    A wrong prediction is a false positive of the gold class and a false negative of the predicted one, as the corpus
    tools count them; F1 is the same either way.  Undefined precision and recall are -1, an undefined F1 is 0.
    """
    same = F.col(gold_class) == F.col(predicted)
    sides = F.explode(F.array(F.struct(F.col(gold_class).alias("class"), same.cast("long").alias("tp"), (~same).cast("long").alias("fp"), F.lit(0).cast("long").alias("fn")), F.struct(F.col(predicted).alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), (~same).cast("long").alias("fn"))))
    counts = rows.select(*by, sides.alias("x")).groupBy(*by, F.col("x.class").alias("class")).agg(*(F.sum(f"x.{c}").alias(c) for c in ("tp", "fp", "fn")))
    whole = counts.where(F.col("class") != excluded).groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))).select(*by, F.lit(None).cast(counts.schema["class"].dataType).alias("class"), "tp", "fp", "fn")
    ratio = lambda a, b, none: F.round(F.coalesce(F.try_divide(a, b), F.lit(none)), 9)
    tp, fp, fn = map(F.col, ("tp", "fp", "fn"))
    return counts.unionByName(whole).select("*", ratio(tp, tp + fp, -1.0).alias("precision"), ratio(tp, tp + fn, -1.0).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn, 0.0).alias("f1"))


def label_accuracy(scored: DataFrame) -> DataFrame:
    """doc_id, accuracy: the share of sentences whose labels agree."""
    own = scored.where(F.size("gold") > 0)
    same = F.size(F.filter(F.arrays_zip("gold", "hyp"), lambda x: x["gold"] == x["hyp"]))
    return own.select("doc_id", F.round(same / F.size("gold"), 9).alias("accuracy"))


def flags_of_targets(targets: Column, n: Column) -> Column:
    """0 and 1 for each of n sentences from the places of the last sentences of segments; the last sentence is a cut."""
    ordered = F.array_sort(F.array_distinct(F.filter(F.array_append(targets, n - 1), lambda t: (t >= 0) & (t < n))))
    spread = lambda e: F.flatten(F.transform(e, lambda t, j: F.concat(F.array_repeat(F.lit(0), (t - F.coalesce(F.get(e, j - 1), F.lit(-1)) - 1).cast("int")), F.array(F.lit(1)))))
    return F.when(n > 0, let(ordered, spread)).otherwise(F.array().cast("array<int>"))


def with_predictions(docs: DataFrame, flags: DataFrame) -> DataFrame:
    """Question documents (id, ...) with segmented_sentences from rows (id, sent_idx, cut), in order; documents without rows keep theirs."""
    own = flags.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("sent_idx", "cut"))).alias("_f"))
    return docs.join(own, "id", "left").withColumn("segmented_sentences", F.coalesce(F.transform("_f", lambda x: x["cut"].cast("int")), F.col("segmented_sentences"))).select(*docs.columns)


def probabilities(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, gold, p: a hashed stand-in for a model's boundary probabilities."""
    own = sentence_arrays(docs, keep).where(F.size("s") > 0)
    p = F.transform("s", lambda x, i: (stable_hash(F.lit("p"), F.col("doc_id").cast("string"), i.cast("string")) % 1000) / 1000)
    return own.select("doc_id", *keep, gold(F.col("s")).alias("gold"), p.alias("p"))


def _two_to(n: Column) -> Column:
    return F.pow(F.lit(2), n).cast("int")


def threshold_sweep(predicted: DataFrame, *by: str, steps: int = 20) -> DataFrame:
    """Corpus Pk at thresholds 0, 0.05, ... (a cut is p > threshold; the last sentence always is one).

    A sentence's level is the number of thresholds that p exceeds, so a window has a cut at threshold t if the highest
    level in it is above t.  One pass finds the highest level of every window, and windows are counted by it.
    """
    least = F.lit(0.05)

    def level(x: Column) -> Column:
        near = F.greatest(F.lit(0), F.least(F.lit(steps), F.ceil(x / least).cast("int")))
        return let(near, lambda n: F.when((n < steps) & (x > n * least), n + 1).when((n > 0) & ~(x > (n - 1) * least), n - 1).otherwise(n))

    def highest(levels: Column, k: Column) -> Column:
        """The highest of each k levels, by doubling; the array keeps its length."""
        wide = F.aggregate(F.sequence(F.lit(0), F.floor(F.log2(k)).cast("int")), levels, lambda a, j: F.when(j == 0, a).otherwise(F.transform(a, lambda x, i: F.greatest(x, F.coalesce(F.get(a, i + _two_to(j - 1)), F.lit(0))))))
        return let(wide, lambda a: F.transform(a, lambda x, i: F.greatest(x, F.coalesce(F.get(a, i + k - _two_to(F.floor(F.log2(k)))), F.lit(0)))))

    own = predicted.where(F.size("gold") > 0).select(*by, "gold", "p", window_size(F.col("gold")).alias("k"))
    own = own.select(*by, "k", segment_ids(F.col("gold")).alias("g"), highest(F.transform("p", level), F.col("k")).alias("top"))
    there = lambda ids: F.filter(F.transform(ids, lambda x, i: F.struct((F.get(ids, i + F.col("k")) > x).alias("gold"), F.get("top", i).alias("top"))), lambda x: x["gold"].isNotNull())
    windows = own.select(*by, F.explode_outer(let(F.col("g"), there)).alias("w")).groupBy(*by, "w.gold", "w.top").agg(F.count("w").alias("n"))
    at = windows.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    wrong = F.sum(F.when(F.col("gold") == (F.col("top") > F.col("t")), 0).otherwise(F.col("n")))
    sums = at.groupBy(*by, "t").agg(wrong.alias("errors"), F.sum("n").alias("windows"))
    score = F.round(F.coalesce(F.try_divide("errors", "windows"), F.lit(-1.0)), 9)
    return sums.select(*by, "t", "errors", "windows", score.alias("score"), F.round(F.col("t") * least, 2).alias("threshold"))


def best_threshold(sweep: DataFrame, *by: str) -> DataFrame:
    """The threshold of lowest Pk, the lowest of equals."""
    return sweep.groupBy(*by).agg(F.min(F.struct("score", "t")).alias("m")).select(*by, F.col("m.t").alias("t"), F.round(F.col("m.t") * F.lit(0.05), 2).alias("threshold"), F.col("m.score").alias("score"))


def cross_validated(predicted: DataFrame, folds: int = 5) -> DataFrame:
    """Each fold is scored at the threshold that is best on the others: fold, threshold, errors, windows."""
    own = predicted.withColumn("fold", F.col("doc_id") % folds)
    by_fold = threshold_sweep(own, "fold").select("fold", "t", "errors", "windows")
    test = by_fold.select(F.col("fold").alias("test"), "t", F.col("errors").alias("test_errors"), F.col("windows").alias("test_windows"))
    whole = by_fold.groupBy("t").agg(F.sum("errors").alias("e"), F.sum("windows").alias("w"))
    rest = test.join(whole, "t").withColumn("score", F.try_divide(F.col("e") - F.col("test_errors"), F.col("w") - F.col("test_windows")))
    chosen = rest.groupBy("test").agg(F.min(F.struct("score", "t", "test_errors", "test_windows")).alias("m"))
    return chosen.select(F.col("test").alias("fold"), F.round(F.col("m.t") * F.lit(0.05), 2).alias("threshold"), F.col("m.test_errors").alias("errors"), F.col("m.test_windows").alias("windows"))


def softmax_boundary(logit0: Column, logit1: Column) -> Column:
    """Probability of class 1 of two logits."""
    return 1 / (1 + F.exp(logit0 - logit1))


def context_windows(docs: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """doc_id, pos, words, n_words of each sentence with its neighbours."""

    def near(w: Column) -> Column:
        return F.transform(w, lambda x, i: F.flatten(F.slice(w, F.greatest(F.lit(1), i + 1 - before), F.least(i, F.lit(before)) + 1 + after)))

    own = sentence_arrays(docs).select("doc_id", let(F.transform("s", lambda x: words(x["text"])), near).alias("w"))
    rows = own.select("doc_id", F.posexplode("w").alias("pos", "words"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "words", F.size("words").cast("long").alias("n_words"))


def segment_rows(scored: DataFrame, flags: str = "hyp") -> DataFrame:
    """doc_id, seg_idx, first_pos, mass, word_mass of each segment."""
    ends = F.filter(F.transform(flags, lambda x, i: F.when(x == 1, i)), lambda i: i.isNotNull())

    def of(e: Column) -> Column:
        start = lambda j: F.coalesce(F.get(e, j - 1), F.lit(-1)) + 1
        total = lambda x, j: F.aggregate(F.slice("n_words", start(j) + 1, x - start(j) + 1), F.lit(0).cast("long"), lambda a, y: a + y)
        return F.transform(e, lambda x, j: F.struct(start(j).alias("first_pos"), (x - start(j) + 1).alias("mass"), total(x, j).alias("word_mass")))

    rows = scored.select("doc_id", F.posexplode(let(ends, of)).alias("seg_idx", "m"))
    return rows.select("doc_id", F.col("seg_idx").cast("long").alias("seg_idx"), *(F.col(f"m.{c}").cast("long").alias(c) for c in ("first_pos", "mass", "word_mass")))


def corpus_stats(docs: DataFrame, *by: str) -> DataFrame:
    """Documents, segments, sentences; least, greatest, mean and population deviation of sections and sentences a document."""
    own = sentence_arrays(docs, by).where(F.size("s") > 0).select(*by, F.size("s").alias("n"), F.aggregate(gold(F.col("s")), F.lit(0), lambda a, x: a + x).alias("m"))
    stats = [f(c).cast("double" if name in ("mean", "std") else "long").alias(f"{name}_{label}") for c, label in (("m", "segments"), ("n", "sentences")) for f, name in ((F.min, "min"), (F.max, "max"), (F.sum, "total"))]
    stats += [F.round(f(c), 6).alias(f"{name}_{label}") for c, label in (("m", "segments"), ("n", "sentences")) for f, name in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    return own.groupBy(*by).agg(F.count("*").alias("documents"), *stats) if by else own.agg(F.count("*").alias("documents"), *stats)


def side_by_side(scored: DataFrame, s: DataFrame) -> DataFrame:
    """doc_id, report: sentences in order, a line of 10 = after a gold cut and a line of 10 - after a predicted one."""
    both = s.join(scored.select("doc_id", "gold", "hyp"), "doc_id")
    line = F.transform("s", lambda x, i: F.concat(x["text"], F.when(F.get("gold", i) == 1, "\n==========").otherwise(""), F.when(F.get("hyp", i) == 1, "\n----------").otherwise("")))
    return both.select("doc_id", F.array_join(line, "\n").alias("report"))


def annotator_scores(annotations: DataFrame, gold_rows: DataFrame) -> DataFrame:
    """annotator, doc_id, n, k, windows, pk_errors for each annotator's cuts (annotator, doc_id, sent_idx, cut).

    The last sentence is a cut whatever the annotator says; documents whose lengths differ from gold have matched = false.
    """
    ordered = F.array_sort(F.collect_list(F.struct("sent_idx", F.coalesce("cut", F.lit(0)).alias("cut"))))
    hyp = annotations.groupBy("annotator", "doc_id").agg(ordered.alias("h")).select("annotator", "doc_id", F.transform("h", lambda x, i: F.when(x["sent_idx"] == F.element_at("h", -1)["sent_idx"], 1).otherwise(x["cut"])).alias("hyp"))
    both = hyp.join(gold_rows.select("doc_id", "gold"), "doc_id").withColumn("matched", F.size("hyp") == F.size("gold"))
    k = F.when(F.col("matched"), window_size(F.col("gold")))
    sized = both.select("*", F.size("hyp").alias("n"), k.alias("k"))
    windows = F.when(F.col("matched"), F.greatest(F.lit(0), F.col("n") - F.col("k"))).otherwise(0).cast("long")
    errors = F.when(F.col("matched"), window_errors(F.col("gold"), F.col("hyp"), F.col("k"))).otherwise(0).cast("long")
    return sized.select("annotator", "doc_id", "n", "k", windows.alias("windows"), errors.alias("pk_errors"), "matched")
