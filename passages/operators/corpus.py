"""Corpus filters: headers, sentences, sections, articles, partitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passages.functions.text import CODE_TOKEN, FORMULA_TOKEN, LIST_TOKEN, let, occurrences, scan, stable_hash, words
from passages.operators.ranks import with_total_before

# Reserved title prefixes and the thresholds of the filters.
NAMESPACES = (
    "Category", "File", "Ru", "Wikipedia", "Talk", "User", "MediaWiki", "Template", "Help", "Portal", "Book", "Draft",
    "Education Program", "TimedText", "Module", "Gadget", "Gadget definition", "Media", "Special",
)
DISAMBIGUATION = "(disambiguation)"
MIN_LETTERS, MIN_SENTENCES, MAX_FORMULAS, MAX_CODES, MIN_SECTIONS, MIN_WORDS, MIN_VALID_RATIO, MAX_LIST_RATIO = 20, 2, 3, 2, 3, 2, 0.2, 0.5


def title_is_article(title: Column) -> Column:
    """Not all digits, not in a reserved namespace, no disambiguation page; letter case counts."""
    reserved = F.substring_index(title, ":", 1).isin(*NAMESPACES) & F.contains(title, F.lit(":"))
    return ~(title.rlike("^[0-9]+$") | reserved | F.endswith(title, F.lit(DISAMBIGUATION)))


def header_info(header: Column) -> Column:
    """Struct of id and title of an article block's header line."""
    return F.struct(F.regexp_extract(header, r'<doc id="(\d+)" url', 1).cast("long").alias("id"), F.regexp_extract(header, r'title="(.*)">', 1).alias("title"))


def body_lines(block: Column) -> Column:
    """Non-empty lines of an article block without the first two."""
    return F.slice(F.filter(F.split(block, "\n"), lambda x: x != ""), 3, 1 << 30)


def keep_sentences(s: Column) -> Column:
    """Struct of the kept sentences and counts of one section's sentences, in order.

    A sentence that contains the list token without being it counts as a list item and goes; the bare token stays once
    after other sentences; any other sentence ends a list, and goes if it has under two words.
    """
    token = LIST_TOKEN + "."
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("lists"), F.lit(False).alias("after"), F.lit(0).alias("n"), F.lit(0).alias("formulas"), F.lit(0).alias("codes"))

    def step(a: Column, x: Column) -> Column:
        bare = x == token
        item = F.contains(x, F.lit(LIST_TOKEN)) & ~bare
        keep = F.when(item, False).when(bare, ~a["after"]).otherwise(F.size(words(x)) >= MIN_WORDS)
        one = keep.cast("int")
        return F.struct(
            F.when(keep, F.array_append(a["kept"], x)).otherwise(a["kept"]).alias("kept"),
            (a["lists"] + F.when(item | (bare & ~a["after"]), 1).otherwise(0)).alias("lists"),
            F.when(item | bare, True).otherwise(False).alias("after"),
            (a["n"] + one).alias("n"),
            (a["formulas"] + one * occurrences(x, FORMULA_TOKEN)).alias("formulas"),
            (a["codes"] + one * occurrences(x, CODE_TOKEN)).alias("codes"),
        )

    return F.aggregate(s, start, step)


def section_verdict(letters: Column, n: Column, lists: Column, formulas: Column, codes: Column) -> Column:
    """The reason against a section, the last of those that hold; null if it is valid."""
    out = F.lit(None).cast("string")
    for bad, reason in ((n < MIN_SENTENCES, "sentences"), ((n > 0) & (lists / F.greatest(n, F.lit(1)) >= MAX_LIST_RATIO), "lists"), (letters < MIN_LETTERS, "letters"), (formulas >= MAX_FORMULAS, "formulas"), (codes >= MAX_CODES, "code")):
        out = F.when(bad, F.lit(reason)).otherwise(out)
    return out


def filtered_section(s: Column) -> Column:
    """Struct of kept, n, lists, formulas, codes, letters (of the kept sentences) and reason of one section's sentences."""

    def judged(k: Column) -> Column:
        letters = letter_count(F.array_join(k["kept"], ""))
        reason = section_verdict(letters, k["n"], k["lists"], k["formulas"], k["codes"])
        return F.struct(k["kept"].alias("kept"), *(k[c].alias(c) for c in ("n", "lists", "formulas", "codes")), letters.alias("letters"), reason.alias("reason"))

    return let(keep_sentences(s), judged)


def letter_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^a-zA-Z]", ""))


def valid_articles(sections: DataFrame) -> DataFrame:
    """doc_id, sections, valid, is_valid from rows (doc_id, reason): three valid sections and a fifth of all, at least."""
    counts = sections.groupBy("doc_id").agg(F.count("*").alias("sections"), F.sum(F.col("reason").isNull().cast("long")).alias("valid"))
    return counts.withColumn("is_valid", (F.col("valid") >= MIN_SECTIONS) & (F.col("valid") >= MIN_VALID_RATIO * F.col("sections")))


def line_runs(lines: Column, starts: Callable[[Column], Column]) -> Column:
    """Array of (run, first_line, lines): runs of lines that begin where ``starts`` holds; run 0 is what stands before the first of them."""
    places = F.filter(F.transform(lines, lambda x, i: F.when(starts(x), i)), lambda i: i.isNotNull())

    def runs(p: Column) -> Column:
        first = F.coalesce(F.get(p, 0) == 0, F.lit(False))
        edges = F.when(first, p).otherwise(F.concat(F.array(F.lit(0)), p))
        return let(edges, lambda e: F.transform(e, lambda x, j: F.struct((j + first.cast("int")).alias("run"), x.alias("first_line"), (F.coalesce(F.get(e, j + 1), F.size(lines)) - x).alias("lines"))))

    return F.when(F.size(lines) > 0, let(places, runs))


def pruned_headers(lines: Column) -> Column:
    """Array of (level, text), level null for content: headers with no content before the next of their level or above go.

    Read from the end, a header stays if its level is below that of every header between it and the next content.
    """
    far = F.lit(1 << 20)
    lowest = lambda state, x: F.when(x["level"].isNull(), far).otherwise(F.least(state, x["level"]))
    stays = scan(F.reverse(lines), F.lit(0), lowest, lambda state, x: F.coalesce(x["level"] < state, F.lit(True)), "boolean")
    return let(F.reverse(stays), lambda k: F.filter(lines, lambda x, i: F.get(k, i)))


def ranked_split(docs: DataFrame, by: str, train: float = 0.8, test: float = 0.1) -> DataFrame:
    """docs with partition: the first by hash of each group's documents train, then test, the rest dev; shares hold to one document."""
    keyed = docs.withColumn("_h", stable_hash(F.col("doc_id").cast("string")))
    ranked = with_total_before(keyed, "_rank", ["_h", "doc_id"], [by])
    sizes = docs.groupBy(by).agg(F.count("*").alias("_n"))
    both = ranked.join(sizes.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by")))
    share = F.when(F.col("_n") > 1, F.col("_rank") / (F.col("_n") - 1)).otherwise(0.0)
    return both.withColumn("partition", F.when(share < train, "train").when(share < train + test, "test").otherwise("dev")).select(*docs.columns, "partition")


def partition_of(doc_id: Column, forced_test: Column | None = None, train: int = 80, test: int = 10) -> Column:
    """train, test or dev by a hash of the id; forced ids are test whatever their hash."""
    h = stable_hash(doc_id.cast("string")) % 100
    by_hash = F.when(h < train, "train").when(h < train + test, "test").otherwise("dev")
    return by_hash if forced_test is None else F.when(forced_test, "test").otherwise(by_hash)


def with_partition(docs: DataFrame, forced: DataFrame, train: int = 80, test: int = 10) -> DataFrame:
    """docs with partition; ids in ``forced`` are test."""
    marked = docs.join(forced.select("doc_id").distinct().withColumn("_forced", F.lit(True)), "doc_id", "left")
    return marked.withColumn("partition", partition_of(F.col("doc_id"), F.col("_forced").isNotNull(), train, test)).drop("_forced")


def without_denied(docs: DataFrame, denied: DataFrame) -> DataFrame:
    return docs.join(denied.select("doc_id"), "doc_id", "left_anti")


def missing_denied(docs: DataFrame, denied: DataFrame) -> DataFrame:
    """Denied ids that no document has."""
    return denied.select("doc_id").distinct().join(docs.select("doc_id"), "doc_id", "left_anti")


def article_path(doc_id: Column) -> Column:
    """aa/bb/cc/id of an id, padded with zeros to seven digits."""
    padded = F.when(F.length(doc_id.cast("string")) < 7, F.lpad(doc_id.cast("string"), 7, "0")).otherwise(doc_id.cast("string"))
    return F.concat_ws("/", F.substring(padded, 1, 2), F.substring(padded, 3, 2), F.substring(padded, 5, 2), doc_id.cast("string"))
