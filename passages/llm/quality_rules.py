"""Line-first cleaning with DataFrame expressions only.

Every line with a word is held against punctuation, navigation, symbol and boilerplate rules; lines that fail go, and a
document that loses more than ``most_lost`` of the characters of its lines is rejected.  Base rules on the whole text come before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WS = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
_SYMBOL = f"[{SYMBOLS}]"
#: A line of fewer words than this must end a sentence or it counts as navigation.
SHORT_LINE = 4
_ENDS = ".!?…:;\"'”’»)]}"
MOST_LOST = 0.5
LEAST_WORDS = 10
WINDOW = 5
MOST_REPEATED = 20
BOILERPLATE = r"(?i)\b(cookie policy|privacy policy|terms of (use|service)|subscribe to|sign up|log ?in|skip to (main )?content|all rights reserved|click here|back to top|share (this|on)|javascript)\b"


def words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space."""
    return F.filter(F.split(text, _WS + "+"), lambda w: w != "")


def repeated_window_words(own: Column, n: Column, window: int = WINDOW) -> Column:
    """Words in windows of ``window`` words that are found twice or more in the array ``own`` of ``n`` words.

    Windows are compared by 64-bit hashes.  Equal neighbours among the sorted (hash, position) pairs are the repeated
    windows; each covers the words up to the next repeated window's start, or its whole length.
    """
    at = F.sequence(F.lit(0), n - window)
    hashes = F.transform(at, lambda i: F.xxhash64(*(F.get(own, i + j) for j in range(window))))
    return F.when(n < window, F.lit(0)).otherwise(_covered(hashes, window))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that f uses more than once; the optimizer cannot put the value's expression in its place."""
    return F.get(F.transform(F.array(value), f), 0)


def _covered(hashes: Column, window: int) -> Column:
    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(p: Column) -> Column:
            twice = F.filter(p, lambda x, i: (F.get(p, i - 1)["h"] == x["h"]) | (F.get(p, i + 1)["h"] == x["h"]))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        def total(s: Column) -> Column:
            return F.aggregate(s, F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n")), lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(window), i - acc["last"])).alias("n")), lambda acc: acc["n"])

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(let(pairs, starts), total))

    return let(hashes, count)


def line_is_kept(line: Column) -> Column:
    """Whether a line passes: punctuation, navigation, symbols, boilerplate."""
    long = F.length(line)
    unended = F.instr(F.lit(_ENDS), F.substring(F.rtrim(line), -1, 1)) == 0
    few = line.rlike(rf"^{_WS}*([^\x20\x09-\x0D]+{_WS}+){{0,{SHORT_LINE - 2}}}[^\x20\x09-\x0D]+{_WS}*$")
    navigation = ((long < 40 * SHORT_LINE) & unended & few) | (F.regexp_count(line, F.lit(r"[|»›•·]")) >= 3)
    symbols = F.regexp_count(line, F.lit(_SYMBOL))
    boilerplate = (long < 120) & line.rlike(BOILERPLATE)
    return ~((symbols * 10 > long) | navigation | boilerplate)


def _measured(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.select("*", text.alias("_text"), words(text).alias("_words"), lines.alias("_lines"))
    return out.select("*", F.size("_words").alias("_n"))


def _base(out: DataFrame) -> DataFrame:
    repeated = repeated_window_words(F.col("_words"), F.col("_n"))
    out = out.select(
        "*",
        F.length(F.array_join("_words", "")).cast("long").alias("_word_chars"),
        F.regexp_count("_text", F.lit(_SYMBOL)).cast("long").alias("_n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("_n_dup_lines"),
        repeated.cast("long").alias("_n_repeat_words"),
    )
    failed = (F.col("_n") < LEAST_WORDS) | (100 * F.col("_n_repeat_words") > MOST_REPEATED * F.col("_n"))
    return out.select("*", failed.alias("_base_failed"))


def _lost(most_lost: float) -> Column:
    """True if the lines that fail hold more than ``most_lost`` of the text's characters in lines."""
    return _lines_lost(F.col("_lines"), most_lost)


def _lines_lost(lines: Column, most_lost: float) -> Column:
    chars = lambda x: F.aggregate(x, F.lit(0), lambda n, line: n + F.length(line))
    return chars(lines) * (1 - most_lost) > chars(F.filter(lines, line_is_kept))


def quality_rules(docs: DataFrame, most_lost: float = MOST_LOST) -> DataFrame:
    """The counts and verdicts of each row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    A null text counts as empty and fails, as any text of under ten words does.  A null doc_id stays null; rows that
    repeat are judged one by one; an empty table gives no rows; further columns of ``docs`` are not read.
    """
    out = _base(_measured(docs.select("doc_id", "text")))
    kept = ~F.col("_base_failed") & ~_lost(most_lost)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_n").cast("long").alias("n_words"), F.col("_word_chars").alias("word_chars"), F.col("_n_symbols").alias("n_symbols"), F.col("_n_dup_lines").alias("n_dup_lines"), F.col("_n_repeat_words").alias("n_repeat_words"), F.col("_base_failed").alias("base_failed"), kept.alias("kept"))


def clean_lines(docs: DataFrame, most_lost: float = MOST_LOST) -> DataFrame:
    """docs without the rows that the rules reject and, in the others' text, without the lines that fail.

    Null, empty and wordless texts are rejected; a null doc_id stays null; rows that repeat are judged one by one; an empty
    table stays empty.  Lines without a word stay.  n_chars, where there is one, is the new text's length; the other columns stay as they are.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def unrepeated(own: Column) -> Column:
        n = F.size(own)
        return F.when(n < LEAST_WORDS, F.lit(False)).otherwise(100 * repeated_window_words(own, n) <= MOST_REPEATED * n)

    kept = docs.where(let(words(text), unrepeated) & ~let(lines, lambda x: _lines_lost(x, most_lost)))
    left = F.filter(F.split("text", "\n"), lambda x: ~x.rlike(r"[^\x20\x09-\x0D]") | line_is_kept(x))
    out = kept.withColumn("text", F.array_join(left, "\n"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def cleaned_text(docs: DataFrame) -> DataFrame:
    """docs with column clean_text: the lines that pass, in order; that of a null or empty text is empty.  All rows stay."""
    lines = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]") & line_is_kept(x))
    return docs.withColumn("clean_text", F.array_join(lines, "\n"))
