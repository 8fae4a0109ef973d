"""Text expressions: splitting, words, clean-up.  All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens, stop words and the separator of the corpus format.
LIST_TOKEN, FORMULA_TOKEN, CODE_TOKEN = "***LIST***", "***formula***", "***codice***"
SPECIAL_TOKENS = (LIST_TOKEN, FORMULA_TOKEN, CODE_TOKEN)
STOP_WORDS = ("of", "a", "and", "to")
SEPARATOR = "========"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that it uses more than once, evaluated once."""
    return F.get(F.transform(F.array(value), f), 0)


def scan(values: Column, start: Column, step: Callable[[Column, Column], Column], out: Callable[[Column, Column], Column], kind: str, part: int = 256) -> Column:
    """``out(state, x)`` for each element in order, where ``step(state, x)`` makes the next state; ``kind`` is the SQL type of what out gives.

    Results are held in parts, since appending to one array would copy it for each element.
    """
    none = F.array().cast(f"array<{kind}>")
    begin = F.struct(start.alias("state"), none.alias("held"), F.array().cast(f"array<array<{kind}>>").alias("done"))

    def add(acc: Column, x: Column) -> Column:
        own, full = out(acc["state"], x).cast(kind), F.size(acc["held"]) >= part
        held = F.when(full, F.array(own)).otherwise(F.array_append(acc["held"], own))
        return F.struct(step(acc["state"], x).alias("state"), held.alias("held"), F.when(full, F.array_append(acc["done"], acc["held"])).otherwise(acc["done"]).alias("done"))

    return F.aggregate(values, begin, add, lambda acc: F.flatten(F.array_append(acc["done"], acc["held"])))


def running_total(numbers: Column) -> Column:
    """The sum of each number and those before it."""
    return scan(numbers.cast("array<bigint>"), F.lit(0).cast("long"), lambda total, x: total + x, lambda total, x: total + x, "bigint")


def split_sentences(text: Column) -> Column:
    """Sentences end with . ! or ? and white space."""
    return F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\x01"), "\x01")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def split_words(text: Column) -> Column:
    """Pieces between runs of white space of any kind."""
    return F.filter(F.split(text, r"[\s\x1c-\x1f\x85\p{Z}]+"), lambda w: w != "")


def without_tokens(text: Column) -> Column:
    for token in SPECIAL_TOKENS:
        text = F.replace(text, F.lit(token), F.lit(""))
    return text


def content_words(text: Column, remove_stop_words: bool = False) -> Column:
    """Words once the special tokens are gone; optionally without the stop words."""
    own = words(without_tokens(text))
    return F.filter(own, lambda w: ~w.isin(*STOP_WORDS)) if remove_stop_words else own


def split_list_sentence(sentence: Column) -> Column:
    """A sentence that ends in a list token on a line of its own, as its lines with a stop each and the token."""
    tail = f"\n{LIST_TOKEN}."
    lines = F.split(F.substring(sentence, 1, F.length(sentence) - len(tail)), "\n")
    return F.when(F.endswith(sentence, F.lit(tail)), F.concat(F.transform(lines, lambda x: F.concat(x, F.lit("."))), F.array(F.lit(LIST_TOKEN + ".")))).otherwise(F.array(sentence))


def split_colon_lines(sentence: Column) -> Column:
    """Pieces between colon and line end; all but the last keep the colon."""
    return let(F.split(sentence, ":\n"), lambda p: F.transform(p, lambda x, i: F.when(i < F.size(p) - 1, F.concat(x, F.lit(":"))).otherwise(x)))


def split_long(sentence: Column, most: int = 45) -> Column:
    """A sentence of over ``most`` words, at its line ends."""
    return F.when(F.size(words(sentence)) > most, F.split(sentence, "\n")).otherwise(F.array(sentence))


def section_sentences(text: Column) -> Column:
    """The chain for a section: sentences, list and colon splits, long ones at line ends; line ends become blanks."""
    out = F.flatten(F.transform(split_sentences(text), split_list_sentence))
    out = F.flatten(F.transform(out, split_colon_lines))
    out = F.flatten(F.transform(out, lambda s: split_long(s)))  # a function of two parameters would get the index
    return F.transform(out, lambda s: F.replace(s, F.lit("\n"), F.lit(" ")))


def letters_only(text: Column) -> Column:
    return F.regexp_replace(text, "[^a-zA-Z0-9 ]+", "")


def clean_paragraph(text: Column) -> Column:
    """Quote clean-up of tokenised news text."""
    for old, new in (("'' ", " "), (" 's", "'s"), ("``", "")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def file_name(text: Column) -> Column:
    return F.regexp_replace(text, r'[\\/*?:"<>|]', "_")


def unquote(text: Column) -> Column:
    """URL-decode; malformed input and plus signs stay."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def strip_html(html: Column) -> Column:
    """Text of a page: no script, style, comment or tag; runs of white space are one blank."""
    out = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def without_bom(text: Column) -> Column:
    return F.regexp_replace(text, "^(﻿|ï»¿|Ã¯Â»Â¿)+", "")


def occurrences(text: Column, literal: str) -> Column:
    return F.size(F.split(text, rf"\Q{literal}\E", -1)) - 1


def split_sections(text: Column, low_granularity: bool = False) -> Column:
    """Pieces between separator lines; low granularity ignores the separators of levels 3 to 9."""
    if low_granularity:
        text = F.regexp_replace(text, rf"{SEPARATOR},[3-9],.*?\.", "")
        return F.split(text, rf"{SEPARATOR},[1-2],.*?\.")
    return F.split(text, rf"{SEPARATOR},\d,.*?\.")


def without_preface(sections: Column) -> Column:
    """The sections with something in them, without what stands before the first separator and without the preface."""
    return F.filter(F.slice(sections, 3, 1 << 30), lambda x: F.regexp_replace(x, "^[\n ]+$", "") != "")


def with_separators(text: Column, old: str = "=" * 10, new: str = "*" * 44) -> Column:
    """Segment separators rewritten as another tool wants them."""
    return F.replace(text, F.lit(old), F.lit(new))


def sentence_count(text: Column) -> Column:
    """Sentences with a word."""
    return F.size(F.filter(split_sentences(text), lambda x: F.size(words(x)) > 0))


def one_line(html: Column) -> Column:
    """Text of a context: no tag, runs of white space are one blank."""
    return F.regexp_replace(F.regexp_replace(html, r"<[^>]*>", ""), r"\s+", " ")


def normal_title(title: Column) -> Column:
    """Underscores and runs of blanks are one blank; the first letter is a capital."""
    own = F.trim(F.regexp_replace(title, r"[\s_]+", " "))
    return F.concat(F.upper(F.substring(own, 1, 1)), F.substring(own, 2, 1 << 30))


def stable_hash(*parts: Column) -> Column:
    """A non-negative 32-bit number from the md5 of the parts, joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def unescape_basic(text: Column) -> Column:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def escape_basic(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text
