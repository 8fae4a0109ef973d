"""Licence scan by a positional rare-token index, with DataFrame expressions only.

Each licence template is a word sequence with mandatory key phrases.  The index holds, for every template, its words of
highest inverse document frequency over the templates, in and out of the key phrases, as postings (template, offset).
A text is split into words once and its words that the index knows are looked up; every posting of such a word proposes
that the template starts at ``position - offset``.  The postings are sorted and intersected by template and start: a start
that all rare words of a template propose is a candidate, and a match if the key phrases stand where the template has them.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passages.llm.quality_rules import let

#: Phrases whose every occurrence counts, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Template word sequences (label: texts) with the phrases that must be there.
TEMPLATES: dict[str, tuple[str, tuple[str, ...]]] = {
    "apache-2.0": ("licensed under the apache license version 2 0", ("apache license", "2 0")),
    "mit": ("released under the mit license", ("mit license",)),
    "mit-text": ("permission is hereby granted free of charge to any person obtaining a copy of this software", ("hereby granted free of charge",)),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", ("source and binary forms",)),
    "gpl-3.0": ("this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    "gpl-2.0": ("gnu general public license version 2", ("gnu general public license", "version 2")),
    "lgpl": ("gnu lesser general public license", ("lesser general public license",)),
    "agpl": ("gnu affero general public license", ("affero general public license",)),
    "mpl-2.0": ("mozilla public license version 2 0", ("mozilla public license",)),
    "cc-by-nc": ("licensed under cc by nc 4 0", ("cc by nc",)),
    "cc-by-sa": ("licensed under cc by sa 4 0", ("cc by sa",)),
    "cc-by-nd": ("licensed under cc by nd 4 0", ("cc by nd",)),
    "cc0": ("cc0 1 0 universal", ("cc0",)),
    "unlicense": ("this is free and unencumbered software released into the public domain", ("released into the public domain",)),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    "spdx": ("spdx license identifier", ("spdx license identifier",)),
    "apache-notice": ("you may not use this file except in compliance with the license you may obtain a copy of the license at", ("except in compliance with the license",)),
    "gpl-notice": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("under the terms of the gnu general public license",)),
    "mpl-notice": ("this source code form is subject to the terms of the mozilla public license v 2 0", ("subject to the terms of the mozilla public license",)),
    "bsd-endorsement": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived from this software",)),
    "no-warranty": ("the software is provided as is without warranty of any kind express or implied", ("provided as is without warranty",)),
}
RARE_WORDS = 3
#: Score of a text: labelled places against this many make one half.
HALF = 1.0
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


Templates = dict[str, tuple[str, tuple[str, ...]]]


def template_index(templates: Templates = TEMPLATES, rare: int = RARE_WORDS) -> list[tuple[str, list[tuple[str, int]], list[tuple[int, list[str]]]]]:
    """For each template: label, its words of highest inverse document frequency (longer before shorter, then as they stand) with their offsets, and its key phrases with theirs."""
    split = {label: text.split() for label, (text, _) in templates.items()}
    idf = {w: math.log(len(split) / n) for w, n in Counter(w for ws in split.values() for w in set(ws)).items()}
    out = []
    for label, (_, phrases) in templates.items():
        ws = split[label]
        order = sorted(range(len(ws)), key=lambda i: (-idf[ws[i]], -len(ws[i]), i))
        keys = [(next(i for i in range(len(ws)) if ws[i : i + len(p)] == p), p) for p in map(str.split, phrases)]
        out.append((label, [(ws[i], i) for i in order[:rare]], keys))
    return out


def _stand_at(words: Column, start: Column, expected: list[str]) -> Column:
    out = F.lit(True)
    for j, w in enumerate(expected):
        out = out & F.coalesce(F.get(words, start + j) == w, F.lit(False))
    return out


def license_scan(docs: DataFrame, base: dict[str, str] = BASE, templates: dict[str, tuple[str, tuple[str, ...]]] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places of each row.

    n_base counts the places where a base phrase's words stand one after another; first_word and last_word are the
    smallest and largest start among them (null without any).  labels adds the templates' labels; places lists them with
    their starts (below zero where a text begins inside a template).  score is n / (n + 1) over the base places and template matches.  Null and empty texts have no word and
    no place; a null doc_id stays null; repeated rows are scanned one by one; an empty table gives no rows; further
    columns of ``docs`` are not read.
    """
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_low"))
    phrases = {tuple(p.split()): label for p, label in base.items()}
    index = template_index(templates)
    postings: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for t, (_, rare, _) in enumerate(index):
        for w, at in rare:
            postings[w].append((t, at))
    words = F.filter(F.split("_low", _SPLIT), lambda w: w != "")
    split = split.select("doc_id", words.alias("_words"))
    known = sorted({p[0] for p in phrases} | set(postings))
    hits = F.filter(F.transform("_words", lambda w, i: F.when(w.isin(known), F.struct(w.alias("w"), i.alias("i")))), lambda h: h.isNotNull())
    split = split.select("doc_id", "_words", hits.alias("_hits"))

    def base_label(h: Column) -> Column:
        out = F.lit(None).cast("string")
        for p, label in phrases.items():
            out = F.when((h["w"] == p[0]) & _stand_at(F.col("_words"), h["i"], list(p)), F.lit(label)).otherwise(out)
        return out

    text = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    array = lambda own: f"array({', '.join(own)})"
    posted = F.expr(f"map({', '.join(f'{text(w)}, ' + array(f'struct({t} as t, {at} as at)' for t, at in own) for w, own in sorted(postings.items()))})")
    needed = F.expr(array(str(len(rare)) for _, rare, _ in index))
    labels = F.expr(array(text(label) for label, _, _ in index))
    keys = F.expr(array(array(f"struct({at + j} as at, {text(w)} as w)" for at, p in own for j, w in enumerate(p)) for _, _, own in index))
    nothing = F.array().cast("array<struct<t:int,at:int>>")
    proposed = F.flatten(F.transform("_hits", lambda h: F.transform(F.coalesce(F.try_element_at(posted, h["w"]), nothing), lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["at"]).alias("at")))))

    def agreed(s: Column) -> Column:
        """The first of each run of equal proposals that is as long as the template has rare words."""
        return F.filter(s, lambda x, i: (F.get(s, i + F.get(needed, x["t"]) - 1) == x) & F.coalesce(F.get(s, i - 1) != x, F.lit(True)))

    candidates = let(F.sort_array(proposed), agreed)
    matches = F.filter(candidates, lambda x: F.forall(F.get(keys, x["t"]), lambda k: F.coalesce(F.get(F.col("_words"), x["at"] + k["at"]) == k["w"], F.lit(False))))
    more = F.transform(matches, lambda x: F.struct(F.get(labels, x["t"]).alias("label"), x["at"].alias("at")))
    based = F.filter(F.transform("_hits", lambda h: F.struct(base_label(h).alias("label"), h["i"].alias("at"))), lambda x: x["label"].isNotNull())
    found = split.select("doc_id", F.size("_words").cast("long").alias("n_words"), based.alias("_base"), more.alias("_more"))
    n = F.size("_base") + F.size("_more")
    joined = lambda rows: F.array_join(F.sort_array(F.array_distinct(F.transform(rows, lambda x: x["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(F.transform("_base", lambda x: x["at"])).cast("long").alias("first_word"),
        F.array_max(F.transform("_base", lambda x: x["at"])).cast("long").alias("last_word"),
        joined(F.col("_base")).alias("base_labels"),
        joined(F.concat("_base", "_more")).alias("labels"),
        (n / (n + F.lit(HALF))).alias("score"),
        F.transform(F.sort_array(F.concat("_base", "_more")), lambda x: F.concat(x["label"], F.lit("@"), x["at"].cast("string"))).alias("places"),
    )
