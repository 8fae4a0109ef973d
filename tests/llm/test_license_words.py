"""Rare words outside the key phrases decide too."""

import re

import numpy as np

from passages.llm import license_scan


def test_rare_words_outside_the_phrases_must_agree(spark):
    templates = license_scan.TEMPLATES
    rows = [(0, "These files were released into the public domain."), (1, "It was sold in source and binary forms."), (2, "Redistribution, in source and binary forms, with modification permitted")]
    labels = list(templates)
    rows += [(10 + i, f"some words; {templates[k][0].upper()}, more") for i, k in enumerate(labels)]
    got = {r["doc_id"]: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["labels"] for i in (0, 1, 2)] == ["", "", ""]
    for i, k in enumerate(labels):
        assert f"{k}@2" in got[10 + i]["places"]


def test_index_holds_the_rarest_words_of_the_whole_template():
    index = {label: [w for w, _ in rare] for label, rare, _ in license_scan.template_index()}
    assert "unencumbered" in index["unlicense"] and "redistribution" in index["bsd"] and index["cc-by-nc"][0] == "nc"


def scan(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["places"] for r in sorted(license_scan.license_scan(df).collect())]


def slow_places(text):
    """Every template at every start: all rare words and all key phrases in their places."""
    words, out = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()) if w], []
    for label, rare, keys in license_scan.template_index():
        for start in range(-len(words), len(words)):
            expected = [(i, w) for w, i in rare] + [(at + j, w) for at, p in keys for j, w in enumerate(p)]
            if all(0 <= start + i < len(words) and words[start + i] == w for i, w in expected):
                out.append(f"{label}@{start}")
    return sorted(out)


def test_the_intersection_decides_where_all_words_and_phrases_are_there(spark):
    """The key phrase stands whole and every rare word is in the text, but not where the template has it."""
    rare = {label: [w for w, _ in own] for label, own, _ in license_scan.template_index()}
    good = license_scan.TEMPLATES["bsd"][0]
    assert set(rare["bsd"]) <= set(good.split())
    moved = f"permitted modification without redistribution {' '.join(rare['bsd'])} and use in source and binary forms with"
    assert scan(spark, [good, moved]) == [["bsd@0"], []]


def test_places_equal_every_template_at_every_start(spark):
    rng = np.random.default_rng(4)
    templates = [t for t, _ in license_scan.TEMPLATES.values()]
    texts = []
    for _ in range(60):
        parts = []
        for k in rng.integers(0, len(templates), 5).tolist():
            w = templates[k].split()
            if rng.random() < 0.5:
                w[int(rng.integers(0, len(w)))] = "other"
            parts += [*w, *["filler"] * int(rng.integers(0, 3))]
        texts.append(" ".join(parts))
    base = set(license_scan.BASE.values())
    got = [[p for p in places if p.split("@")[0] not in base] for places in scan(spark, texts)]
    assert [sorted(x) for x in got] == [slow_places(t) for t in texts] and sum(map(len, got)) > 100


def test_many_hits_in_one_text_take_linear_time(spark):
    text = "Released under the MIT License. " * 20_000
    assert len(scan(spark, [text])[0]) == 20_000
