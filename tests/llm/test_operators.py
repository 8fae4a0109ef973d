"""Each operator against SQL, a brute-force version, a round trip or held-out accuracy."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from passages.llm import decontamination, license_scan, packing, pii, queries, quality_rules, simhash_dedup, substring_dedup, token_counts
from tests.compare import DATA, spark_rows, sql_rows

SMALL = DATA / "sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert spark_rows(queries.queries()[name](spark, str(SMALL))) == sql_rows(queries.oracle_sql()[name], SMALL)


def texts_of(spark, folder=SMALL):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}


# --- 1: token counts

def test_token_counts_equal_a_unigram_tokenizer(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = queries.tokenizer_path("piece_bpe_32k.model")
    vocabulary = token_counts.unigram_vocabulary(path)
    tok = Tokenizer(models.Unigram([("<unk>", 0.0), *((f"<0x{b:02X}>", 0.0) for b in range(256)), *vocabulary], 0, True))
    tok.pre_tokenizer = pre_tokenizers.Metaspace("▁", "always", False)
    expected = {i: len(tok.encode(t).ids) if t else 0 for i, t in texts_of(spark).items()}
    got = {r["doc_id"]: r["n_tokens"] for r in queries.op1_token_counts(spark, str(SMALL)).collect()}
    assert got == expected


def test_equal_paths_keep_the_earlier_start_and_unknown_characters_count_bytes():
    counter = token_counts.ViterbiCounter([("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("▁aa", -3.0)])
    assert counter.text("aa") == (1, -3.0, 0)  # ▁aa, not ▁ + aa or ▁ + a + a
    assert counter.text("é")[0::2] == (3, 1)  # the mark and two bytes


# --- 2: licence scan

def test_license_labels_need_rare_words_and_key_phrases(spark):
    rows = [(1, "Released under the MIT License."), (2, "the licence of the MIT"), (3, "CC BY-NC 4.0 or cc/by; All Rights Reserved all rights reserved"), (4, None)]
    got = {r["doc_id"]: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1]["labels"], got[1]["n_base"], got[1]["first_word"]) == ("mit", 0, None)
    assert got[2]["labels"] == ""
    assert (got[3]["n_base"], got[3]["first_word"], got[3]["last_word"], got[3]["base_labels"]) == (4, 0, 11, "cc-by,reserved")
    assert "cc-by-nc" in got[3]["labels"]
    assert (got[4]["n_words"], got[4]["score"]) == (0, 0.0)


# --- 3 and 5: classifiers

def auc(score, label):
    rank = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    n1 = int((label == 1).sum())
    n0 = len(label) - n1
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n0 * n1)


@pytest.mark.parametrize(("name", "label", "least"), [("op3_quality_classifier", "quality", 0.95), ("op5_toxicity", "toxic", 0.85)])
def test_held_out_ranking(spark, name, label, least):
    folder = DATA / "sf0.01"
    got = queries.queries()[name](spark, str(folder)).collect()
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= (0.5 if label == "quality" else 0.7)) for r in got)
    out = [(r["score"], labels[r["doc_id"]]) for r in got if r["held_out"] and labels.get(r["doc_id"]) is not None]
    score, y = np.array(out).T
    assert auc(score, y) >= least


# --- 4: near duplicates

def slow_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = np.array([xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))


def slow_components(fps, radius=4):
    """Smallest id reachable by links; fps: id -> fingerprint."""
    ids, root = sorted(fps), {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= radius and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_near_duplicates_equal_all_pairs(spark):
    fps = {i: slow_fingerprint(t) for i, t in texts_of(spark).items()}
    label = slow_components(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op4_simhash_dedup(spark, str(SMALL)).collect()}
    assert got == {i: (f"{fps[i]:016x}", label[i]) for i in fps}


def test_split_shards_lose_no_link(spark):
    rng = np.random.default_rng(1)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 40, dtype=np.uint64)]
    for x in list(fps):  # a chain of neighbours for each, up to the radius apart
        for n in (1, 2, 4, 5):
            fps.append(x := x ^ sum(1 << int(b) for b in rng.choice(63, n, replace=False)))
    fps = sorted(set(fps))
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    roots = {r["node"]: r["root"] for r in simhash_dedup.components(simhash_dedup.near_links(df, tree_rows=8)).collect()}
    expected, got = defaultdict(set), defaultdict(set)
    for x, r in slow_components({x: x for x in fps}).items():
        expected[r].add(x)
    for x in fps:
        got[roots.get(x, x)].add(x)
    assert {frozenset(v) for v in got.values()} == {frozenset(v) for v in expected.values()}


# --- 6: personal data

def test_feistel_is_a_permutation():
    p = pii.Pseudonyms(b"k")
    for size in (2, 7, 100, 1000):
        assert sorted(p.permute(x, size, "t") for x in range(size)) == list(range(size))


def test_pseudonyms_keep_their_format_and_link_documents(spark):
    text = "Card 4111 1111 1111 1111, mail jo.doe7@example.org, born 1987-02-28, call 212-555-0187, host 10.1.2.3, iban GB82 WEST 1234 5698 7654 32."
    rows = [(1, text), (2, "again 4111 1111 1111 1111"), (3, "no 4111 1111 1111 1112 and 1987-02-30"), (4, None), (5, "")]
    got = {r["doc_id"]: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    new = got[1]["text"]
    assert (got[1]["n_finds"], got[1]["n_card"], got[1]["n_email"], got[1]["n_date"], got[1]["n_phone"], got[1]["n_ip"], got[1]["n_iban"]) == (6, 1, 1, 1, 1, 1, 1)
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", new)[0]
    assert card != "4111 1111 1111 1111" and pii._luhn(card.replace(" ", "")) == 0 and card in got[2]["text"]
    assert re.search(r"mail [a-z]{2}\.[a-z]{3}\d@[a-z]{7}\.org, born \d{4}-\d\d-\d\d, call [2-9]\d\d-[2-9]\d\d-\d{4}, host [\d.]+, iban GB\d\d ", new)
    assert got[3]["text"] == rows[2][1] and got[3]["n_finds"] == 0
    assert got[4]["text"] is None and got[5]["text"] == ""


def test_values_that_are_not_found_stay(spark):
    for i, t in texts_of(spark).items():
        new, counts = pii.Pseudonyms(b"k").text(t)
        assert len(re.findall(r"\S+", new)) == len(re.findall(r"\S+", t)), i
        assert counts or new == t


# --- 7: benchmark decontamination

def slow_matches(text, items, size=5, least=0.8):
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    shingles = lambda w: Counter(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))
    own, out = words(text), {}
    for item_id, item in items:
        w = words(item)
        if not w or not own or not set(shingles(w)) & set(shingles(own)) and len(w) >= size:
            continue
        best = None
        for s in range(max(1, len(own) - len(w) + 1)):
            a, b = shingles(own[s : s + len(w)]), shingles(w)
            both = sum((a & b).values())
            sim = both / (sum(a.values()) + sum(b.values()) - both)
            if sim >= least and (best is None or sim > best[1]):
                best = (s, sim)
        if best:
            out[item_id] = (best[0], min(len(w), len(own)), round(best[1], 9))
    return out


def test_contaminated_equals_all_windows(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    docs = dict(list(texts_of(spark).items())[:120])
    for k, (_, item) in enumerate(items[:12]):  # items with a word or two replaced, between other words
        w = item.split()
        w[len(w) // 2 : len(w) // 2 + k % 3] = ["otherword"] * (k % 3)
        docs[10_000 + k] = f"some words before {' '.join(w).upper()} and some after it"
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame([*items, (9_001, "short item"), (9_002, None), (9_003, "")], "item_id long, text string")
    got = defaultdict(dict)
    for r in decontamination.contaminated(df, bench, block_chars=4000).collect():
        got[r["doc_id"]][r["item_id"]] = (r["first_word"], r["n_words"], round(r["similarity"], 9))
    expected = {i: m for i, t in docs.items() if (m := slow_matches(t, [*items, (9_001, "short item")]))}
    assert got == expected


# --- 8: repeated windows

def test_repeats_against_brute_force(spark):
    rng = np.random.default_rng(5)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 50, n))
    passage = word(30)
    docs = [(i, f"{word(int(rng.integers(0, 40)))} {passage if i % 3 == 0 else ''}\t{word(9)}") for i in range(60)]
    docs += [(100, None), (101, ""), (None, passage), (102, docs[5][1]), (102, docs[5][1]), (103, " ".join(["same"] * 40))]
    first = {}
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
    for i, t in docs:
        if i is not None:
            w = split(t)
            for a in range(len(w) - 12):
                first[tuple(w[a : a + 13])] = min(i, first.get(tuple(w[a : a + 13]), i))
    expected = []
    for i, t in docs:
        w, gone = split(t), set()
        for a in range(len(w) - 12 if i is not None else 0):
            if first[tuple(w[a : a + 13])] < i:
                gone |= set(range(a, a + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        expected.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for options in ({}, {"batch_chars": 300, "slice_keys": 50}, {"batch_chars": 300, "bits_a_window": 0.01, "most_bits": 64}):
        got = [tuple(r) for r in substring_dedup.remove_repeats(df, digest=True, **options).collect()]
        assert Counter(got) == Counter(expected)


# --- 9: quality rules

def test_line_rules(spark):
    line, other = "A sentence with quite a few words that ends as it should.", "Another one says something else but ends in the same way!"
    rows = [(1, "\n".join(f"{line} {i}." for i in range(8))), (2, "\n".join(["Home", "About us", "Contact"] * 9)), (3, f"{line}\nHome | About | Contact | Help\n{other}"), (4, "few words"), (5, " ".join(["the same five words again"] * 30))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality_rules.quality_rules(df).collect()}
    assert got == {1: (True, False), 2: (True, False), 3: (False, True), 4: (True, False), 5: (True, False)}
    assert {r["doc_id"] for r in quality_rules.clean_lines(df).collect()} == {3}
    assert {r["doc_id"]: r["clean_text"] for r in quality_rules.cleaned_text(df).collect()}[3] == f"{line}\n{other}"


# --- 10: packing

def check_packing(rows, expected):
    """rows: pieces; expected: {doc_id: ids}."""
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for runs in by_sequence.values():
        at = 0
        for offset, length in sorted(runs):
            assert offset == at
            at += length
        assert at <= 4096
    assert set(by_doc) == set(expected)
    for i, pieces in by_doc.items():
        pieces.sort(key=lambda r: r["piece"])
        ids = np.array(expected[i], "<u4")
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert [r["start"] for r in pieces] == list(range(0, len(ids), 4096))
        for r in pieces:
            part = ids[r["start"] : r["start"] + 4096]
            assert (r["length"], r["ids_crc32"]) == (len(part), zlib.crc32(part.tobytes()))
    return len(by_sequence)


def test_words_in_use_are_split_once(monkeypatch):
    own, asked = packing.WordTokenizer(queries.tokenizer_path("word_bpe_49k.json"), most=50), []
    monkeypatch.setattr(own, "_word", lambda w, f=own._word: (asked.append(w), f(w))[1])
    common = [f"often{i}" for i in range(10)]
    for i in range(100):
        text = " ".join([*common, *(f"once{i}x{j}" for j in range(8))])
        assert own.encode(text) == np.array(own.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert all(asked.count(w) == 1 for w in common)
    assert len(own.words) + len(own.before) < 200


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    expected = {i: [*tok.encode(t, add_special_tokens=False).ids, 1] for i, t in texts_of(spark).items()}
    rows = queries.op10_packing(spark, str(SMALL)).collect()
    used = check_packing(rows, expected)
    assert used <= 1.05 * sum(map(len, expected.values())) / 4096 + 1


def test_word_by_word_tokens_equal_the_tokenizer():
    path = queries.tokenizer_path("word_bpe_49k.json")
    own = packing.WordTokenizer(path)
    for t in ("", " ", "It's 12.5% of x_y!", "ÀÉÎ naïve Straße ﬁ İstanbul", "a\tb c d\x0be", "<|endoftext|> <|x", "日本語 текст \U0001f600", "'ll 've é", "\x00 \x7f \x85 ​ ﻿"):
        assert np.frombuffer(own.encode(t), "<u4").tolist() == own.tok.encode(t, add_special_tokens=False).ids, t


def test_a_length_of_many_pieces_is_ranked_in_buckets(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.when(F.col("id") % 3 == 0, 4096).otherwise(1 + F.col("id") % 700).cast("long").alias("length"), F.col("id").alias("ids_crc32"))
    rows = packing.place_pieces(df, bucket_rows=100).collect()
    used, filled = defaultdict(int), defaultdict(list)
    for r in rows:
        used[r["sequence_id"]] += r["length"]
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    assert len(rows) == 3000 and max(used.values()) <= 4096
    for runs in filled.values():
        runs.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(runs, runs[1:], strict=False)) and runs[0][0] == 0
