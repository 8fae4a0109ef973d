"""One query for each operator, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from passages.llm import decontamination, license_scan, packing, pii, quality_classifier, quality_rules, simhash_dedup, substring_dedup, token_counts, toxicity
from passages.llm.common import read_table


def tokenizer_path(name: str) -> str:
    """Where the public tokenizers package keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(read_table(spark, sf_dir, "documents")).drop("places")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality_classifier.quality_scores(docs, quality_classifier.train_on(docs, read_table(spark, sf_dir, "labels")))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.train_on(docs, read_table(spark, sf_dir, "labels")))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(read_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents"), digest=True)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_token_counts, op2_license_scan, op3_quality_classifier, op4_simhash_dedup, op5_toxicity, op6_pii, op7_decontamination, op8_substring_dedup, op9_quality_rules, op10_packing)
    return {f.__name__: f for f in own}


def _sql_op2() -> str:
    """Base phrases by consecutive-word search; templates from their full texts: rarity, agreement on a start and key phrases are worked out in SQL."""
    base = license_scan.BASE
    text = lambda x: "'" + x.replace("'", "''") + "'"
    places = " union all ".join(f"select d.doc_id, d.i - 1 as pos, '{label}' as label from p d where " + " and ".join(f"d.w[d.i + {j}] = '{x}'" for j, x in enumerate(p.split())) for p, label in base.items())
    templates = ", ".join(f"({text(label)}, {text(words)})" for label, (words, _) in license_scan.TEMPLATES.items())
    phrases = ", ".join(f"({text(label)}, {text(p)})" for label, (_, own) in license_scan.TEMPLATES.items() for p in own)
    return rf"""
with t as (select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
p as (select r as doc_id, w, unnest(range(1, len(w) + 1)) as i from t),
x as (select doc_id, i - 1 as pos, w[i] as word from p),
tw as (select label, u.i - 1 as spot, string_split(words, ' ')[u.i] as word from (values {templates}) v(label, words), unnest(range(1, len(string_split(words, ' ')) + 1)) as u(i)),
df as (select word, count(distinct label) as n from tw group by word),
rare as (select label, spot, word from (select tw.*, row_number() over (partition by label order by n, length(word) desc, spot) as k from tw join df using (word)) where k <= {license_scan.RARE_WORDS}),
need as (select label, count(*) as n from rare group by label),
starts as (select x.doc_id, rare.label, x.pos - rare.spot as pos, count(*) as n from x join rare using (word) group by all),
phrase as (select label, string_split(phrase, ' ') as ws from (values {phrases}) v(label, phrase)),
texts as (select label, list(word order by spot) as ws from tw group by label),
placed as (select phrase.label, phrase.ws, min(u.i) - 1 as spot from phrase join texts using (label), unnest(range(1, len(texts.ws) + 1)) as u(i) where texts.ws[u.i:u.i + len(phrase.ws) - 1] = phrase.ws group by all),
more as (select s.doc_id, s.pos, s.label from starts s join need using (label) join t on t.r = s.doc_id where s.n = need.n
 and not exists (select 1 from placed where placed.label = s.label and (s.pos + placed.spot < 0 or t.w[s.pos + placed.spot + 1:s.pos + placed.spot + len(placed.ws)] <> placed.ws))),
base as ({places}),
b as (select doc_id, count(*) as n, min(pos) as f, max(pos) as l, string_agg(distinct label, ',' order by label) as labels from base group by doc_id),
a as (select doc_id, count(*) as n, string_agg(distinct label, ',' order by label) as labels from (select * from base union all select * from more) group by doc_id)
select t.doc_id, cast(len(t.w) as bigint) as n_words, cast(coalesce(b.n, 0) as bigint) as n_base, cast(b.f as bigint) as first_word, cast(b.l as bigint) as last_word,
 coalesce(b.labels, '') as base_labels, coalesce(a.labels, '') as labels, cast(coalesce(a.n, 0) as double) / (coalesce(a.n, 0) + {license_scan.HALF}) as score
from t left join b on b.doc_id = t.r left join a on a.doc_id = t.r"""


def _sql_op9() -> str:
    q = quality_rules
    ws = r"[\x20\x09-\x0D]"
    ends = q._ENDS.replace("'", "''")
    return rf"""
with t as (select doc_id, coalesce(text, '') as x, list_filter(regexp_split_to_array(coalesce(text, ''), '{ws}+'), lambda w: w <> '') as w,
 list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines from documents),
v as (select doc_id, unnest(range(1, len(w) - {q.WINDOW - 2})) as i, w from t where len(w) >= {q.WINDOW}),
g as (select doc_id, i, count(*) over (partition by doc_id, array_to_string(w[i:i + {q.WINDOW - 1}], ' ')) as n from v),
c as (select doc_id, count(distinct i + k) as n from g, unnest(range(0, {q.WINDOW})) as u(k) where n > 1 group by doc_id),
s as (select doc_id, list_filter(lines, lambda l: not (
 10 * len(regexp_extract_all(l, '[#*$%&|<>]')) > length(l)
 or (length(l) < {40 * q.SHORT_LINE} and strpos('{ends}', right(rtrim(l, ' '), 1)) = 0 and len(list_filter(regexp_split_to_array(l, '{ws}+'), lambda w: w <> '')) < {q.SHORT_LINE})
 or len(regexp_extract_all(l, '[|»›•·]')) >= 3
 or (length(l) < 120 and regexp_matches(l, '{q.BOILERPLATE}')))) as kept from t),
m as (select t.doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars, cast(len(regexp_extract_all(x, '[#*$%&|<>]')) as bigint) as n_symbols,
 cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(coalesce(c.n, 0) as bigint) as n_repeat_words,
 coalesce(list_sum(list_transform(lines, lambda l: length(l))), 0) * {1 - q.MOST_LOST} > coalesce(list_sum(list_transform(s.kept, lambda l: length(l))), 0) as lost
 from t left join c using (doc_id) join s using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < {q.LEAST_WORDS} or 100 * n_repeat_words > {q.MOST_REPEATED} * n_words) as base_failed,
 not (n_words < {q.LEAST_WORDS} or 100 * n_repeat_words > {q.MOST_REPEATED} * n_words) and not lost as kept from m"""


def _sql_op8() -> str:
    n = substring_dedup.WINDOW
    ws = r"[\x20\x09-\x0D]"
    return rf"""
with t as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{ws}+'), lambda x: x <> '') as w from documents),
v as (select doc_id, unnest(range(1, len(w) - {n - 2})) as i, w from t where len(w) >= {n}),
g as (select doc_id, i, min(doc_id) over (partition by array_to_string(w[i:i + {n - 1}], ' ')) as first from v),
c as (select distinct doc_id, i + k as i from g, unnest(range(0, {n})) as u(k) where first < doc_id),
p as (select t.doc_id, u.i, t.w[u.i] as x from t, unnest(range(1, len(w) + 1)) as u(i)),
k as (select p.doc_id, string_agg(p.x, ' ' order by p.i) as kept, count(*) as n from p anti join c on p.doc_id = c.doc_id and p.i = c.i group by p.doc_id)
select t.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(k.n, 0) as bigint) as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256 from t left join k using (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": _sql_op2(), "op8_substring_dedup": _sql_op8(), "op9_quality_rules": _sql_op9()}
