"""Registered queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm import (
    collocations,
    decontaminate,
    host_reputation,
    jaccard_join,
    line_templates,
    pii_spans,
    planes,
    pseudo_likelihood,
    repetition,
    rule_ensemble,
    sentencepiece_unigram,
    stratified_index,
    warc_chunks,
)
from churnlens.sources.tables import table


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; the library is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.col("n_shingles").cast("bigint").alias("n_shingles"), "component_id")


def op3_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_unigram.encode_documents(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome of a page is the quality label of its id."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("bigint").alias("page_id"), F.col("quality").alias("good"))
    return host_reputation.url_verdicts(table(spark, sf_dir, "pages"), outcomes)


def op7_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality_rules(table(spark, sf_dir, "documents"))


def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.drop_templates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans.personal_data(table(spark, sf_dir, "documents"))


def op10_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.token_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op11_stratified_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_index.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_chunks.archive_pages(table(spark, sf_dir, "pages"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_rule_ensemble, op2_jaccard_join, op3_pseudo_likelihood, op4_sentencepiece, op5_decontaminate,
    op6_host_reputation, op7_repetition, op8_line_templates, op9_pii_spans, op10_planes,
    op11_stratified_index, op12_warc_chunks, op13_collocations)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE_WORDS = "list_filter(string_split_regex({}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

ORACLE = {
    "op2_jaccard_join": f"""
with recursive w as (
  select doc_id, {_SPACE_WORDS.format(_LOWER.format("coalesce(text, '')"))} as words from documents),
s as (
  select doc_id, unnest(list_distinct(case when len(words) = 0 then []::varchar[][] when len(words) < 5 then [words]
    else list_transform(generate_series(1, len(words) - 4), lambda k: words[k:k + 4]) end)) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
t as (select doc_id, md5(array_to_string(g, chr(1))) as g from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from t a join t b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id as node, doc_id as seen from documents union select r.node, e.b from r join e on r.seen = e.a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id from documents d left join n using (doc_id)
join (select node, min(seen) as component_id from r group by node) c on c.node = d.doc_id""",
    "op5_decontaminate": f"""
with w as (
  select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from documents),
i as (
  select item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from benchmark),
g as (
  select item_id, least(len(words), 13) as size, unnest(list_transform(generate_series(1, greatest(len(words) - 12, 1)), lambda k: array_to_string(words[k:k + 12], ' '))) as phrase
  from i where len(words) > 0),
z as (select distinct size from g),
c as (
  select doc_id, size, unnest(generate_series(1, len(words) - size + 1)) as pos, words from w, z where len(words) >= size),
h as (
  select c.doc_id, c.pos, c.size, g.item_id from c join g on g.size = c.size and array_to_string(c.words[c.pos:c.pos + c.size - 1], ' ') = g.phrase),
x as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(generate_series(pos, pos + size - 1)) as k from h) group by doc_id),
y as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from h) group by doc_id)
select w.doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(words) as contaminated
from w left join x using (doc_id) left join y using (doc_id)""",
    "op6_host_reputation": """
with u as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
p as (
  select page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from u),
o as (select doc_id as page_id, max(quality) as good from labels where quality is not null group by 1),
b as (
  select host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') as bare, count(good)::double as n, coalesce(sum(good), 0)::double as good
  from p left join o using (page_id) group by host),
h as (
  select host, n, good, array_to_string(string_split(bare, '.')[-2:], '.') as domain, string_split(bare, '.')[-1] as suffix from b),
a as (select coalesce(sum(good) / nullif(sum(n), 0), 1.0) as m from h),
s0 as (select suffix, sum(n) as n, sum(good) as good, any_value(m) as m from h, a group by suffix),
sk as (select 1 / least(greatest(coalesce(sum((good - n * m) * (good - n * m) - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0), 0.001), 0.5) - 1 as k from s0),
s1 as (select suffix, (good + k * m) / (n + k) as m from s0, sk),
d0 as (select domain, any_value(m) as m, sum(n) as n, sum(good) as good from h join s1 using (suffix) group by domain),
dk as (select 1 / least(greatest(coalesce(sum((good - n * m) * (good - n * m) - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0), 0.001), 0.5) - 1 as k from d0),
d1 as (select domain, (good + k * m) / (n + k) as m from d0, dk),
h0 as (select host, n, good, m from h join d1 using (domain)),
hk as (select 1 / least(greatest(coalesce(sum((good - n * m) * (good - n * m) - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0), 0.001), 0.5) - 1 as k from h0),
h1 as (select host, (good + k * m) / (n + k) as m, n + k as weight from h0, hk),
r as (select host, m + 1.645 * sqrt(m * (1 - m) / (weight + 1)) < 0.5 as bad from h1),
f as (
  select page_id, host, path, bad,
    case when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/es/') then 'example.org/es/'
      when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/en/1') then 'example.org/en/1'
      when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/fr/') then 'com/fr/'
      when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/de/') then 'com/de/'
      when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/') then 'org/' end as rule
  from p join r using (host))
select page_id, host, path, rule, case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block' when bad then 'block' else 'allow' end as verdict from f""",
    "op11_stratified_index": f"""
with d as (
  select doc_id, row_number() over () as row, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from documents),
s as (select count(*)::hugeint as docs, sum(len(words))::hugeint as words from d where len(words) > 0),
p as (select row, any_value(doc_id) as doc_id, term, count(*) as tf, any_value(n) as n from (select row, doc_id, len(words) as n, unnest(words) as term from d) group by row, term),
f as (select term, floor(1000 * ln((2 * any_value(s.docs)::double + 2) / (2 * count(*) + 1)))::bigint as w from p, s group by term),
i as (select item_id, term, count(*) as times from (
  select item_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) as term from benchmark) group by 1, 2),
x as (
  select item_id, row, any_value(doc_id) as doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * s.docs) // s.words))))::bigint as score
  from i join f using (term) join p using (term), s group by item_id, row),
r as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from x where score > 0)
select item_id, rank::integer as rank, doc_id, score from r where rank <= 20""",
    "op12_warc_chunks": """
with p as (select page_id, coalesce(html, '') as html from pages),
f as (select html, min(page_id) as first from p where strlen(html) >= 100 group by html)
select p.page_id, strlen(p.html)::bigint as payload_bytes, sha256(p.html) as payload_digest,
  case when f.first < p.page_id then 'revisit' else 'response' end as record_type,
  case when f.first < p.page_id then f.first end as refers_to
from p left join f using (html)""",
    "op13_collocations": f"""
with p as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
w as (select lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') as words from p),
n as (select lang, sum(len(words))::bigint as n from w group by lang),
s as (select lang, words, unnest([1, 2, 3, 4]) as k from w),
g as (
  select lang, k, unnest(list_transform(generate_series(1, len(words) - k + 1), lambda i: array_to_string(words[i:i + k - 1], ' '))) as phrase
  from s where len(words) >= k),
f as (select lang, k, phrase, count(*) as f from g group by lang, k, phrase having count(*) >= 30),
c as (select lang, k, phrase, f, string_split(phrase, ' ') as words from f where k >= 2),
i as (select lang, f, k, words, unnest(generate_series(2, k - 1)) as size from c where k > 2),
j as (select lang, f, words, size, unnest(generate_series(1, k - size + 1)) as pos from i),
b as (select lang, array_to_string(words[pos:pos + size - 1], ' ') as phrase, max(f) as longer from j group by 1, 2),
x as (
  select c.lang, c.phrase, c.f as a, c.words, unnest(generate_series(1, c.k - 1)) as cut
  from c left join b on b.lang = c.lang and b.phrase = c.phrase where longer is null or 100 * longer < 80 * c.f),
y as (
  select x.lang, x.phrase, x.a, x.cut, l.f as l, r.f as r, ((2000000::hugeint * x.a) // (l.f + r.f))::bigint as score
  from x join f l on l.lang = x.lang and l.phrase = array_to_string(x.words[1:x.cut], ' ')
  join f r on r.lang = x.lang and r.phrase = array_to_string(x.words[x.cut + 1:], ' ')),
z as (select *, row_number() over (partition by lang, phrase order by score, cut) as nth from y),
o as (select lang, phrase, a, l, r, score, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from z where nth = 1)
select o.lang, rank, phrase, a, l, r, n, score from o join n using (lang) where rank <= 2000""",
}
