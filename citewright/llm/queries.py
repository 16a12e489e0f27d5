"""The operators over the given tables, as registered queries, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from citewright.llm import (
    bpe,
    contamination,
    jaccard,
    language,
    neighbours,
    quality,
    reputation,
    runs,
    spans,
    spelling,
    stripes,
    warc,
    word_bpe,
)

Query = Callable[[SparkSession, str], DataFrame]

PIECES = "piece_bpe_32k.model"
RANKS = "byte_bpe_50k.tiktoken"
WORDS = "word_bpe_49k.json"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page, written to archives and read back."""
    return warc.archived(_table(spark, folder, "pages"))


OP1_SQL = """
with sized as (
    select page_id, coalesce(html, '') as payload, strlen(coalesce(html, '')) as size from pages
), kept as (
    select *, max(page_id) over (partition by payload) as largest from sized
)
select page_id, size::bigint as payload_bytes, sha1(payload) as payload_digest,
       case when size >= 1000 and page_id <> largest then 'revisit' else 'response' end as record_type,
       case when size >= 1000 and page_id <> largest then largest end as refers_to
from kept
"""


def op2_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return jaccard.near_duplicates(_table(spark, folder, "documents"))


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    """How good every document is, by its text and by where it stands."""
    return quality.judged(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op4_hilbert_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one, among all."""
    return neighbours.nearest(_table(spark, folder, "embeddings"), F.col("id") % 100 == 0)


URL_RULES = (
    reputation.Rule("block", "net", "/"),
    reputation.Rule("allow", "example.net", "/en/"),
    reputation.Rule("block", "example.com", "/de/"),
    reputation.Rule("allow", "org", "/fr/"),
)


def op5_url_reputation(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's address, judged by a rule or by its host's reputation."""
    pages, labels = _table(spark, folder, "pages"), _table(spark, folder, "labels")
    found = reputation.judged(pages, labels, URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = """
with split as (
    select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), parts as (
    select page_id, regexp_extract(rest, '^([^/?#]*)', 1) as raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from split
), addresses as (
    select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from parts
), hosts as (
    select host, count(*) filter (quality is not null and toxic is not null) as n,
           count(*) filter (quality = 1 and toxic = 0) as good, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') as names
    from addresses left join labels on page_id = doc_id group by host
), ends as (
    select *, case when len(names) > 1 and length(names[-1]) = 2
                    and names[-2] in ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') then 2 else 1 end as k from hosts
), levels as (
    select host, n, good, array_to_string(names[greatest(len(names) - k, 1) :], '.') as domain,
           array_to_string(names[len(names) - k + 1 :], '.') as suffix from ends
), overall as (
    select (sum(good) + 1.0) / (sum(n) + 2) as p from levels
), s as (
    select suffix, sum(n) as n, sum(good) as good, any_value(p) as prior from levels, overall group by suffix
), s_share as (
    select sum(pow(good - n * prior, 2) / n - prior * (1 - prior)) / nullif(sum(prior * (1 - prior) * (n - 1)), 0) as r from s where n > 0
), s_strength as (
    select case when coalesce(r, 1) > 0 then least(10000.0, greatest(1.0, 1 / coalesce(r, 1) - 1)) else 10000.0 end as m from s_share
), s_mean as (
    select suffix, (good + m * prior) / (n + m) as mean from s, s_strength
), d as (
    select domain, sum(n) as n, sum(good) as good, any_value(mean) as prior from levels join s_mean using (suffix) group by domain
), d_share as (
    select sum(pow(good - n * prior, 2) / n - prior * (1 - prior)) / nullif(sum(prior * (1 - prior) * (n - 1)), 0) as r from d where n > 0
), d_strength as (
    select case when coalesce(r, 1) > 0 then least(10000.0, greatest(1.0, 1 / coalesce(r, 1) - 1)) else 10000.0 end as m from d_share
), d_mean as (
    select domain, (good + m * prior) / (n + m) as mean from d, d_strength
), h as (
    select host, n, good, mean as prior from levels join d_mean using (domain)
), h_share as (
    select sum(pow(good - n * prior, 2) / n - prior * (1 - prior)) / nullif(sum(prior * (1 - prior) * (n - 1)), 0) as r from h where n > 0
), h_strength as (
    select case when coalesce(r, 1) > 0 then least(10000.0, greatest(1.0, 1 / coalesce(r, 1) - 1)) else 10000.0 end as m from h_share
), h_mean as (
    select host, (good + m * prior) / (n + m) as mean, n + m + 1 as size from h, h_strength
), judged as (
    select page_id, host, path, mean - 1.645 * sqrt(mean * (1 - mean) / size) as bound,
           case when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
                when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
                when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
                when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule
    from addresses join h_mean using (host)
)
select page_id, host, path, rule,
       case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null then 'block'
            when bound >= 0.5 then 'allow' else 'block' end as verdict
from judged
"""


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from three quarters of them."""
    return language.predict(_table(spark, folder, "documents"), public_tokenizers.path(PIECES))


def op7_run_index_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the 100-byte strings that also start earlier."""
    return runs.remove_repeated(_table(spark, folder, "documents")).drop("kept")


def op8_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts and digests of every document, encoded and decoded again."""
    ranks = public_tokenizers.path(RANKS)
    return bpe.token_digests(_table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN, by_words=True)


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items of which a document contains four fifths of the five-word shingles."""
    return contamination.contained(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


OP9_SQL = r"""
with item_words as (
    select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from benchmark
), wanted as (
    select distinct item_id, array_to_string(w[i : i + 4], ' ') as shingle
    from item_words, unnest(range(1, greatest(len(w) - 3, 2))) as t(i) where len(w) > 0
), doc_words as (
    select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents
), lengths as (
    select distinct len(w) as k from item_words where len(w) between 1 and 4
), shingles as (
    select doc_id, array_to_string(w[i : i + 4], ' ') as shingle
    from doc_words, unnest(range(1, greatest(len(w) - 3, 2))) as t(i) where len(w) > 0
    union
    select doc_id, array_to_string(w[i : i + k - 1], ' ')
    from doc_words, lengths, unnest(range(1, greatest(len(w) - k + 2, 1))) as t(i)
), sizes as (
    select item_id, count(*) as n from wanted group by 1
)
select doc_id, item_id, any_value(n)::bigint as n_shingles, count(*)::bigint as n_shared
from shingles join wanted using (shingle) join sizes using (item_id)
group by 1, 2 having count(*) >= ceil(any_value(n) * 80 / 100.0)
"""


def op10_span_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the 50-word windows that an earlier one has."""
    found = spans.remove_repeated(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


OP10_SQL = r"""
with words as (
    select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
    from documents
), windows as (
    select doc_id, w, i, array_to_string(w[i : i + 49], ' ') as win
    from words, unnest(range(1, len(w) - 48)) as t(i)
), firsts as (
    select md5(win) as h, min(doc_id) as least from windows group by 1
), marked as (
    select doc_id, i from windows join firsts on md5(win) = h where doc_id > least
), removed as (
    select distinct doc_id, i + k as place from marked, unnest(range(50)) as t(k)
), gone as (
    select doc_id, list(place) as places from removed group by 1
)
select doc_id, len(w)::bigint as n_words, coalesce(len(places), 0)::bigint as n_removed,
       sha256(coalesce(array_to_string(list_filter(w, lambda x, i: places is null or not list_contains(places, i)), ' '), '')) as kept_sha256
from words left join gone using (doc_id)
"""


def op11_word_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts and digests of every document under a vocabulary with word ends."""
    return word_bpe.token_digests(_table(spark, folder, "documents"), public_tokenizers.path(WORDS))


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Every word with the more frequent word it is a variant of."""
    return spelling.grouped(_table(spark, folder, "documents"))


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """How far the sources of a language are from each other, and by which terms."""
    return stripes.audited(_table(spark, folder, "documents"))


OP13_SQL = r"""
with docs as (
    select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
    from documents
), occurrences as (
    select r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs
), kept as (
    select lang, term, count(*)::hugeint as n from occurrences group by all having count(distinct r) >= 10
), langs as (
    select lang, sum(n)::hugeint as total, count(*)::hugeint as v from kept group by all
), groups as (
    select distinct lang, source from docs
), counted as (
    select lang, source, term, count(*)::hugeint as n from occurrences semi join kept using (lang, term) group by all
), totals as (
    select lang, source, coalesce(sum(n), 0)::hugeint as total from groups left join counted using (lang, source) group by all
), rates as (
    select lang, source, term, coalesce(c.n, 0) as n,
           1 + 1000000000 * (coalesce(c.n, 0) + 2) // (t.total + 2 * l.v) as p,
           1 + 1000000000 * (k.n + 2) // (l.total + 2 * l.v) as q
    from totals t join kept k using (lang) join langs l using (lang) left join counted c using (lang, source, term)
), pairs as (
    select lang, a.source, b.source as item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) as value
    from groups a join groups b using (lang) left join rates x on x.lang = lang and x.source = a.source
    left join rates y on y.lang = lang and y.source = b.source and y.term = x.term
    where a.source <> b.source group by all
), terms as (
    select lang, source, term as item, (p - q) * (p - q) // (p + q) as value from rates where n > 0 and p > q
), ranked as (
    select lang, source, 'pair' as part, item, value,
           row_number() over (partition by lang, source order by value desc, item) as rank from pairs
    union all
    select lang, source, 'term', item, value,
           row_number() over (partition by lang, source order by value desc, item) as rank from terms
)
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= 10
"""


def registered() -> dict[str, Query]:
    return {
        "op1_warc": op1_warc,
        "op2_jaccard_join": op2_jaccard_join,
        "op3_quality": op3_quality,
        "op4_hilbert_neighbours": op4_hilbert_neighbours,
        "op5_url_reputation": op5_url_reputation,
        "op6_language_id": op6_language_id,
        "op7_run_index_dedup": op7_run_index_dedup,
        "op8_byte_bpe": op8_byte_bpe,
        "op9_decontamination": op9_decontamination,
        "op10_span_dedup": op10_span_dedup,
        "op11_word_bpe": op11_word_bpe,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_source_divergence": op13_source_divergence,
        "pipeline": corpus_pipeline.run,
    }


def statements() -> dict[str, str]:
    return {
        "op1_warc": OP1_SQL,
        "op5_url_reputation": OP5_SQL,
        "op9_decontamination": OP9_SQL,
        "op10_span_dedup": OP10_SQL,
        "op13_source_divergence": OP13_SQL,
    }
