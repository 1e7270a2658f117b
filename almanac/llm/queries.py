"""Queries of the training-data operators: (spark, sf_dir) -> DataFrame, with production parameters
over whole tables; and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from almanac.llm import byte_bpe, exact_dedup, hyperdim, jaccard_join, license_scan, maxent, packing, recompression, repetition, spelling, token_files, warc_revisits, whitening
from almanac.llm.util import documents


def op1_packing_nnls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc_revisits.resolve(warc_revisits.records_of_pages(pages))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir)).drop("spans")


def op6_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality(documents(spark, sf_dir))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(documents(spark, sf_dir))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.removed(documents(spark, sf_dir))


def op10_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperdim.identify(documents(spark, sf_dir))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op13_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(documents(spark, sf_dir))


OP2_SQL = """
with t as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as s
  from documents
)
select doc_id, max(doc_id) over (partition by s) as keep_id, count(*) over (partition by s) as group_size,
       doc_id = max(doc_id) over (partition by s) as kept, s as text_sha256
from t
"""

#: From the definition: what a revisit was derived from decides its outcome.
OP3_SQL = r"""
with p as (
  select page_id as k, md5(coalesce(html, '')) as h,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as bare
  from pages
), q as (
  select k, h, regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www\.', '') as host,
         regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') as path,
         list_sort(list_filter(string_split(regexp_extract(bare, '^[^?]*\?(.*)$', 1), '&'),
           lambda x: x <> '' and not regexp_matches(x, '^(ref|fbclid|gclid|utm_[a-z]+)(=|$)'))) as params
  from p
), u as (
  select k, h, host || path || case when len(params) > 0 then '?' || array_to_string(params, '&') else '' end as url,
         'day ' || cast(k // 1440 + 1 as varchar) as day
  from q
), full_ as (
  select 3 * k as id, url, 60 * k as t, h as tag, day from u
  union all
  select 3 * k + 1, url, 60 * k + 43200, md5(h || '2'), day from u where k % 3 = 0
), r as (
  select 3 * k + 2 as id, k, url, 60 * k + 86400 as t, day,
         case when k % 5 = 0 then 'other' when k % 3 = 0 then md5(h || '2') else h end as sent
  from u where url is not null
), m as (
  select r.*, f.id as fid, f.tag as ftag, f.day as fday,
         row_number() over (partition by r.id order by f.t desc, f.id desc) as n
  from r left join full_ f on f.url = r.url and f.t < r.t
), o as (
  select *, case when fid is null then 'no_response'
                 when k % 11 = 0 then 'no_validator'
                 when k % 7 = 0 then case when day = fday then 'resolved' else 'stale_validator' end
                 when sent = ftag then 'resolved' else 'stale_validator' end as outcome
  from m where n = 1
)
select id as record_id, url as canonical_url, fid as response_id, outcome,
       case when outcome = 'resolved' then
              'cache-control: no-cache' || chr(10) || 'content-type: text/html' || chr(10) || 'date: later' || chr(10)
              || 'etag: ' || case when k % 7 = 0 then '"' || ftag || '"' else 'W/"' || sent || '"' end || chr(10)
              || 'http-version: 1.1' || chr(10) || 'last-modified: ' || fday
            else
              'cache-control: no-cache' || chr(10) || 'content-length: 0' || chr(10) || 'date: later'
              || case when k % 11 = 0 then '' when k % 7 = 0 then chr(10) || 'last-modified: ' || day
                      else chr(10) || 'etag: W/"' || sent || '"' end
       end as headers,
       case when outcome = 'resolved' then ftag end as payload_digest
from o
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_packing_nnls, op2_exact_dedup, op3_warc_revisits, op4_token_files, op5_license_scan,
        op6_repetition_rules, op7_jaccard_join, op8_byte_bpe, op9_recompression, op10_hyperdimensional_language,
        op11_whitening, op12_spelling_variants, op13_maxent_scores,
    )
}
ORACLES: dict[str, str] = {"op2_exact_dedup": OP2_SQL, "op3_warc_revisits": OP3_SQL}
