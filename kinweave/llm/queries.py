"""The queries ``opN_<name>`` over the driver's tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .audio import audio_matches
from .common import table
from .exact_dedup import exact_dedup
from .minhash import near_duplicates
from .mixing import curriculum
from .quality import quality
from .segmentation import segment
from .token_counts import token_counts
from .toxicity import toxicity
from .url_filters import url_filter
from .warc import archive_and_read

# Fixed values of the query's contract: host, path, verdict.
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumn("evidence", F.transform("evidence", lambda e: e["doc_id"]))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library's encoding of each whole text, checked by decoding, and two sampled segmentations, all with their ids and the crc32 of these."""
    return segment(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_sample_ids=True)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``position`` is the training time of the first taken word in millionths of the whole, rounded down."""
    found = curriculum(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", F.floor(F.col("position") * 1e6).cast("long").alias("position"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments of all recordings with those whose id is divisible by 100."""
    return audio_matches(spark, sf_dir)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_and_read(table(spark, sf_dir, "pages"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("select * from values " + ", ".join(map(str, URL_RULES)) + " as t(host, path, verdict)")
    return url_filter(table(spark, sf_dir, "pages"), rules)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_sentencepiece, op3_mixing, op4_quality, op5_audio, op6_token_counts, op7_warc, op8_minhash, op9_url_filters, op10_exact_dedup)}

SQL = {
    "op3_mixing": r"""
with recursive one as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5(coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) as h
  from documents
), run as (
  select *, (sum(size) over (partition by source order by h, doc_id, size rows unbounded preceding))::bigint - size as start
  from one
), sizes as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source asc nulls last) - 1 as place
  from one group by source
), caps as (
  select *, 1 + place % 3 as weight, 3 * source_size as cap, row_number() over (order by (3 * source_size)::double / (1 + place % 3), place) as turn
  from sizes
), total as (select sum(source_size)::bigint as total, count(*) as n from sizes),
fill(turn, left_words, left_weight) as (
  select 0::bigint, (select total from total), (select sum(weight)::bigint from caps)
  union all
  select c.turn::bigint, (f.left_words - c.cap)::bigint, (f.left_weight - c.weight)::bigint
  from fill f join caps c on c.turn = f.turn + 1
  where c.cap::double < f.left_words::double / f.left_weight::double * c.weight
), last as (select * from fill order by turn desc limit 1),
targets as (
  select c.source, c.source_size, c.place,
         case when c.turn <= l.turn then c.cap::double
              else least(l.left_words::double / l.left_weight::double * c.weight, c.cap::double) end as target
  from caps c cross join last l
)
select r.doc_id, r.size, t.source_size, t.target,
       (greatest(0, least(r.size, floor(t.target)::bigint - r.start))
        + greatest(0, least(r.size, floor(t.target)::bigint - t.source_size - r.start))
        + greatest(0, least(r.size, floor(t.target)::bigint - 2 * t.source_size - r.start)))::bigint as taken,
       case when least(r.size, floor(t.target)::bigint - r.start) > 0 then floor(1e6 * case t.place % 3
         when 0 then 2 * (r.start / t.target) / (1.5 + sqrt(greatest(2.25 - 2 * (r.start / t.target), 0)))
         when 1 then r.start / t.target
         when 2 then case when r.start / t.target < 0.3125 then 2 * (r.start / t.target) / (0.5 + sqrt(0.25 + (r.start / t.target)))
                          else 0.5 + 2 * (r.start / t.target - 0.3125) / (0.75 + sqrt(0.5625 + 5 * (r.start / t.target - 0.3125))) end
         end)::bigint end as position
from run r join targets t on r.source is not distinct from t.source
""",
    "op7_warc": r"""
with p as (select page_id, coalesce(html, '') as payload from pages),
q as (select page_id, payload, strlen(payload)::bigint as payload_bytes, max(page_id) over (partition by payload) as first_id from p)
select page_id, payload_bytes, sha1(payload) as payload_digest,
       case when payload_bytes >= 1000 and page_id <> first_id then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id <> first_id then first_id end as refers_to
from q
""",
    "op8_minhash": r"""
with recursive lists as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), sets as (
  select doc_id,
         case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
              else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s
  from lists
), rows as materialized (select doc_id, len(s) as n, unnest(s) as shingle from sets),
pairs as (
  select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as common
  from rows a join rows b on a.shingle = b.shingle and a.doc_id < b.doc_id
  where 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id
), links as materialized (
  select a, b from pairs where 100 * common >= 85 * (na + nb - common)
  union all select b, a from pairs where 100 * common >= 85 * (na + nb - common)
), reach(doc_id, other) as (
  select doc_id, doc_id from documents
  union
  select r.doc_id, l.b from reach r join links l on r.other = l.a
)
select s.doc_id, len(s.s)::bigint as n_shingles, min(r.other) as component_id, s.doc_id = min(r.other) as kept
from sets s join reach r using (doc_id)
group by s.doc_id, s.s
""",
    "op9_url_filters": r"""
with parts as (
  select page_id,
         case when url is null or strpos(url, '://') = 0 then '' else substr(url, strpos(url, '://') + 3) end as rest
  from pages
), split as (
  select page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from parts
), rules(r_host, r_path, r_verdict) as (
  values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fits as (
  select page_id, host, path, r_host || r_path as rule, r_verdict,
         row_number() over (partition by page_id order by length(r_host || r_path) desc, length(r_host) desc) as place
  from split join rules on (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path)
)
select s.page_id, s.host, s.path, f.rule, coalesce(f.r_verdict, 'allow') as verdict
from split s left join fits f on s.page_id = f.page_id and f.place = 1
""",
    "op10_exact_dedup": r"""
select doc_id,
       max(doc_id) over (partition by coalesce(text, '')) as keep_id,
       count(*) over (partition by coalesce(text, '')) as group_size,
       doc_id = max(doc_id) over (partition by coalesce(text, '')) as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents
""",
}
