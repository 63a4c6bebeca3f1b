"""The queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe, ctw, fingerprint, langid, line_dedup, minhash, packing, token_counts, topk, warc
from .common import read


def op1_bpe(spark, sf_dir):
    return bpe.encode_decode_digests(read(spark, sf_dir, "documents"))


def op2_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), percent=80, shingle=4)


def op3_language_id(spark, sf_dir):
    return langid.identify_documents(read(spark, sf_dir, "documents"))


def op4_warc(spark, sf_dir):
    return warc.pages_through_archives(read(spark, sf_dir, "pages"))


def op5_exact_top_k(spark, sf_dir):
    return topk.exact_top_k(read(spark, sf_dir, "embeddings"), k=20, query_step=20)


def op6_lm_score(spark, sf_dir):
    return ctw.score_documents(read(spark, sf_dir, "documents"))


def op7_token_counts(spark, sf_dir):
    return token_counts.token_counts(read(spark, sf_dir, "documents"), limit=512)


def op8_packing(spark, sf_dir):
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op9_line_dedup(spark, sf_dir):
    """Documents, their source taken as the host: what each keeps."""
    cleaned = line_dedup.drop_boilerplate(read(spark, sf_dir, "documents"), F.col("source"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op10_fingerprint(spark, sf_dir):
    return fingerprint.compare_with_next(read(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_bpe, op2_near_dedup, op3_language_id, op4_warc, op5_exact_top_k, op6_lm_score, op7_token_counts, op8_packing, op9_line_dedup, op10_fingerprint, pipeline)}

LINE_SQL = """
with lines as (
  select doc_id, source, coalesce(source, chr(1) || 'none') host, text, string_split(text, chr(10)) ls from documents),
total as (select host, count(*) pages from lines group by host),
each as (
  select host, l, count(*) n from (
    select host, unnest(list_distinct(list_filter(ls, lambda x: trim(translate(x, chr(9) || chr(13) || chr(12) || chr(11), '    ')) <> ''))) l from lines)
  group by host, l having count(*) >= 10),
boiler as (select e.host, list(e.l) bs from each e join total t using (host) where e.n > 0.1 * t.pages group by e.host),
kept as (
  select d.*, case when bs is null then ls else list_filter(ls, lambda x: trim(translate(x, chr(9) || chr(13) || chr(12) || chr(11), '    ')) = '' or not list_contains(bs, x)) end ks
  from lines d left join boiler b using (host)),
judged as (
  select *, coalesce(len(ks) < len(ls) and len(list_filter(ks, lambda x: trim(translate(x, chr(9) || chr(13) || chr(12) || chr(11), '    ')) <> '')) > 0, false) cut from kept)
select doc_id, coalesce(len(ls), 0)::bigint n_lines, case when cut then len(ls) - len(ks) else 0 end::bigint n_dropped,
  sha256(case when cut then array_to_string(ks, chr(10)) else text end) text_sha256
from judged
"""

TOP_K_SQL = """
with x as (
  select row_number() over () rid, vec_id, list_transform(embedding, lambda v: floor(64 * v::double)::bigint) q from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0),
s as (
  select a.rid, a.vec_id query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::bigint score
  from x a join x b on a.rid <> b.rid where a.vec_id % 20 = 0),
r as (select *, row_number() over (partition by rid order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20
"""

WARC_SQL = None  # base-32 digests: DuckDB has no such function

ORACLE_SQL = {"op9_line_dedup": LINE_SQL, "op5_exact_top_k": TOP_K_SQL}
