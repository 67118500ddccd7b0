"""Registered queries of this subpackage: name -> (Spark query, comparison SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgauge.llm import (
    exact_dedup, lang_id, lm_scoring, minhash_join, mixing, packing, pii, piece_sampling, token_store, vector_codes, warc, winnowing, word_runs,
)
from inkgauge.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op4_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.near_duplicates(table(spark, sf_dir, "documents"))


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.revisits_of_pages(table(spark, sf_dir, "pages"))


OP5_SQL = r"""
with base as (
  select page_id, url, coalesce(html, '') as html, substr(sha256(coalesce(html, '')), 1, 16) as tag,
    1700000000 + (page_id * 7919 % 100003) * 60 as seconds, regexp_replace(trim(url), '#.*$', '') as bare
  from pages
), split as (
  select *, regexp_extract(bare, '^(?i:https?)://(?:[^/?@]*@)?(.*)$', 1) as rest from base
), named as (
  select *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), ':(?:80|443)$', ''), '^www\.', '') as host,
    regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/$', '') as path,
    list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda p: p <> '' and not starts_with(p, 'utm_'))) as query
  from split
), pages_ as (
  select *, host || path || case when len(query) > 0 then '?' || array_to_string(query, '&') else '' end as address from named
), revisits as (
  select page_id, address, seconds + ((page_id * 31) % 5 - 1) * 3600 as at, page_id % 50 as day,
    case when page_id % 5 = 0 then null when page_id % 7 = 0 then 'changed' else tag end as tag, page_id % 35 <> 0 as dated
  from pages_ where page_id % 2 = 0
), matched as (
  select v.page_id, v.address, v.tag as vtag, v.day as vday, v.dated, r.page_id as rid, r.tag, r.page_id % 50 as rday, r.html,
    row_number() over (partition by v.page_id order by r.seconds desc nulls last, 'r' || r.page_id desc) as k
  from revisits v left join pages_ r on r.address = v.address and r.seconds < v.at
), judged as (
  select *, case when rid is null then 'no_response' when vtag is not null then case when vtag = tag then 'resolved' else 'mismatch' end
      when dated then case when vday = rday then 'resolved' else 'mismatch' end else 'unchecked' end as status,
    '"' || vtag || '"' as shown
  from matched where k = 1
)
select page_id, address, status, case when status in ('resolved', 'unchecked') then 'r' || rid end as response_id,
  case when status in ('resolved', 'unchecked') then
    'cache-control=max-age=' || page_id % 10 || ';content-length=' || octet_length(encode(html)) || ';content-type=text/html;etag=' ||
    case when vtag is not null then 'W/"' || vtag || '"' else '"' || tag || '"' end || ';last-modified=day ' || case when dated then vday else rday end || ';server=s9'
  else 'cache-control=max-age=' || page_id % 10 || ';connection=close;content-length=0' ||
    case when vtag is null then '' when vtag = 'changed' then ';etag="changed"' else ';etag=W/"' || vtag || '"' end ||
    case when dated then ';last-modified=day ' || vday else '' end || ';server=s9' end as headers,
  case when status in ('resolved', 'unchecked') then sha256(html) end as payload_sha256
from judged
"""


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.materialise(spark, table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op8_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.encode(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


OP9_SQL = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
  doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))
"""


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = winnowing.edited_fingerprints(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", winnowing.as_text(F.col("fingerprint")).alias("fingerprint"),
        winnowing.as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


def _op12_sql(rounds: int = vector_codes.ROUNDS, parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES) -> str:
    """Components as rows; every round joins each part with every entry of its codebook."""
    head = f"""
with kept as (
  select vec_id, label, embedding as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), flat as (
  select vec_id, cast(floor({vector_codes.SCALE} * cast(u.x as double)) as bigint) as v, u.d, cast(u.d // (u.n // {parts}) as int) as part
  from (select vec_id, unnest(list_transform(range(len(e)), lambda i: {{'x': e[i + 1], 'd': i, 'n': len(e)}})) as u from kept)
), book0 as (
  select part, d, k - 1 as entry, v from flat join (select vec_id, row_number() over (order by vec_id) as k from kept) using (vec_id) where k <= {entries}
)"""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""near{r} as (
  select vec_id, part, min({{'far': far, 'entry': entry}}) as best from (
    select f.vec_id, f.part, b.entry, sum((f.v - b.v) * (f.v - b.v)) as far from flat f join book{r} b on f.part = b.part and f.d = b.d group by all
  ) group by all
)""")
        if r < rounds:
            steps.append(f"""sums{r} as (
  select f.part, f.d, n.best.entry as entry, cast(sum(f.v) as bigint) as s, count(*) as c from flat f join near{r} n on f.vec_id = n.vec_id and f.part = n.part group by all
), book{r + 1} as (
  select b.part, b.d, b.entry, coalesce((s - ((s % c) + c) % c) // c, b.v) as v from book{r} b left join sums{r} m on b.part = m.part and b.d = m.d and b.entry = m.entry
)""")
    return f"""{head}, {", ".join(steps)}, coded as (
  select vec_id, label, string_agg(printf('%02x', cast(best.entry as int)), '' order by part) as code, cast(sum(best.far) as bigint) as error
  from near{rounds} join kept using (vec_id) group by all
)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
  (select sha256(string_agg(cast(v as varchar), ',' order by part, entry, d)) from book{rounds}) as codebooks_sha256
from coded
"""


def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_runs.word_runs(table(spark, sf_dir, "documents"), stutter=True)


QUERIES = {
    "op1_language_id": (op1_language_id, None),
    "op2_personal_data": (op2_personal_data, None),
    "op3_mixing": (op3_mixing, None),
    "op4_minhash_join": (op4_minhash_join, None),
    "op5_warc_revisits": (op5_warc_revisits, OP5_SQL),
    "op6_token_store": (op6_token_store, None),
    "op7_lm_scoring": (op7_lm_scoring, None),
    "op8_piece_sampling": (op8_piece_sampling, None),
    "op9_exact_dedup": (op9_exact_dedup, OP9_SQL),
    "op10_fingerprints": (op10_fingerprints, None),
    "op11_packing": (op11_packing, None),
    "op12_vector_codes": (op12_vector_codes, _op12_sql()),
    "op13_word_runs": (op13_word_runs, None),
}
