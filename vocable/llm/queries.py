"""Registered queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocable.llm.bm25_packing import retrieval_packing
from vocable.llm.exact_dedup import exact_dedup
from vocable.llm.hard_negatives import hard_negatives, relabelled
from vocable.llm.jaccard_join import jaccard_components
from vocable.llm.license_scan import license_scan, license_sql
from vocable.llm.quality_crf import quality
from vocable.llm.rule_ledger import quality_ledger
from vocable.llm.sentencepiece_codec import sentencepiece_codec
from vocable.llm.spelling_variants import spelling_variants
from vocable.llm.store import table
from vocable.llm.suffix_dedup import suffix_dedup
from vocable.llm.tag_path import main_text
from vocable.llm.toxicity_ftrl import toxicity
from vocable.llm.warc import archive_round_trip

Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size,
       doc_id = min(doc_id) over g as kept, sha256(t) as text_sha256
from n window g as (partition by t)
"""


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


OP2_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
k as (select page_id, strlen(html) as payload_bytes, sha256(html) as payload_digest,
             min(page_id) over (partition by html) as first_id,
             payload_bytes >= 100 and page_id is not null and row_number() over (partition by html order by page_id) > 1 as again from p)
select page_id, payload_bytes, payload_digest, case when again then 'revisit' else 'response' end as record_type,
       case when again then first_id end as refers_to
from k
"""


def op3_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ledger(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from d),
tri as (select r, unnest(range(1, len(ws) - 1)) as i,
               unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i:i+2])) as g from w where len(ws) >= 3),
rep as (select r, i from (select r, i, count(*) over (partition by r, g) as c from tri) where c >= 2),
cov as (select r, count(distinct i + o) as n from rep, (values (0), (1), (2)) as off(o) group by r),
ln as (select r, l from (select r, unnest(string_split(t, chr(10))) as l from d) where regexp_matches(l, '[^\x20\x09-\x0D]')),
lc as (select r, count(*) as n_lines, count(*) - count(distinct l) as n_dup from ln group by r),
m as (select w.r, doc_id, len(ws)::bigint as n_words,
             length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
             coalesce(n_dup, 0)::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words,
             coalesce(n_lines, 0) as n_lines,
             length(regexp_replace(t, '[^A-Z]+', '', 'g')) as n_upper,
             length(regexp_replace(t, '[^a-z]+', '', 'g')) as n_lower,
             len(list_filter(ws, lambda x: regexp_matches(x, '[.!?…。！？｡।॥۔؟։።။‼⁇⁈⁉]["''”’»›)\]}）」』】〉》]*$'))) as n_ends
      from w left join cov using (r) left join lc using (r)),
b as (select *, (case when n_words < 50 then 1 else 0 end)
       + (case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end)
       + (case when 10 * n_symbols > n_words then 4 else 0 end)
       + (case when word_chars < 2 * n_words then 8 else 0 end)
       + (case when word_chars > 15 * n_words then 16 else 0 end)
       + (case when n_lines >= 4 and 100 * n_dup_lines > 60 * n_lines then 32 else 0 end)
       + (case when n_upper > n_lower then 64 else 0 end)
       + (case when n_words >= 50 and 200 * n_ends < n_words then 128 else 0 end) as fb from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fb & 3) <> 0 as base_failed, fb = 0 as kept, fb::bigint as fail_bits
from b
"""


def op5_tag_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op7_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("kept")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentencepiece_codec(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids_crc32", "round_trip", "parity")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


# The CRC is taken bit by bit; near pairs share a word with one place left out.
OP12_SQL = r"""
with recursive run as (
  select doc_id, r, count(*) as m from (
    select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[a-zÀ-ÿ]+')) as r from documents) group by all),
bits as (select r, m, length(r) as len, flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || r, ''), lambda c:
           case when ord(c) < 128 then [ord(c)::bigint, 0, 0, 0, 0, 0, 0, 0]
                else [195::bigint, 0, 0, 0, 0, 0, 0, 0, (ord(c) - 64)::bigint, 0, 0, 0, 0, 0, 0, 0] end)) as b from run),
crc as (select r, m, len, xor(list_reduce(list_prepend(4294967295::bigint, b), lambda c, x:
           xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384)), 4294967295) as h from bits),
voc as (select w, sum(m)::bigint as n from (
          select m, case when h % 97 = 0 then substr(r, 1, (h % len)::int) || substr(r, (h % len)::int + 2) else r end as w from crc)
        where length(w) >= 5 group by w having sum(m) >= 3),
hole as (select w, n, i, substr(w, 1, i) || substr(w, i + 2) as rest from (select w, n, unnest(range(length(w)))::int as i from voc)),
pair as (select a.w, a.n, b.w as v, b.n as vn from hole a join hole b on a.i = b.i and a.rest = b.rest and a.w <> b.w
         union select h.w, h.n, v.w, v.n from hole h join voc v on v.w = h.rest
         union select v.w, v.n, h.w, h.n from hole h join voc v on v.w = h.rest),
best as (select w, count(*) as n_near, arg_min(v, (-vn, v)) as top, max(vn) as top_n from pair group by w),
f as (select voc.w, voc.n, coalesce(n_near, 0) as n_near, case when top_n >= 2 * voc.n then top end as form,
             case when top_n >= 2 * voc.n then top_n end as form_n from voc left join best using (w)),
walk as (select w, form, w as at from f union all select walk.w, f.form, f.w from walk join f on f.w = walk.form)
select f.w as word, f.n, f.n_near, f.form, f.form_n, walk.at as root
from f join walk on walk.w = f.w and walk.form is null
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(relabelled(table(spark, sf_dir, "embeddings")))


OP13_SQL = """
with v as (select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                  list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q
           from embeddings where vec_id is not null and label is not null and embedding is not null
           and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.r as ar, a.vec_id as anchor_id, b.r as br, b.vec_id, a.label = b.label as same,
             list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::bigint as score
      from v a join v b on a.r <> b.r where a.vec_id % 100 = 0),
p as (select * from s where same qualify row_number() over (partition by ar order by score desc, vec_id, br) <= 5)
select p.anchor_id, p.vec_id as positive_id,
       row_number() over (partition by p.ar, p.br order by n.score desc, n.vec_id)::int as rank,
       n.vec_id as negative_id, p.score as positive_score, n.score as negative_score
from p join s n on n.ar = p.ar and not n.same and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score
qualify rank <= 10
"""


QUERIES: dict[str, Query] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_warc": op2_warc,
    "op3_quality_crf": op3_quality_crf,
    "op4_toxicity_ftrl": op4_toxicity_ftrl,
    "op5_tag_path": op5_tag_path,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_bm25_packing": op7_bm25_packing,
    "op8_rule_ledger": op8_rule_ledger,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_license_scan": op11_license_scan,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLE: dict[str, str] = {
    "op1_exact_dedup": OP1_SQL,
    "op2_warc": OP2_SQL,
    "op8_rule_ledger": OP8_SQL,
    "op11_license_scan": license_sql(),
    "op12_spelling_variants": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}
