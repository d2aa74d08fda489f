"""D (lookups) and F (splits, sampling, weights)."""

from pyspark.sql import functions as F

from vocable.functions.hashing import hash52, sql_hash52, sql_uniform
from vocable.operators import lookup as D
from vocable.operators import split as S
from vocable.operators import stats as E
from vocable.plans.catalog.keys_filters import LISTING_SQL, listing
from vocable.plans.catalog.sqlbits import SAMPLES
from vocable.plans.position import with_position
from vocable.plans.registry import register
from vocable.sources.tables import samples, table


# ---------------------------------------------------------------- D
@register("d1_dense_ids", """
SELECT doc_id, CAST(dense_rank() OVER (ORDER BY source) - 1 AS BIGINT) AS speaker_id FROM documents
""")
def d1(spark, sf):
    s = samples(spark, sf)
    ids = D.dense_ids(s, "speaker_name", "speaker_id")
    return D.apply_ids(s, ids, "speaker_name", "speaker_id").select("doc_id", "speaker_id")


@register("d2_vector_lookup", """
SELECT e.event_id, round(list_sum(CAST(m.embedding AS DOUBLE[])), 6) AS vec_sum
FROM events e JOIN embeddings m ON m.vec_id = e.user_id
""")
def d2(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id")
    vec = table(spark, sf, "embeddings").select(F.col("vec_id").alias("user_id"), "embedding")
    j = D.strict_lookup(ev, vec, "user_id", ["embedding"], what="speaker vector")
    return j.select("event_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double")), 6)
                    .alias("vec_sum"))


@register("d3_alignment_lookup", f"""
SELECT doc_id, trim('  /attn/' || speaker_name || '/' || CAST(doc_id AS VARCHAR) || '.npy  ') AS alignment_file
FROM ({SAMPLES})
""")
def d3(spark, sf):
    s = samples(spark, sf)
    meta = s.select("audio_file", F.concat(F.lit("  /attn/"), F.col("speaker_name"), F.lit("/"),
                                           F.col("doc_id").cast("string"), F.lit(".npy  ")).alias("raw"))
    meta = meta.select("audio_file", F.trim("raw").alias("alignment_file"))
    return D.strict_lookup(s, meta, "audio_file", ["alignment_file"], what="alignment").select(
        "doc_id", "alignment_file")


@register("d4_zip_by_stem", f"""
SELECT speaker_name || '/' || CAST(doc_id AS VARCHAR) AS stem, audio_file AS wav,
       '/feat/' || speaker_name || '/' || CAST(doc_id AS VARCHAR) || '.npy' AS feat
FROM ({SAMPLES})
""")
def d4(spark, sf):
    s = samples(spark, sf)
    stem = F.concat_ws("/", "speaker_name", F.col("doc_id").cast("string"))
    wav = s.select(stem.alias("stem"), F.col("audio_file").alias("wav"))
    feat = s.select(stem.alias("stem"), F.concat(F.lit("/feat/"), stem, F.lit(".npy")).alias("feat"))
    return D.zip_by_stem(wav, feat, "stem")


@register("d5_vector_upsert", """
WITH o AS (SELECT vec_id, 'old' || CAST(label AS VARCHAR) AS name, embedding FROM embeddings WHERE vec_id < 300),
n AS (SELECT vec_id, 'spk' || CAST(label AS VARCHAR) AS name, embedding FROM embeddings WHERE vec_id >= 200)
SELECT coalesce(o.vec_id, n.vec_id) AS vec_id, coalesce(n.name, o.name) AS name,
       CASE WHEN o.name IS NOT NULL AND n.name IS NOT NULL THEN 'updated' WHEN n.name IS NULL THEN 'kept'
            ELSE 'computed' END AS source,
       round(list_sum(CAST(coalesce(o.embedding, n.embedding) AS DOUBLE[])), 6) AS vec_sum
FROM o FULL OUTER JOIN n ON o.vec_id = n.vec_id
""")
def d5(spark, sf):
    e = table(spark, sf, "embeddings")
    old = e.where(F.col("vec_id") < 300).select("vec_id", F.concat(F.lit("old"), F.col("label").cast("string"))
                                                .alias("name"), "embedding")
    new = e.where(F.col("vec_id") >= 200).select("vec_id", F.concat(F.lit("spk"), F.col("label").cast("string"))
                                                 .alias("name"), "embedding")
    u = D.vector_upsert(old, new, "vec_id", "name", "embedding")
    return u.select("vec_id", "name", "source",
                    F.round(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double")), 6)
                    .alias("vec_sum"))


@register("d6_cache_miss_compute", f"""
SELECT doc_id, n_chars AS feature, {LISTING_SQL} AS from_cache FROM documents
""")
def d6(spark, sf):
    d = table(spark, sf, "documents")
    store = d.where(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) < "c").select(
        "doc_id", F.col("n_chars").alias("feature"))
    return D.cache_miss_compute(d.select("doc_id", "text"), store, "doc_id",
                                lambda m: m.select("doc_id", F.length("text").cast("long").alias("feature")))


@register("d7_missing_speakers", """
SELECT DISTINCT source AS speaker_name FROM documents WHERE source NOT IN
  (SELECT DISTINCT source FROM documents WHERE source NOT IN ('src3', 'src11'))
""")
def d7(spark, sf):
    s = samples(spark, sf)
    saved = s.select("speaker_name").distinct().where(~F.col("speaker_name").isin("src3", "src11"))
    return D.missing_from_set(s, saved, "speaker_name")


# ---------------------------------------------------------------- F
def _h(op, col="doc_id", seed=0):
    return sql_hash52(seed, op, col)


@register("f1_split_one_speaker", f"""
WITH h AS (SELECT doc_id, {_h('f1')} AS h FROM documents), n AS (SELECT count(*) AS n FROM documents)
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY h, doc_id) - 1 < least(floor(n * 0.1), 50)
                    THEN 'eval' ELSE 'train' END AS split FROM h, n
""")
def f1(spark, sf):
    s = samples(spark, sf).select("doc_id")
    return S.split_one_speaker(s, "doc_id", 0.1, max_size=50).select("doc_id", "split")


@register("f2_split_multi_speaker", f"""
WITH h AS (SELECT doc_id, source AS speaker_name, {_h('f2')} AS h FROM documents),
p AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY speaker_name ORDER BY h, doc_id) AS rn FROM h)
      WHERE rn = 1),
n AS (SELECT count(*) AS n FROM documents),
fr AS (SELECT * FROM h WHERE doc_id NOT IN (SELECT doc_id FROM p))
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY h, doc_id) - 1 < floor(n * 0.3) THEN 'eval' ELSE 'train' END AS split
FROM fr, n
UNION ALL SELECT doc_id, 'train' AS split FROM p
""")
def f2(spark, sf):
    s = samples(spark, sf).select("doc_id", "speaker_name")
    return S.split_many_speakers(s, "doc_id", "speaker_name", 0.3).select("doc_id", "split")


F3_MAX = 800


@register("f3_multi_dataset", f"""
WITH h AS (SELECT doc_id, lang, source, {_h('f3')} AS h FROM documents),
g AS (SELECT lang, count(*) AS n, count(DISTINCT source) AS speakers, count(*) OVER () AS sets FROM h GROUP BY lang),
p AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY h, doc_id) = 1 AS first_one FROM h),
m AS (SELECT p.doc_id, p.lang, p.h, p.first_one AND g.speakers > 1 AS prot,
             least(floor(g.n * 0.1), {F3_MAX} // g.sets) AS size FROM p JOIN g ON p.lang = g.lang),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY prot, h, doc_id) - 1 AS rk FROM m)
SELECT doc_id, lang AS dataset, CASE WHEN NOT prot AND rk < size THEN 'eval' ELSE 'train' END AS split FROM r
""")
def f3(spark, sf):
    s = samples(spark, sf).select("doc_id", "language", "speaker_name")
    return S.split_datasets(s, "doc_id", "language", "speaker_name", 0.1, max_size=F3_MAX).select(
        "doc_id", F.col("language").alias("dataset"), "split")


@register("f4_ordered_prefix_split", """
WITH n AS (SELECT count(*) AS n FROM documents)
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) - 1 < ceil(n * 0.85) THEN 'train' ELSE 'eval' END AS split
FROM documents, n
""")
def f4(spark, sf):
    return S.ordered_prefix_split(table(spark, sf, "documents").select("doc_id"), ["doc_id"], 0.85)


@register("f5_percentage_split", f"""
WITH h AS (SELECT doc_id, {_h('f5')} AS h FROM documents), n AS (SELECT count(*) AS n FROM documents)
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY h, doc_id) - 1 < floor(n * 0.15) THEN 'eval' ELSE 'train' END AS split
FROM h, n
""")
def f5(spark, sf):
    s = samples(spark, sf).select("doc_id", "audio_file")
    return S.split_one_speaker(s, "doc_id", 0.15, op="f5").orderBy("audio_file").select("doc_id", "split")


@register("f6_paired_split", f"""
WITH p AS (SELECT doc_id, speaker_name || '/' || CAST(doc_id AS VARCHAR) AS stem FROM ({SAMPLES})),
h AS (SELECT stem, {_h('f6', 'stem')} AS h FROM p), n AS (SELECT count(*) AS n FROM p)
SELECT stem, CASE WHEN row_number() OVER (ORDER BY h, stem) - 1 < floor(n * 0.2) THEN 'eval' ELSE 'train' END AS split
FROM h, n
""")
def f6(spark, sf):
    pairs = d4(spark, sf)
    return S.split_one_speaker(pairs, "stem", 0.2, op="f6").select("stem", "split")


def _w_sql(attr_expr: str, name: str) -> str:
    return f"""{name} AS (SELECT a, (1.0 / c) / sqrt(sum(1.0 / c) OVER ()) AS w
           FROM (SELECT {attr_expr} AS a, count(*) AS c FROM s GROUP BY 1))"""


@register("f7_inverse_frequency_weight", f"""
WITH s AS ({SAMPLES}), {_w_sql('speaker_name', 'w')}
SELECT s.doc_id, round(w.w, 9) AS weight FROM s JOIN w ON s.speaker_name = w.a
""")
def f7(spark, sf):
    w = S.inverse_frequency_weight(samples(spark, sf), "speaker_name")
    return w.select("doc_id", F.round("weight", 9).alias("weight"))


BUCKET_SQL = """CASE WHEN hi = lo THEN 1 ELSE CAST(greatest(1, least(10, ceil((audio_length - lo) / ((hi - lo) / 10.0)))) AS INTEGER) END"""


@register("f8_length_bucket_weight", f"""
WITH s0 AS ({SAMPLES}), mm AS (SELECT min(audio_length) AS lo, max(audio_length) AS hi FROM s0),
s AS (SELECT s0.*, {BUCKET_SQL} AS bucket FROM s0, mm), {_w_sql('bucket', 'w')}
SELECT s.doc_id, round(w.w, 9) AS weight FROM s JOIN w ON s.bucket = w.a
""")
def f8(spark, sf):
    b = E.length_buckets(samples(spark, sf), "audio_length", 10)
    w = S.inverse_frequency_weight(b, "bucket")
    return w.select("doc_id", F.round("weight", 9).alias("weight"))


@register("f9_combined_weight", f"""
WITH s0 AS ({SAMPLES}), mm AS (SELECT min(audio_length) AS lo, max(audio_length) AS hi FROM s0),
s AS (SELECT s0.*, {BUCKET_SQL} AS bucket FROM s0, mm),
{_w_sql('language', 'wl')}, {_w_sql('speaker_name', 'ws')}, {_w_sql('bucket', 'wb')}
SELECT s.doc_id, round(1.0 * wl.w + 2.0 * ws.w + 0.5 * wb.w, 9) AS weight
FROM s JOIN wl ON s.language = wl.a JOIN ws ON s.speaker_name = ws.a JOIN wb ON s.bucket = wb.a
""")
def f9(spark, sf):
    return f9_weight(spark, sf).select("doc_id", F.round("weight", 9).alias("weight"))


def f9_weight(spark, sf):
    b = E.length_buckets(samples(spark, sf), "audio_length", 10)
    b = S.inverse_frequency_weight(b, "language", "wl")
    b = S.inverse_frequency_weight(b, "speaker_name", "ws")
    b = S.inverse_frequency_weight(b, "bucket", "wb")
    return b.select("doc_id", (1.0 * F.col("wl") + 2.0 * F.col("ws") + 0.5 * F.col("wb")).alias("weight"))


F9_SQL = f"""
WITH s0 AS ({SAMPLES}), mm AS (SELECT min(audio_length) AS lo, max(audio_length) AS hi FROM s0),
s AS (SELECT s0.*, {BUCKET_SQL} AS bucket FROM s0, mm),
{_w_sql('language', 'wl')}, {_w_sql('speaker_name', 'ws')}, {_w_sql('bucket', 'wb')},
f9 AS (SELECT s.doc_id, 1.0 * wl.w + 2.0 * ws.w + 0.5 * wb.w AS weight
       FROM s JOIN wl ON s.language = wl.a JOIN ws ON s.speaker_name = ws.a JOIN wb ON s.bucket = wb.a)"""


@register("f10_weighted_sampling", f"""{F9_SQL},
r AS (SELECT doc_id, w, sum(w) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
      FROM (SELECT doc_id, CAST(round(weight * 1048576) AS DOUBLE) / 1048576 AS w FROM f9)),
t AS (SELECT sum(w) AS total, count(*) AS n FROM r),
d AS (SELECT range AS draw, {sql_uniform(0, 'f10', 'range')} * total AS x FROM range((SELECT n FROM t)), t)
SELECT d.draw, r.doc_id FROM d JOIN r ON r.cum - r.w <= d.x AND d.x < r.cum
""")
def f10(spark, sf):
    """As many draws as rows, by the F9 weight.  The weight is rounded to a
    multiple of 2**-20 so that prefix sums are exact in any order of addition."""
    d = f9_weight(spark, sf).select("doc_id", (F.round(F.col("weight") * 1048576) / 1048576).alias("weight"))
    return S.weighted_draws(d, "doc_id", "weight", table(spark, sf, "documents").count())


@register("f11_language_uniform", f"""
WITH st AS (SELECT lang, count(*) AS cnt, dense_rank() OVER (ORDER BY lang) - 1 AS gi FROM documents GROUP BY lang),
ng AS (SELECT count(*) AS ng FROM st),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS ord FROM documents),
d AS (SELECT range AS draw, {sql_hash52(0, 'f11g', 'range')} % ng AS gi, {sql_hash52(0, 'f11r', 'range')} AS hr
      FROM range((SELECT count(*) FROM documents)), ng)
SELECT d.draw, st.lang, r.doc_id FROM d JOIN st ON d.gi = st.gi JOIN r ON r.lang = st.lang AND r.ord = d.hr % st.cnt
""")
def f11(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return S.uniform_by_group(d, "doc_id", "lang", d.count())


@register("f12_shard_by_rank", """
WITH n AS (SELECT count(*) AS n FROM documents),
p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents)
SELECT doc_id, CAST(pos % 3 AS INTEGER) AS shard FROM p, n WHERE pos < n - n % 3
""")
def f12(spark, sf):
    return S.shard_by_rank(table(spark, sf, "documents").select("doc_id"), ["doc_id"], 3).select("doc_id", "shard")


@register("f13_random_member", f"""
SELECT source AS speaker_name, arg_min(doc_id, ({_h('f13')}, doc_id)) AS doc_id FROM documents GROUP BY source
""")
def f13(spark, sf):
    return S.random_member(samples(spark, sf), "speaker_name", "doc_id")


@register("f14_repeat_epochs", """
WITH n AS (SELECT count(*) AS n FROM documents),
p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents)
SELECT doc_id, CAST(e.epoch AS INTEGER) AS epoch, e.epoch * n + pos AS step FROM p, n, (SELECT unnest(range(3)) AS epoch) e
""")
def f14(spark, sf):
    return S.repeat_epochs(table(spark, sf, "documents").select("doc_id"), ["doc_id"], 3).select(
        "doc_id", "epoch", "step")


@register("f15_random_pairing", f"""
WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS p FROM documents),
b AS (SELECT doc_id AS partner, row_number() OVER (ORDER BY {sql_hash52(0, 'f15', 'doc_id')}, doc_id) AS p FROM documents)
SELECT a.doc_id, b.partner FROM a JOIN b ON a.p = b.p
""")
def f15(spark, sf):
    return S.random_pairing(table(spark, sf, "documents").select("doc_id"), "doc_id")
