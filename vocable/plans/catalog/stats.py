"""E (statistics) and H (set operations)."""

from pyspark.sql import functions as F

from vocable.functions.text import basic_cleaners
from vocable.operators import stats as E
from vocable.operators.filters import length_ok
from vocable.operators.vocab import DEFAULT_PUNCTUATIONS, distinct_chars
from vocable.plans.catalog.sqlbits import SAMPLES, sql_basic_clean
from vocable.functions.hashing import sql_hash52
from vocable.plans.registry import register
from vocable.sources.tables import samples, table

EMB_LONG = """(SELECT vec_id, label, 'spk' || CAST(label AS VARCHAR) AS name,
       unnest(embedding)::DOUBLE AS x, unnest(generate_series(0, len(embedding) - 1)) AS pos FROM embeddings)"""

C1_B = (5, 1500, 200, 15000)


@register("e1_length_profile", f"""
WITH s AS (SELECT *, (text_length BETWEEN {C1_B[0]} AND {C1_B[1]}) AND (audio_length BETWEEN {C1_B[2]} AND {C1_B[3]}) AS k
           FROM ({SAMPLES}))
SELECT max(text_length) FILTER (WHERE k) AS max_text_len, min(text_length) FILTER (WHERE k) AS min_text_len,
       round(avg(text_length) FILTER (WHERE k), 6) AS avg_text_len,
       max(audio_length) FILTER (WHERE k) AS max_audio_len, min(audio_length) FILTER (WHERE k) AS min_audio_len,
       round(avg(audio_length) FILTER (WHERE k), 6) AS avg_audio_len,
       count(*) FILTER (WHERE NOT k) AS n_discarded, count(*) FILTER (WHERE k) AS n_instances
FROM s
""")
def e1(spark, sf):
    s = samples(spark, sf)
    p = E.length_profile(s, length_ok("text_length", "audio_length", *C1_B))
    return p.withColumn("avg_text_len", F.round("avg_text_len", 6)).withColumn(
        "avg_audio_len", F.round("avg_audio_len", 6))


@register("e2_char_inventory", """
SELECT DISTINCT c AS ch, lower(c) = c AS is_lower, lower(c) AS lowered
FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> ''
""")
def e2(spark, sf):
    return E_char_inventory(table(spark, sf, "documents"))


def E_char_inventory(d):
    from vocable.operators.vocab import char_inventory
    return char_inventory(d, "text")


# Fixed value: default grapheme set of the character vocabulary.
DEFAULT_CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


@register("e4_oov_report", f"""
SELECT c AS ch, count(*) AS n
FROM (SELECT unnest(string_split({sql_basic_clean('text')}, '')) AS c FROM documents)
WHERE c <> '' AND NOT contains('{DEFAULT_CHARACTERS}' || '{DEFAULT_PUNCTUATIONS.replace("'", "''")}', c)
GROUP BY c
""")
def e4(spark, sf):
    from vocable.operators.vocab import oov_report
    d = table(spark, sf, "documents").select(basic_cleaners(F.col("text")).alias("clean"))
    vocab = spark.createDataFrame([(c,) for c in DEFAULT_CHARACTERS + DEFAULT_PUNCTUATIONS], "ch string")
    return oov_report(d, vocab, "clean")


@register("e5_per_bin_mean_std", f"""
SELECT pos AS bin, round(sum(x) / count(*), 6) AS mean,
       round(sqrt(greatest(0.0, sum(x * x) / count(*) - (sum(x) / count(*)) * (sum(x) / count(*)))), 6) AS std
FROM {EMB_LONG} GROUP BY pos
""")
def e5(spark, sf):
    e = table(spark, sf, "embeddings")
    r = E.per_bin_mean_std(e, "embedding")
    return r.select(F.col("bin").cast("long").alias("bin"), F.round("mean", 6).alias("mean"),
                    F.round("std", 6).alias("std"))


E6_V = "CASE WHEN value < 50 THEN 0.0 ELSE value END"


@register("e6_nonzero_mean_std", f"""
SELECT event_type, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std
FROM (SELECT event_type, {E6_V} AS v FROM events) WHERE v <> 0 GROUP BY event_type
""")
def e6(spark, sf):
    ev = table(spark, sf, "events").select("event_type", F.expr(E6_V).alias("v"))
    r = E.nonzero_mean_std(ev, ["event_type"], "v")
    return r.select("event_type", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def clip_vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.concat(F.lit("spk"), F.col("label").cast("string")).alias("name"), "embedding")


@register("e7_mean_vector", f"""
SELECT name, CAST(pos AS BIGINT) AS pos, round(avg(x), 6) AS mean FROM {EMB_LONG} GROUP BY name, pos
""")
def e7(spark, sf):
    m = E.mean_vectors(clip_vectors(spark, sf), "name", "embedding")
    return m.select("name", F.col("pos").cast("long").alias("pos"), F.round("mean", 6).alias("mean"))


@register("e7_mean_vector_first_n", f"""
WITH r AS (SELECT vec_id, name, row_number() OVER (PARTITION BY name ORDER BY vec_id) AS rn
           FROM (SELECT vec_id, 'spk' || CAST(label AS VARCHAR) AS name FROM embeddings))
SELECT l.name, CAST(l.pos AS BIGINT) AS pos, round(avg(l.x), 6) AS mean
FROM {EMB_LONG} l JOIN r ON l.vec_id = r.vec_id WHERE r.rn <= 10 GROUP BY l.name, l.pos
""")
def e7n(spark, sf):
    m = E.mean_vectors(clip_vectors(spark, sf), "name", "embedding", order_col="vec_id", first_n=10)
    return m.select("name", F.col("pos").cast("long").alias("pos"), F.round("mean", 6).alias("mean"))


@register("e7_mean_vector_random_n", f"""
WITH r AS (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY {sql_hash52(0, 'e7', 'vec_id')}, vec_id) AS rn FROM embeddings)
SELECT l.name, CAST(l.pos AS BIGINT) AS pos, round(avg(l.x), 6) AS mean
FROM {EMB_LONG} l JOIN r ON l.vec_id = r.vec_id WHERE r.rn <= 7 GROUP BY l.name, l.pos
""")
def e7r(spark, sf):
    m = E.mean_vectors(clip_vectors(spark, sf), "name", "embedding", order_col="vec_id", random_n=7)
    return m.select("name", F.col("pos").cast("long").alias("pos"), F.round("mean", 6).alias("mean"))


@register("e8_normalised_mean_vector", f"""
WITH m AS (SELECT name, pos, avg(x) AS mean FROM {EMB_LONG} GROUP BY name, pos),
n AS (SELECT name, sqrt(sum(mean * mean)) AS nn FROM m GROUP BY name)
SELECT m.name, CAST(m.pos AS BIGINT) AS pos, round(m.mean / n.nn, 6) AS x FROM m JOIN n USING (name)
""")
def e8(spark, sf):
    m = E.normalised_mean_vectors(clip_vectors(spark, sf), "name", "embedding")
    return m.select("name", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@register("e9_vector_counts", """
SELECT 'spk' || CAST(label AS VARCHAR) AS name, count(*) AS n_vectors,
       (SELECT count(*) FROM embeddings) AS total_vectors,
       (SELECT count(DISTINCT label) FROM embeddings) AS total_names,
       (SELECT CAST(max(len(embedding)) AS BIGINT) FROM embeddings) AS dim
FROM embeddings GROUP BY label
""")
def e9(spark, sf):
    return E.vector_counts(clip_vectors(spark, sf), "name", "embedding")


@register("e11_total_duration", f"""
SELECT language, round(sum(audio_length / 22050.0), 4) AS total_seconds FROM ({SAMPLES}) GROUP BY language
""")
def e11(spark, sf):
    s = samples(spark, sf)
    return s.groupBy("language").agg(F.round(F.sum(F.col("audio_length") / 22050.0), 4).alias("total_seconds"))


@register("e12_class_counter", f"""
SELECT speaker_name, count(*) AS n FROM ({SAMPLES}) GROUP BY speaker_name
""")
def e12(spark, sf):
    return samples(spark, sf).groupBy("speaker_name").agg(F.count(F.lit(1)).alias("n"))


@register("e13_length_histogram", f"""
WITH s AS ({SAMPLES}), mm AS (SELECT min(audio_length) AS lo, max(audio_length) AS hi FROM s)
SELECT CAST(CASE WHEN hi = lo THEN 1
            ELSE greatest(1, least(10, ceil((audio_length - lo) / ((hi - lo) / 10.0)))) END AS INTEGER) AS bucket,
       count(*) AS n
FROM s, mm GROUP BY 1
""")
def e13(spark, sf):
    b = E.length_buckets(samples(spark, sf), "audio_length", 10)
    return b.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


E15_ORDER = "ts, event_id"


@register("e15_running_mean", f"""
SELECT event_id, event_type,
       round(sum(value) OVER (PARTITION BY event_type ORDER BY {E15_ORDER}
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2)
       / row_number() OVER (PARTITION BY event_type ORDER BY {E15_ORDER}) AS running_mean
FROM events
""")
def e15(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type", "ts", "value")
    r = E.running_mean(ev, "event_type", ["ts", "event_id"], "value", decimals=2)
    return r.select("event_id", "event_type", "running_mean")


@register("e15_running_mean_compat", f"""
WITH w AS (SELECT event_id, event_type, value,
       row_number() OVER (PARTITION BY event_type ORDER BY {E15_ORDER}) AS rn,
       round(sum(value) OVER (PARTITION BY event_type ORDER BY {E15_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS s,
       first_value(value) OVER (PARTITION BY event_type ORDER BY {E15_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f
       FROM events)
SELECT event_id, event_type, CASE WHEN rn = 1 THEN f ELSE (s - f) / (rn - 1) END AS running_mean FROM w
""")
def e15c(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type", "ts", "value")
    r = E.running_mean(ev, "event_type", ["ts", "event_id"], "value", compat=True, decimals=2)
    return r.select("event_id", "event_type", "running_mean")


@register("e16_best_rows", """
WITH w AS (SELECT event_id, event_type, value,
       min(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_so_far,
       row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS rk FROM events),
x AS (SELECT *, lag(best_so_far) OVER (PARTITION BY event_type ORDER BY event_id) AS prev FROM w)
SELECT event_id, event_type, best_so_far, (prev IS NULL OR value < prev) AS is_new_best, rk <= 3 AS kept FROM x
""")
def e16(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type", "value")
    r = E.best_rows(ev, "event_type", "event_id", "value", 3)
    return r.select("event_id", "event_type", "best_so_far", "is_new_best", "kept")


@register("e17_processing_ratio", """
SELECT event_id, value / (CAST(json_extract(props, '$.k') AS DOUBLE) + 1.0) AS rtf FROM events
""")
def e17(spark, sf):
    ev = table(spark, sf, "events")
    audio_s = F.get_json_object("props", "$.k").cast("double") + 1.0
    return ev.select("event_id", (F.col("value") / audio_s).alias("rtf"))


# ---------------------------------------------------------------- H
@register("h1_union_datasets", f"""
SELECT dataset, speaker_name, count(*) AS n FROM (
  SELECT 'docs' AS dataset, speaker_name, language FROM ({SAMPLES})
  UNION ALL
  SELECT 'conv' AS dataset, role AS speaker_name, NULL AS language FROM conversations)
GROUP BY dataset, speaker_name
""")
def h1(spark, sf):
    a = samples(spark, sf).select(F.lit("docs").alias("dataset"), "speaker_name", "language")
    b = table(spark, sf, "conversations").select(F.lit("conv").alias("dataset"), F.col("role").alias("speaker_name"))
    u = a.unionByName(b, allowMissingColumns=True)
    return u.groupBy("dataset", "speaker_name").agg(F.count(F.lit(1)).alias("n"))


@register("h2_intersect_union", f"""
WITH s AS ({SAMPLES}),
tk AS (SELECT doc_id FROM s WHERE text_length BETWEEN {C1_B[0]} AND {C1_B[1]}),
ak AS (SELECT doc_id FROM s WHERE audio_length BETWEEN {C1_B[2]} AND {C1_B[3]}),
ti AS (SELECT doc_id FROM s WHERE NOT (text_length BETWEEN {C1_B[0]} AND {C1_B[1]})),
ai AS (SELECT doc_id FROM s WHERE NOT (audio_length BETWEEN {C1_B[2]} AND {C1_B[3]}))
SELECT doc_id, 'kept' AS side FROM (SELECT doc_id FROM tk INTERSECT SELECT doc_id FROM ak)
UNION ALL
SELECT doc_id, 'ignored' AS side FROM (SELECT doc_id FROM ti UNION SELECT doc_id FROM ai)
""")
def h2(spark, sf):
    s = samples(spark, sf)
    tk = s.where(F.col("text_length").between(C1_B[0], C1_B[1])).select("doc_id")
    ak = s.where(F.col("audio_length").between(C1_B[2], C1_B[3])).select("doc_id")
    ti = s.where(~F.col("text_length").between(C1_B[0], C1_B[1])).select("doc_id")
    ai = s.where(~F.col("audio_length").between(C1_B[2], C1_B[3])).select("doc_id")
    kept = tk.intersect(ak).withColumn("side", F.lit("kept"))
    ign = ti.union(ai).distinct().withColumn("side", F.lit("ignored"))
    return kept.unionByName(ign)


@register("h3_key_collisions", """
SELECT doc_id FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)
""")
def h3(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return d.intersect(table(spark, sf, "labels").select("doc_id"))


@register("h4_except_keep_duplicates", """
SELECT c.conv_id, c.turn FROM conversations c
WHERE NOT EXISTS (SELECT 1 FROM conversations e WHERE e.role = 'user' AND e.conv_id = c.conv_id AND e.turn = 0)
""")
def h4(spark, sf):
    c = table(spark, sf, "conversations")
    ev = c.where((F.col("role") == "user") & (F.col("turn") == 0)).select("conv_id")
    return c.join(ev, "conv_id", "left_anti").select("conv_id", "turn")
