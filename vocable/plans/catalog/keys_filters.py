"""B (keys/projections) and C (filters) over the sample table."""

from pyspark.sql import functions as F

from vocable.functions.text import basic_cleaners
from vocable.operators import filters as C
from vocable.operators import keys as B
from vocable.plans.catalog.sqlbits import SAMPLES, sql_basic_clean
from vocable.plans.registry import register
from vocable.sources.tables import samples, table

RATE = 22050


# ---------------------------------------------------------------- B
@register("b1_unique_audio_name", f"""
SELECT doc_id, audio_unique_name FROM ({SAMPLES})
""")
def b1(spark, sf):
    return samples(spark, sf).select("doc_id", "audio_unique_name")


@register("b2_file_key", """
SELECT doc_id,
       translate(to_base64(encode('/data/' || source || '/' || CAST(doc_id AS VARCHAR) || '.wav')), '+/', '-_') AS file_key,
       decode(from_base64(translate(translate(to_base64(encode(text)), '+/', '-_'), '-_', '+/'))) = text AS roundtrip_ok
FROM documents
""")
def b2(spark, sf):
    s = samples(spark, sf)
    return s.select("doc_id", B.file_key("audio_file").alias("file_key"),
                    (B.file_key_decode(B.file_key("text")) == F.col("text")).alias("roundtrip_ok"))


@register("b3_positional_record", f"""
WITH f AS (
  SELECT doc_id, list_slice([text, audio_file, speaker_name, root_path, audio_unique_name], 1, 3 + (doc_id % 3)) AS a
  FROM ({SAMPLES}))
SELECT doc_id, CAST(length(a[1]) AS BIGINT) AS text_chars, a[2] AS audio_file, a[3] AS speaker_name,
       CASE WHEN len(a) >= 4 THEN a[4] END AS root_path,
       CASE WHEN len(a) >= 5 THEN a[5] END AS audio_unique_name
FROM f
""")
def b3(spark, sf):
    s = samples(spark, sf)
    arr = F.slice(F.array("text", "audio_file", "speaker_name", "root_path", "audio_unique_name"),
                  1, (F.lit(3) + F.pmod("doc_id", F.lit(3))).cast("int"))
    r = s.select("doc_id", B.positional_record(arr).alias("r"))
    return r.select("doc_id", F.length("r.text").cast("long").alias("text_chars"), "r.audio_file",
                    "r.speaker_name", "r.root_path", "r.audio_unique_name")


@register("b4_derived_lengths", f"""
SELECT doc_id, CAST(length(text) AS BIGINT) AS text_chars,
       CAST(trunc(audio_length / 100.0 * {RATE}) AS BIGINT) AS n_samples,
       round(CAST(trunc(audio_length / 100.0 * {RATE}) AS BIGINT) / {RATE}.0, 6) AS seconds,
       round(CAST(trunc(audio_length / 100.0 * {RATE}) AS BIGINT) / {RATE}.0 * 1000.0, 6) AS ms
FROM ({SAMPLES})
""")
def b4(spark, sf):
    s = samples(spark, sf)
    n = B.audio_samples(F.col("audio_length") / 100.0, F.lit(RATE))
    return s.select("doc_id", F.length("text").cast("long").alias("text_chars"), n.alias("n_samples"),
                    F.round(B.duration_seconds(n, F.lit(RATE)), 6).alias("seconds"),
                    F.round(B.duration_ms(n, F.lit(RATE)), 6).alias("ms"))


@register("b5_fill_defaults", f"""
SELECT s.doc_id,
       coalesce(CASE WHEN l.toxic = 1 THEN 'toxic' WHEN l.quality = 1 THEN 'good'
                     WHEN l.quality IS NOT NULL THEN 'bad' END, 'neutral') AS emotion_name,
       'default' AS speaker_alias
FROM ({SAMPLES}) s LEFT JOIN labels l ON s.doc_id = l.doc_id
""")
def b5(spark, sf):
    s = samples(spark, sf, with_emotion=True).select("doc_id", "emotion_name")
    return B.fill_defaults(s, {"emotion_name": "neutral", "speaker_alias": "default"})


@register("b6_nested_text_map", f"""
SELECT doc_id, {sql_basic_clean('text')} AS n_text,
       {sql_basic_clean('source')} || '|' || {sql_basic_clean('lang')} AS n_tags,
       {sql_basic_clean('lang')} AS n_lang
FROM documents
""")
def b6(spark, sf):
    d = table(spark, sf, "documents")
    nested = d.select("doc_id", F.struct(
        F.col("text").alias("text"), F.array("source", "lang").alias("tags"),
        F.create_map(F.lit("lang"), F.col("lang")).alias("meta")).alias("rec"))
    dtype = nested.schema["rec"].dataType
    out = nested.select("doc_id", B.map_strings(F.col("rec"), dtype, basic_cleaners).alias("rec"))
    return out.select("doc_id", F.col("rec.text").alias("n_text"),
                      F.array_join("rec.tags", "|").alias("n_tags"), F.col("rec.meta")["lang"].alias("n_lang"))


@register("b7_rows_to_columns", """
SELECT conv_id, list(role ORDER BY turn) AS role, list(CAST(length(text) AS BIGINT) ORDER BY turn) AS n_chars,
       list(turn ORDER BY turn) AS turn
FROM conversations GROUP BY conv_id
""")
def b7(spark, sf):
    c = table(spark, sf, "conversations").withColumn("n_chars", F.length("text").cast("long"))
    return B.rows_to_columns(c, "conv_id", "turn", ["role", "n_chars", "turn"])


@register("b8_group_by_key", f"""
SELECT speaker_name, count(*) AS n_rows, min(doc_id) AS first_doc, max(doc_id) AS last_doc,
       CAST(sum(audio_length) AS BIGINT) AS total_length
FROM ({SAMPLES}) GROUP BY speaker_name
""")
def b8(spark, sf):
    s = samples(spark, sf)
    return s.groupBy("speaker_name").agg(F.count(F.lit(1)).alias("n_rows"), F.min("doc_id").alias("first_doc"),
                                         F.max("doc_id").alias("last_doc"),
                                         F.sum("audio_length").alias("total_length"))


# ---------------------------------------------------------------- C
C1_B = (5, 1500, 200, 15000)


@register("c1_length_bounds", f"""
SELECT doc_id, text_length, audio_length,
       (text_length BETWEEN {C1_B[0]} AND {C1_B[1]}) AND (audio_length BETWEEN {C1_B[2]} AND {C1_B[3]}) AS kept
FROM ({SAMPLES})
""")
def c1(spark, sf):
    s = samples(spark, sf)
    return s.select("doc_id", "text_length", "audio_length",
                    C.length_ok("text_length", "audio_length", *C1_B).alias("kept"))


@register("c2_ignore_speakers", f"""
SELECT doc_id, speaker_name FROM ({SAMPLES}) WHERE speaker_name NOT IN ('src3', 'src7')
""")
def c2(spark, sf):
    return C.ignore_speakers(samples(spark, sf), ["src3", "src7"]).select("doc_id", "speaker_name")


LISTING_SQL = "substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) < 'c'"


def listing(spark, sf):
    """Simulated file listing: the audio files whose md5(doc_id) starts below 'c'."""
    s = samples(spark, sf)
    return s.where(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) < "c").select(
        F.col("audio_file").alias("path"))


@register("c3_file_exists", f"""
SELECT s.doc_id, s.audio_file FROM ({SAMPLES}) s
WHERE s.audio_file IN (SELECT audio_file FROM ({SAMPLES}) x WHERE {LISTING_SQL.replace('doc_id', 'x.doc_id')})
""")
def c3(spark, sf):
    return C.existing_files(samples(spark, sf), listing(spark, sf)).select("doc_id", "audio_file")


@register("c4_no_digit", f"""
SELECT doc_id FROM documents
WHERE NOT regexp_matches(text, '{C.DIGIT_CLASS}')
""")
def c4(spark, sf):
    d = table(spark, sf, "documents")
    return d.where(~C.has_digit("text")).select("doc_id")


@register("c5_transcript_sanity", f"""
SELECT doc_id, {sql_basic_clean('text')} <> '' AND {sql_basic_clean('text')} <> '<music>'
              AND length({sql_basic_clean('text')}) >= 5
              AND audio_length > 300 AND audio_length < 12000
              AND text_length > 10 AND text_length < 1500 AS ok
FROM ({SAMPLES})
""")
def c5(spark, sf):
    s = samples(spark, sf).withColumn("clean", basic_cleaners(F.col("text")))
    ok = C.transcript_ok("clean", "audio_length", "text_length", 300, 12000, 10, 1500, mode="strict")
    return s.select("doc_id", ok.alias("ok"))


@register("c6_post_token_reject", f"""
SELECT doc_id, CASE WHEN text_length > 1200 THEN 'text_too_long'
                    WHEN audio_length < 400 THEN 'audio_too_short' END AS reason
FROM ({SAMPLES})
""")
def c6(spark, sf):
    s = samples(spark, sf)
    return s.select("doc_id", C.post_token_reason("text_length", "audio_length", 1200, 400).alias("reason"))


@register("c7_validity_reason", f"""
SELECT doc_id, CASE WHEN audio_length > 16000 THEN 'wav_too_long'
                    WHEN text_length > 1400 THEN 'text_too_long'
                    WHEN length(trim(text)) = 0 THEN 'blank_text'
                    WHEN audio_length < 0.5 * 1000 THEN 'clip_too_short' END AS reason
FROM ({SAMPLES})
""")
def c7(spark, sf):
    s = samples(spark, sf)
    return s.select("doc_id", C.validity_reason("text", "audio_length", "text_length", 1000, 16000, 1400)
                    .alias("reason"))


@register("c8_reserved_tokens", """
SELECT doc_id, list_bool_or(list_transform(string_split(text, ' '), lambda w: length(w) <= 1)) AS invalid
FROM documents
""")
def c8(spark, sf):
    d = table(spark, sf, "documents")
    ids = F.transform(F.split("text", " ", -1), lambda w: F.length(w))
    return d.select("doc_id", C.reserved_token_found(ids).alias("invalid"))


@register("c9_class_size", f"""
WITH s AS ({SAMPLES}),
big AS (SELECT speaker_name FROM s GROUP BY speaker_name HAVING count(*) >= 50)
SELECT doc_id, speaker_name FROM s WHERE speaker_name IN (SELECT speaker_name FROM big) AND audio_length > 1000
""")
def c9(spark, sf):
    return C.class_size_filter(samples(spark, sf), "speaker_name", 50, "audio_length", 1000).select(
        "doc_id", "speaker_name")


@register("c10_short_clip", f"""
SELECT doc_id FROM ({SAMPLES}) WHERE audio_length >= 3000 / 3.0
""")
def c10(spark, sf):
    return samples(spark, sf).where(C.long_enough("audio_length", 3000)).select("doc_id")


C11_X = ("CASE WHEN event_type = 'error' THEN CAST('NaN' AS DOUBLE) "
         "WHEN event_type = 'signup' AND value > 300 THEN CAST('Infinity' AS DOUBLE) ELSE value END")


@register("c11_finite", f"""
SELECT event_id FROM (SELECT event_id, {C11_X} AS x FROM events)
WHERE x IS NOT NULL AND NOT isnan(x) AND abs(x) < CAST('Infinity' AS DOUBLE)
""")
def c11(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.expr(C11_X).alias("x"))
    return e.where(C.finite("x")).select("event_id")


@register("c12_audio_range_clip", """
WITH a AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE) * 12.0) AS x FROM embeddings)
SELECT vec_id,
       list_bool_or(list_transform(x, lambda v: v > 10.0)) OR NOT list_bool_or(list_transform(x, lambda v: v < 0)) AS flagged,
       round(list_sum(list_transform(x, lambda v: greatest(-1.0, least(1.0, v)))), 6) AS clipped_sum
FROM a
""")
def c12(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double") * 12.0)
                                               .alias("x"))
    clipped = C.clip_audio("x")
    return e.select("vec_id", C.audio_out_of_range("x", 10.0).alias("flagged"),
                    F.round(F.aggregate(clipped, F.lit(0.0), lambda a, v: a + v), 6).alias("clipped_sum"))
