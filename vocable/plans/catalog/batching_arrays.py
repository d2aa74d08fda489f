"""G (ordering, batching) and I (array shaping)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from vocable.functions.hashing import hash52, sql_hash52
from vocable.operators import arrays as I
from vocable.operators import batching as G
from vocable.operators import clips as C
from vocable.plans.catalog.sqlbits import SAMPLES
from vocable.plans.position import with_position
from vocable.plans.registry import register
from vocable.sources.tables import samples, table


def _h(op, *cols, seed=0):
    return sql_hash52(seed, op, *cols)


POS_SQL = f"(SELECT *, row_number() OVER (ORDER BY audio_length, doc_id) - 1 AS pos FROM ({SAMPLES}))"


# ---------------------------------------------------------------- G
@register("g1_sort_by_length", f"""
WITH p AS {POS_SQL}, n AS (SELECT count(*) AS n FROM p)
SELECT doc_id, CASE WHEN pos = 0 THEN n - 1 WHEN pos = n - 1 THEN 0 ELSE pos END AS pos FROM p, n
""")
def g1(spark, sf):
    return G.sort_by_length(samples(spark, sf).select("doc_id", "audio_length"), "audio_length", "doc_id",
                            start_by_longest=True).select("doc_id", "pos")


@register("g2_batch_group_shuffle", f"""
WITH p AS {POS_SQL}, n AS (SELECT count(*) AS n FROM p),
g AS (SELECT doc_id, pos, pos // 32 AS grp,
             row_number() OVER (PARTITION BY pos // 32 ORDER BY {_h('g2', 'doc_id')}, doc_id) - 1 AS r FROM p)
SELECT doc_id, CASE WHEN grp < floor(n / 32) THEN grp * 32 + r ELSE pos END AS new_pos FROM g, n
""")
def g2(spark, sf):
    p = G.sort_by_length(samples(spark, sf).select("doc_id", "audio_length"), "audio_length", "doc_id")
    return G.shuffle_batch_groups(p, "doc_id", 32).select("doc_id", "new_pos")


@register("g3_fixed_batches", f"""
WITH p AS {POS_SQL}, n AS (SELECT count(*) AS n FROM p)
SELECT doc_id, pos // 32 AS batch_id FROM p, n WHERE pos // 32 < floor(n / 32)
""")
def g3(spark, sf):
    p = G.sort_by_length(samples(spark, sf).select("doc_id", "audio_length"), "audio_length", "doc_id")
    return G.fixed_batches(p, 32, drop_last=True).select("doc_id", "batch_id")


@register("g4_bucket_batching", f"""
WITH p AS (SELECT doc_id, audio_length, row_number() OVER (ORDER BY {_h('g4s', 'doc_id')}, doc_id) - 1 AS sp FROM ({SAMPLES})),
b AS (SELECT *, sp // 80 AS bucket, row_number() OVER (PARTITION BY sp // 80 ORDER BY audio_length, sp) - 1 AS r FROM p),
bb AS (SELECT DISTINCT bucket, r // 8 AS bi FROM b),
sh AS (SELECT bucket, bi, row_number() OVER (PARTITION BY bucket ORDER BY {_h('g4b', 'bucket', 'bi')}, bi) - 1 AS batch_in_bucket FROM bb)
SELECT b.doc_id, b.bucket, sh.batch_in_bucket, b.r % 8 AS row_in_batch
FROM b JOIN sh ON b.bucket = sh.bucket AND b.r // 8 = sh.bi
""")
def g4(spark, sf):
    s = samples(spark, sf).select("doc_id", "audio_length")
    return G.bucket_batches(s, "doc_id", "audio_length", 8, multiplier=10).select(
        "doc_id", "bucket", "batch_in_bucket", "row_in_batch")


G5_SQL = f"""
p AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_h('g5', 'doc_id')}, doc_id) - 1 AS round
      FROM documents),
st AS (SELECT lang, count(*) AS cnt, dense_rank() OVER (ORDER BY lang) - 1 AS class_rank FROM documents GROUP BY lang),
m AS (SELECT min(cnt) AS mn, count(*) AS ncls FROM st),
g AS (SELECT p.doc_id, p.round, CAST(floor(p.round / (8 / m.ncls)) AS BIGINT) AS batch_id, st.class_rank
      FROM p JOIN st ON p.lang = st.lang, m WHERE p.round < m.mn)"""


@register("g5_class_balanced", f"WITH {G5_SQL} SELECT doc_id, round, batch_id, class_rank FROM g")
def g5(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return G.class_balanced_batches(d, "doc_id", "lang", 8).select("doc_id", "round", "batch_id", "class_rank")


@register("g5_rotating_classes", f"""
WITH p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_h('g5r', 'doc_id')}, doc_id) - 1 AS place FROM documents),
st AS (SELECT source, count(*) AS cnt, row_number() OVER (ORDER BY source) - 1 AS class_rank FROM documents GROUP BY source),
b AS (SELECT unnest(range((SELECT count(*) FROM documents) // 10 + 1)) AS batch_id),
c AS (SELECT batch_id, class_rank FROM b, st QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY {_h('g5r-class', 'batch_id', 'class_rank')}, class_rank) <= 5),
u AS (SELECT *, row_number() OVER (PARTITION BY class_rank ORDER BY batch_id) - 1 AS nth FROM c),
l AS (SELECT u.*, greatest(0, least(2, cnt - nth * 2)) AS lft FROM u JOIN st USING (class_rank)),
e AS (SELECT batch_id AS stop, min(lft) AS rounds FROM l WHERE lft < 2 GROUP BY batch_id ORDER BY batch_id LIMIT 1)
SELECT p.doc_id, u.batch_id, p.place % 2 AS round, st.class_rank
FROM p JOIN st ON st.source = p.source JOIN u ON u.class_rank = st.class_rank AND u.nth = p.place // 2, e
WHERE u.batch_id < stop OR (u.batch_id = stop AND p.place % 2 < rounds)
""")
def g5r(spark, sf):
    """Batches of ten from five of the twenty sources, drawn anew for every batch."""
    d = table(spark, sf, "documents").select("doc_id", "source")
    return G.rotating_class_batches(d, "doc_id", "source", 10, 5).select("doc_id", "batch_id", "round", "class_rank")


@register("g6_regroup_batch", f"""WITH {G5_SQL}
SELECT doc_id, batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY class_rank, round) - 1 AS pos_in_batch FROM g
""")
def g6(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    b = G.class_balanced_batches(d, "doc_id", "lang", 8)
    return G.order_in_batch(b, "batch_id", ["class_rank", "round"]).select("doc_id", "batch_id", "pos_in_batch")


@register("g7_grouped_length_order", f"""
WITH n AS (SELECT count(*) AS n FROM documents),
p AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY {_h('g7', 'doc_id')}, doc_id) - 1 AS sp FROM documents),
m AS (SELECT p.*, sp // greatest(1, n // 100) AS megabatch FROM p, n)
SELECT doc_id, megabatch, row_number() OVER (ORDER BY megabatch, n_chars DESC, sp) - 1 AS pos FROM m
""")
def g7(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return G.grouped_length_order(d, "doc_id", "n_chars").select("doc_id", "megabatch", "pos")


@register("g8_sort_batch_by_tokens", f"""
WITH p AS {POS_SQL}
SELECT doc_id, pos // 32 AS batch_id,
       row_number() OVER (PARTITION BY pos // 32 ORDER BY text_length DESC, pos) - 1 AS pos_in_batch FROM p
""")
def g8(spark, sf):
    p = G.sort_by_length(samples(spark, sf).select("doc_id", "audio_length", "text_length"), "audio_length",
                         "doc_id")
    b = G.fixed_batches(p, 32)
    return G.order_in_batch(b, "batch_id", [F.col("text_length").desc(), F.col("pos")]).select(
        "doc_id", "batch_id", "pos_in_batch")


@register("g9_sorted_index", f"""
SELECT doc_id, row_number() OVER (ORDER BY text_length, doc_id) - 1 AS pos FROM ({SAMPLES})
""")
def g9(spark, sf):
    s = samples(spark, sf).select("doc_id", "text_length")
    return with_position(s, ["text_length", "doc_id"]).select("doc_id", "pos")


@register("g10_top_k", """
SELECT source AS speaker_name, doc_id, n_chars, rank FROM (
  SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank
  FROM documents) WHERE rank <= 3
""")
def g10(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("speaker_name"), "doc_id", "n_chars")
    return G.top_k(d, "speaker_name", F.col("n_chars"), 3, "doc_id").select("speaker_name", "doc_id", "n_chars",
                                                                            F.col("rank"))


@register("g11_first_seen_ordinal", """
WITH f AS (SELECT source, min(doc_id) AS first FROM documents GROUP BY source),
ids AS (SELECT source, row_number() OVER (ORDER BY first, source) - 1 AS first_seen_id FROM f)
SELECT d.doc_id, ids.first_seen_id, (row_number() OVER (ORDER BY d.doc_id) - 1) // 2 + 1 AS pair_speaker
FROM documents d JOIN ids ON d.source = ids.source
""")
def g11(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    f = G.first_seen_ids(d, "source", "doc_id")
    p = with_position(f, ["doc_id"], "pos")
    return p.select("doc_id", "first_seen_id", (F.expr("pos div 2") + 1).alias("pair_speaker"))


# ---------------------------------------------------------------- G12
SR = 22050
SAMPLES_PER_CHAR = 1323   # 0.06 s at 22050 Hz


def timed_words(spark, sf):
    """Word tables from ``conversations``: one file per (conv_id, turn)."""
    c = table(spark, sf, "conversations")
    w = c.select("conv_id", "turn", F.posexplode(F.split("text", " ", -1)).alias("idx", "piece"))
    w = w.withColumn("word", F.concat(F.lit(" "), F.col("piece"))).withColumn("wlen", F.length("word"))
    f = Window.partitionBy("conv_id", "turn").orderBy("idx")
    before = F.coalesce(F.sum("wlen").over(f.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    w = w.withColumn("start", before * 0.06).withColumn("end", F.col("start") + F.col("wlen") * 0.05)
    tot = F.sum("wlen").over(Window.partitionBy("conv_id", "turn"))
    return w.withColumn("n_samples", tot * SAMPLES_PER_CHAR)


def sentence_segments(words, rate: int = SR, buffer: float = 0.2):
    """Sentences from timed words (see module docs of the operator)."""
    f = Window.partitionBy("conv_id", "turn").orderBy("idx")
    closer = F.substring("word", -1, 1).isin("!", ".", "?")
    w = (words.withColumn("_close", closer.cast("int"))
         .withColumn("sid", F.coalesce(F.sum("_close").over(f.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
         .withColumn("_prev_end", F.lag("end").over(f))
         .withColumn("_next_start", F.lead("start").over(f)))
    g = w.groupBy("conv_id", "turn", "sid").agg(
        F.min("idx").alias("_s"),
        F.max_by(F.col("_close"), F.col("idx")).alias("_closed"),
        F.min_by(F.col("start"), F.col("idx")).alias("_first_start"),
        F.min_by(F.col("_prev_end"), F.col("idx")).alias("_pe"),
        F.max_by(F.col("end"), F.col("idx")).alias("_last_end"),
        F.max_by(F.col("_next_start"), F.col("idx")).alias("_ns"),
        F.first("n_samples").alias("_n"),
        F.array_sort(F.collect_list(F.struct("idx", "word"))).alias("_ws"))
    g = g.where(F.col("_closed") == 1)
    start = F.when(F.col("_s") == 0, F.greatest(F.col("_first_start") - buffer, F.lit(0.0))).otherwise(
        F.greatest(F.col("_first_start") - buffer, (F.col("_pe") + F.col("_first_start")) / 2))
    nxt = F.coalesce(F.col("_ns"), (F.col("_n") - 1) / F.lit(float(rate)))
    end = F.least((F.col("_last_end") + nxt) / 2, F.col("_last_end") + buffer)
    g = g.withColumn("start", start).withColumn("end", end)
    a = F.least(F.floor(F.col("start") * rate), F.col("_n"))
    b = F.least(F.floor(F.col("end") * rate), F.col("_n"))
    g = g.withColumn("n_clip", F.greatest(b - a, F.lit(0)))
    text = F.array_join(F.transform("_ws", lambda x: x["word"]), "")
    g = g.withColumn("text", F.substring(text, 2, 1 << 30))   # first character (the leading space) cut
    return g.where(F.col("n_clip") >= rate / 3.0).select(
        "conv_id", "turn", F.col("sid").alias("sent_idx"), F.round("start", 6).alias("start"),
        F.round("end", 6).alias("end"), "text")


@register("g12_sentence_segments", f"""
WITH w0 AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS piece,
                   unnest(generate_series(0, len(string_split(text, ' ')) - 1)) AS idx FROM conversations),
w1 AS (SELECT *, ' ' || piece AS word, length(piece) + 1 AS wlen FROM w0),
w2 AS (SELECT *, coalesce(sum(wlen) OVER (PARTITION BY conv_id, turn ORDER BY idx
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 0.06::DOUBLE AS start,
              sum(wlen) OVER (PARTITION BY conv_id, turn) * {SAMPLES_PER_CHAR} AS n_samples FROM w1),
w3 AS (SELECT *, start + wlen * 0.05::DOUBLE AS "end", CASE WHEN right(word, 1) IN ('!', '.', '?') THEN 1 ELSE 0 END AS cl
       FROM w2),
w4 AS (SELECT *, coalesce(sum(cl) OVER (PARTITION BY conv_id, turn ORDER BY idx
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sid,
              lag("end") OVER (PARTITION BY conv_id, turn ORDER BY idx) AS pe,
              lead(start) OVER (PARTITION BY conv_id, turn ORDER BY idx) AS ns FROM w3),
g AS (SELECT conv_id, turn, sid, min(idx) AS s, arg_max_null(cl, idx) AS closed, arg_min_null(start, idx) AS fs,
             arg_min_null(pe, idx) AS pe, arg_max_null("end", idx) AS le, arg_max_null(ns, idx) AS ns, first(n_samples) AS n,
             string_agg(word, '' ORDER BY idx) AS t
      FROM w4 GROUP BY conv_id, turn, sid),
h AS (SELECT *, CASE WHEN s = 0 THEN greatest(fs - 0.2, 0.0) ELSE greatest(fs - 0.2, (pe + fs) / 2) END AS st,
             least((le + coalesce(ns, (n - 1) / {SR}.0::DOUBLE)) / 2, le + 0.2) AS en FROM g WHERE closed = 1)
SELECT conv_id, turn, CAST(sid AS BIGINT) AS sent_idx, round(st, 6) AS start, round(en, 6) AS "end", substr(t, 2) AS text
FROM h WHERE greatest(least(floor(en * {SR}), n) - least(floor(st * {SR}), n), 0) >= {SR} / 3.0
""")
def g12(spark, sf):
    return sentence_segments(timed_words(spark, sf))


SERIES_TOKENS = """(SELECT user_id, event_id, ts, event_id % 2 AS tok,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)"""


@register("g13_trailing_run_trim", f"""
WITH s AS {SERIES_TOKENS},
g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, tok = 0 ORDER BY ts, event_id) AS grp FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, tok = 0, grp ORDER BY ts, event_id) AS run FROM g)
SELECT user_id, CAST(coalesce(min(i) FILTER (WHERE tok = 0 AND run > 3), count(*)) AS BIGINT) AS trim_at
FROM r GROUP BY user_id
""")
def g13(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "event_id", "ts", F.pmod("event_id", F.lit(2)).alias("tok"))
    return C.trim_points(C.indexed(ev, "user_id", ["ts", "event_id"]), "user_id", "i", "tok", 0, 3)


@register("g14_interpolate_missing", """
WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i,
                  CASE WHEN event_id % 5 = 0 THEN -1
                       ELSE (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)) * 3 + event_id % 3 END AS a
           FROM events),
k AS (SELECT *, max(CASE WHEN a <> -1 THEN i END) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pi,
             min(CASE WHEN a <> -1 THEN i END) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ni,
             count(*) OVER (PARTITION BY user_id) AS n FROM s),
v AS (SELECT k.*, p.a AS pv, q.a AS nv FROM k LEFT JOIN s p ON p.user_id = k.user_id AND p.i = k.pi
                                        LEFT JOIN s q ON q.user_id = k.user_id AND q.i = k.ni)
SELECT user_id, i, CAST(CASE WHEN a <> -1 THEN a
       ELSE floor(((i - coalesce(pi + 1, 0) + 1) * (coalesce(nv, 500) - coalesce(pv, 500)))::DOUBLE
                  / (coalesce(ni, n) - coalesce(pi + 1, 0) + 1))
            + coalesce(pv, 500) END AS BIGINT) AS filled
FROM v
""")
def g14(spark, sf):
    s = C.indexed(table(spark, sf, "events").select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"]).select(
        "user_id", "i", F.when(F.pmod("event_id", F.lit(5)) == 0, F.lit(-1))
        .otherwise((F.col("i") + 1) * 3 + F.pmod("event_id", F.lit(3))).cast("long").alias("a"))
    return C.interpolate_missing(s, "user_id", "i", "a", 500)


@register("g15_head", """
SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 25
""")
def g15(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "n_chars").orderBy("doc_id").limit(25)


# ---------------------------------------------------------------- I
IDS_SQL = "list_transform(string_split(text, ' '), lambda w: CAST(length(w) AS BIGINT))"


def word_ids(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.transform(F.split("text", " ", -1), lambda w: F.length(w).cast("bigint")).alias("ids"))


BATCH_SQL = f"(SELECT doc_id, doc_id // 8 AS batch_id, {IDS_SQL} AS ids FROM documents)"


@register("i1_pad_batch", f"""
WITH b AS {BATCH_SQL}, m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS batch_max FROM b)
SELECT doc_id, batch_max, list_resize(ids, batch_max, 0) AS padded FROM m
""")
def i1(spark, sf):
    b = word_ids(spark, sf).withColumn("batch_id", F.expr("doc_id div 8"))
    return I.pad_batch(b, "batch_id", "ids").select("doc_id", F.col("batch_max").cast("bigint"), "padded")


@register("i2_pad_to_multiple", f"""
WITH b AS {BATCH_SQL}, m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS mx FROM b)
SELECT doc_id, mx + ((-mx) % 5 + 5) % 5 AS batch_max, len(list_resize(ids, mx + ((-mx) % 5 + 5) % 5, 0)) AS padded_len FROM m
""")
def i2(spark, sf):
    b = word_ids(spark, sf).withColumn("batch_id", F.expr("doc_id div 8"))
    p = I.pad_batch(b, "batch_id", "ids", multiple=5)
    return p.select("doc_id", F.col("batch_max").cast("bigint"), F.size("padded").cast("bigint").alias("padded_len"))


@register("i3_stop_targets", f"""
WITH b AS {BATCH_SQL},
m AS (SELECT doc_id, len(ids) AS l, max(len(ids)) OVER (PARTITION BY batch_id) AS mx FROM b),
p AS (SELECT doc_id, l, mx + ((-mx) % 5 + 5) % 5 AS pl FROM m),
s AS (SELECT doc_id, list_concat(list_resize([]::DOUBLE[], l - 1, 0.0::DOUBLE), list_resize([]::DOUBLE[], pl - l + 1, 1.0::DOUBLE)) AS stop FROM p)
SELECT doc_id, stop, list_transform(range(len(stop) // 5),
       lambda g: CASE WHEN list_bool_or(list_transform(stop[g * 5 + 1: g * 5 + 5], lambda v: v > 0)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS reduced
FROM s
""")
def i3(spark, sf):
    b = word_ids(spark, sf).withColumn("batch_id", F.expr("doc_id div 8"))
    p = I.pad_batch(b, "batch_id", "ids", multiple=5)
    st = I.stop_targets(F.size("ids"), F.col("batch_max"))
    return p.select("doc_id", st.alias("stop")).select("doc_id", "stop", I.reduce_stop_targets("stop", 5)
                                                        .alias("reduced"))


@register("i4_sequence_mask", f"""
WITH b AS {BATCH_SQL}, m AS (SELECT doc_id, len(ids) AS l, max(len(ids)) OVER (PARTITION BY batch_id) AS mx FROM b)
SELECT doc_id, list_transform(range(mx), lambda i: i < l) AS mask FROM m
""")
def i4(spark, sf):
    b = word_ids(spark, sf).withColumn("batch_id", F.expr("doc_id div 8"))
    p = I.pad_batch(b, "batch_id", "ids")
    return p.select("doc_id", I.sequence_mask(F.size("ids"), F.col("batch_max")).alias("mask"))


@register("i5_relative_length", f"""
WITH b AS {BATCH_SQL}
SELECT doc_id, len(ids) / max(len(ids)) OVER (PARTITION BY batch_id) AS rel FROM b
""")
def i5(spark, sf):
    b = word_ids(spark, sf).withColumn("batch_id", F.expr("doc_id div 8"))
    p = I.pad_batch(b, "batch_id", "ids")
    return p.select("doc_id", (F.size("ids") / F.col("batch_max")).alias("rel"))


@register("i6_pad_or_truncate", f"""
SELECT doc_id, list_resize({IDS_SQL}, 50, 0) AS fixed FROM documents
""")
def i6(spark, sf):
    return word_ids(spark, sf).select("doc_id", I.pad_or_truncate("ids", 50).alias("fixed"))


@register("i7_trim_to_multiple", f"""
SELECT doc_id, ids[1: len(ids) - len(ids) % 4] AS trimmed FROM (SELECT doc_id, {IDS_SQL} AS ids FROM documents)
""")
def i7(spark, sf):
    return word_ids(spark, sf).select("doc_id", I.trim_to_multiple("ids", 4).alias("trimmed"))


@register("i8_edge_pad_frames", """
SELECT vec_id, list_concat(embedding, list_resize([]::FLOAT[], 5, embedding[len(embedding)]))[1: (len(embedding) // 5 + 1) * 5] AS audio
FROM embeddings
""")
def i8(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", I.edge_pad_frames("embedding", F.expr("size(embedding) div 5 + 1"), 5).alias("audio"))


@register("i9_pad_short_clips", """
SELECT user_id, list_resize(list(value ORDER BY ts, event_id), 80, 0.0) AS clip FROM events GROUP BY user_id
""")
def i9(spark, sf):
    from vocable.plans.catalog.vectors import series
    head = series(spark, sf).where(F.col("i") < 80).groupBy("user_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("x"))
    return head.select("user_id", I.pad_or_truncate("x", 80, 0.0).alias("clip"))


I10_SQL = """WITH t AS (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda w: CAST(length(w) AS BIGINT)) AS r
           FROM conversations),
c AS (SELECT max(len(r)) AS mc FROM t),
m AS (SELECT conv_id, list(r ORDER BY turn) AS m FROM t GROUP BY conv_id)"""


@register("i10_pad_2d", f"""{I10_SQL}
SELECT conv_id, list_concat(list_transform(m, lambda r: list_resize(r, mc, 0)),
                            list_transform(range(mr - len(m)), lambda i: list_resize([]::BIGINT[], mc, 0))) AS padded
FROM m, c, (SELECT max(len(m)) AS mr FROM m) r
""")
def i10(spark, sf):
    c = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.transform(F.split("text", " ", -1), lambda w: F.length(w).cast("bigint")).alias("r"))
    mc = c.agg(F.max(F.size("r")).alias("mc"))
    m = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "r"))).alias("_m"))
    m = m.select("conv_id", F.transform("_m", lambda x: x["r"]).alias("m"))
    from vocable.operators.common import attach_scalars
    mr = c.groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("k")).agg(F.max("k").alias("mr"))
    m = attach_scalars(attach_scalars(m, mc), mr)
    return m.select("conv_id", _pad2d_dynamic(F.col("m"), F.col("mr"), F.col("mc")).alias("padded"))


def _pad2d_dynamic(m, rows, cols):
    padded_rows = F.transform(m, lambda r: I.pad_to(r, cols, 0))
    empty = F.array_repeat(F.lit(0).cast("bigint"), cols)
    guard = F.when(F.size(m) <= rows, F.lit(True)).otherwise(F.raise_error(F.lit("negative padding")))
    return F.when(guard, F.concat(padded_rows, F.array_repeat(empty, rows - F.size(m))))


@register("i11_adjacent_diff", f"""
SELECT doc_id, list_transform(range(1, len(ids)), lambda i: ids[i + 1] - ids[i]) AS diff
FROM (SELECT doc_id, {IDS_SQL} AS ids FROM documents)
""")
def i11(spark, sf):
    return word_ids(spark, sf).select("doc_id", I.adjacent_diff("ids").alias("diff"))


@register("i12_bos_eos_blank", f"""
SELECT doc_id, list_concat([1::BIGINT], ids, [2::BIGINT]) AS with_bos_eos,
       list_concat([0::BIGINT], flatten(list_transform(ids, lambda x: [x, 0::BIGINT]))) AS interspersed
FROM (SELECT doc_id, {IDS_SQL} AS ids FROM documents)
""")
def i12(spark, sf):
    return word_ids(spark, sf).select("doc_id", I.add_bos_eos("ids", 1, 2).alias("with_bos_eos"),
                                      I.intersperse("ids", 0).alias("interspersed"))


@register("i13_shifted_pair", f"""
SELECT doc_id, list_concat([1000::BIGINT], ids) AS inp, list_concat(ids, [1001::BIGINT]) AS tgt
FROM (SELECT doc_id, {IDS_SQL} AS ids FROM documents)
""")
def i13(spark, sf):
    inp, tgt = I.shifted_pair("ids", 1000, 1001)
    return word_ids(spark, sf).select("doc_id", inp.alias("inp"), tgt.alias("tgt"))


@register("i14_replace_tail", f"""
SELECT doc_id, list_transform(range(len(ids)), lambda i: CASE WHEN i >= len(ids) // 2 THEN 999 ELSE ids[i + 1] END) AS out
FROM (SELECT doc_id, {IDS_SQL} AS ids FROM documents)
""")
def i14(spark, sf):
    return word_ids(spark, sf).select("doc_id", I.replace_tail("ids", F.expr("size(ids) div 2"), 999).alias("out"))
