"""L (signal and alignment tables) and M (evaluation)."""

from pyspark.sql import functions as F

from vocable.functions.hashing import sql_hash52, sql_uniform
from vocable.operators import clips as C
from vocable.operators import evalm as M
from vocable.operators import signal as L
from vocable.operators.common import attach_scalars, let
from vocable.plans.catalog.stats import E6_V
from vocable.plans.catalog.vectors import SERIES_SQL, series, series_lengths
from vocable.plans.registry import register
from vocable.sources.tables import table

SHORT_SQL = "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"


def short_clips(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def _sum(a):
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)


def _lsum(a):
    return F.aggregate(a, F.lit(0).cast("long"), lambda acc, v: acc + v)


SERIES_LONG_SQL = """(SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i,
                      value AS x FROM events)"""


@register("l1_peak_normalise", f"""
WITH s AS {SHORT_SQL}, p AS (SELECT vec_id, x, list_max(list_transform(x, lambda v: abs(v))) AS peak FROM s)
SELECT vec_id, round(list_sum(list_transform(x, lambda v: v / peak * 0.95)), 6) AS y_sum,
       CAST(list_sum(list_transform(x, lambda v: CAST(trunc(v * 32767 / greatest(0.01, peak)) AS BIGINT))) AS BIGINT) AS i16_sum
FROM p
""")
def l1(spark, sf):
    s = short_clips(spark, sf)
    i16 = F.transform(L.to_int16_peak("x"), lambda v: v.cast("long"))
    return s.select("vec_id", F.round(_sum(L.peak_normalise("x")), 6).alias("y_sum"), _lsum(i16).alias("i16_sum"))


@register("l2_rms_normalise", f"""
WITH s AS {SHORT_SQL},
g AS (SELECT vec_id, x, pow(10.0, (-27.0 - 20 * log10(sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)))) / 20) AS gain FROM s),
y AS (SELECT vec_id, list_transform(x, lambda v: v * gain) AS y FROM g)
SELECT vec_id, round(sqrt(list_sum(list_transform(y, lambda v: v * v)) / len(y)), 6) AS rms_after,
       round(list_sum(y), 6) AS y_sum FROM y
""")
def l2(spark, sf):
    y = short_clips(spark, sf).select("vec_id", L.rms_normalise("x", -27.0).alias("y"))
    return y.select("vec_id", F.round(L.rms("y"), 6).alias("rms_after"), F.round(_sum(F.col("y")), 6).alias("y_sum"))


@register("l3_preemphasis", f"""
SELECT vec_id, list_transform(range(len(x)), lambda i: round(CASE WHEN i = 0 THEN x[1] ELSE x[i + 1] - 0.97 * x[i] END, 6)) AS y
FROM {SHORT_SQL}
""")
def l3(spark, sf):
    s = short_clips(spark, sf)
    return s.select("vec_id", F.transform(L.preemphasis("x"), lambda v: F.round(v, 6)).alias("y"))


DB_SQL = f"""(SELECT user_id, list_transform(x, lambda v: 20 * log10(greatest(1e-8, v))) AS db FROM {SERIES_SQL})"""


def _one(values):
    """A value-wise operator on a column of single values."""
    return F.element_at(values, 1)


def decibels(spark, sf):
    """One row per sample: no clip is gathered for what is done value by value."""
    return table(spark, sf, "events").select("user_id", _one(L.amp_to_db(F.array("value"))).alias("db"))


@register("l4_amp_db", f"""
SELECT user_id, round(list_sum(db), 4) AS db_sum, round(list_sum(list_transform(db, lambda d: pow(10.0, d / 20))), 4) AS amp_sum
FROM {DB_SQL}
""")
def l4(spark, sf):
    d = decibels(spark, sf)
    return d.groupBy("user_id").agg(F.round(F.sum("db"), 4).alias("db_sum"), F.round(F.sum(_one(L.db_to_amp(F.array("db")))), 4).alias("amp_sum"))


@register("l5_range_normalise", f"""
SELECT user_id, round(list_sum(list_transform(db, lambda s: greatest(-4.0, least(4.0, 8.0 * ((s - 20.0 + 100.0) / 100.0) - 4.0)))), 6) AS norm_sum
FROM {DB_SQL}
""")
def l5(spark, sf):
    return decibels(spark, sf).groupBy("user_id").agg(F.round(F.sum(_one(L.range_normalise(F.array("db")))), 6).alias("norm_sum"))


@register("l6_meanvar_scale", """
WITH l AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(generate_series(0, len(embedding) - 1)) AS b FROM embeddings),
st AS (SELECT b, avg(x) AS m, stddev_pop(x) AS s FROM l GROUP BY b)
SELECT vec_id, round(sum((x - m) / s), 4) AS scaled_sum FROM l JOIN st USING (b) GROUP BY vec_id
""")
def l6(spark, sf):
    s = short_clips(spark, sf)
    lf = s.select("vec_id", F.posexplode("x").alias("b", "x"))
    st = lf.groupBy("b").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    j = lf.join(F.broadcast(st), "b")   # one row per bin: bounded by the vector dimension
    return j.groupBy("vec_id").agg(F.round(F.sum((F.col("x") - F.col("m")) / F.col("s")), 4).alias("scaled_sum"))


@register("l6_zero_preserving_scale", f"""
WITH v AS (SELECT event_id, {E6_V} AS v FROM events),
st AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM v WHERE v <> 0)
SELECT event_id, round(CASE WHEN v = 0 THEN 0.0 ELSE (v - m) / s END, 6) AS scaled FROM v, st
""")
def l6z(spark, sf):
    v = table(spark, sf, "events").select("event_id", F.expr(E6_V).alias("v"))
    st = v.where(F.col("v") != 0).agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    y = attach_scalars(v, st)
    return y.select("event_id", F.round(F.when(F.col("v") == 0, F.lit(0.0))
                                        .otherwise((F.col("v") - F.col("m")) / F.col("s")), 6).alias("scaled"))


@register("l7_mulaw_quantise", f"""
WITH c AS (SELECT vec_id, list_transform(x, lambda v: greatest(-1.0, least(1.0, v * 3.0))) AS c FROM {SHORT_SQL})
SELECT vec_id,
       list_transform(c, lambda v: CAST(floor((sign(v) * ln(1 + 255.0 * abs(v)) / ln(256.0) + 1) / 2 * 255.0 + 0.5) AS BIGINT)) AS mulaw,
       round(list_sum(list_transform(c, lambda v: (v + 1.0) * 65535 / 2)), 4) AS q16_sum
FROM c
""")
def l7(spark, sf):
    s = short_clips(spark, sf).select("vec_id", F.transform("x", lambda v: F.greatest(F.lit(-1.0), F.least(
        F.lit(1.0), v * 3.0))).alias("c"))
    return s.select("vec_id", L.mulaw_encode("c", 8).alias("mulaw"),
                    F.round(_sum(L.quantize("c", 16)), 4).alias("q16_sum"))


@register("l8_silence_endpoint", f"""
WITH s AS {SERIES_SQL},
q AS (SELECT user_id, len(x) AS n, list_filter(range(2, len(x) - 8, 2), lambda st: list_max(x[st + 1: st + 8]) < 20.0) AS quiet FROM s)
SELECT user_id, CAST(CASE WHEN len(quiet) > 0 THEN quiet[1] + 2 ELSE n END AS INTEGER) AS endpoint FROM q
""")
def l8(spark, sf):
    e = C.silence_endpoints(series(spark, sf), "user_id", "i", "x", 8, 20.0)
    return e.select("user_id", F.col("endpoint").cast("int").alias("endpoint"))


@register("l9_frame_energy", f"""
SELECT user_id, i // 8 AS frame, round(sqrt(sum(x * x)), 6) AS energy FROM {SERIES_LONG_SQL} GROUP BY user_id, i // 8
""")
def l9(spark, sf):
    s = series(spark, sf)
    return s.groupBy("user_id", F.expr("i div 8").alias("frame")).agg(
        F.round(F.sqrt(F.sum(F.col("x") * F.col("x"))), 6).alias("energy"))


FOLD_T, FOLD_O = 16, 6
FOLD_SQL = f"""
f0 AS (SELECT user_id, x, len(x) AS t, (len(x) - {FOLD_O}) // {FOLD_T + FOLD_O} AS nf FROM {SERIES_SQL}),
f1 AS (SELECT user_id, x, t - (nf * {FOLD_T + FOLD_O} + {FOLD_O}) AS rem, nf FROM f0),
f2 AS (SELECT user_id, CASE WHEN rem <> 0 THEN nf + 1 ELSE nf END AS nf,
              list_concat(x, list_resize([]::DOUBLE[], CASE WHEN rem <> 0 THEN greatest({FOLD_T + 2 * FOLD_O} - rem, 0) ELSE 0 END, 0.0::DOUBLE)) AS xp
       FROM f1),
folds AS (SELECT user_id, fi, xp[fi * {FOLD_T + FOLD_O} + 1: fi * {FOLD_T + FOLD_O} + {FOLD_T + 2 * FOLD_O}] AS fold
          FROM (SELECT user_id, xp, unnest(range(nf)) AS fi FROM f2))"""


def folds(spark, sf):
    return C.folds(series(spark, sf), "user_id", "i", "x", FOLD_T, FOLD_O)


@register("l12_fold_with_overlap", f"WITH {FOLD_SQL} SELECT user_id, CAST(fi AS INTEGER) AS fold_idx, fold FROM folds")
def l12(spark, sf):
    return folds(spark, sf)


@register("l13_overlap_add", f"""WITH {FOLD_SQL},
e AS (SELECT user_id, fi, unnest(fold) AS v, unnest(range(len(fold))) AS j FROM folds),
g AS (SELECT user_id, fi * {FOLD_T + FOLD_O} + j AS pos,
             v * CASE WHEN j < {FOLD_O} THEN (CASE WHEN j < {FOLD_O // 2} THEN 0.0
                                             ELSE sqrt(0.5 * (1 + (CASE WHEN j - {FOLD_O // 2} = {FOLD_O - FOLD_O // 2 - 1} THEN 1.0
                                                                   ELSE -1.0 + (j - {FOLD_O // 2}) * (2.0 / {FOLD_O - FOLD_O // 2 - 1}) END))) END)
                      WHEN j >= {FOLD_T + FOLD_O} THEN (CASE WHEN j - {FOLD_T + FOLD_O} >= {FOLD_O - FOLD_O // 2} THEN 0.0
                                             ELSE sqrt(0.5 * (1 - (CASE WHEN j - {FOLD_T + FOLD_O} = {FOLD_O - FOLD_O // 2 - 1} THEN 1.0
                                                                   ELSE -1.0 + (j - {FOLD_T + FOLD_O}) * (2.0 / {FOLD_O - FOLD_O // 2 - 1}) END))) END)
                      ELSE 1.0 END AS y FROM e)
SELECT user_id, CAST(pos AS BIGINT) AS pos, round(sum(y), 6) AS y FROM g GROUP BY user_id, pos
""")
def l13(spark, sf):
    f = folds(spark, sf)
    out = L.overlap_add(f, "user_id", "fold_idx", "fold", FOLD_T, FOLD_O)
    return out.select("user_id", F.col("pos").cast("long").alias("pos"), F.round("y", 6).alias("y"))


@register("l10_conditioning_crop", f"""
WITH s AS (SELECT user_id, x, len(x) AS n,
                  20 + CAST(floor({sql_uniform(0, 'l10len', 'user_id')} * 41) AS INTEGER) AS want FROM {SERIES_SQL}),
c AS (SELECT user_id, x, n, CASE WHEN n - want < 0 THEN n // 2 ELSE want END AS length FROM s),
d AS (SELECT user_id, x, length, CAST(floor({sql_uniform(0, 'l10st', 'user_id')} * (n - length + 1)) AS INTEGER) AS start FROM c)
SELECT user_id, list_resize(x[start + 1: start + length], 60, 0.0::DOUBLE) AS x, CAST(length AS INTEGER) AS length, start,
       CAST(start + length AS INTEGER) AS "end" FROM d
""")
def l10(spark, sf):
    from vocable.functions.hashing import uniform
    spans = C.crop_spans(series_lengths(spark, sf), uniform(0, "l10len", F.col("user_id")), uniform(0, "l10st", F.col("user_id")), 20, 60)
    r = C.segments(series(spark, sf), "user_id", "i", "x", spans)
    padded = F.concat("segment", F.array_repeat(F.lit(0.0), F.lit(60) - F.size("segment")))
    return r.select("user_id", padded.alias("x"), "start", "length", (F.col("start") + F.col("length")).alias("end"))


@register("l11_random_segments", f"""
WITH s AS (SELECT user_id, x, CAST(floor({sql_uniform(0, 'l11', 'user_id')} * (len(x) - 16 + 1)) AS INTEGER) AS start
           FROM {SERIES_SQL})
SELECT user_id, start, start * 256 AS audio_start, x[start + 1: start + 16] AS segment FROM s
""")
def l11(spark, sf):
    from vocable.functions.hashing import uniform
    start = F.floor(uniform(0, "l11", F.col("user_id")) * (F.col("n") - 16 + 1)).cast("int")
    spans = series_lengths(spark, sf).select("user_id", start.alias("start"), F.lit(16).alias("length"))
    r = C.segments(series(spark, sf), "user_id", "i", "x", spans)
    return r.select("user_id", "start", (F.col("start") * 256).alias("audio_start"), "segment")


@register("l21_noise_mixing", f"""
WITH c AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
nn AS (SELECT count(*) AS n FROM embeddings),
np AS (SELECT vec_id - 0 AS nid, CAST(embedding AS DOUBLE[]) AS nz, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings),
p AS (SELECT c.vec_id, c.x, {sql_hash52(0, 'l21', 'c.vec_id')} % nn.n AS pos,
             3.0 + {sql_uniform(0, 'l21snr', 'c.vec_id')} * (15.0 - 3.0) AS snr FROM c, nn),
j AS (SELECT p.vec_id, p.x, np.nz, p.snr FROM p JOIN np ON p.pos = np.pos),
g AS (SELECT vec_id, x, nz,
             sqrt(pow(10.0, ((10 * log10(list_sum(list_transform(x, lambda v: v * v)) / len(x) + 1e-4))
                            - (10 * log10(list_sum(list_transform(nz, lambda v: v * v)) / len(nz) + 1e-4)) - snr) / 10)) AS gain
      FROM j)
SELECT vec_id, round(list_sum(list_transform(range(len(x)), lambda i: x[i + 1] + nz[i + 1] * gain)), 4) AS mixed_sum FROM g
""")
def l21(spark, sf):
    e = short_clips(spark, sf)
    m = L.mix_noise(e, e.select(F.col("vec_id").alias("nid"), F.col("x").alias("nz")), "vec_id", "x", "nid", "nz",
                    3.0, 15.0)
    return m.select("vec_id", F.round(_sum(F.col("mixed")), 4).alias("mixed_sum"))


@register("l22_dither_and_mono", f"""
WITH s AS (SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS x, CAST(b.embedding AS DOUBLE[]) AS y
           FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id,
       round(list_sum(list_transform(range(len(x)), lambda i: x[i + 1] + {sql_uniform(0, 'l22', 'vec_id', 'i')} / 32768.0)), 6) AS dithered_sum,
       round(list_sum(list_transform(range(len(x)), lambda i: (x[i + 1] + y[i + 1]) / 2)), 6) AS mono_sum
FROM s
""")
def l22(spark, sf):
    e = short_clips(spark, sf)
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    j = e.join(nxt, "vec_id")
    return j.select("vec_id", F.round(_sum(L.dither("x", F.col("vec_id"))), 6).alias("dithered_sum"),
                    F.round(_sum(L.mono(F.array("x", "y"))), 6).alias("mono_sum"))


RUNS_SQL = f"""runs AS (
  SELECT user_id, min(i) AS start, max(i) + 1 AS "end" FROM (
    SELECT user_id, i, x > 100 AS on_, i - row_number() OVER (PARTITION BY user_id, x > 100 ORDER BY i) AS g
    FROM {SERIES_LONG_SQL}) WHERE on_ GROUP BY user_id, g),
iv AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY start) - 1 AS k, start, "end" FROM runs)"""


def intervals(spark, sf):
    return C.runs_above(series(spark, sf), "user_id", "i", "x", 100.0)


@register("l14_rescale_intervals", f"""WITH {RUNS_SQL}
SELECT user_id, CAST(k AS INTEGER) AS k, CAST(trunc(start * (16000 / 22050.0)) AS BIGINT) AS start,
       CAST(trunc("end" * (16000 / 22050.0)) AS BIGINT) AS "end" FROM iv
""")
def l14(spark, sf):
    iv = intervals(spark, sf).select("user_id", F.col("k").cast("int").alias("k"),
                                     _one(L.rescale_intervals(F.array(F.struct("start", "end")), 16000 / 22050.0)).alias("s"))
    return iv.select("user_id", "k", "s.start", "s.end")


@register("l15_keep_intervals", f"""WITH {RUNS_SQL},
s AS {SERIES_LONG_SQL},
kept AS (SELECT s.user_id, s.x FROM s JOIN iv ON s.user_id = iv.user_id AND s.i >= iv.start AND s.i < iv."end"),
a AS (SELECT user_id, count(*) AS n, sum(x) AS sx FROM kept GROUP BY user_id),
t AS (SELECT user_id, count(*) AS n, sum(x) AS sx FROM s GROUP BY user_id)
SELECT t.user_id, coalesce(a.n, t.n) AS kept_len, round(coalesce(a.sx, t.sx), 6) AS kept_sum, a.n IS NULL AS flagged
FROM t LEFT JOIN a ON t.user_id = a.user_id
""")
def l15(spark, sf):
    x = series(spark, sf)
    k = C.keep_intervals(x, "user_id", "i", "x", C.runs_above(x, "user_id", "i", "x", 100.0))
    return k.groupBy("user_id").agg(F.sum(F.size("kept")).cast("long").alias("kept_len"), F.round(F.sum(_sum(F.col("kept"))), 6).alias("kept_sum"),
                                    F.max("flagged").alias("flagged"))


DUR_SQL = f"""
n AS (SELECT user_id, count(*) AS t FROM events GROUP BY user_id),
tk AS (SELECT user_id, t, unnest(range(t)) AS token FROM n),
c AS (SELECT *, 1 + token % 4 AS d0, sum(1 + token % 4) OVER (PARTITION BY user_id ORDER BY token) AS cum FROM tk),
durs AS (SELECT user_id, token, least(d0, t - (cum - d0)) AS dur, cum - d0 AS lo FROM c WHERE cum - d0 < t)"""


def durations(spark, sf):
    """Durations 1 to 4 for the tokens of each clip until its frames are used up."""
    from vocable.plans.position import keyed_running
    tk = series(spark, sf).select("user_id", F.col("i").alias("token"), (1 + F.pmod("i", F.lit(4))).alias("d0"))
    tk = keyed_running(tk, ["user_id"], ["token"], [("d0", "sum", "cum")]).join(series_lengths(spark, sf), "user_id")
    lo = F.col("cum").cast("long") - F.col("d0")
    return tk.where(lo < F.col("n")).select("user_id", "token", F.least(F.col("d0"), F.col("n") - lo).alias("dur"))


@register("l16_mean_over_durations", f"""WITH {DUR_SQL},
s AS (SELECT user_id, i, {E6_V.replace('value', 'x')} AS x FROM {SERIES_LONG_SQL})
SELECT d.user_id, d.token, round(coalesce(avg(s.x) FILTER (WHERE s.x <> 0), 0.0), 6) AS mean
FROM durs d LEFT JOIN s ON s.user_id = d.user_id AND s.i >= d.lo AND s.i < d.lo + d.dur
GROUP BY d.user_id, d.token
""")
def l16(spark, sf):
    fr = series(spark, sf).withColumn("x", F.expr(E6_V.replace("value", "x")))
    m = C.mean_over_durations(fr, durations(spark, sf), "user_id", "i", "x", "token", "dur")
    return m.select("user_id", "token", F.round("mean", 6).alias("mean"))


@register("l18_path_from_durations", f"""WITH {DUR_SQL}
SELECT user_id, token, CAST(dur AS BIGINT) AS n_frames, CAST(lo AS BIGINT) AS first_frame FROM durs WHERE dur > 0
""")
def l18(spark, sf):
    sp = C.duration_bounds(durations(spark, sf), "user_id", "token", "dur").where("dur > 0")
    return sp.select("user_id", "token", F.col("dur").alias("n_frames"), F.col("lo").alias("first_frame"))


N_FRAMES, N_TOKENS = 32, 32
#: Clips whose cells (a thousand each) one task makes; the number of tasks follows from it.
CLIPS_A_TASK = 2500
ATT_SQL = """att AS (
  SELECT vec_id, f, t, exp(s) / sum(exp(s)) OVER (PARTITION BY vec_id, f) AS p FROM (
    SELECT vec_id, f.f, t.t, embedding[f.f + 1]::DOUBLE * embedding[33 + t.t]::DOUBLE * 10.0 AS s
    FROM embeddings, range(32) f(f), range(32) t(t)))"""


def attention(spark, sf):
    """Alignment matrices: frames = the first 32 values, tokens = the other 32 of
    each embedding; score = a·b·10, softmax over tokens per frame.

    Only the embeddings are shuffled: a frame's cells are made where its vector is, so
    the measures by clip need no shuffle of cells.  Rows that share an id are one clip,
    each frame of which meets the tokens of all."""
    e = table(spark, sf, "embeddings").where("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", "embedding")
    g = e.repartition(e.count() // CLIPS_A_TASK + 1, "vec_id").groupBy("vec_id").agg(F.collect_list("embedding").alias("_e"))
    tokens = F.flatten(F.transform("_e", lambda e: F.transform(F.slice(e, N_FRAMES + 1, N_TOKENS), lambda b, t: F.named_struct(
        F.lit("t"), t, F.lit("b"), b.cast("double")))))
    frames = F.sequence(F.lit(0), F.lit(N_FRAMES - 1))
    fr = g.select("vec_id", "_e", tokens.alias("_tk"), F.explode(frames).alias("f"))
    has = F.filter("_e", lambda e: F.size(e) > F.col("f"))
    values = F.transform(has, lambda e: F.element_at(e, F.col("f") + 1).cast("double"))
    scores = F.flatten(F.transform(values, lambda a: F.transform("_tk", lambda k: F.named_struct(F.lit("t"), k["t"], F.lit("v"), a * k["b"] * 10.0))))

    def powers(sc):
        top = F.array_max(F.transform(sc, lambda c: c["v"]))
        return let(top, lambda m: F.transform(sc, lambda c: F.named_struct(F.lit("t"), c["t"], F.lit("v"), F.exp(c["v"] - m))))

    def shares(ex):
        total = F.aggregate(ex, F.lit(0.0), lambda a, c: a + F.coalesce(c["v"], F.lit(0.0)))
        return let(total, lambda n: F.transform(ex, lambda c: F.named_struct(F.lit("t"), c["t"], F.lit("v"), c["v"] / n)))
    cells = let(let(scores, powers), shares)
    return fr.select("vec_id", "f", F.inline(cells).alias("t", "p"))


@register("l17_durations_from_alignment", f"""WITH {ATT_SQL},
best AS (SELECT vec_id, f, arg_max(t, (p, -t)) AS t FROM att GROUP BY vec_id, f),
cnt AS (SELECT vec_id, t, count(*) AS c FROM best GROUP BY vec_id, t),
tok AS (SELECT vec_id, t.t FROM embeddings, range(32) t(t)),
d AS (SELECT tok.vec_id, tok.t, coalesce(cnt.c, 1) AS d FROM tok LEFT JOIN cnt ON tok.vec_id = cnt.vec_id AND tok.t = cnt.t),
x AS (SELECT *, sum(d) OVER (PARTITION BY vec_id) - 32 AS extra,
             row_number() OVER (PARTITION BY vec_id ORDER BY d DESC, t) AS r FROM d)
SELECT vec_id, t AS token, CAST(d - CASE WHEN r <= extra THEN 1 ELSE 0 END AS BIGINT) AS duration FROM x
""")
def l17(spark, sf):
    att = attention(spark, sf)
    toks = table(spark, sf, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(N_TOKENS - 1))).alias("t"),
                                                 F.lit(N_FRAMES).alias("n_frames"))
    d = L.durations_from_alignment(att, "vec_id", "f", "t", "p", toks)
    return d.select("vec_id", F.col("t").cast("long").alias("token"), "duration")


@register("l19_tail_repair", """
WITH c AS (SELECT user_id, list(event_id % 50 ORDER BY ts, event_id) AS codes FROM events GROUP BY user_id),
p AS (SELECT user_id, codes, list_position(codes, 7) AS fp FROM c),
r AS (SELECT user_id, CASE WHEN fp IS NULL THEN codes ELSE
       list_transform(range(len(codes)), lambda i: CASE WHEN i = len(codes) - 3 THEN 45 WHEN i = len(codes) - 2 THEN 45
                                                   WHEN i = len(codes) - 1 THEN 248
                                                   WHEN i >= fp - 1 THEN 83 ELSE codes[i + 1] END) END AS codes FROM p)
SELECT user_id, block, codes[block * 32 + 1: block * 32 + 32] AS codes
FROM (SELECT user_id, codes, unnest(range((len(codes) + 31) // 32)) AS block FROM r)
""")
def l19(spark, sf):
    """The repaired codes in blocks of 32."""
    ev = C.indexed(table(spark, sf, "events").select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"])
    return C.repair_tail(ev.select("user_id", "i", F.pmod("event_id", F.lit(50)).alias("code")), "user_id", "i", "code", 7, size=32)


@register("l20_redaction_spans", """
WITH t AS (SELECT conv_id, turn, 'Say [' || role || '] ' || text AS t FROM conversations),
p AS (SELECT conv_id, turn, string_split_regex(t, '[\\[\\]]') AS pieces FROM t),
l AS (SELECT conv_id, turn, unnest(range(len(pieces))) AS i, unnest(list_transform(pieces, lambda s: length(s))) AS len FROM p),
s AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM l)
SELECT conv_id, turn, CAST(i // 2 AS INTEGER) AS k, CAST(st AS INTEGER) AS start, CAST(greatest(0, st + len - 1) AS INTEGER) AS "end"
FROM s WHERE i % 2 = 0
""")
def l20(spark, sf):
    c = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.concat(F.lit("Say ["), F.col("role"), F.lit("] "), F.col("text")).alias("t"))
    r = c.select("conv_id", "turn", F.posexplode(L.redaction_spans("t")).alias("k", "s"))
    return r.select("conv_id", "turn", F.col("k").cast("int"), F.col("s.start").cast("int").alias("start"),
                    F.col("s.end").cast("int").alias("end"))


# ---------------------------------------------------------------- M
PT_SQL = """pt AS (SELECT a.vec_id, unnest(a.embedding)::DOUBLE AS p, unnest(b.embedding)::DOUBLE AS t,
                   unnest(range(len(a.embedding))) AS pos, 16 + a.vec_id % 48 AS len
            FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""


def pred_target(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("t"))
    j = e.join(nxt, "vec_id").select("vec_id", F.arrays_zip("embedding", "t").alias("z"),
                                     (16 + F.pmod("vec_id", F.lit(48))).alias("len"))
    lf = j.select("vec_id", "len", F.posexplode("z").alias("pos", "pz"))
    return lf.select("vec_id", "len", "pos", F.col("pz.embedding").cast("double").alias("p"),
                     F.col("pz.t").cast("double").alias("t"))


@register("m1_masked_losses", f"""WITH {PT_SQL},
d AS (SELECT vec_id, p - t AS d FROM pt WHERE pos < len),
per AS (SELECT vec_id, sum(abs(d)) AS l1, sum(d * d) AS l2,
               sum(CASE WHEN abs(d) < 1.0 THEN 0.5 * d * d ELSE abs(d) - 0.5 END) AS hb, count(*) AS n FROM d GROUP BY vec_id)
SELECT round(sum(l1) / sum(n), 6) AS l1, round(sum(l2) / sum(n), 6) AS mse, round(sum(hb) / sum(n), 6) AS huber,
       round(avg(l1 / n), 6) AS l1_seq, round(avg(l2 / n), 6) AS mse_seq FROM per
""")
def m1(spark, sf):
    r = M.masked_losses(pred_target(spark, sf), "vec_id", "pos", "p", "t", "len")
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


@register("m2_minmax_scale", f"""WITH {PT_SQL},
v AS (SELECT vec_id, p FROM pt WHERE pos < len),
mm AS (SELECT vec_id, min(p) AS mn, max(p) AS mx FROM v GROUP BY vec_id)
SELECT vec_id, round(sum((p - mn) / (mx - mn + 1e-8)), 6) AS scaled_sum FROM v JOIN mm USING (vec_id) GROUP BY vec_id
""")
def m2(spark, sf):
    s = M.minmax_scale(pred_target(spark, sf), "vec_id", "pos", "p", "len")
    return s.groupBy("vec_id").agg(F.round(F.sum("scaled"), 6).alias("scaled_sum"))


@register("m3_diagonality", f"""WITH {ATT_SQL}
SELECT round(avg(m), 6) AS diagonality FROM (SELECT vec_id, t, max(p) AS m FROM att GROUP BY vec_id, t)
""")
def m3(spark, sf):
    return M.diagonality(attention(spark, sf), "vec_id", "f", "t", "p").select(
        F.round("diagonality", 6).alias("diagonality"))


@register("m3_diagonality_binary", f"""WITH {ATT_SQL}
SELECT round(avg(m), 6) AS diagonality FROM (SELECT vec_id, t, CAST(max(CASE WHEN p >= 0.05 THEN p ELSE 0 END) > 0 AS INTEGER) AS m FROM att GROUP BY vec_id, t)
""")
def m3_binary(spark, sf):
    """Attention below 0.05 counts as none, the rest as a mask."""
    att = attention(spark, sf).withColumn("p", F.when(F.col("p") >= 0.05, F.col("p")).otherwise(0.0))
    return M.diagonality(att, "vec_id", "f", "t", "p", binary=True).select(F.round("diagonality", 6).alias("diagonality"))


@register("m4_alignment_entropy", f"""WITH {ATT_SQL}
SELECT round(avg(h) / ln(32), 6) AS entropy FROM (SELECT vec_id, f, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) AS h
                                                 FROM att GROUP BY vec_id, f)
""")
def m4(spark, sf):
    return M.alignment_entropy(attention(spark, sf), "vec_id", "f", "t", "p", N_TOKENS).select(
        F.round("entropy", 6).alias("entropy"))


@register("m5_guided_attention", f"""WITH {ATT_SQL}
SELECT round(avg(p * (1 - exp(-((t / 32.0 - f / 32.0) * (t / 32.0 - f / 32.0)) / (2 * 0.4 * 0.4)))), 6) AS guided_attention FROM att
""")
def m5(spark, sf):
    return M.guided_attention(attention(spark, sf), "f", "t", "p", N_FRAMES, N_TOKENS).select(
        F.round("guided_attention", 6).alias("guided_attention"))


@register("m5_guided_attention_masked", f"""WITH {ATT_SQL},
l AS (SELECT *, 16 + vec_id % 17 AS n_f, 8 + vec_id % 25 AS n_t FROM att)
SELECT round(avg(p * (1 - exp(-((t / n_t::DOUBLE - f / n_f::DOUBLE) * (t / n_t::DOUBLE - f / n_f::DOUBLE)) / (2 * 0.4 * 0.4)))), 6) AS guided_attention
FROM l WHERE f < n_f AND t < n_t
""")
def m5_masked(spark, sf):
    """Clips of their own lengths: cells beyond them don't count."""
    att = attention(spark, sf).withColumn("n_f", 16 + F.pmod("vec_id", F.lit(17))).withColumn("n_t", 8 + F.pmod("vec_id", F.lit(25)))
    return M.guided_attention(att, "f", "t", "p", F.col("n_f"), F.col("n_t")).select(F.round("guided_attention", 6).alias("guided_attention"))


@register("m6_spectral_losses", f"""WITH {PT_SQL},
m AS (SELECT abs(p) + 1e-5 AS x, abs(t) + 1e-5 AS y FROM pt)
SELECT round(sqrt(sum((y - x) * (y - x))) / sqrt(sum(y * y)), 6) AS spectral_convergence,
       round(avg(abs(ln(y) - ln(x))), 6) AS log_mag_l1 FROM m
""")
def m6(spark, sf):
    pt = pred_target(spark, sf).select((F.abs("p") + 1e-5).alias("x"), (F.abs("t") + 1e-5).alias("y"))
    r = M.spectral_losses(pt, "x", "y")
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])
