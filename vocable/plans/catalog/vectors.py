"""K (vectors and codes) plus the statistics built on them."""

from pyspark.sql import functions as F

from vocable.functions.hashing import sql_hash52
from vocable.operators import clips as C
from vocable.operators import stats as E
from vocable.operators import vectors as K
from vocable.plans.catalog.stats import EMB_LONG, clip_vectors
from vocable.plans.registry import register
from vocable.sources.tables import table

N_CODES = 16

CB_SQL = f"""cb AS (SELECT vec_id AS cv, row_number() OVER (ORDER BY vec_id) - 1 AS code
              FROM (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT {N_CODES})),
l AS {EMB_LONG},
cbl AS (SELECT c.code, l.pos, l.x AS e FROM cb c JOIN l ON l.vec_id = c.cv),
d AS (SELECT l.vec_id, c.code, sum((l.x - c.e) * (l.x - c.e)) AS dist FROM l JOIN cbl c ON l.pos = c.pos
      GROUP BY l.vec_id, c.code),
asg AS (SELECT vec_id, CAST(arg_min(code, dist) AS INTEGER) AS code FROM d GROUP BY vec_id)"""


def codebook(spark, sf):
    return K.codebook_from_rows(table(spark, sf, "embeddings"), "embedding", "vec_id", N_CODES)


def assigned(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return K.nearest_code(e, "embedding", codebook(spark, sf))


@register("k1_cosine_similarity", """
SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cos,
       round(list_sum(list_transform(CAST(a.embedding AS DOUBLE[]),
             lambda v: v / sqrt(list_sum(list_transform(CAST(a.embedding AS DOUBLE[]), lambda w: w * w)))))
             , 6) AS normalised_sum
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
""")
def k1(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("nxt"))
    j = e.join(nxt, "vec_id")
    norm_sum = F.aggregate(K.l2_normalise("embedding"), F.lit(0.0), lambda a, v: a + v)
    return j.select("vec_id", F.round(K.cosine("embedding", "nxt"), 6).alias("cos"),
                    F.round(norm_sum, 6).alias("normalised_sum"))


K2_BATCH = 100
K2_SQL = f"""
h AS (SELECT vec_id, 'spk' || CAST(label AS VARCHAR) AS name,
             row_number() OVER (PARTITION BY label ORDER BY {sql_hash52(0, 'g5', 'vec_id')}, vec_id) - 1 AS rd FROM embeddings),
mn AS (SELECT min(c) AS c, count(*) AS k FROM (SELECT count(*) AS c FROM embeddings GROUP BY label)),
b AS (SELECT vec_id, CAST(floor(rd / ({K2_BATCH}.0 / mn.k)) AS BIGINT) AS batch_id FROM h, mn WHERE rd < mn.c),
l AS (SELECT b.batch_id, x.* FROM {EMB_LONG} x JOIN b ON b.vec_id = x.vec_id),
cs AS (SELECT batch_id, name AS other, pos, sum(x) AS s, count(*) AS n FROM l GROUP BY batch_id, name, pos),
j AS (SELECT l.batch_id, l.vec_id, l.name, c.other, l.x,
             CASE WHEN l.name = c.other THEN (c.s - l.x) / (c.n - 1) ELSE c.s / c.n END AS c
      FROM l JOIN cs c ON l.pos = c.pos AND l.batch_id = c.batch_id),
k2 AS (SELECT vec_id, name, other,
              greatest(sum(x * c) / (sqrt(sum(x * x)) * sqrt(sum(c * c))), 1e-6) * 10.0 - 5.0 AS score
       FROM j GROUP BY batch_id, vec_id, name, other)"""


def class_batches(spark, sf):
    """Clip vectors in class-balanced batches."""
    from vocable.operators.batching import class_balanced_batches
    return class_balanced_batches(clip_vectors(spark, sf), "vec_id", "name", K2_BATCH)


@register("k2_loo_centroid_scores", f"WITH {K2_SQL} SELECT vec_id, name, other, round(score, 6) AS score FROM k2")
def k2(spark, sf):
    s = K.ge2e_scores(class_batches(spark, sf), "vec_id", "name", "embedding", "batch_id").drop("batch_id")
    return s.withColumn("score", F.round("score", 6))


@register("k3_ge2e_losses", f"""WITH {K2_SQL}
SELECT vec_id, name,
       round(ln(sum(exp(score))) - max(score) FILTER (WHERE name = other), 6) AS softmax_loss,
       round(1.0 - 1.0 / (1.0 + exp(-max(score) FILTER (WHERE name = other)))
             + max(1.0 / (1.0 + exp(-score))) FILTER (WHERE name <> other), 6) AS contrast_loss
FROM k2 GROUP BY vec_id, name
""")
def k3(spark, sf):
    s = K.ge2e_scores(class_batches(spark, sf), "vec_id", "name", "embedding", "batch_id")
    r = K.ge2e_losses(s, "vec_id", "name")
    return r.select("vec_id", "name", F.round("softmax_loss", 6).alias("softmax_loss"),
                    F.round("contrast_loss", 6).alias("contrast_loss"))


@register("k4_prototype_loss", f"""
WITH r AS (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings),
l AS (SELECT l.vec_id, l.name, l.pos, l.x, r.rn FROM {EMB_LONG} l JOIN r ON l.vec_id = r.vec_id),
p AS (SELECT name AS cj, pos, x AS p FROM l WHERE rn = 1),
a AS (SELECT name AS ck, pos, avg(x) AS a FROM l WHERE rn > 1 GROUP BY name, pos),
s AS (SELECT cj, ck, sum(p * a) / (sqrt(sum(p * p)) * sqrt(sum(a * a))) * 10.0 - 5.0 AS score
      FROM p JOIN a ON p.pos = a.pos GROUP BY cj, ck)
SELECT cj AS name, round(ln(sum(exp(score))) - max(score) FILTER (WHERE cj = ck), 6) AS loss FROM s GROUP BY cj
""")
def k4(spark, sf):
    r = K.prototype_loss(clip_vectors(spark, sf), "vec_id", "name", "embedding")
    return r.select("name", F.round("loss", 6).alias("loss"))


@register("k5_nearest_code", f"WITH {CB_SQL} SELECT vec_id, code FROM asg")
def k5(spark, sf):
    return assigned(spark, sf).select("vec_id", "code")


@register("k5_nearest_code_relational", f"WITH {CB_SQL} SELECT vec_id, code FROM asg")
def k5r(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    r = K.nearest_code_sql_form(e, "vec_id", "embedding", codebook(spark, sf))
    return r.select("vec_id", F.col("code").cast("int").alias("code"))


@register("k6_code_to_vector", f"""WITH {CB_SQL}
SELECT a.vec_id, a.code, round(sum(c.e), 6) AS centroid_sum
FROM asg a JOIN cbl c ON a.code = c.code GROUP BY a.vec_id, a.code
""")
def k6(spark, sf):
    v = K.code_vectors(assigned(spark, sf).select("vec_id", "code"), "code", codebook(spark, sf))
    return v.select("vec_id", "code", F.round(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x), 6)
                    .alias("centroid_sum"))


@register("k7_ema_codebook_update", f"""WITH {CB_SQL},
cnt AS (SELECT code, count(*) AS cnt FROM asg GROUP BY code),
sums AS (SELECT a.code, l.pos, sum(l.x) AS s FROM asg a JOIN l ON a.vec_id = l.vec_id GROUP BY a.code, l.pos),
size AS (SELECT cb.code, 0.0::DOUBLE * 0.99::DOUBLE + coalesce(cnt.cnt, 0)::DOUBLE * (1.0::DOUBLE - 0.99::DOUBLE) AS cluster_size
         FROM cb LEFT JOIN cnt ON cb.code = cnt.code),
tot AS (SELECT sum(cluster_size) AS n FROM size),
nrm AS (SELECT code, cluster_size, (cluster_size + 1e-5) / (n + {N_CODES} * 1e-5) * n AS norm FROM size, tot),
av AS (SELECT c.code, c.pos, c.e * 0.99::DOUBLE + coalesce(s.s, 0.0) * (1.0::DOUBLE - 0.99::DOUBLE) AS av
       FROM cbl c LEFT JOIN sums s ON c.code = s.code AND c.pos = s.pos)
SELECT av.code, CAST(av.pos AS BIGINT) AS pos, round(nrm.cluster_size, 6) AS cluster_size, round(av.av / nrm.norm, 4) AS v
FROM av JOIN nrm ON av.code = nrm.code
""")
def k7(spark, sf):
    u = K.ema_update(assigned(spark, sf), "embedding", codebook(spark, sf))
    return u.select(F.col("code").cast("bigint").alias("code"), F.col("pos").cast("long").alias("pos"),
                    F.round("cluster_size", 6).alias("cluster_size"), F.round("v", 4).alias("v"))


@register("k8_reset_codes", f"""WITH {CB_SQL},
u AS (SELECT code, count(*) AS n FROM asg GROUP BY code),
t AS (SELECT count(*) AS total FROM asg),
fl AS (SELECT cb.code FROM cb LEFT JOIN u ON cb.code = u.code, t
       WHERE coalesce(u.n, 0) / t.total > 0.9 OR coalesce(u.n, 0) / t.total < 0.01),
nn AS (SELECT count(*) AS n FROM embeddings),
p AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings),
pk AS (SELECT fl.code, {sql_hash52(0, 'k8', 'fl.code')} % nn.n AS pos FROM fl, nn),
repl AS (SELECT pk.code, p.vec_id FROM pk JOIN p ON pk.pos = p.pos),
newv AS (SELECT r.code, sum(l.x) AS s FROM repl r JOIN l ON l.vec_id = r.vec_id GROUP BY r.code)
SELECT CAST(cb.code AS INTEGER) AS code, round(coalesce(newv.s, (SELECT sum(e) FROM cbl WHERE cbl.code = cb.code)), 6) AS centroid_sum,
       newv.s IS NOT NULL AS reset
FROM cb LEFT JOIN newv ON cb.code = newv.code
""")
def k8(spark, sf):
    usage = E.code_usage(assigned(spark, sf), "code", N_CODES)
    data = table(spark, sf, "embeddings").select("vec_id", "embedding")
    r = K.reset_codes(codebook(spark, sf), usage, data, "vec_id", "embedding")
    return r.select("code", F.round(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x), 6).alias("centroid_sum"),
                    "reset")


def series(spark, sf):
    """Long clips: ``events.value`` per user, numbered by (ts, event_id)."""
    ev = table(spark, sf, "events").select("user_id", "event_id", "ts", F.col("value").alias("x"))
    return C.indexed(ev, "user_id", ["ts", "event_id"])


def series_lengths(spark, sf):
    return C.lengths(table(spark, sf, "events"), "user_id")


SERIES_SQL = "(SELECT user_id, list(value ORDER BY ts, event_id) AS x FROM events GROUP BY user_id)"


@register("k9_window_offsets", f"""
WITH s AS {SERIES_SQL},
o AS (SELECT user_id, len(x) AS n, least(len(x), 20) AS w, unnest(generate_series(0, 9)) AS i FROM s)
SELECT user_id, CAST(i AS INTEGER) AS i,
       CAST(trunc(CASE WHEN i = 9 THEN CAST(n - w AS DOUBLE) ELSE i * (CAST(n - w AS DOUBLE) / 9) END) AS INTEGER) AS offset
FROM o
""")
def k9(spark, sf):
    s = series_lengths(spark, sf)
    return s.select("user_id", F.posexplode(K.window_offsets("n", 20, 10)).alias("i", "offset"))


@register("k10_partial_windows", f"""
WITH s AS (SELECT user_id, len(x) * 40 AS n FROM {SERIES_SQL}),
f AS (SELECT user_id, n, CAST(ceil((n + 1) / 160.0) AS BIGINT) AS nf FROM s),
st AS (SELECT user_id, n, generate_series(0, greatest(1, nf - 12 + 5 + 1) - 1, 5) AS starts FROM f),
k AS (SELECT user_id, CASE WHEN (n - starts[len(starts)] * 160) / (12.0 * 160) < 0.75 AND len(starts) > 1
                           THEN starts[1:len(starts) - 1] ELSE starts END AS starts FROM st)
SELECT user_id, CAST(unnest(starts) AS INTEGER) AS start_frame FROM k
""")
def k10(spark, sf):
    s = series_lengths(spark, sf).select("user_id", (F.col("n") * 40).cast("int").alias("n"))
    return s.select("user_id", F.explode(K.partial_slices("n", 160, 12, 5, 0.75)).alias("start_frame"))


@register("k11_chunked_average", f"""
WITH s AS {SERIES_SQL},
c AS (SELECT user_id, x, unnest(generate_series(0, len(x) - 1, 16)) AS st FROM s),
m AS (SELECT user_id, st, list_avg(x[st + 1: st + 16]) AS cm, len(x[st + 1: st + 16]) AS cl FROM c)
SELECT user_id, round(avg(cm), 6) AS mean_of_chunks, count(*) AS n_chunks FROM m WHERE cl >= 16 * 0.33 GROUP BY user_id
""")
def k11(spark, sf):
    m = C.chunk_means(series(spark, sf), "user_id", "i", "x", 16)
    return m.select("user_id", F.round("mean", 6).alias("mean_of_chunks"), "n_chunks")


@register("k11_first_chunk", f"""
WITH s AS {SERIES_SQL} SELECT user_id, round(list_avg(x[1:16]), 6) AS mean FROM s WHERE len(x[1:16]) >= 16 * 0.33
""")
def k11_first(spark, sf):
    m = C.chunk_means(series(spark, sf), "user_id", "i", "x", 16, first_only=True)
    return m.select("user_id", F.round("mean", 6).alias("mean"))


@register("k11_mean_of_clips", f"""
WITH s AS {SERIES_SQL},
c AS (SELECT user_id, x, unnest(generate_series(0, len(x) - 1, 16)) AS st FROM s),
m AS (SELECT user_id, avg(list_avg(x[st + 1: st + 16])) AS cm FROM c WHERE len(x[st + 1: st + 16]) >= 16 * 0.33 GROUP BY user_id)
SELECT user_id % 10 AS grp, round(avg(cm), 6) AS mean, count(*) AS n_clips FROM m GROUP BY user_id % 10
""")
def k11_clips(spark, sf):
    m = C.chunk_means(series(spark, sf), "user_id", "i", "x", 16)
    g = C.mean_of_clips(m, F.pmod("user_id", F.lit(10)).alias("grp"))
    return g.select("grp", F.round("mean", 6).alias("mean"), "n_clips")


@register("k10_last_window_always", """
WITH f AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)
SELECT user_id, unnest(CASE WHEN n > 12 THEN list_append(range(0, n - 12, 5), n - 12) ELSE [0::BIGINT] END) AS start_frame FROM f
""")
def k10_last(spark, sf):
    return series_lengths(spark, sf).select("user_id", F.explode(K.partial_slices_with_last("n", 12, 5)).alias("start_frame"))


@register("k12_voice_from_files", f"""
SELECT name, CAST(pos AS BIGINT) AS pos, round(avg(x), 6) AS mean FROM {EMB_LONG} l GROUP BY name, pos
""")
def k12(spark, sf):
    """One voice vector per speaker: the mean over all its files."""
    m = E.mean_vectors(clip_vectors(spark, sf), "name", "embedding")
    return m.select("name", F.col("pos").cast("long").alias("pos"), F.round("mean", 6).alias("mean"))


@register("e10_class_accuracy", f"""
WITH l AS {EMB_LONG},
m AS (SELECT name AS cls, pos, avg(x) AS mx FROM l GROUP BY name, pos),
d AS (SELECT l.vec_id, l.name, m.cls, sum(l.x * m.mx) / (sqrt(sum(l.x * l.x)) * sqrt(sum(m.mx * m.mx))) AS cos
      FROM l JOIN m ON l.pos = m.pos GROUP BY l.vec_id, l.name, m.cls),
p AS (SELECT vec_id, name, arg_max(cls, cos) AS predicted FROM d GROUP BY vec_id, name),
a AS (SELECT name, avg(CASE WHEN name = predicted THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS n FROM p GROUP BY name)
SELECT name, round(accuracy, 6) AS accuracy, n, round((SELECT avg(accuracy) FROM a), 6) AS macro_accuracy FROM a
""")
def e10(spark, sf):
    v = clip_vectors(spark, sf)
    means = E.mean_vectors(v, "name", "embedding").select(F.col("name").alias("cls"), "pos",
                                                           F.col("mean").alias("x"))
    pred = K.nearest_mean(v, "embedding", means, "cls")
    acc = E.class_accuracy(pred, "name", "predicted")
    return acc.select("name", F.round("accuracy", 6).alias("accuracy"), "n",
                      F.round("macro_accuracy", 6).alias("macro_accuracy"))


@register("e14_code_usage", f"""WITH {CB_SQL},
u AS (SELECT code, count(*) AS n FROM asg GROUP BY code),
t AS (SELECT count(*) AS total FROM asg)
SELECT CAST(cb.code AS BIGINT) AS code, coalesce(u.n, 0) AS n, round(coalesce(u.n, 0) / t.total, 6) AS share,
       coalesce(u.n, 0) / t.total > 0.9 AS over_used, coalesce(u.n, 0) / t.total < 0.01 AS dead
FROM cb LEFT JOIN u ON cb.code = u.code, t
""")
def e14(spark, sf):
    u = E.code_usage(assigned(spark, sf), "code", N_CODES)
    return u.select(F.col("code").cast("long").alias("code"), "n", F.round("share", 6).alias("share"),
                    "over_used", "dead")


@register("e18_quantisation_mse", f"""WITH {CB_SQL}
SELECT round(avg((l.x - c.e) * (l.x - c.e)), 6) AS mse
FROM asg a JOIN l ON a.vec_id = l.vec_id JOIN cbl c ON c.code = a.code AND c.pos = l.pos
""")
def e18(spark, sf):
    v = K.code_vectors(assigned(spark, sf), "code", codebook(spark, sf))
    sq = F.aggregate(F.zip_with("embedding", "centroid", lambda x, e: (x.cast("double") - e) ** 2),
                     F.lit(0.0), lambda a, v: a + v)
    return v.agg(F.round(F.sum(sq) / F.sum(F.size("embedding")), 6).alias("mse"))
