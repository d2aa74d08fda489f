"""K: vectors and codes.

Vectors are ``array<float>`` columns.  Work against a set of vectors (class
centroids, a codebook) is done either in long form (``(id, pos, x)`` joined on
``pos``) or, for the best entry of a set, as a product in blocks (``blocked``),
one plan for every size.  Joins with the small side are plain: the planner
broadcasts it when its size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocable.operators.blocked import best_entry
from vocable.operators.common import col


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def l2norm(a) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def cosine(a, b) -> Column:
    """K1: cosine similarity of two array columns, in double."""
    return dot(a, b) / (l2norm(a) * l2norm(b))


def l2_normalise(a) -> Column:
    n = l2norm(a)
    return F.transform(col(a), lambda v: v.cast("double") / n)


def to_long(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return df.select(id_col, F.posexplode(vec_col).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


def cosine_to_set(rows: DataFrame, row_id: str, vec_col: str, small_long: DataFrame,
                  set_id: str, set_val: str = "x") -> DataFrame:
    """K1 against a small set given in long form ``(set_id, pos, set_val)``.

    Returns ``(row_id, set_id, cos)``: joined on ``pos``, then one partial
    aggregate per (row, member).
    """
    r = to_long(rows, row_id, vec_col)
    s = small_long.select(set_id, "pos", F.col(set_val).cast("double").alias("_e"))
    s_norm = s.groupBy(set_id).agg(F.sqrt(F.sum(F.col("_e") * F.col("_e"))).alias("_en"))
    r_norm = r.groupBy(row_id).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("_xn"))
    j = r.join(s, "pos")
    dots = j.groupBy(row_id, set_id).agg(F.sum(F.col("x") * F.col("_e")).alias("_dot"))
    return (dots.join(r_norm, row_id).join(s_norm, set_id)
            .select(row_id, set_id, (F.col("_dot") / (F.col("_xn") * F.col("_en"))).alias("cos")))


def nearest_mean(rows: DataFrame, vec_col: str, means: DataFrame, cls: str, out: str = "predicted") -> DataFrame:
    """The class whose mean vector ``(cls, pos, x)`` has the largest cosine; ties go to the smallest class."""
    vectors = means.groupBy(cls).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("_mean"))
    return best_entry(rows, vec_col, vectors, cls, "_mean", out, "_cos", cosine=True).drop("_cos")


def nearest_by_cosine(rows: DataFrame, row_id: str, vec_col: str, small_long: DataFrame,
                      set_id: str, set_val: str = "x") -> DataFrame:
    sims = cosine_to_set(rows, row_id, vec_col, small_long, set_id, set_val)
    best = sims.groupBy(row_id).agg(F.min(F.struct(-F.col("cos"), F.col(set_id).alias("predicted"))).alias("_b"), F.max("cos").alias("best_cos"))
    return best.select(row_id, "_b.predicted", "best_cos")


# ---------------------------------------------------------------- codebook (K5-K8)

def codebook_from_rows(df: DataFrame, vec_col: str, order_col: str, n_codes: int) -> DataFrame:
    """Codebook ``(code, centroid)`` = the first ``n_codes`` rows in ``order_col``."""
    w = Window.orderBy(order_col)
    top = df.orderBy(order_col).limit(n_codes)   # top-k: TakeOrderedAndProject, bounded by n_codes
    return top.select((F.row_number().over(w) - 1).cast("int").alias("code"),
                      F.transform(vec_col, lambda v: v.cast("double")).alias("centroid"))


def nearest_code(df: DataFrame, vec_col: str, codebook: DataFrame, out_col: str = "code",
                 dist_col: str | None = None) -> DataFrame:
    """K5: argmin_e ‖x − e‖², ties to the lowest code.  Output keeps all input columns."""
    out = best_entry(df, vec_col, codebook.select(F.col("code").cast("int").alias("code"), "centroid"), "code", "centroid",
                     out_col, dist_col or "_dist")
    return out if dist_col else out.drop("_dist")


def nearest_code_sql_form(df: DataFrame, id_col: str, vec_col: str, codebook: DataFrame) -> DataFrame:
    """K5 as a relational plan (long form, ``min_by``); same answer, no Python."""
    cb_long = codebook.select("code", F.posexplode("centroid").alias("pos", "_e"))
    r = to_long(df, id_col, vec_col)
    j = r.join(cb_long, "pos")
    d = j.groupBy(id_col, "code").agg(F.sum((F.col("x") - F.col("_e")) ** 2).alias("dist"))
    return d.groupBy(id_col).agg(F.min(F.struct("dist", "code")).alias("_b")).select(id_col, "_b.code", "_b.dist")


def code_vectors(codes: DataFrame, code_col: str, codebook: DataFrame) -> DataFrame:
    """K6: code → centroid (join; the codebook side is small)."""
    cb = codebook.withColumnRenamed("code", code_col)
    return codes.join(cb, code_col, "left")


def ema_update(assigned: DataFrame, vec_col: str, codebook: DataFrame, cluster_size: DataFrame | None = None,
               decay: float = 0.99, eps: float = 1e-5) -> DataFrame:
    """K7: one EMA codebook step.  Returns ``(code, cluster_size, centroid)``.

    ``assigned`` has a ``code`` column (K5 output).  Per-code counts and
    element sums are one grouped aggregate in long form; the rest is
    arithmetic on the (small) codebook.  ``embed_avg`` starts as the centroid
    and ``cluster_size`` as 0 unless given.
    """
    n_codes = codebook.count()
    lf = assigned.select("code", F.posexplode(vec_col).alias("pos", "x"))
    sums = lf.groupBy("code", "pos").agg(F.sum(F.col("x").cast("double")).alias("s"))
    counts = assigned.groupBy("code").agg(F.count(F.lit(1)).cast("double").alias("cnt"))
    cb = codebook.select("code", F.posexplode("centroid").alias("pos", "e"))
    cs0 = (cluster_size if cluster_size is not None
           else codebook.select("code", F.lit(0.0).alias("cluster_size")))
    size = (cs0.join(counts, "code", "left")
            .select("code", (F.col("cluster_size") * decay + F.coalesce("cnt", F.lit(0.0)) * (1 - decay))
                    .alias("cluster_size")))
    tot = size.agg(F.sum("cluster_size").alias("_n"))
    from vocable.operators.common import attach_scalars
    size = attach_scalars(size, tot).withColumn(
        "_norm", (F.col("cluster_size") + eps) / (F.col("_n") + n_codes * eps) * F.col("_n"))
    avg = (cb.join(sums, ["code", "pos"], "left")
           .select("code", "pos", (F.col("e") * decay + F.coalesce("s", F.lit(0.0)) * (1 - decay)).alias("avg")))
    upd = avg.join(size, "code").select("code", "pos", "cluster_size", (F.col("avg") / F.col("_norm")).alias("v"))
    return upd


def reset_codes(codebook: DataFrame, usage: DataFrame, data: DataFrame, key: str, vec_col: str,
                seed: int = 0, op: str = "k8") -> DataFrame:
    """K8: codes whose share is over-used or dead (E14 flags) get the vector of a
    hash-chosen data row; the others keep their centroid.

    The data row for code c is the one at global position hash(seed, op, c) mod N
    (position helper over ``key``), joined on that position: no row is
    collected, and the choice does not depend on partitioning.
    """
    from vocable.functions.hashing import hash52
    from vocable.operators.common import attach_scalars
    from vocable.plans.position import with_position

    pos = with_position(data.select(key, vec_col), [key], "_pos")
    n = data.agg(F.count(F.lit(1)).alias("_n"))
    flagged = usage.where(F.col("over_used") | F.col("dead")).select("code")
    pick = attach_scalars(flagged, n).withColumn("_pos", F.pmod(hash52(seed, op, F.col("code")), F.col("_n")))
    repl = pick.join(pos, "_pos").select("code", F.transform(vec_col, lambda v: v.cast("double")).alias("_new"))
    out = codebook.join(repl, "code", "left")
    return out.select("code", F.coalesce("_new", "centroid").alias("centroid"), F.col("_new").isNotNull().alias("reset"))


def window_offsets(length, window: int, n: int = 10) -> Column:
    """K9: ``n`` offsets ``int(linspace(0, length - w, n))`` with w = min(window, length).

    Same arithmetic as linspace: i·((stop)/(n−1)), the last one exactly ``stop``.
    """
    w = F.least(col(length), F.lit(window))
    stop = (col(length) - w).cast("double")
    step = stop / (n - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                       lambda i: F.when(i == n - 1, stop).otherwise(i * step).cast("int"))


def partial_slices(n_samples, samples_per_frame: int, partial_frames: int, frame_step: int,
                   min_coverage: float = 0.75) -> Column:
    """Start frames of fixed-length partial windows every ``frame_step``.

    n_frames = ceil((n+1)/spf); starts = range(0, max(1, n_frames − P + step + 1), step);
    the last window is dropped when it covers less than ``min_coverage`` of a
    window and it is not the only one.
    """
    n = col(n_samples)
    n_frames = F.ceil((n + 1) / F.lit(samples_per_frame)).cast("int")
    steps = F.greatest(F.lit(1), n_frames - partial_frames + frame_step + 1)
    starts = F.sequence(F.lit(0), steps - 1, F.lit(frame_step))
    last = F.element_at(starts, -1)
    cover = (n - last * samples_per_frame).cast("double") / (partial_frames * samples_per_frame)
    drop = (cover < min_coverage) & (F.size(starts) > 1)
    return F.when(drop, F.slice(starts, 1, F.size(starts) - 1)).otherwise(starts)


def partial_slices_with_last(n_frames, partial_frames: int, frame_step: int) -> Column:
    """K10, second form: windows every ``frame_step`` below n - P, and always the last P frames; a clip of at
    most P frames is one window."""
    n = col(n_frames).cast("long")
    starts = F.sequence(F.lit(0).cast("long"), n - partial_frames - 1, F.lit(frame_step).cast("long"))
    return F.when(n > partial_frames, F.concat(starts, F.array(n - partial_frames))).otherwise(F.array(F.lit(0).cast("long")))


# ---------------------------------------------------------------- GE2E / prototype (K2-K4)

def class_sums(long_rows: DataFrame, cls: str) -> DataFrame:
    """Per class and position: sum and count (partial aggregates; one row per class × pos)."""
    cnt = long_rows.select("id", cls).distinct().groupBy(cls).agg(F.count(F.lit(1)).alias("n"))
    s = long_rows.groupBy(cls, "pos").agg(F.sum("x").alias("s"))
    return s.join(cnt, cls)


def ge2e_scores(df: DataFrame, id_col: str, cls: str, vec_col: str, batch: str, w: float = 10.0, b: float = -5.0) -> DataFrame:
    """K2: ``(batch, id, cls, other, score)``: w·max(cos(x, centroid), 1e-6) + b,
    for every class of the row's ``batch`` (a G5 batch bounds rows and classes).

    The own-class centroid excludes the row itself: (Σ − x)/(n − 1).  Class sums
    of a batch are joined to its rows on (batch, pos).
    """
    lr = df.select(batch, F.col(id_col).alias("id"), cls, F.posexplode(vec_col).alias("pos", "x")).withColumn(
        "x", F.col("x").cast("double"))
    cnt = df.groupBy(batch, cls).agg(F.count(F.lit(1)).alias("n"))
    cs = lr.groupBy(batch, cls, "pos").agg(F.sum("x").alias("s")).join(cnt, [batch, cls]).withColumnRenamed(cls, "other")
    j = lr.join(cs, [batch, "pos"])
    own = F.col(cls) == F.col("other")
    c = F.when(own, (F.col("s") - F.col("x")) / (F.col("n") - 1)).otherwise(F.col("s") / F.col("n"))
    g = j.groupBy(batch, "id", cls, "other").agg(F.sum(F.col("x") * c).alias("_dot"), F.sum(c * c).alias("_cc"),
                                                 F.sum(F.col("x") * F.col("x")).alias("_xx"))
    cos = F.col("_dot") / (F.sqrt("_xx") * F.sqrt("_cc"))
    return g.select(batch, F.col("id").alias(id_col), cls, "other", (F.greatest(cos, F.lit(1e-6)) * w + b).alias("score"))


def ge2e_losses(scores: DataFrame, id_col: str, cls: str) -> DataFrame:
    """K3: per row, softmax loss −log softmax(score)[own] and contrast loss
    1 − σ(own) + max σ(other)."""
    own = F.col(cls) == F.col("other")
    sig = 1.0 / (1.0 + F.exp(-F.col("score")))
    g = scores.groupBy(id_col, cls).agg(
        F.max(F.when(own, F.col("score"))).alias("_own"),
        F.max("score").alias("_mx"),
        F.max(F.when(~own, sig)).alias("_max_other_sig"),
        F.collect_list(F.col("score")).alias("_all"))
    lse = F.col("_mx") + F.log(F.aggregate("_all", F.lit(0.0), lambda a, s: a + F.exp(s - F.col("_mx"))))
    return g.select(id_col, cls, (lse - F.col("_own")).alias("softmax_loss"),
                    (1.0 - 1.0 / (1.0 + F.exp(-F.col("_own"))) + F.col("_max_other_sig")).alias("contrast_loss"))


def prototype_loss(df: DataFrame, id_col: str, cls: str, vec_col: str, w: float = 10.0, b: float = -5.0) -> DataFrame:
    """K4: positive = first row of a class (by id), anchor = mean of the rest;
    cross-entropy of w·cos(positive_j, anchor_k)+b at k = j.  Returns per-class loss."""
    first = df.groupBy(cls).agg(F.min_by(vec_col, id_col).alias("_v"))           # a class of any size: partial step
    pos_v = first.select(F.col(cls).alias("cj"), F.posexplode("_v").alias("pos", "p")).withColumn("p", F.col("p").cast("double"))
    sums = df.select(cls, F.posexplode(vec_col).alias("pos", "x")).groupBy(cls, "pos").agg(
        F.sum(F.col("x").cast("double")).alias("_s"), F.count("x").alias("_n"))
    anc = sums.join(pos_v, (F.col(cls) == F.col("cj")) & (sums["pos"] == pos_v["pos"])).where("_n > 1").select(
        F.col(cls).alias("ck"), sums["pos"], ((F.col("_s") - F.col("p")) / (F.col("_n") - 1)).alias("a"))
    j = pos_v.join(anc, "pos")
    g = j.groupBy("cj", "ck").agg(F.sum(F.col("p") * F.col("a")).alias("_d"), F.sum(F.col("p") ** 2).alias("_pp"),
                                  F.sum(F.col("a") ** 2).alias("_aa"))
    s = g.select("cj", "ck", (F.col("_d") / (F.sqrt("_pp") * F.sqrt("_aa")) * w + b).alias("score"))
    per = s.groupBy("cj").agg(F.max(F.when(F.col("cj") == F.col("ck"), F.col("score"))).alias("_own"),
                              F.max("score").alias("_mx"), F.collect_list("score").alias("_all"))
    lse = F.col("_mx") + F.log(F.aggregate("_all", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("_mx"))))
    return per.select(F.col("cj").alias(cls), (lse - F.col("_own")).alias("loss"))
