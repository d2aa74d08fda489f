"""E: corpus statistics.  All are aggregates with a partial (map-side) step;
vector statistics use the long form ``(key, pos, x)`` so no group is ever
collected into one array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocable.functions.hashing import hash52

from vocable.operators.common import attach_scalars, col


def length_profile(df: DataFrame, kept: Column, text_col: str = "text_length",
                   audio_col: str = "audio_length") -> DataFrame:
    """max/min/mean of text and audio lengths over kept rows; discarded and kept counts."""
    k = F.coalesce(kept, F.lit(False))
    t, a = F.when(k, F.col(text_col)), F.when(k, F.col(audio_col))
    return df.agg(
        F.max(t).alias("max_text_len"), F.min(t).alias("min_text_len"), F.avg(t).alias("avg_text_len"),
        F.max(a).alias("max_audio_len"), F.min(a).alias("min_audio_len"), F.avg(a).alias("avg_audio_len"),
        F.count_if(~k).alias("n_discarded"), F.count_if(k).alias("n_instances"),
    )


def long_form(df: DataFrame, key_cols: list[str], arr_col: str, pos: str = "pos", val: str = "x") -> DataFrame:
    """Array column → ``(keys..., pos, x)`` rows (0-based pos)."""
    return df.select(*key_cols, F.posexplode(arr_col).alias(pos, val))


def per_bin_mean_std(frames: DataFrame, arr_col: str) -> DataFrame:
    """E5: per-bin mean and population std over all frames.

    std = sqrt(Σx²/N − mean²) with N the number of frames; one pass, partial sums.
    """
    lf = long_form(frames, [], arr_col, "bin", "x").withColumn("x", F.col("x").cast("double"))
    g = lf.groupBy("bin").agg(F.sum("x").alias("s1"), F.sum(F.col("x") * F.col("x")).alias("s2"),
                              F.count(F.lit(1)).alias("n"))
    mean = F.col("s1") / F.col("n")
    return g.select("bin", mean.alias("mean"),
                    F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("n") - mean * mean)).alias("std"))


def nonzero_mean_std(df: DataFrame, key_cols: list[str], x: str) -> DataFrame:
    """Mean and population std of the non-zero values (0.0 means "unvoiced")."""
    v = df.where(F.col(x) != 0)
    return v.groupBy(*key_cols).agg(F.avg(F.col(x).cast("double")).alias("mean"),
                                    F.stddev_pop(F.col(x).cast("double")).alias("std"))


def mean_vectors(vectors: DataFrame, name_col: str, vec_col: str, order_col: str | None = None,
                 first_n: int | None = None, random_n: int | None = None, seed: int = 0) -> DataFrame:
    """Mean vector per name, long form ``(name, pos, mean)``.

    With ``first_n``: only the first n vectors of each name in ``order_col``, with
    ``random_n`` n of them by keyed hash (a per-name top-n: Catalyst plans a
    WindowGroupLimit below the window).  A name with fewer vectors is an error.
    """
    v, n = vectors, random_n if random_n is not None else first_n
    if n is not None:
        order = [F.col(order_col)] if random_n is None else [hash52(seed, "e7", F.col(order_col)), F.col(order_col)]
        w = Window.partitionBy(name_col).orderBy(*order)
        v = v.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    lf = long_form(v, [name_col], vec_col)
    m = lf.groupBy(name_col, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.count(F.lit(1)).alias("_n"))
    if n is not None:
        few = F.concat(F.lit(f"fewer than {n} vectors of "), F.col(name_col).cast("string"))
        m = m.withColumn("mean", F.when(F.col("_n") < n, F.raise_error(few).cast("double")).otherwise(F.col("mean")))
    return m.drop("_n")


def normalised_mean_vectors(vectors: DataFrame, name_col: str, vec_col: str) -> DataFrame:
    """Mean vector divided by its L2 norm (long form)."""
    m = mean_vectors(vectors, name_col, vec_col)
    norms = m.groupBy(name_col).agg(F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("_norm"))
    return m.join(norms, name_col).select(name_col, "pos", (F.col("mean") / F.col("_norm")).alias("x"))


def vector_counts(vectors: DataFrame, name_col: str, vec_col: str) -> DataFrame:
    """Per name: vector count; plus totals (vectors, names, dim)."""
    per = vectors.groupBy(name_col).agg(F.count(F.lit(1)).alias("n_vectors"))
    tot = vectors.agg(F.count(F.lit(1)).alias("total_vectors"),
                      F.count_distinct(name_col).alias("total_names"),
                      F.max(F.size(vec_col)).cast("long").alias("dim"))
    return attach_scalars(per, tot)


def class_accuracy(pred: DataFrame, true_col: str, pred_col: str) -> DataFrame:
    """Accuracy per class and the unweighted mean over classes (macro)."""
    # in a filter, where the optimiser can't prune it
    checked = pred.where(F.when(F.col(true_col).isNotNull(), F.lit(True)).otherwise(
        F.raise_error(F.lit("null class label"))))
    per = checked.groupBy(true_col).agg(
        F.avg((F.col(true_col) == F.col(pred_col)).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("n"))
    macro = per.agg(F.avg("accuracy").alias("macro_accuracy"))
    return attach_scalars(per, macro)


def length_buckets(df: DataFrame, len_col: str, n_buckets: int = 10) -> DataFrame:
    """bucket = first of ``n_buckets`` equal upper edges (from the minimum) ≥ length."""
    mm = df.agg(F.min(len_col).alias("_lo"), F.max(len_col).alias("_hi"))
    x = attach_scalars(df, mm)
    step = (F.col("_hi") - F.col("_lo")).cast("double") / n_buckets
    b = F.when(step == 0, F.lit(1)).otherwise(
        F.greatest(F.lit(1), F.least(F.lit(n_buckets), F.ceil((F.col(len_col) - F.col("_lo")) / step)))).cast("int")
    return x.withColumn("bucket", b).drop("_lo", "_hi")


def code_usage(codes: DataFrame, code_col: str, n_codes: int, hi: float = 0.9, lo: float = 0.01) -> DataFrame:
    """Usage share of every code of ``0..n_codes-1`` (unused codes get 0)."""
    spark = codes.sparkSession
    total = codes.agg(F.count(F.lit(1)).alias("_total"))
    used = codes.groupBy(code_col).agg(F.count(F.lit(1)).alias("n"))
    allc = spark.range(n_codes).select(F.col("id").alias(code_col))
    u = allc.join(used, code_col, "left").fillna(0, ["n"])
    u = attach_scalars(u, total).withColumn("share", F.col("n") / F.col("_total")).drop("_total")
    return u.withColumn("over_used", F.col("share") > hi).withColumn("dead", F.col("share") < lo)


def running_mean(df: DataFrame, key_col: str, order_cols: list, x: str, compat: bool = False,
                 decimals: int | None = None) -> DataFrame:
    """E15 mean: running mean per key in order.

    ``compat=True`` reproduces the reference's bookkeeping where the first
    value seeds the average but is not counted (the mean of rows 2..k,
    and the first value itself on row 1).
    """
    from vocable.plans.position import keyed_running

    # Running sums and counts per key through range partitioning (a hot metric
    # key is spread over many tasks), not a window partitioned by the key.
    d = df.withColumn("_one", F.lit(1.0)).withColumn("_x", F.col(x).cast("double"))
    r = keyed_running(d, [key_col], order_cols, [("_x", "sum", "_s"), ("_one", "sum", "_rn")])
    s, rn = F.col("_s"), F.col("_rn")
    if decimals is not None:
        # Inputs with a fixed number of decimals: round the running sum back to
        # that grid, which removes the float summation error exactly.
        s = F.round(s, decimals)
    if not compat:
        return r.withColumn("running_mean", s / rn).drop("_one", "_x", "_s", "_rn")
    # The first value of each key: the keyed minimum of the order rank picks it.
    firsts = df.groupBy(key_col).agg(F.min_by(F.col(x).cast("double"), F.struct(*order_cols)).alias("_first"))
    r = r.join(firsts, key_col)
    out = r.withColumn("running_mean", F.when(rn == 1, F.col("_first"))
                       .otherwise((s - F.col("_first")) / (rn - 1)))
    return out.drop("_one", "_x", "_s", "_rn", "_first")


def ema_fold(values: Column, decay: float = 0.99) -> Column:
    """E15 EMA over an ordered array: starts at the first value, then
    ``ema = decay·ema + (1-decay)·x``."""
    return F.aggregate(F.slice(values, 2, 1 << 30), F.element_at(values, 1).cast("double"),
                       lambda acc, x: acc * decay + x.cast("double") * (1.0 - decay))


def best_rows(df: DataFrame, key_col: str | None, order_col: str, loss_col: str, keep_last: int) -> DataFrame:
    """Running best (lowest loss so far), flag for a new best, and the last k rows."""
    from vocable.plans.position import keyed_running

    d = df if key_col else df.withColumn("_all", F.lit(0))
    key = key_col or "_all"
    # Running minimum by range partitioning (no window over a hot key).
    r = keyed_running(d, [key], [order_col], [(loss_col, "min", "best_so_far")])
    # The running minimum only steps down at a new best, so a new best is the
    # first row of its (key, best_so_far) group: an aggregate, not a lag.
    firsts = r.groupBy(key, "best_so_far").agg(F.min(order_col).alias("_first"))
    r = r.join(firsts, [key, "best_so_far"])
    r = r.withColumn("is_new_best", F.col(order_col) == F.col("_first"))
    # Last k rows per key: a top-k per group (planned as a WindowGroupLimit, so
    # at most k rows per key and partition reach the shuffle) joined back.
    last = (d.select(key, order_col)
            .withColumn("_rk", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order_col).desc())))
            .where(F.col("_rk") <= keep_last).select(key, order_col, F.lit(True).alias("kept")))
    r = r.join(last, [key, order_col], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    return r.drop("_first", "_all") if not key_col else r.drop("_first")
