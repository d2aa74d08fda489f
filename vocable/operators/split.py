"""F: splits, sampling and balancing.

Every random choice is a keyed hash (``vocable.functions.hashing``).  Orders
over the whole table use the global-position helper (range partitioned), and
per-group choices use aggregates (``min_by``) rather than windows partitioned
by a possibly hot group key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocable.functions.hashing import hash52, uniform
from vocable.operators.common import attach_scalars
from vocable.plans.position import last_mark_before, with_position


def eval_size_expr(n: Column, size: float, max_size: int | None = None) -> Column:
    """Eval size: int(size) if size > 1, else int(n·size), capped at max_size."""
    if size > 1:
        return F.lit(int(size)).cast("long")
    e = F.floor(n * F.lit(size)).cast("long")
    if max_size:
        e = F.least(e, F.lit(int(max_size)).cast("long"))
    return e


def _some(size: Column) -> Column:
    """The eval size; 0 fails the job."""
    return F.when(size > 0, size).otherwise(F.raise_error(F.lit("eval split size is 0: not enough samples")))


def split_one_speaker(df: DataFrame, key: str, size: float, seed: int = 0, max_size: int | None = None,
                      op: str = "f1") -> DataFrame:
    """shuffle by hash; the first ``size`` rows are eval, the rest train.

    Adds ``split`` ∈ {eval, train}.  Eval size 0 fails the job.
    """
    h = df.withColumn("_h", hash52(seed, op, F.col(key)))
    pos = with_position(h, ["_h", key], "_pos", total_col="_n")
    pos = pos.withColumn("_size", _some(eval_size_expr(F.col("_n"), size, max_size)))
    out = pos.withColumn("split", F.when(F.col("_pos") < F.col("_size"), F.lit("eval")).otherwise(F.lit("train")))
    return out.drop("_h", "_pos", "_n", "_size")


def split_many_speakers(df: DataFrame, key: str, speaker: str, size: float, seed: int = 0,
                        max_size: int | None = None, op: str = "f2") -> DataFrame:
    """as F1, but every speaker keeps at least one training row.

    Each speaker's protected row is its hash-smallest row (``min_by``, a
    partial aggregate: a hot speaker is one group, not one sorted task).  The
    other rows are hash-ordered globally; the first ``size`` go to eval,
    capped at the number of unprotected rows.
    """
    h = df.withColumn("_h", hash52(seed, op, F.col(key)))
    prot = h.groupBy(speaker).agg(F.min_by(F.col(key), F.struct("_h", key)).alias(key)).select(key)
    prot = prot.withColumn("_prot", F.lit(True))
    marked = h.join(prot, key, "left").withColumn("_prot", F.coalesce("_prot", F.lit(False)))
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    free = marked.where(~F.col("_prot"))
    pos = with_position(free, ["_h", key], "_pos")
    pos = attach_scalars(pos, n).withColumn("_size", _some(eval_size_expr(F.col("_n"), size, max_size)))
    free_out = pos.withColumn("split", F.when(F.col("_pos") < F.col("_size"), F.lit("eval")).otherwise(F.lit("train")))
    kept = marked.where(F.col("_prot")).withColumn("split", F.lit("train"))
    cols = df.columns + ["split"]
    return free_out.select(*cols).unionByName(kept.select(*cols))


def ordered_prefix_split(df: DataFrame, order: list, ratio: float) -> DataFrame:
    """the first ceil(n·ratio) rows in ``order`` are train, the rest eval."""
    pos = with_position(df, order, "_pos", total_col="_n")
    k = F.ceil(F.col("_n") * F.lit(ratio))
    return pos.withColumn("split", F.when(F.col("_pos") < k, F.lit("train")).otherwise(F.lit("eval"))).drop(
        "_pos", "_n")


def inverse_frequency_weight(df: DataFrame, attr: str, out: str = "weight",
                             multipliers: dict | None = None) -> DataFrame:
    """w = (1/c)/sqrt(Σ_groups 1/c): the L2 norm of the per-row vector in
    closed form over the (small) group-count table; optional per-value
    multiplier, where an unknown value fails the job."""
    counts = df.groupBy(attr).agg(F.count(F.lit(1)).alias("_c"))
    norm = counts.agg(F.sqrt(F.sum(1.0 / F.col("_c"))).alias("_norm"))
    w = attach_scalars(counts, norm).select(attr, ((1.0 / F.col("_c")) / F.col("_norm")).alias(out))
    res = df.join(w, attr, "left")
    if multipliers:
        m = F.create_map(*[x for k, v in multipliers.items() for x in (F.lit(k), F.lit(float(v)))])
        mult = F.coalesce(F.try_element_at(m, F.col(attr)),
                          F.raise_error(F.concat(F.lit("no multiplier for "), F.col(attr).cast("string"))))
        res = res.withColumn(out, F.col(out) * mult)
    return res


def weighted_draws(df: DataFrame, key: str, weight: str, n_draws: int, seed: int = 0, op: str = "f10") -> DataFrame:
    """``n_draws`` draws with replacement, p ∝ weight; ``key`` is a number.

    Row *i* owns the points from the prefix sum before it to its own; each draw
    is a point ``u·total`` and takes the last row that begins at or before it.
    Neighbouring intervals share their ends, so rounding can't lose or double a
    draw, and the weights may be of any size.
    """
    ranked = with_position(df.where(F.col(weight) > 0).select(key, weight), [key], "_pos", weight=F.col(weight), cum_col="_cum")
    marks = ranked.select(F.col("_cum"), F.col("_pos"), F.col(key), "_cum_total")
    # the interval of position p begins where that of p - 1 ends; the first begins at 0
    total = marks.agg(F.max("_cum_total").alias("_total"))
    begins = marks.select((F.col("_pos") + 1).alias("_row"), F.col("_cum").alias("_at")).unionByName(
        df.sparkSession.createDataFrame([(0, 0.0)], "_row long, _at double"))
    draws = attach_scalars(df.sparkSession.range(n_draws).withColumnRenamed("id", "draw"), total)
    draws = draws.select("draw", (uniform(seed, op, F.col("draw")) * F.col("_total")).alias("_at"))
    last = ranked.agg(F.max("_pos").alias("_last"))
    hit = attach_scalars(last_mark_before(draws, begins, "_at", "draw", "_row"), last)
    # a point that rounding puts at the very end belongs to the last row
    hit = hit.select("draw", F.least("_row", "_last").alias("_pos"))
    return hit.join(marks.select("_pos", key), "_pos").select("draw", key)


def split_datasets(df: DataFrame, key: str, dataset: str, speaker: str, size: float, seed: int = 0,
                   max_size: int | None = None, op: str = "f3") -> DataFrame:
    """every row of every dataset comes out as train or eval.

    Each dataset is split by itself: eval size as in F1, capped at ``max_size``
    divided by the number of datasets; in a dataset with several speakers each
    keeps at least one training row (its hash-smallest).  One global order over
    (dataset, protected last, hash) gives all ranks at once.
    """
    h = df.withColumn("_h", hash52(seed, op, F.col(key)))
    prot = h.groupBy(dataset, speaker).agg(F.min_by(F.col(key), F.struct("_h", key)).alias(key))
    many = prot.groupBy(dataset).agg(F.count(F.lit(1)).alias("_speakers"))
    stats = h.groupBy(dataset).agg(F.count(F.lit(1)).alias("_n")).join(many, dataset)
    n_sets = stats.agg(F.count(F.lit(1)).alias("_sets"))
    cap = F.floor(F.lit(max_size) / F.col("_sets")).cast("long") if max_size else None
    want = eval_size_expr(F.col("_n"), size)
    sizes = attach_scalars(stats, n_sets).withColumn("_size", _some(F.least(want, cap) if max_size else want))
    kept = prot.join(many.where("_speakers > 1").select(dataset), dataset).select(key, F.lit(True).alias("_prot"))
    marked = h.join(kept, key, "left").withColumn("_prot", F.coalesce("_prot", F.lit(False)))
    pos = with_position(marked, [dataset, "_prot", "_h", key], "_pos")
    start = pos.groupBy(dataset).agg(F.min("_pos").alias("_start"))
    out = pos.join(start.join(sizes.select(dataset, "_size"), dataset), dataset)
    is_eval = ~F.col("_prot") & (F.col("_pos") - F.col("_start") < F.col("_size"))
    return out.withColumn("split", F.when(is_eval, F.lit("eval")).otherwise(F.lit("train"))).select(*df.columns, "split")


def uniform_by_group(df: DataFrame, key: str, group: str, n_draws: int, seed: int = 0, op: str = "f11") -> DataFrame:
    """pick a group uniformly, then a row uniformly inside it.

    Row ordinals inside a group come from the global position over
    (group, key) minus the group's first position, so no window is
    partitioned by the group.
    """
    spark = df.sparkSession
    pos = with_position(df.select(group, key), [group, key], "_pos")
    stats = pos.groupBy(group).agg(F.min("_pos").alias("_start"), F.count(F.lit(1)).alias("_cnt"))
    gidx = with_position(stats.select(group, "_cnt"), [group], "_gi")
    ng = stats.agg(F.count(F.lit(1)).alias("_ng"))
    rows = pos.join(stats.select(group, "_start"), group).select(group, key, (F.col("_pos") - F.col("_start"))
                                                                 .alias("_ord"))
    d = attach_scalars(spark.range(n_draws).withColumnRenamed("id", "draw"), ng)
    d = d.withColumn("_gi", F.pmod(hash52(seed, op + "g", F.col("draw")), F.col("_ng")))
    d = d.join(gidx, "_gi").withColumn("_ord", F.pmod(hash52(seed, op + "r", F.col("draw")), F.col("_cnt")))
    return d.join(rows, [group, "_ord"]).select("draw", group, key)


def shard_by_rank(df: DataFrame, order: list, n_replicas: int) -> DataFrame:
    """drop the tail so the size divides; row i goes to shard i mod r."""
    pos = with_position(df, order, "_pos", total_col="_n")
    keep = F.col("_pos") < F.col("_n") - F.pmod(F.col("_n"), F.lit(n_replicas))
    return pos.where(keep).withColumn("shard", F.pmod(F.col("_pos"), F.lit(n_replicas)).cast("int")).drop("_n")


def random_member(df: DataFrame, group: str, key: str, seed: int = 0, op: str = "f13") -> DataFrame:
    """one hash-chosen member per group (partial aggregate)."""
    h = df.withColumn("_h", hash52(seed, op, F.col(key)))
    return h.groupBy(group).agg(F.min_by(F.col(key), F.struct("_h", key)).alias(key))


def repeat_epochs(df: DataFrame, order: list, n_epochs: int) -> DataFrame:
    """each row once per epoch, with the running count over epochs."""
    pos = with_position(df, order, "_pos", total_col="_n").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n_epochs - 1))))
    return pos.withColumn("step", F.col("epoch") * F.col("_n") + F.col("_pos")).drop("_n", "_pos")


def random_pairing(df: DataFrame, key: str, seed: int = 0, op: str = "f15") -> DataFrame:
    """each item paired with a shuffled partner (position i in key order
    ↔ position i in hash order); an equi-join on position."""
    a = with_position(df.select(key), [key], "_pos")
    b = with_position(df.select(F.col(key).alias("partner")).withColumn("_h", hash52(seed, op, F.col("partner"))),
                      ["_h", "partner"], "_pos")
    return a.join(b.select("partner", "_pos"), "_pos").select(key, "partner")
