"""G: ordering, ranking and batching.

Whole-table orders go through the global-position helper (range
partitioned); windows are only partitioned by keys whose groups are bounded
by construction (a batch, a bucket of ``b·100`` rows, one clip).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocable.functions.hashing import hash52
from vocable.operators.common import attach_scalars, col
from vocable.plans.position import keyed_running, with_position


def floor_div(a, b) -> Column:
    """Python's ``a // b`` for b > 0 (Spark's ``div`` truncates toward zero)."""
    a, b = col(a), col(b)
    return ((a - F.pmod(a, b)) / b).cast("long")


def sort_by_length(df: DataFrame, length: str, key: str, start_by_longest: bool = False) -> DataFrame:
    """G1: ascending position by length; optionally swap the first and last rows."""
    p = with_position(df, [length, key], "pos")
    if not start_by_longest:
        return p
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    p = attach_scalars(p, n)
    return p.withColumn("pos", F.when(F.col("pos") == 0, F.col("_n") - 1)
                        .when(F.col("pos") == F.col("_n") - 1, F.lit(0)).otherwise(F.col("pos"))).drop("_n")


def shuffle_batch_groups(pos_df: DataFrame, key: str, group_size: int, seed: int = 0, op: str = "g2") -> DataFrame:
    """Shuffle inside consecutive full groups of ``group_size`` positions;
    the trailing partial group keeps its order.  Groups are bounded, so the
    window per group is bounded too."""
    n = pos_df.agg(F.count(F.lit(1)).alias("_n"))
    d = attach_scalars(pos_df, n).withColumn("_g", F.expr(f"pos div {group_size}"))
    full = F.col("_g") < F.floor(F.col("_n") / group_size)
    w = Window.partitionBy("_g").orderBy(hash52(seed, op, F.col(key)), F.col(key))
    shuffled = F.col("_g") * group_size + F.row_number().over(w) - 1
    return d.withColumn("new_pos", F.when(full, shuffled).otherwise(F.col("pos")).cast("long")).drop("_n", "_g")


def fixed_batches(pos_df: DataFrame, batch_size: int, drop_last: bool = False) -> DataFrame:
    """``batch_id = pos // b``; optionally drop a short last batch."""
    b = pos_df.withColumn("batch_id", F.expr(f"pos div {batch_size}"))
    if not drop_last:
        return b
    n = pos_df.agg(F.count(F.lit(1)).alias("_n"))
    return attach_scalars(b, n).where(F.col("batch_id") < F.floor(F.col("_n") / batch_size)).drop("_n")


def bucket_batches(df: DataFrame, key: str, sort_key: str, batch_size: int, multiplier: int = 100,
                   drop_last: bool = False, seed: int = 0, op: str = "g4") -> DataFrame:
    """Random sampler order → buckets of b·multiplier → sort each bucket by
    ``sort_key`` → cut into batches → shuffle the batches inside the bucket.

    Adds ``bucket``, ``batch_in_bucket`` (position after the shuffle) and
    ``row_in_batch``.  Buckets are bounded, so per-bucket windows are too.
    """
    bucket_size = batch_size * multiplier
    p = with_position(df.withColumn("_h", hash52(seed, op + "s", F.col(key))), ["_h", key], "_pos")
    p = p.withColumn("bucket", F.expr(f"_pos div {bucket_size}"))
    r = F.row_number().over(Window.partitionBy("bucket").orderBy(F.col(sort_key), F.col("_pos"))) - 1
    p = p.withColumn("_r", r).withColumn("_b", F.expr(f"_r div {batch_size}"))
    sizes = p.groupBy("bucket", "_b").agg(F.count(F.lit(1)).alias("_bs"))
    if drop_last:
        sizes = sizes.where(F.col("_bs") == batch_size)
    sizes = sizes.withColumn("batch_in_bucket", (F.row_number().over(
        Window.partitionBy("bucket").orderBy(hash52(seed, op + "b", F.col("bucket"), F.col("_b")), "_b")) - 1)
        .cast("long"))
    out = p.join(sizes, ["bucket", "_b"]).withColumn("row_in_batch", F.pmod(F.col("_r"), F.lit(batch_size)).cast("long"))
    return out.drop("_h", "_pos", "_r", "_b", "_bs")


def class_balanced_batches(df: DataFrame, key: str, cls: str, batch_size: int, drop_last: bool = False,
                           seed: int = 0, op: str = "g5") -> DataFrame:
    """G5 (all classes in every batch): round-robin one row per class until
    the first class runs out; a batch holds batch_size / n_classes rounds.

    The ordinal inside a class comes from the global position over
    (class, hash) minus the class start, so a hot class is not one task.
    Adds ``round``, ``batch_id`` and ``class_rank``.
    """
    h = df.withColumn("_h", hash52(seed, op, F.col(key)))
    p = with_position(h, [cls, "_h", key], "_pos")
    st = p.groupBy(cls).agg(F.min("_pos").alias("_start"), F.count(F.lit(1)).alias("_cnt"))
    st = with_position(st, [cls], "class_rank")
    meta = st.agg(F.min("_cnt").alias("_min"), F.count(F.lit(1)).alias("_ncls"))
    st = attach_scalars(st, meta)
    p = p.join(st, cls).withColumn("round", F.col("_pos") - F.col("_start"))
    p = p.where(F.col("round") < F.col("_min"))
    per_batch = F.lit(batch_size) / F.col("_ncls")
    guard = F.when(F.lit(batch_size) % F.col("_ncls") == 0, F.lit(True)).otherwise(
        F.raise_error(F.lit("batch size must be divisible by the number of classes")))
    p = p.where(guard).withColumn("batch_id", F.floor(F.col("round") / per_batch).cast("long"))
    if drop_last:
        p = p.where(F.col("batch_id") < F.floor(F.col("_min") / per_batch))
    return p.drop("_h", "_pos", "_start", "_cnt", "_min", "_ncls")


def rotating_class_batches(df: DataFrame, key: str, cls: str, batch_size: int, classes_in_batch: int, drop_last: bool = False,
                           seed: int = 0, op: str = "g5r") -> DataFrame:
    """G5 with fewer classes in a batch than there are: each batch draws its classes by hash and takes
    batch_size / classes_in_batch rounds from them, until a drawn class has run out; that batch keeps its full
    rounds or, with ``drop_last``, is left out.  Adds ``batch_id``, ``round`` (in the batch) and ``class_rank``.

    A table of choices (batch, class) with running counts says what each class has given before a batch; the
    first batch that a class can't serve is a minimum over it.  Rows find their batch by (class, how many of the
    class's batches come before), so no class is one task.
    """
    if batch_size % classes_in_batch:
        raise ValueError("batch size must be divisible by the number of classes in a batch")
    per_class = batch_size // classes_in_batch
    p = with_position(df.withColumn("_h", hash52(seed, op, F.col(key))), [cls, "_h", key], "_pos")
    st = p.groupBy(cls).agg(F.min("_pos").alias("_start"), F.count(F.lit(1)).alias("_cnt"))
    st = with_position(st, [cls], "class_rank")
    meta = st.agg(F.count(F.lit(1)).alias("_ncls"), F.sum("_cnt").alias("_rows")).first()
    if meta._ncls < classes_in_batch:
        raise ValueError(f"{meta._ncls} classes, {classes_in_batch} wanted in a batch")
    batches = df.sparkSession.range(meta._rows // batch_size + 1).select(F.col("id").alias("batch_id"))
    drawn = F.slice(F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(meta._ncls - 1)), lambda c: F.struct(
        hash52(seed, op + "-class", F.col("batch_id"), c).alias("h"), c.cast("long").alias("c")))), 1, classes_in_batch)
    choice = batches.select("batch_id", F.explode(drawn).alias("d")).select("batch_id", F.col("d.c").alias("class_rank"), F.lit(1).alias("_one"))
    choice = keyed_running(choice, ["class_rank"], ["batch_id"], [("_one", "sum", "_nth")])
    choice = choice.select("batch_id", "class_rank", (F.col("_nth").cast("long") - 1).alias("_nth"))
    left = choice.join(st.select("class_rank", "_cnt"), "class_rank").withColumn(
        "_left", F.greatest(F.lit(0), F.least(F.lit(per_class), F.col("_cnt") - F.col("_nth") * per_class)))
    last = left.where(F.col("_left") < per_class).groupBy("batch_id").agg(F.min("_left").alias("rounds")).agg(
        F.min(F.struct("batch_id", "rounds")).alias("_end")).select("_end.*")
    end = last.first()
    stop, rounds = (end.batch_id, 0 if drop_last else end.rounds) if end and end.batch_id is not None else (meta._rows, 0)
    rows = p.join(st, cls).withColumn("_place", F.col("_pos") - F.col("_start")).withColumn(
        "_nth", F.floor(F.col("_place") / per_class)).withColumn("round", F.pmod("_place", F.lit(per_class)))
    out = rows.join(choice, ["class_rank", "_nth"]).where((F.col("batch_id") < stop) | ((F.col("batch_id") == stop) & (F.col("round") < rounds)))
    return out.drop("_h", "_pos", "_start", "_cnt", "_place", "_nth")


def order_in_batch(df: DataFrame, batch: str, order: list, out: str = "pos_in_batch") -> DataFrame:
    """Position inside a (bounded) batch by the given order."""
    return df.withColumn(out, (F.row_number().over(Window.partitionBy(batch).orderBy(*order)) - 1).cast("long"))


def grouped_length_order(df: DataFrame, key: str, length: str, n_groups: int = 100, seed: int = 0,
                         op: str = "g7") -> DataFrame:
    """G7 (strict): random permutation, megabatches of n // n_groups rows, each
    sorted by length descending, flattened.  A megabatch can be a large share
    of the data, so the within-group sort is a second global-position pass
    over (megabatch, −length, shuffled position), not a window per group."""
    p = with_position(df.withColumn("_h", hash52(seed, op, F.col(key))), ["_h", key], "_sp")
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    p = attach_scalars(p, n).withColumn("_m", F.greatest(F.lit(1), F.floor(F.col("_n") / n_groups)))
    p = p.withColumn("megabatch", floor_div(F.col("_sp"), F.col("_m")))
    return with_position(p, [F.col("megabatch"), F.col(length).desc(), F.col("_sp")], "pos").drop("_h", "_n", "_m")


def top_k(df: DataFrame, group: str, score: Column, k: int, tie: str) -> DataFrame:
    """The k best rows per group (row_number ≤ k plans a WindowGroupLimit,
    so each partition keeps only k rows per group before the shuffle)."""
    w = Window.partitionBy(group).orderBy(score.desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def first_seen_ids(df: DataFrame, name: str, order: str, out: str = "first_seen_id") -> DataFrame:
    """Id by order of first appearance (min position per name, ranked on
    the small name table)."""
    first = df.groupBy(name).agg(F.min(order).alias("_first"))
    ids = with_position(first, ["_first", name], out).drop("_first")
    return df.join(ids, name)
