"""Global row position, running sums and as-of matching without a one-task window.

``row_number() over (order by k)`` moves every row into one task.  Instead the
rows are range-partitioned on the order key (Spark chooses and adapts the number
of partitions), sorted inside each partition and written, with partition number
and local number, to the shared folder.  One row per partition then says where
each partition begins; that small table is joined back.

The written table makes the second use read the very same partitions: range
bounds come from sampling, and computing them twice could differ.  A lost
executor costs the job it was working on, and nothing stays cached.  The order
key must be a total order: give a unique tie-breaker.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocable.session import written

#: ``monotonically_increasing_id`` keeps the row's number inside its partition in the lower 33 bits.
_LOCAL = (1 << 33) - 1


def _cols(order):
    return [F.col(c) if isinstance(c, str) else c for c in order]


def _ranged(df: DataFrame, order: list, num_partitions: int | None) -> DataFrame:
    n = [num_partitions] if num_partitions else []
    return df.repartitionByRange(*n, *order).sortWithinPartitions(*order).withColumn(
        "_pp", F.spark_partition_id()).withColumn("_ln", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL)))


def _local_cumsum(batches):
    running = 0.0
    for pdf in batches:
        c = pdf["_w"].cumsum() + running
        if len(c):
            running = float(c.iloc[-1])
        yield pdf.assign(_lcum=c)


def with_position(df: DataFrame, order: list, pos_col: str = "pos", num_partitions: int | None = None,
                  weight: Column | None = None, cum_col: str | None = None, total_col: str | None = None) -> DataFrame:
    """Add a 0-based global position ``pos_col`` in ``order``.

    ``total_col`` adds the number of rows, from the same per-partition counts.
    With ``weight``, ``cum_col`` is the running sum of the weight up to and
    including the row, and ``<cum_col>_total`` the sum over all rows.
    """
    tagged = _ranged(df, _cols(order), num_partitions)
    aggs = [F.count(F.lit(1)).alias("_n")]
    if weight is not None:
        tagged = tagged.withColumn("_w", weight.cast("double"))
        tagged = tagged.mapInPandas(_local_cumsum, T.StructType(
            list(tagged.schema.fields) + [T.StructField("_lcum", T.DoubleType())]))
        aggs.append(F.sum("_w").alias("_wsum"))
    tagged = written(tagged, "position")
    before, everything = Window.orderBy("_pp").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    # One row per partition: bounded by the partition count, safe in one window and to broadcast.
    parts = tagged.groupBy("_pp").agg(*aggs).withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    parts = parts.withColumn("_total", F.sum("_n").over(everything))
    if weight is not None:
        parts = parts.withColumn("_woff", F.coalesce(F.sum("_wsum").over(before), F.lit(0.0))).withColumn(
            "_wtotal", F.sum("_wsum").over(everything)).drop("_wsum")
    out = tagged.join(F.broadcast(parts.drop("_n")), "_pp").withColumn(pos_col, (F.col("_off") + F.col("_ln")).cast("long"))
    if total_col:
        out = out.withColumn(total_col, F.col("_total"))
    if weight is not None:
        name = cum_col or "cum_weight"
        out = out.withColumn(name, F.col("_woff") + F.col("_lcum")).withColumn(name + "_total", F.col("_wtotal"))
    return out.drop("_pp", "_ln", "_off", "_total", "_w", "_lcum", "_woff", "_wtotal")


_COMBINE = {"sum": (F.sum, lambda a, b: a + b), "min": (F.min, F.least), "max": (F.max, F.greatest)}
_FOLD = {"sum": np.add, "min": np.fmin, "max": np.fmax}


def _segments(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """True where a row's key differs from the row before; nulls are equal to each other."""
    new = np.zeros(len(pdf), bool)
    new[0] = True
    for k in keys:
        v = pdf[k]
        same = (v == v.shift()) | (v.isna() & v.shift().isna())
        new[1:] |= ~same.to_numpy(bool)[1:]
    return new


def _local_running(keys: list[str], specs: list[tuple[str, str, str]]):
    """Running aggregates per key inside a sorted partition.

    A key's rows are neighbours, so only the first run of a batch can continue
    the batch before; nothing is kept per key.
    """
    def fn(batches):
        last_key, last = None, {}
        for pdf in batches:
            if len(pdf) == 0:
                continue
            out = pdf.reset_index(drop=True)
            run = pd.Series(np.cumsum(_segments(out, keys)))
            goes_on = last_key is not None and all(
                (a == b) or (pd.isna(a) and pd.isna(b)) for a, b in zip(last_key, out.loc[0, keys]))
            first = (run == 1).to_numpy()
            for src, how, dst in specs:
                g = out[src].astype("float64").groupby(run, sort=False)
                loc = {"sum": g.cumsum, "min": g.cummin, "max": g.cummax}[how]().to_numpy().copy()
                if goes_on:
                    loc[first] = _FOLD[how](loc[first], last[dst])
                out["_loc_" + dst] = loc
                last[dst] = float(loc[-1])
            last_key = list(out.loc[len(out) - 1, keys])
            yield out
    return fn


def keyed_running(df: DataFrame, keys: list[str], order: list, aggs: list[tuple[str, str, str]],
                  num_partitions: int | None = None) -> DataFrame:
    """Running ``sum``/``min``/``max`` per key in ``order`` without a window
    partitioned by the key (a hot key would be one task).

    ``aggs`` = [(source column, "sum"|"min"|"max", output column)].  Rows are
    range-partitioned on (keys, order), so a hot key is spread over several
    partitions; per (partition, key) totals form a small table whose running
    combination gives each partition's start.  (keys, order) must be a total order.
    """
    order = _cols(order)
    tagged = _ranged(df, [F.col(k) for k in keys] + order, num_partitions)
    schema = T.StructType(list(tagged.schema.fields) + [T.StructField("_loc_" + dst, T.DoubleType()) for _, _, dst in aggs])
    body = written(tagged.mapInPandas(_local_running(keys, aggs), schema), "running")
    parts = body.groupBy("_pp", *keys).agg(*[_COMBINE[how][0](F.col(src).cast("double")).alias("_p_" + dst)
                                             for src, how, dst in aggs])
    # One row per key and partition it spans: a hot key has as many rows as partitions.
    w = Window.partitionBy(*keys).orderBy("_pp").rowsBetween(Window.unboundedPreceding, -1)
    offs = parts.select(F.col("_pp").alias("_op"), *[F.col(k).alias("_k_" + k) for k in keys],
                        *[_COMBINE[how][0]("_p_" + dst).over(w).alias("_o_" + dst) for _, how, dst in aggs])
    on = body["_pp"] == offs["_op"]
    for k in keys:
        on = on & body[k].eqNullSafe(offs["_k_" + k])
    out = body.join(offs, on, "left")
    for _, how, dst in aggs:
        out = out.withColumn(dst, F.when(F.col("_o_" + dst).isNull(), F.col("_loc_" + dst))
                             .otherwise(_COMBINE[how][1](F.col("_o_" + dst), F.col("_loc_" + dst))))
    return out.drop("_pp", "_ln", "_op", *["_k_" + k for k in keys],
                    *[c for _, _, d in aggs for c in ("_loc_" + d, "_o_" + d)])


def _fill_forward(batches):
    """Carry the last mark of the partition to the points after it; points before
    the first mark stay open."""
    last = None
    for pdf in batches:
        mark = pdf["_mark"]
        filled = mark.ffill()
        if last is not None:
            filled = filled.fillna(last)
        if len(filled) and pd.notna(filled.iloc[-1]):
            last = filled.iloc[-1]
        yield pdf.assign(_fill=filled)


def last_mark_before(points: DataFrame, marks: DataFrame, at: str, point: str, mark: str) -> DataFrame:
    """As-of match: for every row of ``points`` the ``mark`` with the largest
    position not above its own.  Both have a numeric column ``at``; ``mark`` is a
    unique number.  Returns (point, mark), without points before the first mark.

    Points and marks are sorted together by ranges, one pass carries marks
    forward, and the points at the head of a partition take the last mark of the
    partitions before: work and memory grow with the rows, whatever their spread.
    """
    both = points.select(F.col(at).alias("_at"), F.col(point).cast("long").alias("_point"),
                         F.lit(None).cast("long").alias("_mark")).unionByName(
        marks.select(F.col(at).alias("_at"), F.lit(None).cast("long").alias("_point"), F.col(mark).cast("long").alias("_mark")))
    # marks before points of the same position: a mark holds from its own position on
    ranged = _ranged(both, [F.col("_at"), F.col("_mark").isNull(), F.col("_mark"), F.col("_point")], None).select(
        "_pp", "_ln", "_point", F.col("_mark").cast("string").alias("_mark"))
    filled = written(ranged.mapInPandas(_fill_forward, "_pp int, _ln long, _point long, _mark string, _fill string"), "as-of")
    ends = filled.groupBy("_pp").agg(F.max_by("_fill", "_ln").alias("_end"))
    w = Window.orderBy("_pp").rowsBetween(Window.unboundedPreceding, -1)
    heads = ends.select("_pp", F.last("_end", ignorenulls=True).over(w).alias("_head"))   # one row per partition
    out = filled.where(F.col("_point").isNotNull()).join(F.broadcast(heads), "_pp")
    return out.select(F.col("_point").alias(point), F.coalesce("_fill", "_head").cast("long").alias(mark)).where(
        F.col(mark).isNotNull())
