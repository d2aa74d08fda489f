"""I: array shaping for batches (all higher-order functions, JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocable.operators.common import col


def _pad(a: Column, n: Column, value) -> Column:
    return F.concat(a, F.array_repeat(F.lit(value).cast(_elem_cast(value)), F.greatest(n - F.size(a), F.lit(0))))


def _elem_cast(value) -> str:
    return "double" if isinstance(value, float) else "bigint"


def pad_to(a, n, value=0) -> Column:
    """Right-pad to length ``n`` (no truncation)."""
    return _pad(col(a), col(n) if not isinstance(n, int) else F.lit(n), value)


def pad_batch(df: DataFrame, batch: str, arr: str, value=0, multiple: int | None = None,
              out: str = "padded") -> DataFrame:
    """Pad every array of a batch to the batch maximum (rounded up to a
    multiple of ``multiple``).  The batch is bounded, so its window is."""
    m = F.max(F.size(arr)).over(Window.partitionBy(batch))
    if multiple:
        m = m + F.pmod(-m, F.lit(multiple))
    return df.withColumn("_m", m).withColumn(out, pad_to(arr, F.col("_m"), value)).withColumnRenamed(
        "_m", "batch_max")


def round_up(m, r: int) -> Column:
    """``m`` rounded up to a multiple of ``r``."""
    return col(m) + F.pmod(-col(m), F.lit(r))


def stop_targets(length, padded_len) -> Column:
    """Zeros for length−1 steps, one 1, then 1s up to the padded length."""
    L = col(length)
    return F.concat(F.array_repeat(F.lit(0.0), L - 1), F.array_repeat(F.lit(1.0), col(padded_len) - L + 1))


def reduce_stop_targets(stop, r: int) -> Column:
    """I3 reduced by r: one value per group of r steps, 1 when any step is > 0."""
    s = col(stop)
    return F.transform(F.sequence(F.lit(0), (F.size(s) / r).cast("int") - 1),
                       lambda g: F.when(F.exists(F.slice(s, g * r + 1, r), lambda v: v > 0), F.lit(1.0))
                       .otherwise(F.lit(0.0)))


def sequence_mask(length, max_len) -> Column:
    """I4: position < length for positions 0..max_len−1."""
    return F.transform(F.sequence(F.lit(0), col(max_len) - 1), lambda i: i < col(length))


def pad_or_truncate(a, n: int, value=0) -> Column:
    """Exactly ``n`` elements."""
    return _pad(F.slice(col(a), 1, n), F.lit(n), value)


def trim_to_multiple(a, m: int) -> Column:
    """Drop ``size % m`` elements from the end."""
    s = F.size(col(a))
    return F.slice(col(a), 1, s - F.pmod(s, F.lit(m)))


def edge_pad_frames(a, n_frames, hop: int) -> Column:
    """I8: repeat the last sample ``hop`` times, then cut to frames·hop."""
    x = col(a)
    return F.slice(F.concat(x, F.array_repeat(F.element_at(x, -1), F.lit(hop))), 1, col(n_frames) * hop)


def pad_2d(m, rows: int, cols: int, value=0.0) -> Column:
    """Pad both axes of an array of arrays; a negative pad fails the row."""
    x = col(m)
    guard = F.when((F.size(x) <= rows) & F.forall(x, lambda r: F.size(r) <= cols), F.lit(True)).otherwise(
        F.raise_error(F.lit("negative padding")))
    padded_rows = F.transform(x, lambda r: _pad(r, F.lit(cols), value))
    empty = F.array_repeat(F.lit(value), F.lit(cols))
    return F.when(guard, F.concat(padded_rows, F.array_repeat(empty, F.lit(rows) - F.size(x))))


def adjacent_diff(a) -> Column:
    """x[t+1] − x[t]."""
    x = col(a)
    return F.zip_with(F.slice(x, 2, F.size(x)), F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))),
                      lambda nxt, cur: nxt - cur)


def add_bos_eos(a, bos: int, eos: int) -> Column:
    """[bos, …, eos]."""
    return F.concat(F.array(F.lit(bos).cast("bigint")), col(a), F.array(F.lit(eos).cast("bigint")))


def intersperse(a, blank: int) -> Column:
    """Blank between elements and at both ends (2n + 1)."""
    return F.concat(F.array(F.lit(blank).cast("bigint")),
                    F.flatten(F.transform(col(a), lambda x: F.array(x.cast("bigint"), F.lit(blank).cast("bigint")))))


def shifted_pair(a, start: int, stop: int) -> tuple[Column, Column]:
    """input = [start] + x, target = x + [stop]."""
    x = col(a)
    return (F.concat(F.array(F.lit(start).cast("bigint")), x), F.concat(x, F.array(F.lit(stop).cast("bigint"))))


def replace_tail(a, length, token: int) -> Column:
    """Positions ≥ length become ``token``."""
    return F.transform(col(a), lambda v, i: F.when(i >= col(length), F.lit(token).cast("bigint")).otherwise(v))
