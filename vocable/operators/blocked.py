"""Best entry of a table of vectors for every row, as a product in blocks.

The entries (a codebook, class means) are cut into blocks of at most
``BLOCK_BYTES`` by position.  One block at a time is brought to the driver as one
matrix and broadcast, so neither holds more than that, whatever the table's
size; rows pass one Arrow stage per block and carry (best value, best entry), a
running minimum that is merged in block order.  Rows are not shuffled, there is
one plan for every size, and after ``STAGES`` blocks the rows are written, so that
a task never holds more than that many matrices.

Values that differ by less than the rounding of the product count as equal, and
the entry that comes first wins: the result does not depend on the block size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocable.plans.position import with_position
from vocable.session import written

BLOCK_BYTES, STAGES = 32 << 20, 8
#: Share of a value's magnitude below which a difference is rounding.
TIE = 1e-12


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as one matrix; all of one length, none null."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(np.asarray(column.offsets))
    if len(size) == 0:
        return np.zeros((0, 0))
    if column.null_count or (size != size[0]).any():
        raise ValueError("vectors must be of one length and not null")
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(size), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _stage(shared, vec: str, out: str, value: str, cosine: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, entries = shared.value
        square = (entries * entries).sum(axis=1)
        for batch in batches:
            where = {f.name: k for k, f in enumerate(batch.schema)}
            columns = list(batch.columns)
            valid = np.asarray(batch.column(where[vec]).is_valid())
            x = matrix(batch.column(where[vec]).drop_null())
            if len(x):
                if cosine:
                    d = -_unit(x) @ entries.T
                    near = np.full(len(x), TIE)
                else:
                    own = (x * x).sum(axis=1)
                    d = own[:, None] - 2.0 * x @ entries.T + square
                    near = TIE * (own + square.max(initial=0.0)) + 1e-300
                least = d.min(axis=1)
                k = (d <= (least + near)[:, None]).argmax(axis=1)
                before = np.asarray(batch.column(where[value]).filter(pa.array(valid)).fill_null(np.inf))
                better = least < before - np.where(np.isfinite(before), near, 0.0)
                at = np.flatnonzero(valid)
                # the old entry or, at `size + k`, the new one
                pick = np.arange(batch.num_rows)
                pick[at[better]] = batch.num_rows + k[better]
                both = pa.concat_arrays([batch.column(where[out]), names])
                columns[where[out]] = both.take(pa.array(pick))
                now = batch.column(where[value]).to_numpy(zero_copy_only=False).astype(float).copy()
                now[at[better]] = least[better]
                columns[where[value]] = pa.array(now, pa.float64(), from_pandas=True)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)
    return run


def best_entry(rows: DataFrame, vec: str, entries: DataFrame, name: str, vector: str, out: str, value: str, cosine: bool = False) -> DataFrame:
    """``rows`` with the entry of least squared distance (or largest cosine) in ``out`` and that value in ``value``.

    ``entries`` has (name, vector), each name once, in whose order ties are broken.
    A null vector gets nulls; without entries all rows do.
    """
    size = entries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector)).alias("dim")).first()
    per_block = max(1, BLOCK_BYTES // (8 * max(1, size.dim or 1)))
    placed = with_position(entries.select(name, F.col(vector).cast("array<double>").alias(vector)), [name], "_place")
    done = rows.select("*", F.lit(None).cast(entries.schema[name].dataType).alias(out), F.lit(None).cast("double").alias(value))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in done.schema])
    for stage, start in enumerate(range(0, size.n, per_block)):
        got = placed.where((F.col("_place") >= start) & (F.col("_place") < start + per_block)).orderBy("_place").toArrow()
        m = matrix(got.column(vector))
        shared = rows.sparkSession.sparkContext.broadcast((got.column(name).combine_chunks(), _unit(m) if cosine else m))
        done = done.mapInArrow(_stage(shared, vec, out, value, cosine), schema)
        if stage % STAGES == STAGES - 1:
            done = written(done, "blocked")
    return done.withColumn(value, -F.col(value) if cosine else F.greatest(F.col(value), F.lit(0.0)))
