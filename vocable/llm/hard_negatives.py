"""Hard negatives by a vertical (BOND) scan of quantised vectors.

Vectors become integers, floor(256 x), once.  Rows are dealt into blocks of bounded
size, anchors into groups of bounded size, and every (block, group) cell is one
unit of work: a stated query set against all rows, in blocks, joined on the
cell's key, with no broadcast and no cell that grows with the table.

Inside a cell the block is columnar.  For each anchor the dimensions are read in
descending order of the anchor's magnitudes.  After every few dimensions the
smallest and largest contribution that the rest can still make, from the block's
column minima and maxima, bounds each row's score; rows that can't matter leave
the candidate bitmap.  Scores of rows that reach the last dimension are exact.

1. *Positives*: rows of the anchor's label.  A row leaves when its upper bound is
   below the k-th largest lower bound.  Best k per cell, merged over cells.
2. *Negatives*: rows of other labels.  Each positive opens a window of scores.  A
   row leaves when its bounds miss every window, or when in each window that it may
   still enter ``count`` rows that are surely inside already score above its upper
   bound.  Best ``count`` per cell and window, merged over cells.

Edge cases: rows with a null id, label or vector, or a null or non-finite
component take no part; vectors shorter than the longest count as zero there, an
empty vector scores 0; ties go to the smaller id, equal rows are rows of their
own (an anchor that occurs twice answers twice); a window of a negative positive
score is empty; an anchor without positives gives no rows; an empty table gives an
empty result; other columns are not read.  Components beyond ``LIMIT`` would make
scores that no long holds: they are an error, not a wrong score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocable.llm.store import written

SCALE = 256
#: Largest magnitude of a quantised component: a hundred times a score over 2**7 dimensions fits a long.
LIMIT = 1 << 24
#: Rows of a block, anchors of a group, dimensions read between two looks at the bounds.
BLOCK, GROUP, STEP = 8192, 1024, 8


def quantised(vector: Column) -> Column:
    """floor(256 x) of every component, x as a double; errors beyond ``LIMIT``."""
    def one(x):
        y = F.floor(F.lit(float(SCALE)) * x.cast("double"))
        return F.when(F.abs(y) <= LIMIT, y).otherwise(F.raise_error(F.lit("vector component beyond the quantised range")).cast("long"))
    return F.transform(vector, one).cast("array<long>")


def valid_rows(vectors: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """(vec_id, label, q) of the rows that take part."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    d = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"),
                       F.col(f"`{vector}`").cast("array<double>").alias("v"))
    return d.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite).select(
        "vec_id", "label", quantised(F.col("v")).alias("q"))


class Block:
    """The rows of a cell, one row of the matrix per dimension."""

    def __init__(self, q: pa.Array, dims: int):
        self.cols = matrix(q, dims).T.copy()
        self.low, self.high = self.cols.min(axis=1), self.cols.max(axis=1)

    def scan(self, anchor: np.ndarray, rows: np.ndarray, alive: Callable[[np.ndarray, np.ndarray], np.ndarray]):
        """(rows, scores) that are left of ``rows``; ``alive`` gets lower and upper bounds and says which stay."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        least = np.minimum(anchor * self.low, anchor * self.high)[order]
        most = np.maximum(anchor * self.low, anchor * self.high)[order]
        least = np.r_[least[::-1].cumsum()[::-1], 0]             # of the dimensions from each place on
        most = np.r_[most[::-1].cumsum()[::-1], 0]
        part = np.zeros(len(rows), np.int64)
        for at in range(0, len(order), STEP):
            some = order[at:at + STEP]
            some = some[anchor[some] != 0]
            whole = len(rows) == self.cols.shape[1]
            for d in some:
                part += anchor[d] * (self.cols[d] if whole else self.cols[d, rows])
            end = min(at + STEP, len(order))
            stay = alive(part + least[end], part + most[end])
            if not stay.all():
                rows, part = rows[stay], part[stay]
            if not len(rows):
                break
        return rows, part


def matrix(q: pa.Array, dims: int) -> np.ndarray:
    """Arrays of a column as rows of one matrix, zeros where they are shorter."""
    q = q.combine_chunks() if isinstance(q, pa.ChunkedArray) else q
    size = np.diff(np.asarray(q.offsets))
    flat = np.asarray(q.values)[int(q.offsets[0].as_py()):] if len(q) else np.zeros(0, np.int64)
    flat = flat[:int(size.sum())]
    if len(size) and (size == dims).all():
        return flat.reshape(len(size), dims).astype(np.int64)
    out = np.zeros((len(size), dims), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _best(rows: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int):
    """The k first by score, then id; rows that tie with the last place stay in the race."""
    if len(rows) > k:
        floor = np.partition(score, len(score) - k)[len(score) - k]
        near = score >= floor
        rows, score = rows[near], score[near]
    o = np.lexsort((ids[rows], -score))[:k]
    return rows[o], score[o]


def best_of_label(block: Block, ids: np.ndarray, rids: np.ndarray, labels: np.ndarray, anchor: np.ndarray,
                  rid: int, label: int, k: int):
    """The k best rows of the anchor's label in the block, the anchor itself left out."""
    rows = np.flatnonzero((labels == label) & (rids != rid))

    def alive(lower, upper):
        if len(lower) <= k:
            return np.ones(len(lower), bool)
        return upper >= np.partition(lower, len(lower) - k)[len(lower) - k]
    rows, score = block.scan(anchor, rows, alive)
    return _best(rows, score, ids, k)


def windows_of_others(block: Block, ids: np.ndarray, labels: np.ndarray, anchor: np.ndarray, label: int,
                      low: np.ndarray, high: np.ndarray, count: int):
    """For each window [low, high] the first ``count`` rows of other labels in the block."""
    rows = np.flatnonzero(labels != label)

    def alive(lower, upper):
        stay = np.zeros(len(lower), bool)
        for a, b in zip(low, high):
            may = (upper >= a) & (lower <= b)
            sure = lower[(lower >= a) & (upper <= b)]
            if len(sure) > count:
                may &= upper >= np.partition(sure, len(sure) - count)[len(sure) - count]
            stay |= may
        return stay
    rows, score = block.scan(anchor, rows, alive)
    for a, b in zip(low, high):
        inside = (score >= a) & (score <= b)
        yield _best(rows[inside], score[inside], ids, count)


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def _positives(dims: int, k: int):
    def solve(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and anchors.num_rows:
            block = Block(rows.column("q"), dims)
            ids, rids, labels = (_column(rows, c) for c in ("vec_id", "rid", "label"))
            for a, rid, label in zip(matrix(anchors.column("q"), dims), _column(anchors, "rid"), _column(anchors, "label")):
                best, score = best_of_label(block, ids, rids, labels, a, rid, label, k)
                out += [(rid, ids[r], rids[r], s) for r, s in zip(best, score)]
        return _table(out, ["anchor", "positive_id", "positive_rid", "positive_score"])
    return solve


def _negatives(dims: int, count: int):
    def solve(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and anchors.num_rows:
            block = Block(rows.column("q"), dims)
            ids, labels = _column(rows, "vec_id"), _column(rows, "label")
            windows = anchors.column("windows").to_pylist()
            for a, rid, label, ws in zip(matrix(anchors.column("q"), dims), _column(anchors, "rid"), _column(anchors, "label"), windows):
                low, high = (np.array([w[c] for w in ws], np.int64) for c in ("low", "high"))
                for w, (best, score) in zip(ws, windows_of_others(block, ids, labels, a, label, low, high, count)):
                    out += [(rid, w["place"], ids[r], s) for r, s in zip(best, score)]
        return _table(out, ["anchor", "place", "negative_id", "negative_score"])
    return solve


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.table([pa.array(np.array(c, np.int64)) for c in cols], names=names)


def _cells(rows: DataFrame, anchors: DataFrame, n_blocks: int, n_groups: int, solve, schema: str) -> DataFrame:
    """``solve`` on every (block of rows, group of anchors); either side is bounded."""
    number = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    r = rows.withColumn("block", number("rid", n_blocks)).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    a = anchors.withColumn("grp", number("rid", n_groups)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    return r.groupBy("block", "grp").cogroup(a.groupBy("block", "grp")).applyInArrow(solve, schema)


def hard_negatives(vectors: DataFrame, positives: int = 5, count: int = 10, low: int = 30, high: int = 90, anchor_every: int = 100,
                   vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose id is divisible by ``anchor_every``; a negative's score
    lies between ``low`` and ``high`` hundredths of the positive's.
    """
    rows = written(valid_rows(vectors, vec_id, vector, label).withColumn("rid", F.monotonically_increasing_id()), "negatives-rows")
    is_anchor = F.pmod("vec_id", F.lit(anchor_every)) == 0
    n, n_anchors, dims = rows.agg(F.count(F.lit(1)), F.count_if(is_anchor), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    if dims > 128:
        raise ValueError("scores of more than 128 dimensions may not fit a long")
    n_blocks, n_groups = max(1, -(-n // BLOCK)), max(1, -(-n_anchors // GROUP))
    anchors = written(rows.where(is_anchor), "negatives-anchors")

    found = _cells(rows, anchors, n_blocks, n_groups, _positives(dims, positives),
                   "anchor long, positive_id long, positive_rid long, positive_score long")
    first = F.row_number().over(_by_score("anchor", "positive_score", "positive_id", "positive_rid"))
    pairs = written(found.withColumn("place", first).where(F.col("place") <= positives), "negatives-positives")

    # 100 * score within [low, high] * positive score, in whole numbers; nothing lies there below zero
    windows = pairs.where("positive_score >= 0").groupBy("anchor").agg(F.collect_list(F.struct(
        F.col("place").cast("long").alias("place"), F.expr(f"({low} * positive_score + 99) div 100").alias("low"),
        F.expr(f"{high} * positive_score div 100").alias("high"))).alias("windows"))
    asked = anchors.join(windows, anchors["rid"] == windows["anchor"]).drop("anchor")
    found = _cells(rows, asked, n_blocks, n_groups, _negatives(dims, count),
                   "anchor long, place long, negative_id long, negative_score long")
    rank = F.row_number().over(_by_score(["anchor", "place"], "negative_score", "negative_id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= count)
    names = anchors.select(F.col("rid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return best.join(pairs.select("anchor", F.col("place").cast("long").alias("place"), "positive_id", "positive_score"),
                     ["anchor", "place"]).join(names, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def _by_score(by, score: str, *ties: str):
    from pyspark.sql import Window
    return Window.partitionBy(by).orderBy(F.desc(score), *ties)


def relabelled(vectors: DataFrame, every: int = 7, classes: int = 10) -> DataFrame:
    """``vectors`` with the label of every ``every``-th id moved on by one, modulo ``classes``."""
    moved = F.pmod(F.col("label") + 1, F.lit(classes)).cast(vectors.schema["label"].dataType)
    return vectors.withColumn("label", F.when(F.pmod("vec_id", F.lit(every)) == 0, moved).otherwise(F.col("label")))
