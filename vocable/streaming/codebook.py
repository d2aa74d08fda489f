"""K8: an online codebook with its window of codes, as one versioned state of several tables.

A micro-batch is one step: codes that were dead or over-used in the last
``max_codes`` codes get the vector of a hash-chosen row of the batch, and with it
their average and size start anew; then codes are assigned, the window moves on
and averages, sizes and centroids are updated.

The state is the codebook (code, centroid, average, size) and the window (seq,
code).  A step writes both to fresh folders and then commits one manifest row per
epoch, which names them.  An epoch reads only what the manifest of the epoch
before names: a step that is killed leaves folders that nothing names, and one
that is run again starts from the same state, whatever the first run left.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocable.functions.hashing import hash52
from vocable.operators.vectors import nearest_code
from vocable.plans.position import with_position
from vocable.session import path_exists, written

#: Codes in the window, and shares beyond which a code is given up.
MAX_CODES, OVER_USED, DEAD = 64_000, 0.9, 0.01
BOOK = "code int, centroid array<double>, average array<double>, size double"
RING = "seq long, code int"
MANIFEST = "book string, ring string, seen long, total long, n_reset long"


def _zip_sum(a, b):
    return F.zip_with(a, b, lambda x, y: x + y)


def usage_flags(ring: DataFrame, book: DataFrame, n: int) -> DataFrame:
    """Codes of ``book`` whose share of the window's ``n`` codes is out of bounds."""
    share = F.coalesce("c", F.lit(0)) / F.lit(n)
    used = ring.groupBy("code").agg(F.count(F.lit(1)).alias("c"))
    return book.select("code").join(used, "code", "left").where((share > OVER_USED) | (share < DEAD)).select("code")


def reset(book: DataFrame, flagged: DataFrame, rows: DataFrame, vec: str, n: int, seed: int, epoch: int) -> DataFrame:
    """``book`` with the flagged codes at hash-chosen rows (``pos`` 0 to n - 1), averages and sizes with them."""
    pick = flagged.select("code", F.pmod(hash52(seed, f"k8-{epoch}", F.col("code")), F.lit(n)).alias("pos"))
    new = pick.join(rows, "pos").select("code", F.transform(vec, lambda v: v.cast("double")).alias("_new"))
    b = book.join(new, "code", "left")
    changed = F.col("_new").isNotNull()
    return b.select("code", F.coalesce("_new", "centroid").alias("centroid"), F.coalesce("_new", "average").alias("average"),
                    F.when(changed, 0.0).otherwise(F.col("size")).alias("size"))


def update(book: DataFrame, assigned: DataFrame, vec: str, decay: float, eps: float) -> DataFrame:
    """Sizes and averages move towards the batch's counts and sums; centroids are averages over smoothed sizes."""
    sums = assigned.select("code", F.posexplode(vec).alias("pos", "x")).groupBy("code", "pos").agg(F.sum(F.col("x").cast("double")).alias("s"))
    sums = sums.groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda r: r["s"]).alias("_sum"))
    counts = assigned.groupBy("code").agg(F.count(F.lit(1)).cast("double").alias("_cnt"))
    b = book.join(sums, "code", "left").join(counts, "code", "left")
    part = F.coalesce("_sum", F.transform("average", lambda _: F.lit(0.0)))
    b = b.select("code", F.zip_with("average", part, lambda a, s: a * decay + s * (1 - decay)).alias("average"),
                 (F.col("size") * decay + F.coalesce("_cnt", F.lit(0.0)) * (1 - decay)).alias("size"))
    b = written(b, "codebook-step")
    n, n_codes = b.agg(F.sum("size"), F.count(F.lit(1))).first()
    norm = (F.col("size") + eps) / (n + n_codes * eps) * n
    return b.select("code", F.transform("average", lambda a: a / norm).alias("centroid"), "average", "size")


class CodebookState:
    """The state's tables by epoch, below ``root``."""

    def __init__(self, spark: SparkSession, root: str, initial: DataFrame):
        self.spark, self.root, self.initial = spark, root, initial

    def at(self, epoch: int) -> tuple[DataFrame, DataFrame | None, int, int]:
        """(book, window, codes since the last reset, codes in all) after ``epoch``; -1 is before the first."""
        if epoch < 0:
            start = self.initial.select(F.col("code").cast("int").alias("code"), "centroid", F.col("centroid").alias("average"), F.lit(0.0).alias("size"))
            return start, None, 0, 0
        m = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/epoch={epoch}").first()
        return (self.spark.read.schema(BOOK).parquet(m.book), self.spark.read.schema(RING).parquet(m.ring), m.seen, m.total)

    def resets(self, epoch: int) -> int:
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/epoch={epoch}").first().n_reset

    def commit(self, epoch: int, book: DataFrame, ring: DataFrame, seen: int, total: int, n_reset: int) -> None:
        """Write the tables to folders of their own, then the manifest row that names them."""
        place = f"{self.root}/data/{uuid.uuid4().hex}"
        book.write.parquet(f"{place}/book")
        ring.write.parquet(f"{place}/ring")
        row = [(f"{place}/book", f"{place}/ring", seen, total, n_reset)]
        self.spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/epoch={epoch}")

    def last(self) -> int:
        """The newest committed epoch, -1 if there is none."""
        epoch = -1
        while path_exists(self.spark, f"{self.root}/manifest/epoch={epoch + 1}/_SUCCESS"):
            epoch += 1
        return epoch


def step(state: CodebookState, batch: DataFrame, epoch: int, key: str, vec: str, max_codes: int = MAX_CODES, decay: float = 0.99,
         eps: float = 1e-5, seed: int = 0) -> None:
    """One micro-batch; rows are taken in the order of ``key``, which is unique."""
    book, ring, seen, total = state.at(epoch - 1)
    rows = written(with_position(batch.select(key, vec).where(F.col(vec).isNotNull()), [key], "pos"), "codebook-batch")
    n = rows.count()
    n_reset = 0
    if n and seen > max_codes:                       # the window is full
        flagged = written(usage_flags(ring, book, max_codes), "codebook-flags")
        n_reset = flagged.count()
        if n_reset:
            book = written(reset(book, flagged, rows, vec, n, seed, epoch), "codebook-reset")
            seen, ring = 0, None
    if n:
        assigned = written(nearest_code(rows.select("pos", vec), vec, book.select("code", "centroid")), "codebook-codes")
        fresh = assigned.where(F.col("pos") >= n - max_codes).select((F.col("pos") + total).alias("seq"), "code")
        kept = ring.where(F.col("seq") >= total + n - max_codes) if ring is not None else None
        ring = fresh if kept is None else kept.unionByName(fresh)
        book = update(book, assigned, vec, decay, eps)
    elif ring is None:
        ring = rows.select(F.col("pos").alias("seq"), F.lit(0).alias("code"))
    state.commit(epoch, book, ring, seen + n, total + n, n_reset)


def online_codebook(stream: DataFrame, state: CodebookState, chk: str, key: str, vec: str, **options):
    """The stream writer that makes one :func:`step` of each micro-batch."""
    return stream.writeStream.foreachBatch(lambda batch, epoch: step(state, batch, epoch, key, vec, **options)).option("checkpointLocation", chk)
