"""Chunks of a keyed stream where one key may hold most of a micro-batch.

A micro-batch is numbered by key with the keyed-running helper: rows are
range-partitioned on (key, order), so a hot key is spread over all tasks, and
nothing gathers a key's rows.  What a key carries over is small: how many values it
has had and the values of its unfinished chunk.  That table is written per epoch
and read by the next one; an epoch that runs again reads the same version and
replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocable.operators.clips import indexed
from vocable.session import written

CARRY = "key long, seen long, tail array<double>"


class ChunkState:
    """Carry tables and results by epoch, below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def carry(self, epoch: int) -> DataFrame:
        """(key, seen, tail) after ``epoch``; -1 is before the first."""
        if epoch < 0:
            return self.spark.createDataFrame([], CARRY)
        return self.spark.read.schema(CARRY).parquet(f"{self.root}/carry/epoch={epoch}")

    def chunks(self) -> DataFrame:
        """(key, chunk_idx, n, chunk) of all epochs; an unfinished chunk has a row for each epoch that touched it."""
        return self.spark.read.parquet(f"{self.root}/chunks").drop("epoch")


def chunk_step(state: ChunkState, batch: DataFrame, epoch: int, key: str, order: list[str], value: str, n: int) -> None:
    """One micro-batch: every chunk of ``n`` values that it touches, with what earlier ones left of it in front."""
    before = state.carry(epoch - 1)
    rows = indexed(batch.select(F.col(key).cast("long").alias("key"), *order, F.col(value).cast("double").alias("x")), "key", order, "i")
    placed = rows.join(before.select("key", "seen"), "key", "left").withColumn("_at", F.coalesce("seen", F.lit(0)) + F.col("i"))
    pieces = placed.groupBy("key", F.floor(F.col("_at") / n).alias("chunk_idx")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_at", "x"))), lambda s: s["x"]).alias("_x"))
    open_ = before.where(F.size("tail") > 0).select("key", F.floor(F.col("seen") / n).alias("chunk_idx"), "tail")
    full = pieces.join(open_, ["key", "chunk_idx"], "left").select(
        "key", "chunk_idx", F.concat(F.coalesce("tail", F.array().cast("array<double>")), "_x").alias("chunk"))
    full = written(full.withColumn("n", F.size("chunk").cast("long")), "chunks-step")
    now = full.groupBy("key").agg(F.max("chunk_idx").alias("last"), F.max_by("chunk", "chunk_idx").alias("tail"))
    done = F.size("tail") == n
    carry = now.select("key", (F.col("last") * n + F.size("tail")).alias("seen"), F.when(done, F.array().cast("array<double>")).otherwise(
        F.col("tail")).alias("tail"))
    kept = before.join(now.select("key"), "key", "left_anti")
    full.select("key", "chunk_idx", "n", "chunk").write.mode("overwrite").parquet(f"{state.root}/chunks/epoch={epoch}")
    carry.unionByName(kept).write.mode("overwrite").parquet(f"{state.root}/carry/epoch={epoch}")


def chunk_sink(stream: DataFrame, state: ChunkState, chk: str, key: str, order: list[str], value: str, n: int):
    """The stream writer that makes one :func:`chunk_step` of each micro-batch."""
    return stream.writeStream.foreachBatch(lambda batch, epoch: chunk_step(state, batch, epoch, key, order, value, n)).option(
        "checkpointLocation", chk)


def longest(chunks: DataFrame) -> DataFrame:
    """The last state of each chunk."""
    return chunks.groupBy("key", "chunk_idx").agg(F.max_by("chunk", "n").alias("chunk"), F.max("n").alias("n"))
