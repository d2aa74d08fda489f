"""Folds and the bounded training sample shared by the two classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def training_sample(docs: DataFrame, labels: DataFrame, label: str, n_folds: int, held_out: int,
                    max_docs: int) -> DataFrame:
    """(text, y, ord) of at most ``max_docs`` labelled documents outside the held-out fold.

    The ids come first, in the order of a hash, from the narrow label table; only
    their texts are then read, through a broadcast of those at most ``max_docs``
    ids.  Repeated label rows count once (largest label), null labels not at all,
    and an id that many rows share lends its smallest text.
    """
    ids = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
           .where(fold(F.col("doc_id"), n_folds) != held_out)
           .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
           .withColumn("ord", F.xxhash64("doc_id")).orderBy("ord", "doc_id").limit(max_docs))
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select("doc_id", text).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y", "ord").agg(
        F.min("text").alias("text")).select("text", "y", "ord")


def in_one_task(sample: DataFrame) -> DataFrame:
    """The bounded sample in one sorted partition, for a sequential learner."""
    return sample.repartition(1).sortWithinPartitions("ord", "text")
