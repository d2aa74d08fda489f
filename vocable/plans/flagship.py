"""The minimum end-to-end slice.

documents → sample schema → basic cleaner → length filter → character
vocabulary → ids → sort by audio length → fixed-size batches → per batch:
rows, max length, padded cells, padding ratio and the id checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocable.functions.text import basic_cleaners
from vocable.operators.filters import length_bounds
from vocable.operators.vocab import build_vocabulary, encode_chars_lut, vocab_lut
from vocable.plans.position import with_position
from vocable.sources.tables import samples

# Parameters of the flagship run.
MIN_TEXT_LEN, MAX_TEXT_LEN = 1, 2000          # words
MIN_AUDIO_LEN, MAX_AUDIO_LEN = 100, 20000     # audio_length units
BATCH_SIZE = 32


def encoded_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).select("doc_id", "audio_length", "text_length",
                                      basic_cleaners(F.col("text")).alias("clean"))
    kept = length_bounds(s, MIN_TEXT_LEN, MAX_TEXT_LEN, MIN_AUDIO_LEN, MAX_AUDIO_LEN)
    vocab = build_vocabulary(kept, "clean")
    lut = vocab_lut(vocab)
    return kept.select("doc_id", "audio_length", encode_chars_lut(F.col("clean"), lut).alias("ids"))


def batch_report(spark: SparkSession, sf_dir: str, batch_size: int = BATCH_SIZE) -> DataFrame:
    enc = encoded_samples(spark, sf_dir)
    # Reduce each row to its measures before ordering: the sort and the cached
    # positioned frame then carry four longs per row, not the id arrays.
    per_row = enc.select("doc_id", "audio_length", F.size("ids").cast("long").alias("n_ids"),
                         F.aggregate("ids", F.lit(0).cast("long"), lambda acc, x: acc + x).alias("row_id_sum"))
    ordered = with_position(per_row, ["audio_length", "doc_id"])
    b = ordered.withColumn("batch_id", F.expr(f"pos div {batch_size}"))
    per_batch = b.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max("n_ids").alias("max_len"),
        F.sum("n_ids").alias("sum_len"),
        F.sum("row_id_sum").alias("id_sum"),
    )
    return per_batch.select(
        "batch_id", "n_rows", "max_len", "sum_len",
        (F.col("n_rows") * F.col("max_len")).alias("padded_cells"),
        F.round(1.0 - F.col("sum_len") / (F.col("n_rows") * F.col("max_len")), 6).alias("padding_ratio"),
        "id_sum",
    )
