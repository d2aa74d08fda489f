"""M: evaluation over (prediction, target) and alignment tables, in long form.

Every measure is a grouped aggregate (partial sums before the shuffle);
"each sequence weighted equally" is a second-level average.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def masked_losses(long_pt: DataFrame, seq: str, pos: str, pred: str, tgt: str, length: str,
                  huber_delta: float = 1.0) -> DataFrame:
    """M1: L1, MSE and Huber over unmasked positions (pos < length): pooled
    means and per-sequence-equal means.  One row."""
    d = long_pt.where(F.col(pos) < F.col(length)).withColumn("_d", F.col(pred) - F.col(tgt))
    ad = F.abs("_d")
    hub = F.when(ad < huber_delta, 0.5 * F.col("_d") ** 2).otherwise(huber_delta * (ad - 0.5 * huber_delta))
    per = d.groupBy(seq).agg(F.sum(ad).alias("_l1"), F.sum(F.col("_d") ** 2).alias("_l2"), F.sum(hub).alias("_hb"),
                             F.count(F.lit(1)).alias("_n"))
    return per.agg(
        (F.sum("_l1") / F.sum("_n")).alias("l1"), (F.sum("_l2") / F.sum("_n")).alias("mse"),
        (F.sum("_hb") / F.sum("_n")).alias("huber"),
        F.avg(F.col("_l1") / F.col("_n")).alias("l1_seq"), F.avg(F.col("_l2") / F.col("_n")).alias("mse_seq"))


def minmax_scale(long_x: DataFrame, seq: str, pos: str, x: str, length: str) -> DataFrame:
    """M2: (x − min)/(max − min + 1e-8) over the unmasked part of each sample."""
    v = long_x.where(F.col(pos) < F.col(length))
    mm = v.groupBy(seq).agg(F.min(x).alias("_mn"), F.max(x).alias("_mx"))
    return v.join(mm, seq).withColumn("scaled", (F.col(x) - F.col("_mn")) / (F.col("_mx") - F.col("_mn") + 1e-8))


def diagonality(att: DataFrame, clip: str, frame: str, token: str, p: str, binary: bool = False) -> DataFrame:
    """M3: mean over clips and tokens of the max over frames; ``binary`` takes attention as a mask."""
    m = att.groupBy(clip, token).agg(F.max(p).alias("_m"))
    if binary:
        m = m.withColumn("_m", F.when(F.col("_m") > 0, 1.0).otherwise(F.col("_m")))
    return m.agg(F.avg("_m").alias("diagonality"))


def alignment_entropy(att: DataFrame, clip: str, frame: str, token: str, p: str, n_tokens: int) -> DataFrame:
    """M4: per frame H = −Σ p ln p over tokens, divided by ln(n_tokens); mean."""
    h = att.groupBy(clip, frame).agg((-F.sum(F.when(F.col(p) > 0, F.col(p) * F.log(F.col(p))).otherwise(0.0)))
                                     .alias("_h"))
    return h.agg((F.avg("_h") / math.log(n_tokens)).alias("entropy"))


def guided_attention(att: DataFrame, frame: str, token: str, p: str, n_frames: int | Column, n_tokens: int | Column,
                     sigma: float = 0.4) -> DataFrame:
    """M5: mean over cells of p · (1 − exp(−(t/T − f/F)² / 2σ²)); lengths may be columns, cells beyond them don't count."""
    att = att.where((F.col(frame) < n_frames) & (F.col(token) < n_tokens))
    w = 1 - F.exp(-((F.col(token) / n_tokens - F.col(frame) / n_frames) ** 2) / (2 * sigma * sigma))
    return att.agg(F.avg(F.col(p) * w).alias("guided_attention"))


def spectral_losses(long_xy: DataFrame, x: str, y: str) -> DataFrame:
    """M6: ‖Y − X‖_F / ‖Y‖_F and mean |log Y − log X| over all cells."""
    return long_xy.agg(
        (F.sqrt(F.sum((F.col(y) - F.col(x)) ** 2)) / F.sqrt(F.sum(F.col(y) ** 2))).alias("spectral_convergence"),
        F.avg(F.abs(F.log(F.col(y)) - F.log(F.col(x)))).alias("log_mag_l1"))
