"""L: signal and alignment tables (column work only; no FFT/filters/decoders).

Clips here are ``array<double>`` columns: short ones, of a bounded length.  Clips
of any length are long tables, see ``clips``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocable.operators.common import col, let


def _sum(a) -> Column:
    return F.aggregate(col(a), F.lit(0.0), lambda acc, v: acc + v)


def peak_normalise(a, scale: float = 0.95) -> Column:
    """L1: x / max|x| · scale."""
    peak = F.array_max(F.transform(col(a), lambda v: F.abs(v)))
    return F.transform(col(a), lambda v: v / peak * scale)


def to_int16_peak(a) -> Column:
    """L1 int16 form: x · 32767 / max(0.01, peak)."""
    peak = F.array_max(F.transform(col(a), lambda v: F.abs(v)))
    return F.transform(col(a), lambda v: (v * 32767 / F.greatest(F.lit(0.01), peak)).cast("short"))


def rms(a) -> Column:
    return F.sqrt(_sum(F.transform(col(a), lambda v: v * v)) / F.size(col(a)))


def rms_normalise(a, target_db: float = -27.0, mode: str = "both") -> Column:
    """L2: scale to ``target_db`` dBFS RMS; ``mode`` up/down limits the direction."""
    cur_db = 20 * F.log10(rms(a))
    gain = F.pow(F.lit(10.0), (F.lit(target_db) - cur_db) / 20)
    if mode == "up":
        gain = F.greatest(gain, F.lit(1.0))
    elif mode == "down":
        gain = F.least(gain, F.lit(1.0))
    return F.transform(col(a), lambda v: v * gain)


def preemphasis(a, coef: float = 0.97) -> Column:
    """L3: y[0] = x[0], y[t] = x[t] − coef·x[t−1]."""
    x = col(a)
    return F.transform(x, lambda v, i: F.when(i == 0, v).otherwise(v - coef * F.element_at(x, i)))


def deemphasis(a, coef: float = 0.97) -> Column:
    """L3 inverse (a recursion): y[t] = x[t] + coef·y[t−1], as a fold."""
    x = col(a)
    start = F.array().cast("array<double>")
    def step(acc, v):
        prev = F.when(F.size(acc) > 0, F.element_at(acc, -1)).otherwise(F.lit(0.0))
        return F.concat(acc, F.array(v.cast("double") + coef * prev))

    return F.aggregate(x, start, step)


def amp_to_db(a, gain: float = 20.0, base10: bool = True) -> Column:
    """L4: gain·log(max(1e-8, x)); negative input fails the row."""
    def one(v):
        chk = F.when(v >= 0, v).otherwise(F.raise_error(F.lit("amp_to_db of a negative value")))
        lg = F.log10(F.greatest(F.lit(1e-8), chk)) if base10 else F.log(F.greatest(F.lit(1e-8), chk))
        return lg * gain
    return F.transform(col(a), one)


def db_to_amp(a, gain: float = 20.0, base10: bool = True) -> Column:
    return F.transform(col(a), lambda v: F.pow(F.lit(10.0), v / gain) if base10 else F.exp(v / gain))


def range_normalise(a, min_db: float = -100.0, ref_db: float = 20.0, max_norm: float = 4.0,
                    symmetric: bool = True, clip: bool = True) -> Column:
    """(S − ref − min)/(−min) mapped to [−m, m] (symmetric) or [0, m]."""
    def one(s):
        n = (s - ref_db - min_db) / (-min_db)
        y = (2 * max_norm) * n - max_norm if symmetric else max_norm * n
        if clip:
            lo = -max_norm if symmetric else 0.0
            y = F.greatest(F.lit(lo), F.least(F.lit(max_norm), y))
        return y
    return F.transform(col(a), one)


def mulaw_encode(a, bits: int = 8) -> Column:
    """floor((sgn·ln(1+μ|x|)/ln(1+μ) + 1)/2·μ + .5), μ = 2^bits − 1."""
    mu = float(2 ** bits - 1)
    return F.transform(col(a), lambda v: F.floor(
        (F.signum(v) * F.log(1 + mu * F.abs(v)) / math.log(1.0 + mu) + 1) / 2 * mu + 0.5).cast("long"))


def mulaw_decode(a, bits: int = 8) -> Column:
    mu = float(2 ** bits - 1)
    return F.transform(col(a), lambda v: F.signum(v) / mu * (F.pow(F.lit(1 + mu), F.abs(v)) - 1))


def quantize(a, bits: int) -> Column:
    return F.transform(col(a), lambda v: (v + 1.0) * (2 ** bits - 1) / 2)


def dequantize(a, bits: int) -> Column:
    return F.transform(col(a), lambda v: 2 * v / (2 ** bits - 1) - 1)


def silence_endpoint(a, window: int, threshold: float) -> Column:
    """First start x in range(hop, len − window, hop) whose window max is
    below ``threshold`` → x + hop; else len.  hop = window // 4."""
    x = col(a)
    hop = max(1, window // 4)
    starts = F.sequence(F.lit(hop), F.greatest(F.size(x) - window - 1, F.lit(hop)), F.lit(hop))
    starts = F.filter(starts, lambda s: s < F.size(x) - window)
    quiet = F.filter(starts, lambda s: F.array_max(F.slice(x, s + 1, window)) < threshold)
    return F.when(F.size(quiet) > 0, F.element_at(quiet, 1) + hop).otherwise(F.size(x))


def fold_with_overlap(a, target: int, overlap: int) -> Column:
    """Windows of target + 2·overlap every target + overlap; the last one
    zero-padded when samples poke out."""
    x = col(a)
    T = F.size(x)
    step = target + overlap
    nf = F.floor((T - overlap) / step).cast("int")
    extended = nf * step + overlap
    remaining = T - extended
    nf2 = F.when(remaining != 0, nf + 1).otherwise(nf)
    pad = F.when(remaining != 0, F.lit(target + 2 * overlap) - remaining).otherwise(F.lit(0))
    xp = F.concat(x, F.array_repeat(F.lit(0.0), F.greatest(pad, F.lit(0))))
    # The padded clip is bound once; referencing it in the lambda would rebuild it per fold.
    return let(xp, lambda xpv: F.transform(F.sequence(F.lit(0), nf2 - 1),
                                           lambda i: F.slice(xpv, i * step + 1, target + 2 * overlap)))


def fade_gain(j, length: int, overlap: int) -> Column:
    """L13 equal-power gain at fold position j: silence half, then sqrt(.5(1±t))."""
    sil = overlap // 2
    fl = overlap - sil

    def tval(k):
        return F.when(k == fl - 1, F.lit(1.0)).otherwise(F.lit(-1.0) + k * (2.0 / (fl - 1)) if fl > 1 else F.lit(-1.0))

    fade_in = F.when(j < sil, F.lit(0.0)).otherwise(F.sqrt(0.5 * (1 + tval(j - sil))))
    k_out = j - (length - overlap)
    fade_out = F.when(k_out >= fl, F.lit(0.0)).otherwise(F.sqrt(0.5 * (1 - tval(k_out))))
    return (F.when(j < overlap, fade_in).when(j >= length - overlap, fade_out).otherwise(F.lit(1.0)))


def overlap_add(folds: DataFrame, clip: str, fold_idx: str, fold: str, target: int, overlap: int) -> DataFrame:
    """Unfold with equal-power fades: explode every fold to absolute sample
    positions, apply the gain, ``groupBy(clip, pos).sum``."""
    length = target + 2 * overlap
    e = folds.select(clip, fold_idx, F.posexplode(fold).alias("j", "v"))
    e = e.withColumn("pos", F.col(fold_idx) * (target + overlap) + F.col("j"))
    e = e.withColumn("y", F.col("v") * fade_gain(F.col("j"), length, overlap))
    return e.groupBy(clip, "pos").agg(F.sum("y").alias("y"))


def crop(a, u_len: Column, u_start: Column, min_len: int, max_len: int, is_eval: bool = False) -> Column:
    """Conditioning crop → struct(x padded to max_len, length, start, end).

    Length is uniform in [min, max] (eval: (min+max)//2); a clip shorter
    than that uses half of itself; the start is uniform in [0, gap]
    (eval: 0).  ``u_len``/``u_start`` are keyed uniforms in [0, 1).
    """
    x = col(a)
    n = F.size(x)
    want = F.lit((min_len + max_len) // 2) if is_eval else (F.lit(min_len) + F.floor(u_len * (max_len - min_len + 1))
                                                            .cast("int"))
    length = F.when(n - want < 0, F.floor(n / 2).cast("int")).otherwise(want)
    gap = n - length
    start = F.lit(0) if is_eval else F.floor(u_start * (gap + 1)).cast("int")
    piece = F.slice(x, start + 1, length)
    padded = F.concat(piece, F.array_repeat(F.lit(0.0), F.greatest(F.lit(max_len) - F.size(piece), F.lit(0))))
    return F.struct(padded.alias("x"), F.size(padded).alias("length"), start.alias("start"),
                    (start + length).alias("end"))


def rand_segment(a, u: Column, segment_size: int, hop: int = 1) -> Column:
    """Random segment start = floor(u·(len − size + 1)); the paired audio
    segment starts at start·hop.  Returns struct(start, audio_start, segment)."""
    x = col(a)
    start = F.floor(u * (F.size(x) - segment_size + 1)).cast("int")
    return F.struct(start.alias("start"), (start * hop).alias("audio_start"),
                    F.slice(x, start + 1, segment_size).alias("segment"))


def power_db(a) -> Column:
    """10·log10(mean(x²) + 1e-4)."""
    x = col(a)
    return 10 * F.log10(_sum(F.transform(x, lambda v: v * v)) / F.size(x) + 1e-4)


def mix_noise(clips: DataFrame, noises: DataFrame, key: str, x: str, noise_key: str, noise_x: str,
              min_snr: float, max_snr: float, seed: int = 0, op: str = "l21") -> DataFrame:
    """Add one hash-chosen noise per clip at a hash-chosen SNR in
    [min_snr, max_snr]: gain = sqrt(10^((clean_db − noise_db − snr)/10)); noises
    shorter than the clip are skipped (the clip passes unchanged).

    The noise row is picked by global position (hash mod the noise count)
    and joined on it, so no noise table is collected or broadcast."""
    from vocable.functions.hashing import hash52, uniform
    from vocable.operators.common import attach_scalars
    from vocable.plans.position import with_position

    npos = with_position(noises.select(noise_key, noise_x), [noise_key], "_npos")
    nn = noises.agg(F.count(F.lit(1)).alias("_nn"))
    c = attach_scalars(clips, nn).withColumn("_npos", F.pmod(hash52(seed, op, F.col(key)), F.col("_nn")))
    c = c.withColumn("_snr", F.lit(min_snr) + uniform(seed, op + "snr", F.col(key)) * (max_snr - min_snr))
    j = c.join(npos.select("_npos", F.col(noise_x).alias("_noise")), "_npos", "left")
    ok = F.col("_noise").isNotNull() & (F.size("_noise") >= F.size(x))
    gain = F.sqrt(F.pow(F.lit(10.0), (power_db(x) - power_db("_noise") - F.col("_snr")) / 10))
    mixed = F.zip_with(x, F.slice("_noise", 1, F.size(x)), lambda a, b: a + b * gain)
    return j.withColumn("mixed", F.when(ok, mixed).otherwise(F.col(x))).drop("_npos", "_nn", "_snr", "_noise")


def dither(a, key: Column, seed: int = 0, op: str = "l22") -> Column:
    """X + u/32768 with u uniform in [0, 1) keyed by (clip, index)."""
    from vocable.functions.hashing import uniform
    return F.transform(col(a), lambda v, i: v + uniform(seed, op, key, i) / 32768.0)


def mono(channels) -> Column:
    """Mean of the channels (array of equal-length channel arrays)."""
    ch = col(channels)
    return F.transform(F.element_at(ch, 1), lambda _, i: F.aggregate(ch, F.lit(0.0), lambda acc, c: acc + c[i])
                       / F.size(ch))


def rescale_intervals(iv, factor: float) -> Column:
    """int(start·f), int(end·f) for an array of (start, end) structs."""
    return F.transform(col(iv), lambda s: F.struct((s["start"] * factor).cast("long").alias("start"),
                                                   (s["end"] * factor).cast("long").alias("end")))


def outer_span(iv) -> Column:
    return F.struct(F.element_at(col(iv), 1)["start"].alias("start"), F.element_at(col(iv), -1)["end"].alias("end"))


def keep_intervals(a, iv) -> Column:
    """Concatenation of the [start, end) chunks; no interval → clip unchanged."""
    x = col(a)
    chunks = F.flatten(F.transform(col(iv), lambda s: F.slice(x, s["start"] + 1, s["end"] - s["start"])))
    return F.when(F.size(col(iv)) > 0, chunks).otherwise(x)


def durations_from_alignment(att: DataFrame, clip: str, frame: str, token: str, p: str,
                             tokens: DataFrame) -> DataFrame:
    """Argmax token per frame → counts; unseen tokens get 1; then 1 is
    subtracted once from each of the ``extra`` largest (ties: lower token
    first) so the total equals the frame count.  ``tokens`` = (clip, token, n_frames)."""
    best = att.groupBy(clip, frame).agg(F.max_by(token, F.struct(F.col(p), -F.col(token))).alias(token))
    cnt = best.groupBy(clip, token).agg(F.count(F.lit(1)).alias("_c"))
    d = tokens.join(cnt, [clip, token], "left").withColumn("_d", F.coalesce("_c", F.lit(1)))
    w = Window.partitionBy(clip)
    d = d.withColumn("_extra", F.sum("_d").over(w) - F.col("n_frames"))
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy(clip).orderBy(F.col("_d").desc(), F.col(token))))
    return d.withColumn("duration", (F.col("_d") - F.when(F.col("_r") <= F.col("_extra"), 1).otherwise(0))
                        .cast("long")).select(clip, token, "duration")


def repair_tail(codes, stop_token: int, fill: int = 83, tail=(45, 45, 248)) -> Column:
    """From the first stop token on, codes become ``fill``; then the last
    three are set to the tail codes.  No stop token: unchanged."""
    c = col(codes)

    def with_first(first):
        filled = F.transform(c, lambda v, i: F.when(i >= first - 1, F.lit(fill).cast("long"))
                             .otherwise(v.cast("long")))
        n = F.size(c)
        tailed = F.transform(filled, lambda v, i: F.when(i == n - 3, F.lit(tail[0]).cast("long"))
                             .when(i == n - 2, F.lit(tail[1]).cast("long"))
                             .when(i == n - 1, F.lit(tail[2]).cast("long")).otherwise(v))
        return F.when(first > 0, tailed).otherwise(F.transform(c, lambda v: v.cast("long")))

    # The stop position is bound once instead of being searched for per element.
    return let(F.array_position(c, F.lit(stop_token)), with_first)


def redaction_spans(text) -> Column:
    """Pieces split on '[' and ']'; even pieces are kept.  Returns the
    kept (start, end) index spans with end = max(0, start + len − 1)."""
    t = col(text)
    pieces = F.split(t, r"[\[\]]", -1)

    def spans_of(lens):
        # Running start of each piece (pieces = 2·brackets + 1, a short array).
        starts = F.transform(lens, lambda _, i: F.aggregate(F.slice(lens, 1, i), F.lit(0), lambda a, v: a + v))
        spans = F.transform(F.arrays_zip(starts.alias("s"), lens.alias("l")),
                            lambda z: F.struct(z["s"].alias("start"),
                                               F.greatest(F.lit(0), z["s"] + z["l"] - 1).alias("end")))
        return F.filter(spans, lambda _, i: F.pmod(i, F.lit(2)) == 0)

    return let(F.transform(pieces, lambda s: F.length(s)), spans_of)
