"""Clips of any length as haloed blocks.

A clip is a long table (clip, order, value).  :func:`indexed` numbers its samples
with the keyed-running helper, so that a clip with a third of all samples is
spread over many tasks; :func:`blocks` groups them into blocks of fixed length
with some samples of the neighbouring blocks on either side.  Windows, folds and
searches read their halo, run borders are found with a halo of one, and what
belongs to a whole clip (a length, a first hit, a sum) is an aggregate with a
partial step.  No task holds a clip, no window is partitioned by one.

Joins that bring blocks their spans are on (clip, block), never on the clip alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocable.operators.common import let
from vocable.operators.batching import floor_div
from vocable.plans.position import keyed_running

#: Samples of a block.
BLOCK = 4096


def indexed(samples: DataFrame, clip: str, order: list, i: str = "i") -> DataFrame:
    """``samples`` with the 0-based place ``i`` of each inside its clip; (clip, order) is a total order."""
    out = keyed_running(samples.withColumn("_one", F.lit(1)), [clip], order, [("_one", "sum", "_place")])
    return out.withColumn(i, (F.col("_place") - 1).cast("long")).drop("_one", "_place")


def lengths(samples: DataFrame, clip: str, n: str = "n") -> DataFrame:
    """(clip, n): samples of each clip."""
    return samples.groupBy(clip).agg(F.count(F.lit(1)).alias(n))


def blocks(samples: DataFrame, clip: str, i: str, x: str, left: int = 0, right: int = 0, size: int = BLOCK) -> DataFrame:
    """(clip, block, first, xs): blocks of ``size`` samples with up to ``left`` and ``right`` samples
    of their neighbours; ``first`` is the place of ``xs[0]``."""
    if max(left, right) > size:
        raise ValueError("a halo must not be longer than a block")
    own, place = F.floor(F.col(i) / size).cast("long"), F.pmod(F.col(i), F.lit(size))
    at = [own]
    if right:
        at.append(F.when((place < right) & (own > 0), own - 1))
    if left:
        at.append(F.when(place >= size - left, own + 1))
    each = samples.select(clip, F.explode(F.filter(F.array(*at), lambda b: b.isNotNull())).alias("block"), F.struct(
        F.col(i).cast("long").alias("i"), F.col(x).alias("x")).alias("_s"))
    g = each.groupBy(clip, "block").agg(F.array_sort(F.collect_list("_s")).alias("_s"))
    g = g.where(F.element_at("_s", -1)["i"] >= F.col("block") * size)       # a block of halo alone is none
    return g.select(clip, "block", F.element_at("_s", 1)["i"].alias("first"), F.transform("_s", lambda s: s["x"]).alias("xs"))


def _core(size: int) -> tuple[Column, Column]:
    """First and one-past-last place that a block answers for."""
    lo = F.col("block") * size
    return lo, F.least(lo + size, F.col("first") + F.size("xs"))


def _places(lo: Column, hi: Column) -> Column:
    """lo, lo + 1, ... below hi."""
    return F.when(hi > lo, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<bigint>"))


def _at(place: Column) -> Column:
    """Value at a place of the clip; null outside of the block."""
    return F.get("xs", (place - F.col("first")).cast("int"))


def first_hits(hits: DataFrame, clip: str, hit: Column) -> DataFrame:
    """(clip, hit): the smallest of each clip."""
    return hits.groupBy(clip).agg(F.min(hit).alias("hit"))


def silence_endpoints(samples: DataFrame, clip: str, i: str, x: str, window: int, threshold: float, size: int = BLOCK) -> DataFrame:
    """(clip, endpoint): first start in range(hop, n - window, hop) whose window stays below the threshold, plus hop; else n."""
    hop = max(1, window // 4)
    b = blocks(samples, clip, i, x, right=window, size=size)
    lo, hi = _core(size)
    starts = F.filter(_places(lo, hi), lambda s: (F.pmod(s, F.lit(hop)) == 0) & (s >= hop) & (s + window < F.col("first") + F.size("xs")))
    quiet = F.filter(starts, lambda s: F.array_max(F.slice("xs", (s - F.col("first") + 1).cast("int"), window)) < threshold)
    found = first_hits(b, clip, F.get(quiet, F.lit(0)))
    return lengths(samples, clip).join(found, clip, "left").select(clip, F.coalesce(F.col("hit") + hop, F.col("n")).alias("endpoint"))


def trim_points(samples: DataFrame, clip: str, i: str, token: str, target: int, max_run: int, size: int = BLOCK) -> DataFrame:
    """(clip, trim_at): first place where ``target`` stands for the (``max_run`` + 1)-th time in a row, else the length."""
    b = blocks(samples, clip, i, token, left=max_run, size=size)
    lo, hi = _core(size)
    hit = F.filter(_places(lo, hi), lambda s: (s - max_run >= F.col("first")) & F.forall(
        F.slice("xs", (s - max_run - F.col("first") + 1).cast("int"), max_run + 1), lambda v: v == target))
    found = first_hits(b, clip, F.get(hit, F.lit(0)))
    return lengths(samples, clip).join(found, clip, "left").select(clip, F.coalesce("hit", "n").alias("trim_at"))


def crop_spans(clips: DataFrame, u_len: Column, u_start: Column, min_len: int, max_len: int, is_eval: bool = False) -> DataFrame:
    """``clips`` (clip, n, ...) with the ``start`` and ``length`` of a conditioning crop.

    Length is uniform in [min, max] (eval: (min + max) // 2), half the clip where it is shorter; the start is
    uniform in [0, n - length] (eval: 0).  ``u_len`` and ``u_start`` are keyed uniforms in [0, 1)."""
    want = F.lit((min_len + max_len) // 2) if is_eval else F.lit(min_len) + F.floor(u_len * (max_len - min_len + 1))
    length = F.when(F.col("n") < want, F.floor(F.col("n") / 2)).otherwise(want)
    out = clips.withColumn("length", length.cast("int"))
    start = F.lit(0) if is_eval else F.floor(u_start * (F.col("n") - F.col("length") + 1))
    return out.withColumn("start", start.cast("int"))


def segments(samples: DataFrame, clip: str, i: str, x: str, spans: DataFrame, size: int = BLOCK) -> DataFrame:
    """``spans`` (clip, start, length, ...; one per clip, of bounded length) with ``segment``, its samples."""
    last = F.floor((F.col("start") + F.greatest(F.col("length"), F.lit(1)) - 1) / size)
    wanted = spans.select(clip, "start", "length", F.explode(F.sequence(F.floor(F.col("start") / size), last)).alias("block"))
    b = blocks(samples, clip, i, x, size=size).join(wanted, [clip, "block"])
    lo = F.greatest(F.col("start"), F.col("first"))
    n = F.greatest(F.least(F.col("start") + F.col("length"), F.col("first") + F.size("xs")) - lo, F.lit(0))
    part = F.slice("xs", (lo - F.col("first") + 1).cast("int"), n.cast("int"))
    whole = b.groupBy(clip).agg(F.array_sort(F.collect_list(F.struct("block", part.alias("p")))).alias("_p"))
    return spans.join(whole, clip, "left").withColumn("segment", F.flatten(F.transform("_p", lambda p: p["p"]))).drop("_p")


def folds(samples: DataFrame, clip: str, i: str, x: str, target: int, overlap: int) -> DataFrame:
    """(clip, fold_idx, fold): windows of target + 2 overlap samples every target + overlap, zeros behind the end."""
    step, length = target + overlap, target + 2 * overlap
    n_folds = F.floor((F.col("n") - overlap) / step)
    n_folds = n_folds + F.when(F.col("n") - (n_folds * step + overlap) != 0, 1).otherwise(0)
    low = F.greatest(F.ceil((F.col(i) - length + 1) / step), F.lit(0))
    each = samples.select(clip, F.explode(F.sequence(low, F.floor(F.col(i) / step))).alias("fold_idx"), F.struct(
        F.col(i).cast("long").alias("i"), F.col(x).alias("x")).alias("_s"))
    g = each.groupBy(clip, "fold_idx").agg(F.transform(F.array_sort(F.collect_list("_s")), lambda s: s["x"]).alias("_x"))
    g = g.join(lengths(samples, clip), clip).where(F.col("fold_idx") < n_folds)
    return g.select(clip, F.col("fold_idx").cast("int").alias("fold_idx"), F.concat(
        "_x", F.array_repeat(F.lit(0.0), F.lit(length) - F.size("_x"))).alias("fold"))


def runs_above(samples: DataFrame, clip: str, i: str, x: str, threshold: float, size: int = BLOCK) -> DataFrame:
    """(clip, k, start, end): runs of values above the threshold, end exclusive.

    A block with a halo of one sees where runs begin and end; the k-th beginning
    of a clip belongs to the k-th end, whatever lies between them.
    """
    b = blocks(samples, clip, i, x, left=1, right=1, size=size)
    lo, hi = _core(size)
    on = lambda place: F.coalesce(_at(place) > threshold, F.lit(False))

    def borders(before: int, place: str) -> DataFrame:
        found = F.filter(_places(lo, hi), lambda s: on(s) & ~on(s + before))
        return indexed(b.select(clip, F.explode(found).alias(place)), clip, [place], "k")
    b = b.select(clip, "block", "first", "xs")
    start, end = borders(-1, "start"), borders(1, "_last")
    return start.join(end, [clip, "k"]).select(clip, F.col("k"), "start", (F.col("_last") + 1).alias("end"))


def spans_by_block(spans: DataFrame, clip: str, start: Column, end: Column, keep: list[str], size: int = BLOCK) -> DataFrame:
    """(clip, block, keep, lo, hi): the part of each span [start, end) in each block that it touches."""
    s = spans.withColumn("_a", start.cast("long")).withColumn("_b", end.cast("long")).where("_b > _a")
    s = s.select(clip, *keep, "_a", "_b", F.explode(F.sequence(F.floor(F.col("_a") / size), F.floor((F.col("_b") - 1) / size))).alias("block"))
    return s.select(clip, "block", *keep, F.greatest(F.col("_a"), F.col("block") * size).alias("lo"),
                    F.least(F.col("_b"), (F.col("block") + 1) * size).alias("hi"))


def keep_intervals(samples: DataFrame, clip: str, i: str, x: str, intervals: DataFrame, size: int = BLOCK) -> DataFrame:
    """(clip, block, kept): the samples inside the clip's disjoint intervals (clip, start, end), block by block;
    a clip without intervals keeps all, with ``flagged``."""
    own = spans_by_block(intervals, clip, F.col("start"), F.col("end"), [], size).groupBy(clip, "block").agg(
        F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("_iv"))
    some = intervals.select(clip).distinct().withColumn("_some", F.lit(True))
    b = blocks(samples, clip, i, x, size=size).join(own, [clip, "block"], "left").join(some, clip, "left")
    inside = F.flatten(F.transform(F.coalesce("_iv", F.array().cast("array<struct<lo:bigint,hi:bigint>>")), lambda s: F.slice(
        "xs", (s["lo"] - F.col("first") + 1).cast("int"), F.greatest(F.least(s["hi"], F.col("first") + F.size("xs")) - s["lo"], F.lit(0)).cast("int"))))
    return b.select(clip, "block", F.when(F.col("_some"), inside).otherwise(F.col("xs")).alias("kept"), F.col("_some").isNull().alias("flagged"))


def duration_bounds(durs: DataFrame, clip: str, token: str, dur: str) -> DataFrame:
    """(clip, token, dur, lo): a token owns the frames [lo, lo + dur), in the order of the tokens."""
    c = keyed_running(durs.select(clip, token, F.col(dur).cast("long").alias(dur)), [clip], [token], [(dur, "sum", "_cum")])
    return c.select(clip, token, dur, (F.col("_cum").cast("long") - F.col(dur)).alias("lo"))


def mean_over_durations(frames: DataFrame, durs: DataFrame, clip: str, i: str, x: str, token: str, dur: str, size: int = BLOCK) -> DataFrame:
    """Mean of the non-zero values of each token with a duration, 0 if none."""
    own = duration_bounds(durs, clip, token, dur)
    parts = spans_by_block(own, clip, F.col("lo"), F.col("lo") + F.col(dur), [token], size)
    b = parts.join(blocks(frames, clip, i, x, size=size), [clip, "block"])
    part = F.filter(F.slice("xs", (F.col("lo") - F.col("first") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")), lambda v: v != 0)
    p = b.select(clip, token, part.alias("p")).select(clip, token, F.size("p").alias("n"), F.aggregate(
        "p", F.lit(0.0), lambda a, v: a + v).alias("s"))
    sums = p.groupBy(clip, token).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    out = own.where(F.col(dur) > 0).select(clip, token).join(sums, [clip, token], "left")
    return out.select(clip, token, F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(F.lit(0.0)).alias("mean"))


def repair_tail(codes: DataFrame, clip: str, i: str, code: str, stop_token: int, fill: int = 83, tail=(45, 45, 248), size: int = BLOCK) -> DataFrame:
    """(clip, block, codes): from a clip's first stop token on codes become ``fill``, the last three the tail codes."""
    per_clip = codes.groupBy(clip).agg(F.min(F.when(F.col(code) == stop_token, F.col(i))).alias("_stop"), F.count(F.lit(1)).alias("_n"))
    b = blocks(codes, clip, i, code, size=size).join(per_clip, clip)

    def one(v, k):
        place, left = F.col("first") + k, F.col("_n") - F.col("first") - k
        out = F.when(place >= F.col("_stop"), F.lit(fill)).otherwise(v)
        for back, t in zip((3, 2, 1), tail):
            out = F.when(left == back, F.lit(t)).otherwise(out)
        return F.when(F.col("_stop").isNull(), v).otherwise(out).cast("long")
    return b.select(clip, "block", F.transform("xs", one).alias("codes"))


def interpolate_missing(samples: DataFrame, clip: str, i: str, value: str, orig_len: int, missing: int = -1) -> DataFrame:
    """Entries equal to ``missing`` filled linearly with floor division between the known neighbours; before the
    first known value stands ``orig_len``, after the last one ``orig_len`` at the clip's end."""
    s = samples.select(clip, F.col(i).cast("long").alias(i), F.col(value).cast("long").alias(value))
    known = F.col(value) != missing
    none = 1 << 52                               # beyond any place, exact in a double
    s = s.withColumn("_k", F.when(known, F.col(i)).otherwise(-1)).withColumn("_m", F.when(known, F.col(i)).otherwise(none)).withColumn("_back", -F.col(i))
    both = keyed_running(s, [clip], [i], [("_k", "max", "_pi")])
    both = keyed_running(both, [clip], ["_back"], [("_m", "min", "_ni")])
    gaps = both.where(~known).select(clip, i, F.when(F.col("_pi") >= 0, F.col("_pi").cast("long")).alias("_pi"),
                                     F.when(F.col("_ni") < none, F.col("_ni").cast("long")).alias("_ni"))
    at = s.where(known).select(clip, F.col(i).alias("_at"), F.col(value).alias("_v"))
    before = at.select(clip, F.col("_at").alias("_pi"), F.col("_v").alias("_pv"))
    after = at.select(clip, F.col("_at").alias("_ni"), F.col("_v").alias("_nv"))
    ends = s.groupBy(clip).agg((F.max(i) + 1).alias("_n"))
    g = gaps.join(before, [clip, "_pi"], "left").join(after, [clip, "_ni"], "left").join(ends, clip)
    lo, hi = F.coalesce(F.col("_pi") + 1, F.lit(0)), F.coalesce(F.col("_ni"), F.col("_n"))
    prev, nxt = F.coalesce(F.col("_pv"), F.lit(orig_len)), F.coalesce(F.col("_nv"), F.lit(orig_len))
    filled = floor_div((F.col(i) - lo + 1) * (nxt - prev), hi - lo + 1) + prev
    return s.where(known).select(clip, i, F.col(value).alias("filled")).unionByName(g.select(clip, i, filled.cast("long").alias("filled")))


def chunk_means(samples: DataFrame, clip: str, i: str, x: str, length: int, min_share: float = 0.33, first_only: bool = False) -> DataFrame:
    """(clip, mean, n_chunks): mean of the means of chunks of ``length`` samples, or the first chunk alone.
    Chunks shorter than ``min_share`` of a length don't count.  Values are summed in their order."""
    if first_only:
        samples = samples.where(F.col(i) < length)
    c = samples.groupBy(clip, F.floor(F.col(i) / length).alias("_c")).agg(F.array_sort(F.collect_list(F.struct(
        F.col(i).alias("i"), F.col(x).alias("x")))).alias("_s")).where(F.size("_s") >= length * min_share)
    total = F.aggregate("_s", F.lit(0.0), lambda a, v: a + v["x"])
    return c.select(clip, (total / F.size("_s")).alias("m")).groupBy(clip).agg(F.avg("m").alias("mean"), F.count(F.lit(1)).alias("n_chunks"))


def mean_of_clips(means: DataFrame, group: Column, mean: str = "mean") -> DataFrame:
    """K11 over several clips: mean of the clips' own means, every clip weighing the same."""
    return means.groupBy(group).agg(F.avg(mean).alias("mean"), F.count(F.lit(1)).alias("n_clips"))
