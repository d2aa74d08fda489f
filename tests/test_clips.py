"""Clips in haloed blocks: against plain Python at small blocks, and one clip of ten million samples."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocable.operators import clips as C

SIZE = 16


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(3)
    sizes = {1: 1, 2: 15, 3: 16, 4: 17, 5: 64, 6: 201, 7: 33}
    clips = {c: [rnd.choice([0.0, 0.0, 1.0, 5.0, 9.0]) for _ in range(n)] for c, n in sizes.items()}
    clips[8] = [9.0] * 70                                  # a run over several blocks
    clips[9] = [0.0] * 40 + [9.0] * 30 + [0.0] * 50
    rows = [(c, 3 * i, x, "clash", 1) for c, xs in clips.items() for i, x in enumerate(xs)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "clip long, t long, x double, block string, first int").repartition(5).drop("block", "first")
    return clips, C.indexed(df, "clip", ["t"]).drop("t")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_indexed_and_lengths(data):
    clips, s = data
    assert rows(s, "clip", "i", "x") == sorted((c, i, x) for c, xs in clips.items() for i, x in enumerate(xs))
    assert rows(C.lengths(s, "clip"), "clip", "n") == sorted((c, len(x)) for c, x in clips.items())


@pytest.mark.parametrize("left, right", [(0, 0), (3, 0), (0, 5), (16, 16)])
def test_blocks(data, left, right):
    clips, s = data
    want = sorted((c, b, max(0, b * SIZE - left), x[max(0, b * SIZE - left):(b + 1) * SIZE + right])
                  for c, x in clips.items() for b in range(-(-len(x) // SIZE)))
    assert rows(C.blocks(s, "clip", "i", "x", left, right, SIZE), "clip", "block", "first", "xs") == want
    with pytest.raises(ValueError):
        C.blocks(s, "clip", "i", "x", 17, 0, SIZE)


def test_first_hits(data):
    clips, s = data

    def endpoint(x, window, limit):
        hop = max(1, window // 4)
        return next((p + hop for p in range(hop, len(x) - window, hop) if max(x[p:p + window]) < limit), len(x))

    def trim(x, run):
        return next((i for i in range(run, len(x)) if all(v == 0 for v in x[i - run:i + 1])), len(x))
    for window in (4, 8, 16):
        assert rows(C.silence_endpoints(s, "clip", "i", "x", window, 5.0, SIZE), "clip", "endpoint") == sorted(
            (c, endpoint(x, window, 5.0)) for c, x in clips.items())
    for run in (1, 3, 12):
        assert rows(C.trim_points(s, "clip", "i", "x", 0, run, SIZE), "clip", "trim_at") == sorted((c, trim(x, run)) for c, x in clips.items())


def plain_runs(x, limit):
    at, out = 0, []
    for on, g in itertools.groupby(x, lambda v: v > limit):
        n = len(list(g))
        if on:
            out.append((at, at + n))
        at += n
    return out


def test_runs_intervals_and_folds(data):
    clips, s = data
    runs = C.runs_above(s, "clip", "i", "x", 4.0, SIZE)
    assert rows(runs, "clip", "k", "start", "end") == sorted(
        (c, k, a, b) for c, x in clips.items() for k, (a, b) in enumerate(plain_runs(x, 4.0)))
    kept = C.keep_intervals(s, "clip", "i", "x", runs.where("clip <> 8"), SIZE).collect()
    for c, x in clips.items():
        got = [v for r in sorted((r for r in kept if r.clip == c), key=lambda r: r.block) for v in r.kept]
        want = [v for a, b in plain_runs(x, 4.0) for v in x[a:b]] if c != 8 else x
        assert got == (want if want or plain_runs(x, 4.0) else x)
        assert all(r.flagged == (c == 8 or not plain_runs(x, 4.0)) for r in kept if r.clip == c)
    target, overlap = 10, 4
    step, length = target + overlap, target + 2 * overlap
    want = []
    for c, x in clips.items():
        n = (len(x) - overlap) // step
        n += len(x) != n * step + overlap
        want += [(c, f, (x[f * step:f * step + length] + [0.0] * length)[:length]) for f in range(max(0, n))]
    assert rows(C.folds(s, "clip", "i", "x", target, overlap), "clip", "fold_idx", "fold") == sorted(want)


def test_segments_durations_tail_and_gaps(data, spark):
    clips, s = data
    spans = C.lengths(s, "clip").select("clip", F.floor(F.col("n") / 3).alias("start"), F.floor(F.col("n") / 2).alias("length"))
    assert rows(C.segments(s, "clip", "i", "x", spans, SIZE), "clip", "segment") == sorted(
        (c, x[len(x) // 3:len(x) // 3 + len(x) // 2]) for c, x in clips.items())
    durs = spark.createDataFrame([(c, t, (t * 7 + c) % 23) for c, x in clips.items() for t in range(len(x) // 12)], "clip long, token long, dur int")
    got = {(r.clip, r.token): r["mean"] for r in C.mean_over_durations(s, durs, "clip", "i", "x", "token", "dur", SIZE).collect()}
    want = {}
    for c, x in clips.items():
        lo = 0
        for t in range(len(x) // 12):
            d = (t * 7 + c) % 23
            part = [v for v in x[lo:lo + d] if v != 0]
            if d:
                want[c, t] = sum(part) / len(part) if part else 0.0
            lo += d
    assert got == pytest.approx(want)
    codes = s.withColumn("code", F.col("x").cast("long"))
    got = C.repair_tail(codes, "clip", "i", "code", 5, size=SIZE).collect()
    for c, x in clips.items():
        y = [int(v) for v in x]
        if 5 in y:
            y[y.index(5):] = [83] * (len(y) - y.index(5))
            for back, t in zip((3, 2, 1), (45, 45, 248)):
                if back <= len(y):
                    y[-back] = t
        assert [v for r in sorted((r for r in got if r.clip == c), key=lambda r: r.block) for v in r.codes] == y
    gaps = s.withColumn("a", F.when(F.col("x") == 0, -1).otherwise(F.col("x") + 10 * F.col("i")).cast("long"))
    got = {(r.clip, r.i): r.filled for r in C.interpolate_missing(gaps, "clip", "i", "a", 50).collect()}
    for c, x in clips.items():
        a = [-1 if v == 0 else int(v + 10 * i) for i, v in enumerate(x)]
        for i, v in enumerate(a):
            if v == -1:
                p = next((j for j in range(i, -1, -1) if a[j] != -1), None)
                q = next((j for j in range(i, len(a)) if a[j] != -1), None)
                lo, hi = 0 if p is None else p + 1, len(a) if q is None else q
                prev, nxt = 50 if p is None else a[p], 50 if q is None else a[q]
                v = (i - lo + 1) * (nxt - prev) // (hi - lo + 1) + prev
            assert got[c, i] == v


def test_chunk_means(data):
    clips, s = data
    got = {r.clip: (r["mean"], r.n_chunks) for r in C.chunk_means(s, "clip", "i", "x", 10).collect()}
    for c, x in clips.items():
        m = [np.mean(x[k:k + 10]) for k in range(0, len(x), 10) if len(x[k:k + 10]) >= 3.3]
        assert (c not in got) if not m else got[c] == (pytest.approx(np.mean(m)), len(m))
    assert {r.clip for r in C.chunk_means(s, "clip", "i", "x", 10, first_only=True).collect()} == {c for c, x in clips.items() if len(x) > 3}


def test_one_clip_of_ten_million_samples(spark):
    """Spread over tasks: no task reads more than a small part of the clip, none gathers it."""
    n, size = 10_000_000, 1 << 14
    s = spark.range(n).select(F.lit(1).alias("clip"), F.col("id").alias("i"), F.when(F.col("id") % 1_000_000 < 999_000, 9.0).otherwise(0.0).alias("x"))
    runs = C.runs_above(s, "clip", "i", "x", 4.0, size)
    assert rows(runs, "k", "start", "end") == [(k, k * 1_000_000, k * 1_000_000 + 999_000) for k in range(10)]
    b = C.blocks(s, "clip", "i", "x", 400, 400, size).groupBy(F.spark_partition_id()).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("xs")).alias("longest")).collect()
    assert sum(r.n for r in b) == -(-n // size) and max(r.longest for r in b) == size + 800
    assert max(r.n for r in b) < 0.5 * sum(r.n for r in b)
