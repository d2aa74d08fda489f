import math
import random

import numpy as np
import pyarrow as pa
import pytest
from conftest_paths import SF001

from vocable.llm import hard_negatives as hn

COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute(rows, positives=5, count=10, low=30, high=90, every=100):
    ok = [(i, v, lab) for i, v, lab in rows if i is not None and v is not None and lab is not None
          and all(x is not None and math.isfinite(x) for x in v)]
    q = [[math.floor(256 * float(x)) for x in v] for _, v, _ in ok]
    out = []
    for a, (i, _, lab) in enumerate(ok):
        if i % every:
            continue
        score = [sum(x * y for x, y in zip(q[a], y)) for y in q]
        rank = sorted(range(len(ok)), key=lambda r: (-score[r], ok[r][0]))
        for p in [r for r in rank if r != a and ok[r][2] == lab][:positives]:
            neg = [r for r in rank if ok[r][2] != lab and low * score[p] <= 100 * score[r] <= high * score[p]]
            out += [(i, ok[p][0], k + 1, ok[r][0], score[p], score[r]) for k, r in enumerate(neg[:count])]
    return sorted(out)


def frame(spark, rows, partitions=3):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows],
                                 "vec_id long, embedding array<float>, label int, block string, rid int").repartition(partitions)


def result(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def awkward_rows():
    rnd = random.Random(3)
    f32 = lambda x: float(np.float32(x))
    rows = [(i, [f32(rnd.gauss(0.1, 1)) for _ in range(6)], i % 3) for i in range(260)]
    rows += [(300, [1.0] * 6, 1), (300, [1.0] * 6, 1), (301, [1.0] * 6, 2), (302, [0.5] * 6, 2), (303, [0.5] * 6, 2)]
    rows += [(400, None, 1), (401, [1.0, None] * 3, 1), (402, [float("nan")] * 6, 1), (403, [float("inf")] * 6, 2), (404, [1.0] * 6, None),
             (None, [2.0] * 6, 1), (500, [], 0), (501, [3.0], 1), (502, [3.0, 3.0], 2), (600, [-1.0] * 6, 7), (700, [0.0] * 6, 0), (-100, [0.7] * 6, 2)]
    return rows + [(k, [0.25] * 6, 0) for k in range(1000, 1040)]       # equal rows


@pytest.mark.parametrize("block", [16, 8192])
def test_hard_negatives_against_all_scores(spark, block, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK", block)
    monkeypatch.setattr(hn, "GROUP", 3 if block == 16 else 1024)
    rows = awkward_rows()
    assert result(hn.hard_negatives(frame(spark, rows))) == brute(rows)


def test_hard_negatives_of_a_given_table(spark):
    table = hn.relabelled(spark.read.parquet(f"{SF001}/embeddings.parquet"))
    assert result(hn.hard_negatives(table)) == brute([tuple(r) for r in table.select("vec_id", "embedding", "label").collect()])


def test_scan_prunes_and_keeps_exact_scores():
    rng = np.random.default_rng(1)
    q = rng.integers(-40, 40, (4000, 32))
    anchor = (rng.integers(-40, 40, 32) * np.exp(-np.arange(32) / 4)).astype(np.int64)
    block, seen = hn.Block(pa.array(q.tolist()), 32), []

    def alive(lower, upper):
        seen.append(len(lower))
        return upper >= np.partition(lower, len(lower) - 10)[len(lower) - 10]
    rows, score = block.scan(anchor, np.arange(4000), alive)
    true = q @ anchor
    assert (score == true[rows]).all() and set(np.argsort(-true)[:10]) <= set(rows.tolist())
    assert seen[-1] < 400


def test_hard_negatives_empty_and_out_of_range(spark):
    assert hn.hard_negatives(frame(spark, [])).collect() == []
    with pytest.raises(Exception, match="quantised range"):
        hn.hard_negatives(frame(spark, [(100, [1e30], 1)])).collect()
