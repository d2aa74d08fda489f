"""Attention by clip, whose cells are not shuffled; rows that share an id are one clip."""

import numpy as np


def test_attention_is_made_in_place(spark, tmp_path):
    from vocable.plans.catalog import signal_eval as S

    rng = np.random.default_rng(5)
    x = [rng.normal(size=64).astype("float32").tolist() for _ in range(4)]
    rows = [(1, x[0], 0), (2, x[1], 0), (2, x[2], 1), (None, x[3], 0), (3, None, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    att = S.attention(spark, str(tmp_path))
    plan = att.groupBy("vec_id", "t").count()._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and plan.count("Exchange") == 1
    got = sorted((r.vec_id, r.f, r.t, round(r.p, 9)) for r in att.collect())
    want = []
    for k, v in ((1, [x[0]]), (2, [x[1], x[2]])):
        v = np.array(v)
        for f in range(32):
            s = np.multiply.outer(v[:, f], v[:, 32:]) * 10.0
            p = np.exp(s - s.max())
            p /= p.sum()
            want += [(k, f, t, round(float(c), 9)) for a in p for b in a for t, c in enumerate(b)]
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
    assert np.allclose([g[3] for g in got], [w[3] for w in sorted(want)], atol=1e-8)
