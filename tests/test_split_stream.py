"""Chunks of a stream with one hot key, against the batch form."""

import random

from pyspark.sql import functions as F

from vocable.streaming import split as S


def test_hot_key_equals_the_batch_form_and_is_spread(spark, tmp_path):
    n, hot = 50, 60_000
    rnd = random.Random(2)
    parts = [[(7, k * hot + i, float(i % 97)) for i in range(hot)] + [(u, k * 1000 + i, float(u + i)) for u in (1, 2, 3) for i in range(rnd.randrange(0, 120))]
             for k in range(3)]
    root = str(tmp_path / "in")
    for k, rows in enumerate(parts):
        rnd.shuffle(rows)
        spark.createDataFrame(rows, "user_id long, t long, value double").coalesce(1).write.parquet(f"{root}/part={k}")
    state = S.ChunkState(spark, str(tmp_path / "state"))
    spread = []
    step = S.chunk_step

    def watched(state, batch, epoch, *rest):
        if epoch == 1:                               # a step that died after its first table is run again
            batch.limit(10).write.parquet(f"{state.root}/chunks/epoch=1")
        step(state, batch, epoch, *rest)
        got = spark.read.parquet(f"{state.root}/chunks/epoch={epoch}").where("key = 7")
        spread.append(got.groupBy(F.input_file_name()).count().count())
    S.chunk_step = watched
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")      # 60,000 rows would fit one task
    try:
        stream = spark.readStream.schema("user_id long, t long, value double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(root)
        S.chunk_sink(stream, state, str(tmp_path / "chk"), "user_id", ["t"], "value", n).trigger(availableNow=True).start().awaitTermination()
    finally:
        S.chunk_step = step
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {(r.key, r.chunk_idx): list(r.chunk) for r in S.longest(state.chunks()).collect()}
    want = {}
    for u in (1, 2, 3, 7):
        x = [v for k in range(3) for _, _, v in sorted(r for r in parts[k] if r[0] == u)]
        if u == 7:
            assert len(x) == 3 * hot
        want |= {(u, i // n): x[i:i + n] for i in range(0, len(x), n)}
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    assert got == want and len(spread) == 3 and min(spread) > 1


def test_steps_carry_tails_from_epoch_to_epoch(spark, tmp_path):
    state, x = S.ChunkState(spark, str(tmp_path / "s")), {1: [], 2: []}
    rnd = random.Random(4)
    for epoch in range(6):
        rows = []
        for u in x:
            new = [float(rnd.randrange(100)) for _ in range(rnd.randrange(0, 9))]
            rows += [(u, len(x[u]) + i, v) for i, v in enumerate(new)]
            x[u] += new
        batch = spark.createDataFrame(rows, "user_id long, t long, value double")
        for _ in range(2):                           # run again: the same result
            S.chunk_step(state, batch, epoch, "user_id", ["t"], "value", 4)
    got = {(r.key, r.chunk_idx): (r.n, list(r.chunk)) for r in S.longest(state.chunks()).collect()}
    assert got == {(u, i // 4): (len(v[i:i + 4]), v[i:i + 4]) for u, v in x.items() for i in range(0, len(v), 4)}
    assert {r.key: r.seen for r in state.carry(5).collect()} == {u: len(v) for u, v in x.items()}
