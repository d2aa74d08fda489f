"""The versioned codebook: stream against plain numpy over twenty files with resets, and a step that is killed."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocable.functions.hashing import hash52
from vocable.streaming import codebook as CB

N_CODES, DIM, WINDOW, FILES, ROWS = 6, 3, 60, 20, 25


def batches():
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(3, DIM)) * 4
    return [centers[rng.integers(0, 3, ROWS)] + rng.normal(size=(ROWS, DIM)) * 0.2 for _ in range(FILES)]


def plain(spark, data, start):
    """The same steps on arrays."""
    e, avg, size = start.copy(), start.copy(), np.zeros(N_CODES)
    window, seen, resets = [], 0, []
    for epoch, x in enumerate(data):
        mask = np.zeros(N_CODES, bool)
        if seen > WINDOW:
            share = np.bincount(window, minlength=N_CODES) / WINDOW
            mask = (share > CB.OVER_USED) | (share < CB.DEAD)
            if mask.any():
                pick = [r[0] for r in spark.range(N_CODES).orderBy("id").select(F.pmod(hash52(0, f"k8-{epoch}", F.col("id").cast("int")), F.lit(len(x)))).collect()]
                for c in np.flatnonzero(mask):
                    e[c] = avg[c] = x[pick[c]]
                    size[c] = 0
                window, seen = [], 0
        resets.append(int(mask.sum()))
        code = ((x[:, None] - e[None]) ** 2).sum(axis=2).argmin(axis=1)
        window = (window + code.tolist())[-WINDOW:]
        seen += len(x)
        size = 0.99 * size + 0.01 * np.bincount(code, minlength=N_CODES)
        sums = np.zeros_like(avg)
        np.add.at(sums, code, x)
        avg = 0.99 * avg + 0.01 * sums
        norm = (size + 1e-5) / (size.sum() + N_CODES * 1e-5) * size.sum()
        e = avg / norm[:, None]
    return e, avg, size, window, resets


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("vectors"))
    data = batches()
    for k, x in enumerate(data):
        spark.createDataFrame([(k * 1000 + i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").coalesce(1).write.parquet(f"{root}/part={k:02d}")
    start = np.random.default_rng(1).normal(size=(N_CODES, DIM)) * 5
    return root, data, start


def stream(spark, root):
    return spark.readStream.schema("id long, v array<double>").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(root)


def test_stream_with_resets_and_a_killed_step(spark, files, tmp_path):
    root, data, start = files
    book = spark.createDataFrame([(c, v.tolist()) for c, v in enumerate(start)], "code int, centroid array<double>")
    state = CB.CodebookState(spark, str(tmp_path / "state"), book)
    # files in the order in which they were written
    order = [sorted(os.listdir(f"{root}/part={k:02d}")) for k in range(FILES)]
    assert all(order)
    killed = {"left": True}
    commit = state.commit

    def broken(epoch, *tables):
        if epoch == 7 and killed["left"]:
            killed["left"] = False
            tables[0].write.parquet(f"{state.root}/data/half-done/book")      # the step dies between its tables
            raise RuntimeError("killed")
        commit(epoch, *tables)
    state.commit = broken
    options = dict(key="id", vec="v", max_codes=WINDOW)
    chk = str(tmp_path / "chk")
    with pytest.raises(Exception, match="killed"):
        q = CB.online_codebook(stream(spark, root), state, chk, **options).trigger(availableNow=True).start()
        q.awaitTermination()
    assert state.last() == 6
    CB.online_codebook(stream(spark, root), state, chk, **options).trigger(availableNow=True).start().awaitTermination()
    assert state.last() == FILES - 1
    e, avg, size, window, resets = plain(spark, data, start)
    assert sum(resets) > 0 and [state.resets(k) for k in range(FILES)] == resets
    got, ring, _, total = state.at(FILES - 1)
    got = got.orderBy("code").collect()
    assert np.allclose([r.centroid for r in got], e) and np.allclose([r.average for r in got], avg) and np.allclose([r["size"] for r in got], size)
    assert [r.code for r in ring.orderBy("seq").collect()] == window and total == FILES * ROWS


def test_empty_batches_leave_the_state(spark, tmp_path):
    book = spark.createDataFrame([(0, [0.0]), (1, [1.0])], "code int, centroid array<double>")
    state = CB.CodebookState(spark, str(tmp_path / "state"), book)
    none = spark.createDataFrame([], "id long, v array<double>")
    CB.step(state, none, 0, "id", "v")
    CB.step(state, spark.createDataFrame([(1, [0.2]), (2, None)], "id long, v array<double>"), 1, "id", "v")
    CB.step(state, none, 2, "id", "v")
    got, ring, seen, total = state.at(2)
    assert [r.code for r in ring.collect()] == [0] and (seen, total) == (1, 1) and got.count() == 2
