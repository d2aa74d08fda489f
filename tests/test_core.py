"""Core helpers: position, hashing, keys, vocabulary, entry contract."""

import duckdb
from pyspark.sql import functions as F

from conftest import SF001


def test_position_is_dense_and_partition_invariant(spark):
    from vocable.plans.position import with_position

    df = spark.range(0, 997).select((F.col("id") * 7919 % 997).alias("k"), F.col("id"))
    seen = None
    for parts in (1, 3, 17):
        out = with_position(df.repartition(parts), ["k", "id"], num_partitions=parts)
        rows = sorted((r.pos, r.k) for r in out.select("pos", "k").collect())
        assert [p for p, _ in rows] == list(range(997))
        assert [k for _, k in rows] == sorted(k for _, k in rows)
        seen = seen or rows
        assert rows == seen


def test_position_prefix_weights(spark):
    from vocable.plans.position import with_position

    df = spark.range(1, 101).select(F.col("id").alias("k"), (F.col("id") % 5).alias("w"))
    out = with_position(df, ["k"], num_partitions=7, weight=F.col("w"), cum_col="cum").orderBy("k").collect()
    run = 0.0
    for r in out:
        run += r.k % 5
        assert abs(r.cum - run) < 1e-9


def test_keyed_running_matches_pandas_and_partitioning(spark):
    import pandas as pd

    from vocable.plans.position import keyed_running

    rows = [(k % 3 if k % 7 else 0, k, float((k * 37) % 101) - 50.0) for k in range(600)]  # key 0 is hot
    df = spark.createDataFrame(rows, "key long, t long, x double")
    pdf = pd.DataFrame(rows, columns=["key", "t", "x"]).sort_values(["key", "t"])
    exp = pdf.assign(s=pdf.groupby("key")["x"].cumsum(), mn=pdf.groupby("key")["x"].cummin(),
                     mx=pdf.groupby("key")["x"].cummax()).set_index("t")
    for parts in (1, 3, 17):
        out = keyed_running(df.repartition(parts), ["key"], ["t"],
                            [("x", "sum", "s"), ("x", "min", "mn"), ("x", "max", "mx")], num_partitions=parts)
        got = out.toPandas().set_index("t").sort_index()
        for c in ("s", "mn", "mx"):
            assert (abs(got[c] - exp.loc[got.index, c]) < 1e-9).all(), (parts, c)


def test_hash_matches_duckdb(spark):
    from vocable.functions.hashing import hash52, sql_hash52

    keys = [str(i) for i in range(200)]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    s = {r.k: r.h for r in df.select("k", hash52(42, "op", F.col("k")).alias("h")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT * FROM (VALUES " + ",".join(f"('{k}')" for k in keys) + ") v(k)")
    d = dict(con.execute(f"SELECT k, {sql_hash52(42, 'op', 'k')} FROM t").fetchall())
    assert s == d


def test_unique_audio_name_paths(spark):
    from vocable.operators.keys import unique_audio_name

    rows = [("/r/a/b.wav", "/r"), ("/r/a/b.tar.gz", "/r/"), ("/r/.hidden", "/r"), ("/x/y.wav", "/r")]
    df = spark.createDataFrame(rows, "f string, root string")
    got = [r.u for r in df.select(unique_audio_name(F.col("f"), F.col("root"), "ds").alias("u")).collect()]
    assert got == ["ds#a/b", "ds#a/b.tar", "ds#.hidden", "ds#/x/y"]


def test_file_key_roundtrip(spark):
    from vocable.operators.keys import file_key, file_key_decode

    df = spark.createDataFrame([("a/b?c=ü+/é",)], "s string")
    r = df.select(file_key("s").alias("k"), file_key_decode(file_key("s")).alias("d")).first()
    assert r.d == "a/b?c=ü+/é" and "+" not in r.k and "/" not in r.k


def test_vocabulary_order_and_encode(spark):
    from vocable.operators.vocab import build_vocabulary, decode_ids, encode_chars_lut, vocab_lut

    df = spark.createDataFrame([("ba c!",), ("éa",)], "text string")
    v = build_vocabulary(df, "text")
    rows = sorted((r.id, r.ch) for r in v.collect())
    chars = [c for _, c in rows]
    assert chars[:4] == ["<PAD>", "<EOS>", "<BOS>", "<BLNK>"]
    assert chars[4:8] == ["a", "b", "c", "é"]
    assert chars[8:] == list("!'(),-.:;? ")
    lut = vocab_lut(v)
    inv = F.create_map(*[x for i, c in rows for x in (F.lit(i), F.lit(c))])
    out = df.select("text", decode_ids(encode_chars_lut(F.col("text"), lut), inv).alias("back")).collect()
    assert all(r.text == r.back for r in out)


def test_entry_contract(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
    assert df.columns == ["batch_id", "n_rows", "max_len", "sum_len", "padded_cells", "padding_ratio", "id_sum"]


def test_smoke_all_queries_sf0001(spark):
    """Every registered query runs on the smallest scale."""
    import __spark_entry__ as E

    for name, fn in sorted(E.queries().items()):
        fn(spark, SF001).write.mode("overwrite").format("noop").save()


def test_relational_nearest_code_at_full_codebook_size(spark):
    """4096 codes of 512 dimensions: 2,097,152 long-form rows, joined without a cap."""
    import numpy as np

    from vocable.operators import vectors as K

    rng = np.random.default_rng(0)
    codes = rng.normal(size=(4096, 512)).round(3)
    book = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(codes)], "code int, centroid array<double>")
    rows = spark.createDataFrame([(i, (codes[i * 500] + 0.01).tolist()) for i in range(4)], "id long, v array<double>")
    assert {r.id: r.code for r in K.nearest_code_sql_form(rows, "id", "v", book).collect()} == {i: i * 500 for i in range(4)}


def test_nearest_code_is_the_same_in_blocks_of_any_size(spark, monkeypatch):
    """Ties, doubled entries and null vectors, whatever block an entry lies in."""
    import numpy as np

    from vocable.operators import blocked
    from vocable.operators import vectors as K

    rng = np.random.default_rng(5)
    codes = rng.integers(-2, 3, (60, 4)).astype(float)                       # many equal entries and equal distances
    book = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(codes)], "code int, centroid array<double>")
    x = rng.integers(-2, 3, (300, 4)) / 2
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, v array<double>").repartition(4)
    want = {i: int(((v - codes) ** 2).sum(axis=1).argmin()) for i, v in enumerate(x)} | {999: None}
    long = rows.where("v is not null").select("id", F.posexplode("v").alias("pos", "x"))
    for size in (1, 32 * 7, 1 << 20):
        monkeypatch.setattr(blocked, "BLOCK_BYTES", size)
        got = K.nearest_code(rows, "v", book, dist_col="d").collect()
        assert {r.id: r.code for r in got} == want
        assert all(abs(r.d - ((x[r.id] - codes[r.code]) ** 2).sum()) < 1e-9 for r in got if r.id != 999)
        means = book.select(F.concat(F.lit("c"), F.col("code")).alias("cls"), F.posexplode("centroid").alias("pos", "x")).where("cls <> 'c0'")
        named = K.nearest_mean(rows, "v", means, "cls").collect()
        if size == 1:
            first = {r.id: r.predicted for r in named}
        assert {r.id: r.predicted for r in named} == first
    assert {r.id: r.code for r in K.nearest_code_sql_form(rows.where("v is not null"), "id", "v", book).collect()} == {k: c for k, c in want.items() if k != 999}
    assert long.count() == 1200


def test_nearest_code_of_a_codebook_of_several_blocks(spark):
    """65,536 entries of 128 dimensions: 67 MB in three blocks, equal to one product."""
    import numpy as np

    from vocable.operators import vectors as K
    from vocable.operators.blocked import matrix

    value = F.transform(F.sequence(F.lit(0), F.lit(127)), lambda i: F.pmod(F.xxhash64("code", i), F.lit(1000)) / 1000.0)
    book = spark.range(65_536).select(F.col("id").cast("int").alias("code")).select("code", value.alias("centroid"))
    rows = spark.range(200).select("id", F.transform(F.sequence(F.lit(0), F.lit(127)), lambda i: F.pmod(F.xxhash64(F.col("id"), i + 5), F.lit(1000)) / 1000.0).alias("v"))
    m, x = (matrix(d.toArrow().column(1)) for d in (book.orderBy("code"), rows.orderBy("id")))
    d = (x * x).sum(axis=1)[:, None] - 2 * x @ m.T + (m * m).sum(axis=1)
    assert [r.code for r in K.nearest_code(rows, "v", book).orderBy("id").collect()] == d.argmin(axis=1).tolist()
    assert np.isfinite(d).all()


def test_weighted_draws_follow_fractional_weights(spark):
    from vocable.operators.split import weighted_draws

    weights = [0.1, 0.2, 0.3, 0.2, 0.1, 0.0]
    df = spark.createDataFrame(list(enumerate(weights)), "k long, w double")
    got = [r.k for r in weighted_draws(df, "k", "w", 20_000).collect()]
    assert len(got) == 20_000
    for k, w in enumerate(weights):
        assert abs(got.count(k) / 20_000 - w / 0.9) < 0.015


def test_last_mark_before_against_bisect(spark):
    import bisect

    from vocable.plans.position import last_mark_before

    marks = [(i, float(i * i % 97)) for i in range(1, 40)]
    points = [(i, i * 0.7) for i in range(140)] + [(200, marks[3][1])]
    got = {r.p: r.m for r in last_mark_before(spark.createDataFrame(points, "p long, at double").repartition(5),
                                              spark.createDataFrame(marks, "m long, at double"), "at", "p", "m").collect()}
    order = sorted((at, m) for m, at in marks)
    for p, at in points:
        k = bisect.bisect_right(order, (at, 10 ** 9))
        assert got.get(p) == (order[k - 1][1] if k else None)


def test_split_sizes_and_guards(spark):
    import pytest

    from vocable.operators.split import split_datasets, split_many_speakers
    from vocable.operators.stats import class_accuracy

    rows = [(i, "a" if i < 70 else "b", f"s{i % 7}" if i < 70 else "only") for i in range(100)]
    df = spark.createDataFrame(rows, "k long, d string, s string")
    out = split_datasets(df, "k", "d", "s", 0.5, max_size=30).collect()
    ev = [r for r in out if r.split == "eval"]
    assert len(out) == 100 and sum(r.d == "a" for r in ev) == 15 and sum(r.d == "b" for r in ev) == 15
    assert {r.s for r in out if r.split == "train"} == {r[2] for r in rows}
    with pytest.raises(Exception, match="eval split size is 0"):
        split_many_speakers(df, "k", "s", 0.001).collect()
    with pytest.raises(Exception, match="null class label"):
        class_accuracy(spark.createDataFrame([("a", "a"), (None, "a")], "t string, p string"), "t", "p").collect()
