"""One file written by many tasks, byte for byte, outer spaces kept."""


def test_single_file_at_places(spark, tmp_path):
    from vocable.sources import metadata as A

    rows = [(i, f" é {i} " if i % 3 else "a|b") for i in range(500)]
    d = spark.createDataFrame(rows, "k long, t string").repartition(5)
    A.write_single_file(d, f"{tmp_path}/one/all.csv", ["k", "t"], ["k"])
    want = "k|t\n" + "".join(f"{k}|{t.replace('|', '/')}\n" for k, t in rows)
    assert (tmp_path / "one" / "all.csv").read_text() == want
    assert A.read_single_file(spark, f"{tmp_path}/one/all.csv").count() == 500
    A.write_single_file(d.where("k < 0"), f"{tmp_path}/one/none.csv", ["k", "t"], ["k"])
    assert A.read_single_file(spark, f"{tmp_path}/one/none.csv").count() == 0
