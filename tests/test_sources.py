"""Maps of any size, single files with a manifest, folder layouts."""

import json

import pytest
from pyspark.sql import functions as F

from vocable.sources import metadata as A

KEYS = ["plain", "with } brace", 'quote " inside', 'both "}{," }', "back\\slash \\", "{", "}", "é 漢", "tab\tnew\nline"]


def as_map(rows):
    return {r.clip: (r.name, list(r.embedding)) for r in rows}


@pytest.mark.parametrize("indent", [None, 4])
def test_embedding_map_of_any_layout(spark, tmp_path, indent):
    data = {f"{k} {i}": {"name": f"n{i % 3} }}{{", "embedding": [i / 2, -1.0, 0.25]} for i, k in enumerate(KEYS * 3)}
    (tmp_path / "m.json").write_text(json.dumps(data, indent=indent))
    got = as_map(A.load_embedding_map(spark, str(tmp_path / "m.json")).collect())
    assert got == {k: (v["name"], v["embedding"]) for k, v in data.items()}


def test_one_large_map_is_read_in_several_tasks(spark, tmp_path):
    n = 40_000
    with open(tmp_path / "big.json", "w") as f:
        f.write("{" + ", ".join(json.dumps(f"clip }} {i}") + ": " + json.dumps({"name": f"s{i % 7}", "embedding": [i, 0.5] * 8}) for i in range(n)) + "}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512k")
    try:
        assert spark.read.option("lineSep", "}").text(str(tmp_path / "big.json")).rdd.getNumPartitions() > 5
        got = A.load_embedding_map(spark, str(tmp_path / "big.json"))
        assert got.count() == n
        assert got.agg(F.sum(F.element_at("embedding", 1))).first()[0] == n * (n - 1) / 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_map_round_trip_and_damage(spark, tmp_path):
    df = spark.createDataFrame([(k, f"name {i}", [float(i), 1.5]) for i, k in enumerate(KEYS)], "clip string, name string, embedding array<float>").repartition(4)
    A.save_embedding_map(df, str(tmp_path / "out"))
    assert as_map(A.read_embedding_map(spark, str(tmp_path / "out")).collect()) == as_map(df.collect())
    for part in (tmp_path / "out").glob("p=*/part-*.txt"):
        assert isinstance(json.loads(part.read_text()), dict)          # each file is a map of its own
    (tmp_path / "bad.json").write_text('{"a": {"name": "x", "embedding": [1]}, "b": {"name": oops}}')
    with pytest.raises(Exception, match="not an entry"):
        A.load_embedding_map(spark, str(tmp_path / "bad.json")).collect()


def test_single_files_and_their_manifest(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text | {i}\nmore" if i % 5 else "", None if i % 3 else "x") for i in range(200)], "k long, t string, u string").repartition(7)
    got = A.write_train_eval(df, str(tmp_path), ["k", "t", "u"], ["k"], F.col("k") % 4 == 0, F.col("k") > 150)
    assert {n: m["rows"] for n, m in got.items()} == {"train.csv": 113, "eval.csv": 38, "rejected.csv": 49}
    lines = (tmp_path / "eval.csv").read_text().splitlines()
    assert lines[0] == "k|t|u" and [int(x.split("|")[0]) for x in lines[1:]] == list(range(0, 152, 4)) and lines[2].startswith("4|text / 4 more|")
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == [
        "eval.csv", "eval.csv.manifest", "rejected.csv", "rejected.csv.manifest", "train.csv", "train.csv.manifest"]
    assert A.read_single_file(spark, str(tmp_path / "train.csv")).count() == 113
    (tmp_path / ".train.csv.crc").unlink(missing_ok=True)
    (tmp_path / "train.csv").write_text("\n".join((tmp_path / "train.csv").read_text().splitlines()[:-1]))
    with pytest.raises(RuntimeError, match="manifest"):
        A.read_single_file(spark, str(tmp_path / "train.csv"))


def test_a_failed_attempt_leaves_nothing(spark, tmp_path):
    df = spark.range(20).withColumn("t", F.when(F.col("id") == 13, F.raise_error(F.lit("stop"))).otherwise(F.col("id").cast("string")))
    with pytest.raises(Exception, match="stop"):
        A.write_single_file(df, str(tmp_path / "x.csv"), ["id", "t"], ["id"])
    assert not list(tmp_path.iterdir())


def test_files_by_row(spark, tmp_path):
    df = spark.createDataFrame([("a/1.txt", "one"), ("a/b/2.txt", None), ("3.txt", "é")], "name string, content string")
    assert A.write_files(df, str(tmp_path)) == 3 and A.write_files(df, str(tmp_path)) == 3
    assert {str(p.relative_to(tmp_path)): p.read_text() for p in tmp_path.rglob("*.txt")} == {"a/1.txt": "one", "a/b/2.txt": "", "3.txt": "é"}
