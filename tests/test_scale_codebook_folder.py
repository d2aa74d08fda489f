"""N7s and K8 on a table kept as a folder of files: the same single step as on one file."""

from conftest import SF001


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_online_codebook_of_a_folder_of_files(spark, tmp_path):
    from vocable.plans.catalog import streaming as S

    e = spark.read.parquet(f"{SF001}/embeddings.parquet")
    e.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    for query in (S.n7s, S.k8_online):
        assert _rows(query(spark, str(tmp_path))) == _rows(query(spark, SF001)) != []


def test_event_stream_of_a_folder_of_files(spark, tmp_path):
    from vocable.streaming import stateful as N

    spark.read.parquet(f"{SF001}/events.parquet").repartition(2).write.parquet(f"{tmp_path}/events.parquet")
    out = N.run_to_parquet(N.event_stream(spark, str(tmp_path)).select("event_id"), "t-events")
    assert spark.read.parquet(out).count() == spark.read.parquet(f"{SF001}/events.parquet").count()
