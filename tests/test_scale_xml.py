"""The XML corpus is written in parts of an even size."""

import glob

from pyspark.sql import functions as F


def test_xml_parts_are_even(spark, tmp_path):
    from vocable.plans.catalog import sources as S
    from vocable.session import ensure_checkpoint_dir

    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(*[
        F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"-{k}")), 512) for k in range(16)]).alias("text"))
    d.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    parts = ensure_checkpoint_dir(spark).removeprefix("file:") + "/a6-*/voice_over_recordings/recording_script.xml/part-*"
    before = set(glob.glob(parts))
    spark.conf.set(size, "20k")
    try:
        assert S.a6(spark, str(tmp_path)).count() == 3000
    finally:
        spark.conf.unset(size)
    assert len(set(glob.glob(parts)) - before) > 1
