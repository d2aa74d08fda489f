"""Driver tables and the sample table derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one driver table; column pruning and filters reach the scan."""
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of space-separated pieces (empty pieces count, as in a plain split)."""
    return F.size(F.split(text, " ", -1)).cast("long")


def emotion_of(quality: Column, toxic: Column) -> Column:
    return (F.when(toxic == 1, F.lit("toxic"))
            .when(quality == 1, F.lit("good"))
            .when(quality.isNotNull(), F.lit("bad")))


def samples(spark: SparkSession, sf_dir: str, dataset: str = "docs",
            with_emotion: bool = False) -> DataFrame:
    """The sample schema built from ``documents``.

    text, language, speaker_name, root_path, audio_file, audio_unique_name,
    audio_length (stands in for samples), text_length (words), doc_id and,
    optionally, emotion_name from a left join with ``labels``.
    """
    d = table(spark, sf_dir, "documents")
    root = F.lit("/data")
    audio_file = F.concat(root, F.lit("/"), d.source, F.lit("/"), d.doc_id.cast("string"), F.lit(".wav"))
    out = d.select(
        d.doc_id,
        d.text,
        d.lang.alias("language"),
        d.source.alias("speaker_name"),
        root.alias("root_path"),
        audio_file.alias("audio_file"),
        d.n_chars.alias("audio_length"),
        word_count(d.text).alias("text_length"),
    )
    from vocable.operators.keys import unique_audio_name

    out = out.withColumn("audio_unique_name",
                         unique_audio_name(F.col("audio_file"), F.col("root_path"), dataset))
    if with_emotion:
        lab = table(spark, sf_dir, "labels")
        # labels is unique on doc_id (guarded by its producer); plain left join,
        # the planner picks broadcast only when statistics say it is small.
        out = (out.join(lab, "doc_id", "left")
               .withColumn("emotion_name", emotion_of(F.col("quality"), F.col("toxic")))
               .drop("quality", "toxic"))
    return out
