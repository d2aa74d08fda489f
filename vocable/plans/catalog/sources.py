"""A: sources and sinks, exercised on metadata files that Spark writes from
the driver tables into the shared scratch folder and reads back."""

from pyspark.sql import functions as F

from vocable.functions.text import basic_cleaners
from vocable.plans.catalog.sqlbits import sql_basic_clean
from vocable.plans.registry import register
from vocable.sources import metadata as A
from vocable.sources.tables import table
from vocable.session import scratch


@register("a1_pipe_metadata_roundtrip", f"""
SELECT doc_id, replace({sql_basic_clean('text')}, '|', '/') AS text, 'ljspeech' AS speaker_name FROM documents
""")
def a1(spark, sf):
    """A11 sink (id|raw|normalised) then the A1 ljspeech scan of the written files."""
    root = scratch(spark, "a1")
    d = table(spark, sf, "documents").withColumn("clean", basic_cleaners(F.col("text")))
    A.write_pipe_metadata(d, f"{root}/metadata", ["doc_id", "text", "clean"])
    s = A.load_dataset(spark, "ljspeech", root, "metadata")
    return s.select(F.regexp_extract("audio_file", r"/wavs/(\d+)\.wav$", 1).cast("long").alias("doc_id"), "text",
                    "speaker_name")


@register("a3_header_metadata", f"""
SELECT doc_id, text, source AS speaker_name, 'neutral' AS emotion_name FROM (
  SELECT doc_id, replace(replace(replace(text, '|', '/'), chr(13), ' '), chr(10), ' ') AS text, source FROM documents)
""")
def a3(spark, sf):
    """A3: header ``audio_file|text|speaker_name`` (no emotion column → 'neutral')."""
    root = scratch(spark, "a3")
    d = table(spark, sf, "documents").select(F.concat(F.lit("wavs/"), F.col("doc_id").cast("string"), F.lit(".wav"))
                                             .alias("audio_file"), "text", F.col("source").alias("speaker_name"))
    A.write_header_metadata(d, f"{root}/meta", ["audio_file", "text", "speaker_name"])
    s = A.load_dataset(spark, "coqui", root, "meta", skip_missing=False)   # the table has no recordings
    return s.select(F.regexp_extract("audio_file", r"/wavs/(\d+)\.wav$", 1).cast("long").alias("doc_id"), "text",
                    "speaker_name", "emotion_name")


@register("a4_malformed_lines", """
SELECT doc_id FROM documents WHERE contains(text, '|')
""")
def a4(spark, sf):
    """A4: lines whose field count differs from the header's; the writer
    here does not escape ``|``, so documents containing one are malformed."""
    root = scratch(spark, "a4")
    d = table(spark, sf, "documents")
    body = d.select(F.concat_ws("|", F.col("doc_id").cast("string"),
                                F.regexp_replace("text", "[\r\n]", " ")).alias("id|text"))
    # Every part file gets its own header line (the column name).
    body.write.mode("overwrite").option("header", True).option("quote", "").option("escape", "").csv(f"{root}/meta")
    bad = A.malformed_lines(spark, f"{root}/meta", "|")
    return bad.select(F.element_at(F.split("value", r"\|"), 1).cast("long").alias("doc_id"))


def _id(path: str, pattern: str = r"(\d+)\.[a-z0-9]+$"):
    return F.regexp_extract(path, pattern, 1).cast("long")


def _folder(spark, name: str) -> str:
    return A.plain(scratch(spark, name))


LINE_SQL = "replace(replace(replace(text, '|', '/'), chr(13), ' '), chr(10), ' ')"


@register("a2_datasets", f"""
SELECT doc_id, {LINE_SQL} AS text, CASE WHEN doc_id % 2 = 0 THEN 'ljspeech' ELSE 'thorsten' END AS speaker_name,
       CASE WHEN doc_id % 2 = 0 THEN 'en' ELSE 'de' END AS language, CASE WHEN doc_id % 2 = 0 THEN 'one' ELSE 'two' END AS dataset FROM documents
""")
def a2(spark, sf):
    """Two corpora of different layouts, read by name into one table."""
    root = _folder(spark, "a2")
    d = table(spark, sf, "documents")
    A.write_pipe_metadata(d.where("doc_id % 2 = 0"), f"{root}/one/metadata", ["doc_id", "doc_id", "text"])
    A.write_pipe_metadata(d.where("doc_id % 2 <> 0"), f"{root}/two/metadata", ["doc_id", "text"])
    s = A.load_datasets(spark, [
        {"formatter": "ljspeech", "path": f"{root}/one", "meta_file": "metadata", "language": "en", "name": "one"},
        {"formatter": "Thorsten", "path": f"{root}/two", "meta_file": "metadata", "language": "de", "name": "two"}])
    return s.select(_id("audio_file").alias("doc_id"), "text", "speaker_name", "language", "dataset")


@register("a5_vctk_crawl", """
SELECT doc_id, string_split(text, chr(10))[1] AS text, 'VCTK_' || source AS speaker_name FROM documents WHERE doc_id % 3 <> 0
""")
def a5(spark, sf):
    """A transcript file per document and speaker folder; a third of the recordings is missing and skipped."""
    root = _folder(spark, "a5")
    d = table(spark, sf, "documents")
    path = F.concat_ws("/", F.col("source"), F.col("doc_id").cast("string"))
    A.write_files(d.select(F.concat(F.lit("txt/"), path, F.lit(".txt")).alias("name"), F.col("text").alias("content")), root)
    A.write_files(d.where("doc_id % 3 <> 0").select(F.concat(F.lit("wav48_silence_trimmed/"), path, F.lit("_mic1.flac")).alias("name"),
                                                    F.lit("x").alias("content")), root)
    s = A.load_dataset(spark, "vctk", root)
    return s.select(_id("audio_file", r"(\d+)_mic1\.flac$").alias("doc_id"), "text", "speaker_name")


@register("a6_xml_corpus", f"""
SELECT doc_id, {sql_basic_clean('text')} AS text, 'sam_accenture' AS speaker_name FROM documents
""")
def a6(spark, sf):
    root = _folder(spark, "a6")
    d = table(spark, sf, "documents").select("doc_id", basic_cleaners(F.col("text")).alias("text"))
    # parts of an even size: a reader takes a part of an XML corpus whole
    script = d.select(F.col("doc_id").cast("string").alias("_id"), F.col("text").alias("_VALUE")).hint("rebalance")
    script.write.format("xml").option(
        "rowTag", "fileid").option("rootTag", "recordings").save(f"{root}/voice_over_recordings/recording_script.xml")
    A.write_files(d.select(F.concat(F.lit("vo_voice_quality_transformation/"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("name"),
                           F.lit("x").alias("content")), root)
    s = A.load_dataset(spark, "sam_accenture", root, "recording_script.xml")
    return s.select(_id("audio_file").alias("doc_id"), "text", "speaker_name")


@register("a7_parquet_corpus", "SELECT doc_id, text, lang FROM documents ORDER BY doc_id LIMIT 300")
def a7(spark, sf):
    """A Parquet corpus, its first rows in an order, columns dropped before they are read."""
    return A.parquet_corpus(spark, f"{sf}/documents.parquet", 300, ("source", "n_chars"), "doc_id")


MAP_SQL = """SELECT CAST(vec_id AS VARCHAR) || ' }"{,' AS clip, 'spk' || label AS name, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total
FROM embeddings"""


def _clip_map(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.concat(F.col("vec_id").cast("string"), F.lit(' }"{,')).alias("clip"),
                    F.concat(F.lit("spk"), F.col("label").cast("string")).alias("name"), "embedding")


def _total(df):
    return df.withColumn("total", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4))


@register("a8_embedding_map", MAP_SQL)
def a8(spark, sf):
    """A map of clips as JSON objects, written and read in pieces; braces and quotes inside the keys."""
    root = _folder(spark, "a8")
    A.save_embedding_map(_clip_map(spark, sf), root)
    return _total(A.read_embedding_map(spark, root)).select("clip", "name", "total")


@register("a9_embedding_maps", f"""
WITH m AS ({MAP_SQL}), f AS (SELECT *, CASE WHEN CAST(string_split(clip, ' ')[1] AS BIGINT) % 2 = 0 THEN 0 ELSE 1 END AS file_no FROM m),
n AS (SELECT name, row_number() OVER (ORDER BY min(file_no), name) - 1 AS name_id FROM f GROUP BY name)
SELECT clip, name, total, file_no, name_id FROM f JOIN n USING (name)
""")
def a9(spark, sf):
    """Several maps as one, ids of names anew."""
    root, m = _folder(spark, "a9"), _clip_map(spark, sf)
    for k in (0, 1):
        A.save_embedding_map(m.where(F.pmod("vec_id", F.lit(2)) == k), f"{root}/{k}.json")
    return _total(A.load_embedding_maps(spark, [f"{root}/0.json", f"{root}/1.json"])).select("clip", "name", "total", "file_no", "name_id")


@register("a10_attention_masks", "SELECT doc_id, 'masks/' || source || '.npy' AS mask_file FROM documents")
def a10(spark, sf):
    root = _folder(spark, "a10")
    d = table(spark, sf, "documents").select(F.concat(F.lit("wavs/"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("a"),
                                             F.concat(F.lit("masks/"), F.col("source"), F.lit(".npy ")).alias("m"))
    A.write_pipe_metadata(d, root, ["a", "m"])
    return A.attention_masks(spark, root).select(_id("audio_file").alias("doc_id"), "mask_file")


@register("a11_train_eval_files", f"""
SELECT CASE WHEN n_chars > 3000 THEN 'rejected.csv' WHEN doc_id % 7 = 0 THEN 'eval.csv' ELSE 'train.csv' END AS file,
       doc_id, {LINE_SQL} AS text, source AS speaker_name FROM documents WHERE text <> ''
""")
def a11(spark, sf):
    """train.csv, eval.csv and the list of rejected files, each one file with a manifest."""
    root = _folder(spark, "a11")
    d = table(spark, sf, "documents").where("text <> ''").select("doc_id", "text", F.col("source").alias("speaker_name"), "n_chars")
    A.write_train_eval(d, root, ["doc_id", "text", "speaker_name"], ["doc_id"], F.col("doc_id") % 7 == 0, F.col("n_chars") > 3000)
    out = None
    for name in ("train.csv", "eval.csv", "rejected.csv"):
        part = A.read_single_file(spark, f"{root}/{name}").select(F.lit(name).alias("file"), F.col("doc_id").cast("long").alias("doc_id"), "text", "speaker_name")
        out = part if out is None else out.unionByName(part)
    return out


def _recordings(spark, sf, name: str) -> str:
    """A file per document below its source's folder: .wav, .flac and .txt in turn."""
    root = _folder(spark, name)
    ext = F.element_at(F.array(F.lit("wav"), F.lit("FLAC"), F.lit("txt")), (F.col("doc_id") % 3 + 1).cast("int"))
    d = table(spark, sf, "documents").select(F.concat_ws("", F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("name"),
                                             F.coalesce("text", F.lit("")).alias("content"))
    A.write_files(d, root)
    return root


FILES_SQL = """(SELECT doc_id, source, source || '/' || doc_id || '.' || ['wav', 'FLAC', 'txt'][doc_id % 3 + 1] AS path,
                       strlen(coalesce(text, '')) AS length, md5(coalesce(text, '')) AS digest FROM documents)"""


@register("a12_list_files", f"SELECT path, length FROM {FILES_SQL} WHERE doc_id % 3 < 2")
def a12(spark, sf):
    root = _recordings(spark, sf, "a12")
    return A.list_files(spark, root).select(F.replace("path", F.lit(f"{root}/"), F.lit("")).alias("path"), "length")


@register("a13_checksums", f"SELECT path, doc_id % 5 <> 0 AS ok FROM {FILES_SQL}")
def a13(spark, sf):
    """A manifest of expected digests against the files' bytes; every fifth expectation is wrong."""
    root = _recordings(spark, sf, "a13")
    d = table(spark, sf, "documents")
    ext = F.element_at(F.array(F.lit("wav"), F.lit("FLAC"), F.lit("txt")), (F.col("doc_id") % 3 + 1).cast("int"))
    m = d.select(F.concat(F.lit(f"{root}/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"),
                 F.when(F.col("doc_id") % 5 == 0, F.lit("wrong")).otherwise(F.md5(F.coalesce("text", F.lit("")))).alias("expected"))
    return A.check_manifest(spark, root, m).select(F.replace("path", F.lit(f"{root}/"), F.lit("")).alias("path"), "ok")


@register("a14_label_crawl", f"""
WITH f AS (SELECT * FROM {FILES_SQL} WHERE doc_id % 3 = 0),
s AS (SELECT source, row_number() OVER (ORDER BY min(path)) - 1 AS speaker_id FROM f GROUP BY source)
SELECT path, length, source AS speaker_name, speaker_id FROM f JOIN s USING (source)
""")
def a14(spark, sf):
    root = _recordings(spark, sf, "a14")
    return A.label_crawl(spark, root).select(F.replace("path", F.lit(f"{root}/"), F.lit("")).alias("path"), "length", "speaker_name", "speaker_id")


@register("a15_cached_crawl", f"SELECT path, length FROM {FILES_SQL} WHERE doc_id % 3 = 0")
def a15(spark, sf):
    """The second call reads what the first one wrote; it would fail if it crawled."""
    root, cache = _recordings(spark, sf, "a15"), _folder(spark, "a15-cache")
    A.cached_crawl(spark, cache, lambda: A.list_files(spark, root, (".wav",)))

    def crawled_again():
        raise RuntimeError("the cache was not used")
    return A.cached_crawl(spark, cache, crawled_again, 1).select(F.replace("path", F.lit(f"{root}/"), F.lit("")).alias("path"), "length")


@register("a16_voice_folders", f"SELECT source AS voice, list(path ORDER BY path) AS files FROM {FILES_SQL} WHERE doc_id % 3 = 0 GROUP BY source")
def a16(spark, sf):
    root = _recordings(spark, sf, "a16")
    return A.voice_folders(spark, root).select("voice", F.transform("files", lambda p: F.replace(p, F.lit(f"{root}/"), F.lit(""))).alias("files"))
