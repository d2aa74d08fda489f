"""A: corpus metadata sources and sinks, as DataFrame builders.

Every formatter returns the sample schema
``text, audio_file, speaker_name, root_path, emotion_name?`` (plus
``line_no`` when line order matters).  Files are read line-exact with
``spark.read.text`` (no CSV quoting: the reference splits lines on a
delimiter), so a file is split across tasks like any text input.
"""

from __future__ import annotations

import fnmatch
import os
import re
import stat
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vocable.plans.position import keyed_running, with_position
from vocable.session import path_exists, written

SAMPLE_COLUMNS = ["text", "audio_file", "speaker_name", "root_path", "emotion_name"]


def _join(root: str, *parts) -> Column:
    cols = [F.lit(root.rstrip("/"))] + [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.concat_ws("/", *cols)


def lines(spark: SparkSession, path: str, encoding: str | None = None, ordered: bool = False) -> DataFrame:
    """A1 base: one row per line (``value``); with ``ordered``, a 0-based
    ``line_no`` in file order (file path, then position in the file)."""
    if encoding and encoding.lower() not in ("utf-8", "utf8"):
        df = (spark.read.option("sep", "\u0000").option("quote", "").option("escape", "").option("encoding", encoding)
              .option("header", False).csv(path).withColumnRenamed("_c0", "value"))
    else:
        df = spark.read.text(path)
    if not ordered:
        return df
    df = df.withColumn("_f", F.col("_metadata.file_path")).withColumn("_o", F.monotonically_increasing_id())
    return with_position(df, ["_f", "_o"], "line_no").drop("_f", "_o")


def split_fields(value: Column, sep: str) -> Column:
    return F.split(value, re.escape(sep), -1)


def sample(text, audio_file, speaker, root: str, emotion=None) -> list[Column]:
    return [text.alias("text"), audio_file.alias("audio_file"),
            (speaker if isinstance(speaker, Column) else F.lit(speaker)).alias("speaker_name"),
            F.lit(root).alias("root_path"),
            (emotion if isinstance(emotion, Column) else F.lit(emotion)).cast("string").alias("emotion_name")]


# ---------------------------------------------------------------- formatters (A1/A3)
def ljspeech(spark, root: str, meta_file: str, **_) -> DataFrame:
    f = split_fields(F.col("value"), "|")
    return lines(spark, f"{root}/{meta_file}").select(
        *sample(F.element_at(f, 3), _join(root, "wavs", F.concat(F.element_at(f, 1), F.lit(".wav"))), "ljspeech", root))


def ljspeech_test(spark, root: str, meta_file: str, **_) -> DataFrame:
    """A new speaker every two lines, ids from 1 (needs line order)."""
    f = split_fields(F.col("value"), "|")
    l = lines(spark, f"{root}/{meta_file}", ordered=True)
    spk = F.concat(F.lit("ljspeech-"), (F.expr("line_no div 2") + 1).cast("string"))
    return l.select(*sample(F.element_at(f, 3), _join(root, "wavs", F.concat(F.element_at(f, 1), F.lit(".wav"))),
                            spk, root), "line_no")


def _simple(name: str, sep: str, text_i: int, wav_i: int, speaker: str, wav_dir: str | None = "wavs",
            ext: str = ".wav", encoding: str | None = None, strip: bool = False, text_fn=None):
    def build(spark, root: str, meta_file: str, **_) -> DataFrame:
        f = split_fields(F.col("value"), sep)
        t = F.element_at(f, text_i)
        w = F.element_at(f, wav_i)
        if strip:
            t, w = F.trim(t), F.trim(w)
        if text_fn is not None:
            t = text_fn(t)
        parts = ([wav_dir] if wav_dir else []) + [F.concat(w, F.lit(ext)) if ext else w]
        return lines(spark, f"{root}/{meta_file}", encoding).select(*sample(t, _join(root, *parts), speaker, root))
    build.__name__ = name
    return build


thorsten = _simple("thorsten", "|", 2, 1, "thorsten")
kss = _simple("kss", "|", 3, 1, "kss", wav_dir=None, ext="")
bel_tts_formatter = _simple("bel_tts_formatter", "|", 2, 1, "bel_tts", wav_dir=None, ext="")
kokoro = _simple("kokoro", "|", 3, 1, "kokoro", text_fn=lambda t: F.replace(t, F.lit(" "), F.lit("")))
css10 = _simple("css10", "|", 2, 1, "css10", wav_dir=None, ext="")
ruslan = _simple("ruslan", "|", 2, 1, "ruslan", wav_dir="RUSLAN")
tweb = _simple("tweb", "\t", 2, 1, "tweb", wav_dir=None)
mozilla = _simple("mozilla", "|", 1, 2, "mozilla", ext="", strip=True)


def present(samples: DataFrame, root: str) -> DataFrame:
    """Samples whose audio file lies below ``root``; the others are skipped.  The
    listing is a scan of paths (no contents), so it runs on the cluster."""
    from vocable.operators.filters import existing_files

    return existing_files(samples, list_files(samples.sparkSession, root).select("path"))


def custom_turkish(spark, root: str, meta_file: str, **_) -> DataFrame:
    """Fields trimmed; lines whose recording is missing are skipped."""
    rows = _simple("custom_turkish", "|", 2, 1, "turkish-female", strip=True)(spark, root, meta_file)
    return present(rows, root)


def mozilla_de(spark, root: str, meta_file: str, **_) -> DataFrame:
    """ISO 8859-1; recordings lie in ``BATCH_<first name part>_FINAL``."""
    f = split_fields(F.trim("value"), "|")
    wav = F.trim(F.element_at(f, 1))
    folder = F.concat(F.lit("BATCH_"), F.element_at(F.split(wav, "_"), 1), F.lit("_FINAL"))
    return lines(spark, f"{root}/{meta_file}", "ISO-8859-1").select(
        *sample(F.trim(F.element_at(f, 2)), _join(root, folder, wav), "mozilla", root))


def nancy(spark, root: str, meta_file: str, **_) -> DataFrame:
    """Lines ``( id "text " )``: the text stands between the outer quotes, less its last character."""
    v = F.col("value")
    text = F.regexp_replace(F.regexp_extract(v, '"(.*)"', 1), ".$", "")
    utt = F.element_at(F.split(F.trim(v), r"\s+"), 2)
    return lines(spark, f"{root}/{meta_file}").select(
        *sample(text, _join(root, "wavn", F.concat(utt, F.lit(".wav"))), "nancy", root))


def mailabs(spark, root: str, meta_files=None, ignored_speakers=None, **_) -> DataFrame:
    """All ``metadata.csv`` below ``root`` (or the given ones); speaker from
    ``by_book/<sex>/<speaker>/``; files elsewhere and missing recordings are skipped."""
    if meta_files:
        named = [meta_files] if isinstance(meta_files, str) else meta_files
        t = spark.read.text([m if m.startswith("/") or ":" in m else f"{root}/{m}" for m in named])
    else:
        t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "metadata.csv").text(root)
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/")
    t = t.select("value", path.alias("_file"))
    spk = F.regexp_extract("_file", r"by_book/(?:male|female)/([^/]+)/", 1)
    f = split_fields(F.col("value"), "|")
    audio = F.concat(F.regexp_replace("_file", "/[^/]*$", ""), F.lit("/wavs/"), F.element_at(f, 1), F.lit(".wav"))
    out = t.where(spk != "").select(*sample(F.trim(F.element_at(f, 2)), audio, spk, root))
    return present(_without_speakers(out, ignored_speakers), root)


def libri_tts(spark, root: str, meta_files=None, ignored_speakers=None, **_) -> DataFrame:
    """``*trans.tsv`` files; names ``speaker_chapter_…``; a missing recording fails the job."""
    if meta_files:
        named = [meta_files] if isinstance(meta_files, str) else meta_files
        t = spark.read.text([f"{root}/{m}" for m in named])
    else:
        t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*trans.tsv").text(root)
    f = split_fields(F.col("value"), "\t")
    name = F.element_at(f, 1)
    parts = F.split(name, "_")
    out = t.select(*sample(F.element_at(f, 3), _join(root, F.element_at(parts, 1), F.element_at(parts, 2),
                                                     F.concat(name, F.lit(".wav"))), F.element_at(parts, 1), root))
    out = _without_speakers(out, ignored_speakers)
    found = list_files(spark, root).select(F.col("path").alias("_p"), F.lit(True).alias("_there"))
    checked = out.join(found, out.audio_file == F.col("_p"), "left").where(
        F.when(F.col("_there"), F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("recording does not exist: "), F.col("audio_file")))))
    return checked.select(*SAMPLE_COLUMNS).withColumn("speaker_name", F.concat(F.lit("LTTS_"), F.col("speaker_name")))


def _without_speakers(df: DataFrame, ignored_speakers) -> DataFrame:
    return df.where(~F.col("speaker_name").isin(list(ignored_speakers))) if ignored_speakers else df


def ljspeech_records(spark, root: str, meta_file: str = "metadata.csv", **_) -> DataFrame:
    """The second LJSpeech loader: raw text (field 2) of lines with exactly three
    fields, with a language; of a repeated name the last line counts; missing
    recordings are skipped."""
    f = split_fields(F.col("value"), "|")
    l = lines(spark, f"{root}/{meta_file}", ordered=True).where(F.size(f) == 3)
    last = l.groupBy(F.element_at(f, 1).alias("name")).agg(F.max_by(F.element_at(f, 2), "line_no").alias("text"))
    out = last.select(*sample(F.col("text"), _join(root, "wavs", F.concat("name", F.lit(".wav"))), "ljSpeech", root),
                      F.lit("en").alias("language"))
    return present(out, root)


def baker(spark, root: str, meta_file: str, **_) -> DataFrame:
    """Exactly two fields per line; any other width fails the job."""
    f = split_fields(F.col("value"), "|")
    ok = F.when(F.size(f) == 2, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("baker: bad line: "), "value")))
    l = lines(spark, f"{root}/{meta_file}").where(ok)
    return l.select(*sample(F.element_at(f, 2), _join(root, "clips_22", F.element_at(f, 1)), "baker", root))


def header_table(spark, path: str, sep: str) -> DataFrame:
    """A3 base: header line gives the column names."""
    return spark.read.option("sep", sep).option("header", True).option("quote", "").csv(path)


def coqui(spark, root: str, meta_file: str, ignored_speakers=None, skip_missing: bool = True, **_) -> DataFrame:
    """Header ``audio_file|text[|speaker_name][|emotion_name]``; absent
    speaker → 'coqui', absent emotion → 'neutral'."""
    t = header_table(spark, f"{root}/{meta_file}", "|")
    for c in ("audio_file", "text"):
        if c not in t.columns:
            raise ValueError(f"coqui metadata needs column {c!r}")
    spk = F.col("speaker_name") if "speaker_name" in t.columns else F.lit("coqui")
    emo = F.col("emotion_name") if "emotion_name" in t.columns else F.lit("neutral")
    out = t.select(*sample(F.col("text"), _join(root, F.col("audio_file")), spk, root, emo))
    if ignored_speakers and "speaker_name" in t.columns:
        out = out.where(~F.col("speaker_name").isin(list(ignored_speakers)))
    return present(out, root) if skip_missing else out


def cml_tts(spark, root: str, meta_file: str, ignored_speakers=None, skip_missing: bool = True, **_) -> DataFrame:
    """Header ``wav_filename|transcript[|client_id][|emotion_name]``."""
    t = header_table(spark, f"{root}/{meta_file}", "|")
    for c in ("wav_filename", "transcript"):
        if c not in t.columns:
            raise ValueError(f"cml_tts metadata needs column {c!r}")
    spk = F.col("client_id") if "client_id" in t.columns else F.lit("default")
    emo = F.col("emotion_name") if "emotion_name" in t.columns else F.lit("neutral")
    out = t.select(*sample(F.col("transcript"), _join(root, F.col("wav_filename")), spk, root, emo))
    if ignored_speakers and "client_id" in t.columns:
        out = out.where(~F.col("speaker_name").isin(list(ignored_speakers)))
    return present(out, root) if skip_missing else out


def common_voice(spark, root: str, meta_file: str, ignored_speakers=None, **_) -> DataFrame:
    """Tab file with a header line starting with ``client_id``; ``.mp3`` → ``.wav``."""
    l = lines(spark, f"{root}/{meta_file}").where(~F.col("value").startswith("client_id"))
    f = split_fields(F.col("value"), "\t")
    spk = F.element_at(f, 1)
    out = l.select(*sample(F.element_at(f, 3), _join(root, "clips", F.regexp_replace(F.element_at(f, 2), r"\.mp3$",
                                                                                       ".wav")),
                           F.concat(F.lit("MCV_"), spk), root), spk.alias("_spk"))
    if ignored_speakers:
        out = out.where(~F.col("_spk").isin(list(ignored_speakers)))
    return out.drop("_spk")


def mls(spark, root: str, meta_file: str, ignored_speakers=None, **_) -> DataFrame:
    """Tab file ``speaker_book_segment⇥text``; audio under speaker/book/."""
    f = split_fields(F.col("value"), "\t")
    key = F.element_at(f, 1)
    parts = F.split(key, "_")
    spk = F.element_at(parts, 1)
    folder = [meta_file.rpartition("/")[0]] if "/" in meta_file else []
    audio = _join(root, *folder, "audio", spk, F.element_at(parts, 2),
                  F.concat(key, F.lit(".wav")))
    out = lines(spark, f"{root}/{meta_file}").select(*sample(F.element_at(f, 2), audio, F.concat(F.lit("MLS_"), spk),
                                                             root), spk.alias("_spk"))
    if ignored_speakers:
        out = out.where(~F.col("_spk").isin(list(ignored_speakers)))
    return out.drop("_spk")


def emotion(spark, root: str, meta_file: str, ignored_speakers=None, **_) -> DataFrame:
    """Comma file with a ``file_path`` header line: no text, an emotion per row."""
    l = lines(spark, f"{root}/{meta_file}").where(~F.col("value").startswith("file_path"))
    f = split_fields(F.col("value"), ",")
    spk = F.element_at(f, 2)
    out = l.select(*sample(F.lit(None).cast("string"), _join(root, F.element_at(f, 1)), spk, root,
                           F.element_at(f, 3)))
    if ignored_speakers:
        out = out.where(~F.col("speaker_name").isin(list(ignored_speakers)))
    return out


def brspeech(spark, root: str, meta_file: str, ignored_speakers=None, **_) -> DataFrame:
    l = lines(spark, f"{root}/{meta_file}").where(~F.col("value").startswith("wav_filename"))
    f = split_fields(F.col("value"), "|")
    out = l.select(*sample(F.element_at(f, 3), _join(root, F.element_at(f, 1)), F.element_at(f, 4), root))
    if ignored_speakers:
        out = out.where(~F.col("speaker_name").isin(list(ignored_speakers)))
    return out


def sam_accenture(spark, root: str, meta_file: str, **_) -> DataFrame:
    """XML ``<fileid id="…">text</fileid>`` elements; missing recordings are skipped."""
    x = spark.read.format("xml").option("rowTag", "fileid").load(f"{root}/voice_over_recordings/{meta_file}")
    return present(x.select(*sample(F.col("_VALUE").cast("string"), _join(root, "vo_voice_quality_transformation",
                                                                          F.concat(F.col("_id"), F.lit(".wav"))),
                                    "sam_accenture", root)), root)


def crawl_text_files(spark, root: str, glob: str = "*.txt") -> DataFrame:
    """A5 base: one row per text file: path parts and the first line."""
    if _is_local_folder(root):
        files = _crawl(spark, root).select("path").where(F.element_at(F.split("path", "/"), -1).rlike("^" + fnmatch.translate(glob)))
        heads = files.repartition(_tasks(spark)).mapInArrow(_first_lines, "path string, line binary")
        return heads.select("path", F.col("line").cast("string").alias("first_line"))
    # (``text()`` has its own wholetext argument, which would override an option.)
    t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root, wholetext=True)
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:", "")
    return t.select(path.alias("path"), F.element_at(F.split("value", "\n", 2), 1).alias("first_line"))


def vctk(spark, root: str, meta_files=None, mic: str = "mic1", ignored_speakers=None, **_) -> DataFrame:
    """A5: txt/<speaker>/<file>.txt → wav48_silence_trimmed/<speaker>/<file>_<mic>.flac (p280 always mic1)."""
    c = crawl_text_files(spark, f"{root}/txt")
    spk = F.element_at(F.split("path", "/"), -2)
    fid = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.txt$", "")
    m = F.when(spk == "p280", F.lit("mic1")).otherwise(F.lit(mic))
    audio = _join(root, "wav48_silence_trimmed", spk, F.concat(fid, F.lit("_"), m, F.lit(".flac")))
    out = c.select(*sample(F.col("first_line"), audio, F.concat(F.lit("VCTK_"), spk), root), spk.alias("_spk"))
    if ignored_speakers:
        out = out.where(~F.col("_spk").isin(list(ignored_speakers)))
    return present(out.drop("_spk"), root)


def vctk_old(spark, root: str, meta_files=None, wavs_path: str = "wav48", ignored_speakers=None, **_) -> DataFrame:
    """A5: the older layout: txt/<speaker>/<file>.txt → wav48/<speaker>/<file>.wav."""
    c = crawl_text_files(spark, f"{root}/txt")
    spk = F.element_at(F.split("path", "/"), -2)
    fid = F.element_at(F.split(F.element_at(F.split("path", "/"), -1), r"\."), 1)
    out = c.select(*sample(F.col("first_line"), _join(root, wavs_path, spk, F.concat(fid, F.lit(".wav"))), spk, root))
    return _without_speakers(out, ignored_speakers).withColumn(
        "speaker_name", F.concat(F.lit("VCTK_old_"), F.col("speaker_name")))


def synpaflex(spark, root: str, metafiles=None, **_) -> DataFrame:
    """A5: every ``.wav`` whose transcript exists: below a ``wav`` folder the same
    path with ``wav`` read as ``txt``, else ``txt/<name>.txt`` beside it."""
    wavs = list_files(spark, root, (".wav",)).select(F.col("path").alias("_wav"))
    beside = F.concat(F.regexp_replace("_wav", "/[^/]*$", "/txt/"),
                      F.regexp_replace(F.element_at(F.split("_wav", "/"), -1), r"\.wav", ".txt"))
    wavs = wavs.withColumn("_txt", F.when(F.col("_wav").contains("/wav/"), F.regexp_replace("_wav", "wav", "txt")).otherwise(beside))
    c = crawl_text_files(spark, root)
    j = wavs.join(c, wavs["_txt"] == c.path)
    return j.select(*sample(F.col("first_line"), F.col("_wav"), "synpaflex", root))


def _voxceleb(idx: int, expected: int):
    def build(spark, root: str, meta_file: str | None = None, expected_min: int = expected, **_) -> DataFrame:
        """No transcripts; speaker from the folder above the recording's,
        which must start with ``id``; the crawl is kept and later runs read it."""
        def crawl():
            f = list_files(spark, root, (".wav",))
            spk = F.element_at(F.split("path", "/"), -3)
            ok = F.when(spk.startswith("id"), F.lit(True)).otherwise(
                F.raise_error(F.concat(F.lit("not a speaker folder: "), spk)))
            return f.where(ok).select(*sample(F.lit(None).cast("string"), F.col("path"),
                                              F.concat(F.lit(f"voxcel{idx}_"), spk), root))
        if meta_file is not None:
            f = split_fields(F.trim("value"), "|")
            text = F.when(F.element_at(f, 1) != "None", F.element_at(f, 1))
            return lines(spark, meta_file).select(*sample(text, F.element_at(f, 2), F.element_at(f, 3), root))
        return cached_crawl(spark, f"{root}/metafile_voxceleb{idx}", crawl, expected_min)
    build.__name__ = f"voxceleb{idx}"
    return build


# The least number of recordings of the two corpora.
voxceleb1, voxceleb2 = _voxceleb(1, 148_000), _voxceleb(2, 1_000_000)


def open_bible(spark, root: str, meta_files: str = "train", ignore_digits_sentences: bool = True,
               ignored_speakers=None, **_) -> DataFrame:
    """A5: <split>/<speaker>/<file>.txt; texts with a digit are dropped."""
    from vocable.operators.filters import has_digit
    c = crawl_text_files(spark, f"{root}/{meta_files}")
    spk = F.element_at(F.split("path", "/"), -2)
    fid = F.element_at(F.split(F.element_at(F.split("path", "/"), -1), r"\."), 1)
    text = F.replace(F.col("first_line"), F.lit("\n"), F.lit(""))
    out = c.select(*sample(text, _join(root, meta_files, spk, F.concat(fid, F.lit(".flac"))),
                           F.concat(F.lit("OB_"), spk), root), spk.alias("_spk"))
    if ignore_digits_sentences:
        out = out.where(~has_digit("text"))
    if ignored_speakers:
        out = out.where(~F.col("_spk").isin(list(ignored_speakers)))
    return out.drop("_spk")


# A2: registry, name (lower-cased) → builder.
FORMATTERS: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in [
    ljspeech, ljspeech_test, thorsten, kss, bel_tts_formatter, kokoro, css10, ruslan, tweb, mozilla,
    custom_turkish, baker, coqui, cml_tts, common_voice, mls, emotion, brspeech, sam_accenture, vctk, open_bible,
    mozilla_de, nancy, mailabs, libri_tts, ljspeech_records, vctk_old, synpaflex, voxceleb1, voxceleb2]}


def load_dataset(spark, formatter: str | Callable, root: str, meta_file: str | None = None, **kw) -> DataFrame:
    """Dispatch on the formatter name, or use a caller's builder."""
    fn = formatter if callable(formatter) else FORMATTERS.get(formatter.lower())
    if fn is None:
        raise ValueError(f"unknown formatter {formatter!r}")
    return fn(spark, root, meta_file, **kw)


def load_datasets(spark, datasets: list[dict], formatter: Callable | None = None) -> DataFrame:
    """A2/F3 scan: several datasets (``formatter, path, meta_file, language, name``,
    optional ``ignored_speakers``) as one table.  A caller's ``formatter`` applies to
    the first dataset only; the others go by their own name."""
    parts = []
    for i, d in enumerate(datasets):
        fn = formatter if formatter is not None and i == 0 else d["formatter"]
        rows = load_dataset(spark, fn, d["path"], d.get("meta_file"), ignored_speakers=d.get("ignored_speakers"))
        parts.append(rows.withColumn("language", F.lit(d.get("language", ""))).withColumn("dataset", F.lit(d["name"])))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def parquet_corpus(spark, path: str, max_samples: int = 0, drop: tuple = (), order: str | None = None) -> DataFrame:
    """Parquet scan; with ``max_samples`` the first rows in ``order`` (a head
    without an order would differ from run to run); ``drop`` columns are never read."""
    df = spark.read.parquet(path)
    if max_samples > 0:
        if order is None:
            raise ValueError("a head needs an order")
        df = df.orderBy(order).limit(max_samples)
    return df.drop(*drop)


def attention_masks(spark, path: str) -> DataFrame:
    """A10: ``audio_file|mask_file`` lines."""
    f = split_fields(F.col("value"), "|")
    return lines(spark, path).select(F.element_at(f, 1).alias("audio_file"), F.trim(F.element_at(f, 2)).alias("mask_file"))


# ---------------------------------------------------------------- A4, A11-A16
def malformed_lines(spark, path: str, sep: str = "|") -> DataFrame:
    """A4: lines whose field count differs from their file's header line
    (reported, not dropped).  The header of each file is its first line."""
    l = (spark.read.text(path).withColumn("file", F.col("_metadata.file_path"))
         .withColumn("_o", F.monotonically_increasing_id())
         .withColumn("_n", F.size(split_fields(F.col("value"), sep))))
    heads = l.groupBy("file").agg(F.min_by("_n", "_o").alias("_hn"), F.min("_o").alias("_ho"))
    x = l.join(heads, "file")
    return x.where((F.col("_o") != F.col("_ho")) & (F.col("_n") != F.col("_hn"))).select("file", "value")


def write_header_metadata(df: DataFrame, path: str, cols: list[str], sep: str = "|") -> None:
    """Delimited files with a header line in every part file; ``sep`` and
    newlines inside fields become ``/`` and a space (no quoting, as read)."""
    clean = [F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), re.escape(sep), "/"), "[\r\n]", " ").alias(c)
             for c in cols]
    (df.select(*clean).write.mode("overwrite").option("header", True).option("sep", sep).option("quote", "")
     .option("escape", "").csv(path))


def write_pipe_metadata(df: DataFrame, path: str, cols: list[str], partition_by: list[str] | None = None) -> None:
    """Pipe-separated metadata; ``|`` and newlines inside fields cannot be
    carried by the format and become ``/`` and a space."""
    clean = [F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), "\\|", "/"), "[\r\n]", " ") for c in cols]
    out = df.select(F.concat_ws("|", *clean).alias("value"), *(partition_by or []))
    w = out.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.text(path)


def _is_local_folder(root: str) -> bool:
    """Whether ``root`` is a mounted folder, no pattern and on no other store; Spark's readers list the others."""
    return not re.search(r"[*?\[{]", root) and not re.match("[a-z0-9]+:", plain(root)) and os.path.isdir(plain(root))


def _tasks(spark) -> int:
    return 4 * spark.sparkContext.defaultParallelism


def _entries(batches):
    """What lies in each folder, in pieces; hidden names are left out, as Spark's readers do."""
    import pyarrow as pa

    names = ["path", "folder", "length", "modified"]
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            rows = []
            with os.scandir(folder) as found:
                for entry in found:
                    if entry.name.startswith(".") or entry.name.endswith("._COPYING_") or entry.name.startswith("_") and "=" not in entry.name:
                        continue
                    try:
                        s = entry.stat()
                    except FileNotFoundError:
                        continue
                    rows.append((f"{folder.rstrip('/')}/{entry.name}", stat.S_ISDIR(s.st_mode), s.st_size, s.st_mtime_ns // 1_000_000))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)


def _crawl(spark, root: str) -> DataFrame:
    """``(path, length, modificationTime)`` of the files below a folder that are not empty.  Folders are listed by the
    tasks, a job for each level, so the driver holds no file's name."""
    folders, files = spark.createDataFrame([(os.path.abspath(plain(root)),)], "path string"), None
    while True:
        found = written(folders.repartition(_tasks(spark), "path").mapInArrow(
            _entries, "path string, folder boolean, length long, modified long"), "listing")
        part = found.where("NOT folder AND length > 0").select("path", "length", F.timestamp_millis("modified").alias("modificationTime"))
        files = part if files is None else files.unionByName(part)
        folders = found.where("folder").select("path")
        if folders.isEmpty():
            return files


def _first_lines(batches):
    import pyarrow as pa

    for batch in batches:
        heads = []
        for path in batch.column(0).to_pylist():
            with open(path, "rb") as f:
                heads.append(f.readline().removesuffix(b"\n"))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(heads, pa.binary())], names=["path", "line"])


def list_files(spark, root: str, extensions=(".wav", ".mp3", ".flac"), contains: str | None = None) -> DataFrame:
    """Recursive listing; only path, length and modification time are
    selected, so file contents are never read."""
    if _is_local_folder(root):
        out = _crawl(spark, root)
    else:
        b = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        out = b.select(F.regexp_replace("path", "^file:", "").alias("path"), "length", "modificationTime")
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    out = out.where(ext.isin([e.lower() for e in extensions]))
    if contains:
        out = out.where(F.col("path").contains(contains))
    return out


def checksums(spark, root: str, algo: str = "md5") -> DataFrame:
    """Digest of every file's bytes."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    d = F.md5("content") if algo == "md5" else F.sha2("content", 256)
    return b.select(F.regexp_replace("path", "^file:", "").alias("path"), d.alias("digest"))


def check_manifest(spark, root: str, manifest: DataFrame, algo: str = "md5") -> DataFrame:
    """Manifest rows ``(path, expected)`` with ``ok``."""
    return manifest.join(checksums(spark, root, algo), "path", "left").withColumn(
        "ok", F.coalesce(F.col("digest") == F.col("expected"), F.lit(False)))


def label_crawl(spark, root: str, extensions=(".wav",)) -> DataFrame:
    """Path → speaker (second-to-last folder), numeric id by first
    appearance in path order, file length."""
    from vocable.operators.batching import first_seen_ids
    f = list_files(spark, root, extensions)
    f = f.withColumn("speaker_name", F.element_at(F.split("path", "/"), -2))
    return first_seen_ids(f, "speaker_name", "path", "speaker_id")


def cached_crawl(spark, cache_path: str, build: Callable[[], DataFrame], expected_min: int | None = None) -> DataFrame:
    """Build the metadata once (written as Parquet), later runs read it;
    fewer rows than expected fails."""
    if not path_exists(spark, f"{cache_path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(cache_path)
    df = spark.read.parquet(cache_path)
    if expected_min is not None:
        n = df.count()
        if n < expected_min:
            raise RuntimeError(f"cached metadata has {n} rows, expected at least {expected_min}")
    return df


def voice_folders(spark, root: str) -> DataFrame:
    """Sub-folder name → its voice files (one row per folder; a folder's
    file list is the output itself)."""
    f = list_files(spark, root, (".wav", ".mp3", ".pth"))
    v = f.withColumn("voice", F.element_at(F.split("path", "/"), -2))
    return v.groupBy("voice").agg(F.array_sort(F.collect_list("path")).alias("files"))


def load_embedding_map(spark, path: str) -> DataFrame:
    """``{clip: {name, embedding}}`` JSON → ``(clip, name, embedding)``."""
    if not path.endswith(".json"):
        raise ValueError(f"unsupported embedding file {path!r}")
    return read_embedding_map(spark, path)


def write_id_map(ids: DataFrame, path: str, name: str = "name", id_col: str = "id") -> None:
    """An id map as JSON records, one ``{name, id}`` a line."""
    ids.select(F.col(name).alias("name"), F.col(id_col).alias("id")).write.mode("overwrite").json(path)


def read_id_map(spark, path: str) -> DataFrame:
    return spark.read.schema("name string, id long").json(path)


def save_embedding_records(df: DataFrame, path: str) -> None:
    df.select("clip", "name", "embedding").write.mode("overwrite").json(path)


def load_embedding_maps(spark, paths: list[str]) -> DataFrame:
    """Union of several maps; a clip repeated across files fails; name ids
    are re-densified by (file order, name)."""
    parts = [load_embedding_map(spark, p).withColumn("file_no", F.lit(i)) for i, p in enumerate(paths)]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    dup = u.groupBy("clip").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    u = u.join(dup, "clip", "left").where(F.when(F.col("_n").isNull(), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("clip key in several files: "), F.col("clip"))))).drop("_n")
    names = u.groupBy("name").agg(F.min("file_no").alias("_f"))
    ids = with_position(names, ["_f", "name"], "name_id").drop("_f")
    return u.join(ids, "name")


# ---------------------------------------------------------------- folder layouts, single files, one-object maps
def plain(path: str) -> str:
    """A local path without its scheme; other locations as they are."""
    return re.sub("^file:/+", "/", path)


def _file_writer(root: str):
    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root) if re.match(r"[a-z0-9]+://", root) else (fs.LocalFileSystem(), plain(root))
        made = None
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folder = f"{base}/{name}".rpartition("/")[0]
                if folder != made:
                    store.create_dir(folder, recursive=True)
                    made = folder
                with store.open_output_stream(f"{base}/{name}", compression=None) as f:
                    f.write(content or b"")
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["name"])
    return run


def write_files(df: DataFrame, root: str, name: str = "name", content: str = "content") -> int:
    """One file per row, for corpus layouts that keep a text or recording per file: ``name`` below ``root``, written by
    the tasks; an attempt that runs again writes the same file.  Returns the number of files."""
    rows = df.select(F.col(name).alias("name"), F.col(content).cast("binary").alias("content"))
    return rows.mapInArrow(_file_writer(root), "name string").count()


def _line_places(batches):
    """Lines of a sorted partition with the number of bytes before them, line ends included."""
    import pyarrow as pa

    at = 0
    for batch in batches:
        places = []
        for line in batch.column(1).to_pylist():
            places.append(at)
            at += len(line) + 1
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.int64()), batch.column(1)], names=["_p", "_at", "_line"])


def _line_writer(path: str):
    """Writes each line at its place in the file; a task that runs again writes the same bytes."""
    def run(batches):
        import pyarrow as pa

        with open(path, "r+b") as f:
            for batch in batches:
                end = None
                for at, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if at != end:
                        f.seek(at)
                    f.write(line + b"\n")
                    end = at + len(line) + 1
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])
    return run


def write_single_file(df: DataFrame, path: str, cols: list[str], order: list[str], sep: str = "|") -> dict:
    """One delimited file of exactly this name, rows in ``order``, with a header.

    Sorted by ranges on the cluster and written under a temporary name that is moved once: on a mounted folder by
    all tasks, each at the place of its lines, on other stores by one last task.  A manifest
    beside it (``<path>.manifest``) has the rows and an order-free checksum of them.  A failed attempt leaves
    neither file nor manifest."""
    spark = df.sparkSession
    clean = [F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), re.escape(sep), "/"), "[\r\n]", " ").alias(c) for c in cols]
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).select(*clean).withColumn(
        "_p", F.spark_partition_id()).withColumn("_o", F.monotonically_increasing_id())
    line = F.concat_ws(sep, *[F.coalesce(F.col(c), F.lit("")) for c in cols]).cast("binary")
    temp = f"{path}.tmp-{uuid.uuid4().hex}"
    mounted = not re.match("[a-z0-9]+:", plain(path))
    if mounted:
        ranged = written(ranged.select("_p", line.alias("_line")).mapInArrow(_line_places, "_p int, _at long, _line binary"), "single-file")
        line = F.col("_line")
    else:
        ranged = written(ranged, "single-file")
    rows, checksum = ranged.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.crc32(line)), F.lit(0))).first()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if mounted:
        store.mkdirs(target.getParent())
        head = (sep.join(cols) + "\n").encode()
        with open(plain(temp), "wb") as f:
            f.write(head)
        # one row per partition: where its lines begin
        ends = ranged.groupBy("_p").agg(F.sum(F.length("_line") + 1).alias("_n"))
        before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        starts = ends.select("_p", (F.coalesce(F.sum("_n").over(before), F.lit(0)) + len(head)).alias("_start"))
        placed = ranged.join(F.broadcast(starts), "_p").select((F.col("_start") + F.col("_at")).alias("_at"), "_line")
        done = placed.mapInArrow(_line_writer(plain(temp)), "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if done != rows:
            raise RuntimeError(f"{done} of {rows} lines were written to {temp}")
        made = hadoop.Path(temp)
    else:
        (ranged.orderBy("_o").select(*cols).coalesce(1).write.option("header", True).option("sep", sep).option("quote", "")
         .option("escape", "").option("emptyValue", "").csv(temp))
        parts = store.globStatus(hadoop.Path(f"{temp}/part-*"))
        if len(parts) != 1:
            raise RuntimeError(f"{len(parts)} files below {temp}")
        made = parts[0].getPath()
    store.delete(target, False)
    if not store.rename(made, target):
        raise RuntimeError(f"{path} could not be moved into place")
    store.delete(hadoop.Path(temp), True)
    manifest = {"rows": rows, "checksum": checksum}
    spark.createDataFrame([(path, rows, checksum)], "path string, rows long, checksum long").coalesce(1).write.mode("overwrite").json(f"{path}.manifest")
    return manifest


def read_single_file(spark, path: str, sep: str = "|") -> DataFrame:
    """The rows of a file written by :func:`write_single_file`; raises if its manifest does not hold."""
    m = spark.read.schema("path string, rows long, checksum long").json(f"{path}.manifest").first()
    df = spark.read.option("header", True).option("sep", sep).option("quote", "").option("escape", "").csv(path)
    line = F.concat_ws(sep, *[F.coalesce(F.col(c), F.lit("")) for c in df.columns])
    rows, checksum = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.crc32(line.cast("binary"))), F.lit(0))).first()
    if (rows, checksum) != (m.rows, m.checksum):
        raise RuntimeError(f"{path} does not match its manifest")
    return df


def write_train_eval(df: DataFrame, folder: str, cols: list[str], order: list[str], is_eval: Column, rejected: Column) -> dict[str, dict]:
    """``train.csv``, ``eval.csv`` and ``rejected.csv`` of one table; returns their manifests by name."""
    bad = F.coalesce(rejected, F.lit(False))
    parts = {"train.csv": ~bad & ~is_eval, "eval.csv": ~bad & is_eval, "rejected.csv": bad}
    return {name: write_single_file(df.where(cond), f"{folder}/{name}", cols, order) for name, cond in parts.items()}


MAP_ENTRY = "struct<name: string, embedding: array<float>>"


def save_embedding_map(df: DataFrame, path: str) -> None:
    """``(clip, name, embedding)`` as one JSON object per part file, entry after entry on one line each."""
    body = F.concat(F.to_json(F.struct(F.col("clip").alias("k"))), F.lit("\t"), F.to_json(F.struct("name", "embedding")))
    key, value = F.split(body, "\t", 2)[0], F.split(body, "\t", 2)[1]
    entry = F.concat(F.regexp_extract(key, r"^\{\"k\":(.*)\}$", 1), F.lit(": "), value)
    tagged = df.select(entry.alias("e"), F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("o"))
    tagged = written(tagged, "embedding-map")
    ends = tagged.groupBy("p").agg(F.min("o").alias("_a"), F.max("o").alias("_b"))          # one row per partition
    lines_ = tagged.join(F.broadcast(ends), "p").select("p", "o", F.concat(
        F.when(F.col("o") == F.col("_a"), F.lit("{")).otherwise(F.lit("")), "e",
        F.when(F.col("o") == F.col("_b"), F.lit("}")).otherwise(F.lit(","))).alias("value"))
    lines_.repartition(F.col("p")).sortWithinPartitions("p", "o").select("value", "p").write.partitionBy("p").text(path)


def read_embedding_map(spark, path: str) -> DataFrame:
    """``(clip, name, embedding)`` of one or more JSON objects of any size and layout.

    Files are cut at every closing brace, which Spark's text source can split among tasks.  A brace inside a
    string ends a piece too early: quotes counted up to each piece tell, and such pieces are joined again in
    file order.  No task reads a whole object."""
    t = spark.read.option("lineSep", "}").text(path).withColumn("_f", F.col("_metadata.file_path")).withColumn("_o", F.monotonically_increasing_id())
    bare = F.regexp_replace("value", r"\\.", "")
    t = t.withColumn("_q", F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit(""))))
    r = keyed_running(t, ["_f"], ["_o"], [("_q", "sum", "_quotes")])
    r = r.withColumn("_whole", F.when(F.pmod(F.col("_quotes").cast("long"), F.lit(2)) == 0, 1).otherwise(0))
    r = keyed_running(r, ["_f"], ["_o"], [("_whole", "sum", "_done")])
    entry = r.withColumn("_k", (F.col("_done") - F.col("_whole")).cast("long")).groupBy("_f", "_k").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "value"))), lambda s: s["value"]), "}").alias("e"))
    e = F.regexp_replace("e", r"^[\s{,]+", "")
    whole = entry.select(e.alias("e"))
    m = F.from_json(F.concat(F.lit("{"), F.col("e"), F.lit("}}")), f"map<string, {MAP_ENTRY}>")
    # what stands behind the last entry is empty; no filter, as it could be put behind the check below
    ok = whole.select(F.when(F.col("e") == "", F.create_map().cast(f"map<string, {MAP_ENTRY}>")).when(F.size(m) == 1, m).otherwise(F.raise_error(F.concat(F.lit("not an entry of a map: "), F.substring("e", 1, 80)))).alias("m"))
    return ok.select(F.explode("m").alias("clip", "v")).select("clip", "v.name", "v.embedding")
