"""Per-section tests: fixture files for sources, golden/NumPy re-computations
for the rows-only (P) operators, properties, and stream = batch."""

import hashlib
import json
import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from conftest import SF001, SF01


def _tmp():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def _touch(*paths):
    for p in paths:
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "wb") as f:
            f.write(b"RIFF")


def _put(path, text, encoding="utf-8"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding=encoding) as f:
        f.write(text)


# ---------------------------------------------------------------- A
def test_paths_and_trimming_of_plain_formatters(spark):
    from vocable.sources import metadata as A

    root = _tmp()
    _put(f"{root}/m.tsv", "WEB1\tIn the beginning.\n")
    assert A.load_dataset(spark, "tweb", root, "m.tsv").first().audio_file == f"{root}/WEB1.wav"
    _put(f"{root}/m.txt", " a text |x.wav \n")
    r = A.load_dataset(spark, "mozilla", root, "m.txt").first()
    assert (r.text, r.audio_file) == ("a text", f"{root}/wavs/x.wav")
    _touch(f"{root}/wavs/t1.wav")
    _put(f"{root}/tr.txt", "t1 | merhaba \nt2|yok\n")
    assert [(r.text, r.audio_file) for r in A.load_dataset(spark, "custom_turkish", root, "tr.txt").collect()] == [
        ("merhaba", f"{root}/wavs/t1.wav")]
    _put(f"{root}/a/b/transcripts.txt", "12_34_5\thello\n")
    r = A.load_dataset(spark, "mls", root, "a/b/transcripts.txt").first()
    assert r.audio_file == f"{root}/a/b/audio/12/34/12_34_5.wav" and r.speaker_name == "MLS_12"
    _put(f"{root}/de.txt", "7_9.wav| Grüße \n", "ISO-8859-1")
    r = A.load_dataset(spark, "mozilla_de", root, "de.txt").first()
    assert (r.text, r.audio_file) == ("Grüße", f"{root}/BATCH_7_FINAL/7_9.wav")
    _put(f"{root}/n.txt", '( utt01 "He said so. " )\n')
    r = A.load_dataset(spark, "nancy", root, "n.txt").first()
    assert (r.text, r.audio_file) == ("He said so.", f"{root}/wavn/utt01.wav")


def test_crawling_formatters(spark):
    import pytest

    from vocable.sources import metadata as A

    root = _tmp()
    book = f"{root}/m/by_book/female/ann/b1"
    _put(f"{book}/metadata.csv", "a1|Raw| \na2|gone\n")
    _touch(f"{book}/wavs/a1.wav")
    _put(f"{root}/m/other/metadata.csv", "z|no speaker\n")
    got = A.load_dataset(spark, "mailabs", f"{root}/m").collect()
    assert [(r.text, r.speaker_name, r.audio_file) for r in got] == [("Raw", "ann", f"{book}/wavs/a1.wav")]
    _put(f"{root}/l/10/20/10_20.trans.tsv", "10_20_1\tx\tHello there\n")
    with pytest.raises(Exception, match="does not exist"):
        A.load_dataset(spark, "libri_tts", f"{root}/l").collect()
    _touch(f"{root}/l/10/20/10_20_1.wav")
    got = A.load_dataset(spark, "libri_tts", f"{root}/l").collect()
    assert [(r.text, r.speaker_name) for r in got] == [("Hello there", "LTTS_10")]
    _put(f"{root}/lj/metadata.csv", "n1|first|f\nn1|second|s\nbad|line\nn2|no file|x\n")
    _touch(f"{root}/lj/wavs/n1.wav")
    got = A.load_dataset(spark, "ljspeech_records", f"{root}/lj", "metadata.csv").collect()
    assert [(r.text, r.language) for r in got] == [("second", "en")]
    _put(f"{root}/v/txt/p1/p1_1.txt", "One line\nmore")
    r = A.load_dataset(spark, "vctk_old", f"{root}/v").first()
    assert (r.text, r.speaker_name, r.audio_file) == ("One line", "VCTK_old_p1", f"{root}/v/wav48/p1/p1_1.wav")
    _touch(f"{root}/s/x/wav/q.wav", f"{root}/s/y/r.wav", f"{root}/s/y/none.wav")
    _put(f"{root}/s/x/txt/q.txt", "Bonjour\n")
    _put(f"{root}/s/y/txt/r.txt", "Salut\n")
    assert sorted(r.text for r in A.load_dataset(spark, "synpaflex", f"{root}/s").collect()) == ["Bonjour", "Salut"]
    _touch(f"{root}/vox/id01/v/1.wav", f"{root}/vox/id02/v/2.wav")
    with pytest.raises(RuntimeError, match="expected at least"):
        A.load_dataset(spark, "voxceleb1", f"{root}/vox")
    got = A.load_dataset(spark, "voxceleb1", f"{root}/vox", expected_min=2).collect()
    assert sorted(r.speaker_name for r in got) == ["voxcel1_id01", "voxcel1_id02"]


def test_datasets_heads_and_masks(spark):
    import pytest

    from vocable.sources import metadata as A

    root = _tmp()
    _put(f"{root}/a/m.csv", "x1|r|one\n")
    _put(f"{root}/b/m.csv", "y1|r|two\n")
    sets = [{"formatter": "ljspeech", "path": f"{root}/{k}", "meta_file": "m.csv", "language": "en", "name": k} for k in "ab"]

    def own(spark, root, meta_file, **_):
        return A.ljspeech(spark, root, meta_file).withColumn("text", F.lit("own"))

    got = {r.dataset: r.text for r in A.load_datasets(spark, sets, own).collect()}
    assert got == {"a": "own", "b": "two"}
    docs = f"{SF001}/documents.parquet"
    head = A.parquet_corpus(spark, docs, 7, drop=("source", "lang"), order="doc_id").collect()
    assert [r.doc_id for r in head] == sorted(r.doc_id for r in spark.read.parquet(docs).collect())[:7]
    assert "source" not in head[0].asDict()
    with pytest.raises(ValueError):
        A.parquet_corpus(spark, docs, 7)
    _put(f"{root}/attn.txt", "a.wav|a.npy \n")
    assert A.attention_masks(spark, f"{root}/attn.txt").collect() == [("a.wav", "a.npy")]


def test_formatters_on_fixture_files(spark):
    from vocable.sources import metadata as A

    root = _tmp()
    with open(f"{root}/metadata.csv", "w") as f:
        f.write("LJ001|Raw one.|norm one\nLJ002|Raw two|norm two\nLJ003|x|norm three\n")
    lj = A.load_dataset(spark, "LJSpeech", root, "metadata.csv").orderBy("audio_file").collect()
    assert [r.text for r in lj] == ["norm one", "norm two", "norm three"]
    assert lj[0].audio_file == f"{root}/wavs/LJ001.wav" and lj[0].speaker_name == "ljspeech"
    t = A.ljspeech_test(spark, root, "metadata.csv").orderBy("line_no").collect()
    assert [r.speaker_name for r in t] == ["ljspeech-1", "ljspeech-1", "ljspeech-2"]

    _touch(f"{root}/wavs/a.wav", f"{root}/wavs/b.wav")
    with open(f"{root}/coqui.csv", "w") as f:
        f.write("audio_file|text|speaker_name\nwavs/a.wav|hello|spk1\nwavs/b.wav|bye|spk2\nwavs/gone.wav|x|spk1\n")
    c = A.coqui(spark, root, "coqui.csv", ignored_speakers=["spk2"]).collect()
    assert len(c) == 1 and c[0].emotion_name == "neutral" and c[0].speaker_name == "spk1"

    with open(f"{root}/baker.csv", "w") as f:
        f.write("000001|text one\n000002|text two\n")
    assert A.baker(spark, root, "baker.csv").count() == 2


def test_xml_and_crawl_sources(spark):
    from vocable.sources import metadata as A

    root = _tmp()
    os.makedirs(f"{root}/voice_over_recordings")
    with open(f"{root}/voice_over_recordings/meta.xml", "w") as f:
        f.write('<root><fileid id="f1">Hello there</fileid><fileid id="f2">Second</fileid><fileid id="f3">Gone</fileid></root>')
    _touch(*[f"{root}/vo_voice_quality_transformation/{x}.wav" for x in ("f1", "f2")],
           f"{root}/vctk/wav48_silence_trimmed/p225/p225_001_mic2.flac", f"{root}/vctk/wav48_silence_trimmed/p280/p280_002_mic1.flac")
    x = A.sam_accenture(spark, root, "meta.xml").orderBy("audio_file").collect()
    assert [r.text for r in x] == ["Hello there", "Second"]
    for spk, fid, text in [("p225", "p225_001", "Please call.\nsecond"), ("p280", "p280_002", "Ask her 2 times.")]:
        os.makedirs(f"{root}/vctk/txt/{spk}", exist_ok=True)
        with open(f"{root}/vctk/txt/{spk}/{fid}.txt", "w") as f:
            f.write(text)
    v = {r.speaker_name: r for r in A.vctk(spark, f"{root}/vctk", mic="mic2").collect()}
    assert v["VCTK_p225"].text == "Please call."
    assert v["VCTK_p225"].audio_file.endswith("p225/p225_001_mic2.flac")
    assert v["VCTK_p280"].audio_file.endswith("p280_002_mic1.flac")
    os.makedirs(f"{root}/ob/train/s1", exist_ok=True)
    for fid, text in [("a", "no digits here"), ("b", "has 3 digits")]:
        with open(f"{root}/ob/train/s1/{fid}.txt", "w") as f:
            f.write(text + "\n")
    ob = A.open_bible(spark, f"{root}/ob").collect()
    assert [r.text for r in ob] == ["no digits here"] and ob[0].speaker_name == "OB_s1"


def test_listing_checksum_label_crawl(spark):
    from vocable.sources import metadata as A

    root = _tmp()
    for spk, name, data in [("id1", "a.wav", b"abc"), ("id1", "b.WAV", b"defg"), ("id2", "c.wav", b"x"),
                            ("id2", "notes.txt", b"skip")]:
        os.makedirs(f"{root}/{spk}", exist_ok=True)
        with open(f"{root}/{spk}/{name}", "wb") as f:
            f.write(data)
    files = A.list_files(spark, root).collect()
    assert sorted(os.path.basename(r.path) for r in files) == ["a.wav", "b.WAV", "c.wav"]
    man = spark.createDataFrame([(f"{root}/id1/a.wav", hashlib.md5(b"abc").hexdigest()),
                                 (f"{root}/id2/c.wav", "bad")], "path string, expected string")
    ok = {os.path.basename(r.path): r.ok for r in A.check_manifest(spark, root, man).collect()}
    assert ok == {"a.wav": True, "c.wav": False}
    lab = {os.path.basename(r.path): r.speaker_id for r in A.label_crawl(spark, root, (".wav",)).collect()}
    assert lab == {"a.wav": 0, "b.WAV": 0, "c.wav": 1}


def test_embedding_maps(spark):
    from vocable.sources import metadata as A

    root = _tmp()
    json.dump({"c1": {"name": "b", "embedding": [1.0, 2.0]}, "c2": {"name": "a", "embedding": [0.5, 0.5]}},
              open(f"{root}/e1.json", "w"))
    json.dump({"c3": {"name": "z", "embedding": [3.0, 1.0]}}, open(f"{root}/e2.json", "w"))
    m = {r.clip: r.name_id for r in A.load_embedding_maps(spark, [f"{root}/e1.json", f"{root}/e2.json"]).collect()}
    assert m == {"c2": 0, "c1": 1, "c3": 2}


# ---------------------------------------------------------------- F, G properties
def test_split_is_partition_and_speakers_keep_train(spark):
    from vocable.operators.split import split_many_speakers
    from vocable.sources.tables import samples

    s = samples(spark, SF01).select("doc_id", "speaker_name")
    out = split_many_speakers(s, "doc_id", "speaker_name", 0.9).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in s.collect())
    train_spk = {r.speaker_name for r in out if r.split == "train"}
    assert train_spk == {r.speaker_name for r in s.collect()}


def test_results_do_not_depend_on_partitioning(spark):
    from vocable.operators.split import split_one_speaker

    s = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id")
    a = {r.doc_id: r.split for r in split_one_speaker(s.repartition(3), "doc_id", 0.2).collect()}
    b = {r.doc_id: r.split for r in split_one_speaker(s.repartition(17), "doc_id", 0.2).collect()}
    assert a == b and sum(v == "eval" for v in a.values()) == 200


def test_class_balanced_batches_equal_counts(spark):
    from vocable.operators.batching import class_balanced_batches

    d = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang")
    b = class_balanced_batches(d, "doc_id", "lang", 8)
    per = b.groupBy("batch_id", "lang").count().collect()
    assert {r["count"] for r in per} == {2}


# ---------------------------------------------------------------- J, L (P checks)
def test_sentence_packing_properties(spark):
    """No chunk over the limit, no word lost or moved, no two neighbours that would still fit."""
    from vocable.operators.hooks import sentence_chunks

    limit = 120
    d = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(
        [(-1, "  Two  spaces.  Stay. "), (-2, "x" * 300 + " tail. End."), (-3, "A. " * 60)], "doc_id long, text string"))
    got = {}
    for r in sentence_chunks(d, "text", limit, ["doc_id"]).collect():
        got.setdefault(r.doc_id, []).append((r.k, r.chunk))
    for r in d.collect():
        chunks = [c for _, c in sorted(got[r.doc_id])]
        assert "".join("".join(chunks).split()) == "".join(r.text.split())
        if len(r.text) < limit:
            assert chunks == [r.text.lstrip()]
            continue
        assert all(len(c) <= limit + 1 for c in chunks)      # the joining space is not counted
        whole = [c for c in chunks if c.endswith((".", "!", "?"))]
        for one, two in zip(chunks, chunks[1:]):
            if one in whole and two in whole and len(one) + len(two) <= limit:
                # only a wrapped sentence may be followed by what would have fitted
                assert not one.startswith(two)


def test_deemphasis_inverts_preemphasis(spark):
    from vocable.operators.signal import deemphasis, preemphasis

    e = spark.read.parquet(f"{SF001}/embeddings.parquet").select(
        "vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    for r in e.select("x", deemphasis(preemphasis("x")).alias("y")).limit(50).collect():
        assert np.allclose(r.x, r.y, atol=1e-9)


def test_overlap_add_values(spark):
    """Every fold faded in and out over the overlap, then summed."""
    from vocable.operators.signal import fold_with_overlap, overlap_add

    x = [float(i % 13) for i in range(100)]
    df = spark.createDataFrame([(1, x)], "clip long, x array<double>")
    folds = df.select("clip", F.posexplode(fold_with_overlap("x", 16, 6)).alias("fi", "fold"))
    rows = folds.collect()
    y = {r.pos: r.y for r in overlap_add(folds, "clip", "fi", "fold", 16, 6).collect()}
    want = np.zeros(max(y) + 1)
    t = np.linspace(-1, 1, 3)              # half of the overlap is silent, half is faded
    for r in rows:
        f = np.array(r.fold, float)
        f[:6] *= np.r_[0, 0, 0, np.sqrt(0.5 * (1 + t))]
        f[-6:] *= np.r_[np.sqrt(0.5 * (1 - t)), 0, 0, 0]
        want[r.fi * 22:r.fi * 22 + len(f)] += f
    assert len(rows) > 2 and np.allclose([y[i] for i in range(len(want))], want, atol=1e-9)


# ---------------------------------------------------------------- U hooks
def test_hooks(spark):
    from vocable.operators.hooks import phonemize_by_language, phonemizer_udf, sentence_chunks, vectorise

    d = spark.createDataFrame([(1, "ab. cd!", "en"), (2, "xy", "fr")], "id long, t string, lang string")
    upper = phonemizer_udf(lambda: (lambda s: s.upper()))
    r = {x.id: x.phonemes for x in phonemize_by_language(d, "t", "lang", {"en": upper, "fr": F.reverse}).collect()}
    assert r == {1: "AB. CD!", 2: "yx"}
    v = vectorise(d.select("id", F.array(F.lit(1.0), F.col("id").cast("double")).alias("x")), "id", "x",
                  lambda a: np.stack([np.asarray(x) * 2 for x in a]), 2).collect()
    assert sorted((x.id, list(x.embedding)) for x in v) == [(1, [2.0, 2.0]), (2, [2.0, 4.0])]
    t = spark.createDataFrame([("ab. cd! efghij.",)], "t string")
    assert [(r.k, r.chunk) for r in sentence_chunks(t, "t", 5).collect()] == [(0, "ab."), (1, "cd!"), (2, "efghi"), (3, "j.")]


# ---------------------------------------------------------------- N (stream = batch)
def _event_files(spark, n_files, hot=False):
    """``events`` in ``n_files`` files in time order, written one after the other;
    with ``hot``, one key with 25,000 rows in a single file."""
    from vocable.streaming import stateful as N

    e = spark.read.schema(N.EVENTS_SCHEMA).parquet(f"{SF001}/events.parquet")
    if hot:
        e = spark.range(25_000, numPartitions=1).select(
            F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, 24999 - id)")
            .alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("x").alias("event_type"),
            (F.pmod(F.col("id") * 7919, F.lit(1009)) / 7.0).alias("value"), F.lit("").alias("props"))
    pdf = e.select("event_id", F.col("ts").cast("string").alias("ts"), "user_id", "event_type", "value", "props").toPandas()
    pdf = pdf.sort_values(["ts", "event_id"]) if not hot else pdf
    root = _tmp()
    bounds = np.linspace(0, len(pdf), n_files + 1).astype(int)
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        part = spark.createDataFrame(pdf.iloc[a:b]).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        part.coalesce(1).write.parquet(f"{root}/tmp{i}")
        src = [f for f in os.listdir(f"{root}/tmp{i}") if f.startswith("part-")][0]
        os.rename(f"{root}/tmp{i}/{src}", f"{root}/events-{i:03d}.parquet")
        os.utime(f"{root}/events-{i:03d}.parquet", (1_700_000_000 + i * 10,) * 2)
    return root, pdf.sort_values(["ts", "event_id"])


def _by_user(pdf):
    return {int(k): g for k, g in pdf.groupby("user_id")}


def _check_streams(spark, root, pdf):
    from vocable.streaming import stateful as N

    users = _by_user(pdf)
    out = N.run_to_parquet(N.chunk_every_n(N.event_stream(spark, root), 8), "t-n1")
    rows = N.latest_chunks(spark.read.schema(N.CHUNK_OUT).parquet(out)).collect()
    chunks = {(r.user_id, r.chunk_idx): list(r.chunk) for r in rows}
    want = {(u, i // 8): g.value.tolist()[i:i + 8] for u, g in users.items() for i in range(0, len(g), 8)}
    assert len(rows) == len(want) and chunks == want
    out = N.run_to_parquet(N.running_stats(N.event_stream(spark, root)), "t-n3")
    got = {r.event_id: (r.running_mean, r.ema) for r in spark.read.parquet(out).collect()}
    for g in users.values():
        x, ema = g.value.to_numpy(), None
        mean = np.cumsum(x) / np.arange(1, len(x) + 1)
        for i, (ev, v) in enumerate(zip(g.event_id, x)):
            ema = v if ema is None else ema * 0.99 + v * 0.01
            assert abs(got[ev][0] - mean[i]) < 1e-6 and abs(got[ev][1] - ema) < 1e-6
    out = N.run_to_parquet(N.log_every_k(N.event_stream(spark, root), 10), "t-n8")
    got = {(r.user_id, r.step): r["mean"] for r in spark.read.parquet(out).collect()}
    want = {(u, i + 10): np.mean(g.value.to_numpy()[i:i + 10]) for u, g in users.items() for i in range(0, len(g) - 9, 10)}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_streams_equal_batch_over_twenty_files(spark):
    from vocable.streaming import stateful as N

    root, pdf = _event_files(spark, 20)
    _check_streams(spark, root, pdf)
    kept, rej, quar = (N.scratch(spark, x) for x in ("t-kept", "t-rej", "t-quar"))
    N.run_foreach(N.quarantine_sink(N.event_stream(spark, root, 4), kept, rej, quar, N.scratch(spark, "t-chk")))
    good = set()
    for g in _by_user(pdf).values():
        bad = (g.event_type == "error").cumsum() > 0
        good |= set(g.event_id[~bad])
    assert {r.event_id for r in spark.read.parquet(kept).collect()} == good
    ring = N.scratch(spark, "t-ring")
    N.run_foreach(N.ring_histogram_sink(N.event_stream(spark, root, 4), ring, N.scratch(spark, "t-chk"), 50,
                                        F.col("event_id"), ["ts", "event_id"]))
    assert {r.code for r in N.latest_version(spark, ring).collect()} == set(pdf.event_id.tail(50))


def test_streams_equal_batch_on_a_hot_key(spark):
    root, pdf = _event_files(spark, 1, hot=True)
    _check_streams(spark, root, pdf)


def test_crossfade_holds_back_and_ends_on_short_chunks():
    from vocable.streaming.stateful import crossfaded

    a, b, short, c = np.arange(6.0), np.arange(10.0, 16), np.array([1.0, 2.0, 3.0]), np.full(6, 5.0)
    out, tail = crossfaded([a, b, short, c], None, 2)
    assert [x.tolist() for x in out] == [[0, 1, 2, 3], [4, 11, 12, 13], [1, 2, 3], [5, 5, 5, 5]]
    assert tail.tolist() == [5, 5]
    first, held = crossfaded([a], None, 2)
    second, _ = crossfaded([b], held, 2)
    assert first[0].tolist() + second[0].tolist() == [0, 1, 2, 3, 4, 11, 12, 13]


def test_rotating_classes_end_at_the_first_exhausted_class(spark):
    """Replayed one row at a time from the drawn classes."""
    import pytest

    from vocable.functions.hashing import hash52
    from vocable.operators.batching import rotating_class_batches

    sizes = {f"c{k}": n for k, n in enumerate([9, 30, 12, 25, 17, 8])}
    rows = [(f"{c}-{i}", c) for c, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "k string, cls string").repartition(4)
    order = {c: [r.k for r in df.where(F.col("cls") == c).orderBy(hash52(0, "g5r", F.col("k")), "k").collect()] for c in sizes}
    draws = spark.range(60).select("id", F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda c: F.struct(
        hash52(0, "g5r-class", F.col("id"), c).alias("h"), c.alias("c")))).alias("d")).orderBy("id").collect()
    want, taken, done = [], dict.fromkeys(sizes, 0), False
    for d in draws:
        chosen = [f"c{x.c}" for x in d.d[:3]]
        for turn in range(2):
            if done or any(taken[c] >= sizes[c] for c in chosen):
                done = True
                break
            for c in chosen:
                want.append((order[c][taken[c]], d.id, turn))
                taken[c] += 1
    got = rotating_class_batches(df, "k", "cls", 6, 3)
    assert sorted((r.k, r.batch_id, r["round"]) for r in got.collect()) == sorted(want)
    full = rotating_class_batches(df, "k", "cls", 6, 3, drop_last=True)
    assert sorted((r.k, r.batch_id, r["round"]) for r in full.collect()) == sorted(
        w for w in want if sum(x[1] == w[1] for x in want) == 6)
    with pytest.raises(ValueError):
        rotating_class_batches(df, "k", "cls", 7, 3)


def test_mean_of_n_vectors_needs_n(spark):
    import pytest

    from vocable.operators.stats import mean_vectors

    df = spark.createDataFrame([(i, "ab"[i > 5], [float(i), 1.0]) for i in range(9)], "k long, name string, v array<double>")
    assert mean_vectors(df, "name", "v", "k", first_n=3).count() == 4 and mean_vectors(df, "name", "v", "k", random_n=2).count() == 4
    for option in ("first_n", "random_n"):
        with pytest.raises(Exception, match="fewer than 4 vectors of b"):
            mean_vectors(df, "name", "v", "k", **{option: 4}).collect()
