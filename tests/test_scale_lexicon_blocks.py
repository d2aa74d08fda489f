"""Of a corpus of many words only texts and a block's distinct words are shuffled."""

import re

import pytest

ROWS = [(1, "Hi, you! 'hi' HI"), (2, ""), (3, None), (4, "you 5 (été. naïve"), (4, "a b"), (5, "don't  end? ok|so"),
        (None, "null one"), (None, "two null"), (6, "b a"), (6, "b a"), (7, "Straße\tund so.\nweiter -x-")]


def plain(rows):
    lex = {w for _, t in rows if t for w in re.sub("[^A-Za-z' ]", "", t).upper().split(" ") if w}
    docs = {}
    for k, t in rows:
        for i, w in enumerate(t.split(" ") if t is not None else []):
            m = re.match(r"([!'(),\-.:;? ]?)(.*?)([!'(),\-.:;? ]?)\Z", w, re.S)
            word = m[2].upper()
            token = m[1] + "{" + " ".join(word) + "}" + m[3] if word in lex else w
            docs.setdefault(k, []).append((i, token.encode(), token))
    return {k: " ".join(t for _, _, t in sorted(x)) for k, x in docs.items()}


@pytest.fixture()
def corpus(spark, tmp_path):
    spark.createDataFrame([(k, t, "en") for k, t in ROWS], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def shuffled(df) -> list[str]:
    return re.findall(r"Exchange (\w+\(.*)", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("slice_bytes", [1, 1 << 20])
def test_phonemes_without_a_shuffle_of_words(spark, corpus, monkeypatch, slice_bytes):
    from vocable.operators import lexicon as LX
    from vocable.plans.catalog import text as T

    monkeypatch.setattr(LX, "BROADCAST_WORDS", 0)
    monkeypatch.setattr(LX, "SLICE_BYTES", slice_bytes, raising=False)
    out = T.j23(spark, corpus)
    rows = out.collect()
    assert {r.doc_id: r.phonemes for r in rows} == plain(ROWS) and len(rows) == 7
    # neither the words of the corpus by word, nor their tokens by document
    assert not any(x.startswith(("hashpartitioning(w#", "hashpartitioning(doc_id#")) for x in shuffled(out))


def test_inventory_over_blocks(spark, corpus, monkeypatch):
    from vocable.operators import lexicon as LX
    from vocable.plans.catalog import text as T

    monkeypatch.setattr(LX, "BROADCAST_WORDS", 0)
    out = T.e3(spark, corpus)
    assert sorted(r.ch for r in out.collect()) == sorted(set("".join(plain(ROWS).values())) - {"|"})
    assert not any(x.startswith(("hashpartitioning(w#", "hashpartitioning(doc_id#")) for x in shuffled(out))


def test_a_block_holds_whole_documents(spark, monkeypatch):
    from pyspark.sql import functions as F

    from vocable.operators import lexicon as LX

    monkeypatch.setattr(LX, "BLOCK_BYTES", 400)
    d = spark.range(500).select((F.col("id") % 250).alias("k"), F.lit("twenty bytes of text").alias("t"))
    at = LX.in_blocks(d, "k", "t").select("k", "_block", F.spark_partition_id().alias("p")).distinct().collect()
    assert len(at) == 250 and len({r._block for r in at}) == len({r.p for r in at}) == len({(r._block, r.p) for r in at}) > 20
