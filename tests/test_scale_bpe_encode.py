"""Encoding shuffles texts only, and rows that share a key give their pieces in turn."""


def test_encoding_explodes_nothing(spark):
    from vocable.operators.bpe import encode_bpe

    vocab = spark.createDataFrame([(0, "[UNK]"), (1, "[SPACE]"), (2, "[en]"), (3, "a"), (4, "b"), (5, "ab")], "id long, token string")
    d = spark.createDataFrame([(1, "ab a", "en"), (2, "ba", "fr"), (7, "a", "en"), (7, "b", "en"), (8, None, "en")], "k long, t string, lang string")
    out = encode_bpe(d, "k", "t", "lang", vocab, [("a", "b")])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
    assert {r.k: r.ids for r in out.collect()} == {1: [2, 5, 1, 3], 2: [0, 4, 3], 7: [2, 2, 3, 4]}
