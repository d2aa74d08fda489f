"""The words of a corpus meet their tokens without a shuffle of words."""


def test_words_are_looked_up_in_place(spark):
    from vocable.operators import lexicon as LX

    d = spark.createDataFrame([(1, "Hi, you! hi"), (2, ""), (3, None), (4, "you 5"), (4, "a b c")], "k long, t string")
    lex = LX.first_pronunciations(LX.lexicon_from_corpus(d.where("k < 4"), "t"))
    out = LX.reassemble(LX.lookup_words(d.repartition("k"), "k", "t", lex), "k")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert {r.k: r.phonemes for r in out.collect()} == {1: "{H I}, {Y O U}! {H I}", 2: "", 4: "a {Y O U} 5 b c"}
