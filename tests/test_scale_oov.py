"""Characters are counted before they are joined."""


def test_oov_joins_counts(spark):
    from vocable.operators.vocab import oov_report

    d = spark.createDataFrame([("abca",), ("zéa",), (None,)], "t string")
    out = oov_report(d, spark.createDataFrame([("b",), ("c",)], "ch string"), "t")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftAnti") < plan.index("Aggregate")
    assert {r.ch: r.n for r in out.collect()} == {"a": 3, "z": 1, "é": 1}
