"""Each step of the normaliser is in the plan once."""

import re

from pyspark.sql import functions as F


def test_normaliser_does_each_step_once(spark):
    from vocable.functions import text as J

    texts = ["\u2003 Ünï\u00a0x\tÝ\\ ½ ﬁ…  ok\n", "plain  Text ", "", None, "中 a\x00b", " \x85"]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", J.txt_normalise(F.col("t")).alias("n"))
    assert d._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    import unicodedata
    for r in d.collect():
        if r.t is not None:
            x = unicodedata.normalize("NFKD", r.t.strip().lower()).encode("ascii", "ignore").decode()
            assert r.n == re.sub(r"\s+", " ", re.sub(f"[^{J.CORPUS_ALLOWED}]+", "[UNK]", x))


def test_both_classes_are_the_same():
    from vocable.functions import text as J

    a, b = re.compile(f"[^{J.CORPUS_ALLOWED}]+"), re.compile(J.CORPUS_OTHERS)
    assert all(bool(a.match(chr(c))) == bool(b.match(chr(c))) for c in range(0x3100))
    assert J.WS_CHARS == "".join(chr(c) for c in range(0x110000) if chr(c).isspace())
