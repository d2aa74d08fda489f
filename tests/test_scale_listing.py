"""Folders are listed and transcripts read by the tasks; no file's name is in a plan."""


def test_listing_and_first_lines_of_many_files(spark, tmp_path):
    from vocable.sources import metadata as A

    rows = [(f"s{i % 3}/deep er/{i}.txt", f"line {i}\nmore" if i else "") for i in range(40)] + [("s1/x.wav", "xy"), ("_hid/y.wav", "x"), ("s1/.z.wav", "x")]
    A.write_files(spark.createDataFrame(rows, "name string, content string"), str(tmp_path))
    f = A.list_files(spark, str(tmp_path), (".WAV", ".txt"))
    got = {r.path: r.length for r in f.collect()}
    assert got == {f"{tmp_path}/{n}": len(c) for n, c in rows[1:41]}
    t = A.crawl_text_files(spark, str(tmp_path))
    assert {r.path: r.first_line for r in t.collect()} == {f"{tmp_path}/{n}": c.split("\n")[0] for n, c in rows[1:40]}
    for df in (f, t):
        assert not any(n.endswith((".txt", ".wav")) for n in df.inputFiles())
