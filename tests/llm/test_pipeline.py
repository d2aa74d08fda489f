"""Every stage of the pipeline against brute force, on whole tables and on awkward rows."""

import os
import re
import sys

import pytest
from brute import components, norm, odd_docs, odd_rows, repeated_bytes, rules
from conftest_paths import SF001
from test_text_ops import check_packing

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
END = re.compile("[.!?…。！？｡।॥۔؟։።။‼⁇⁈⁉][\"'”’»›)\\]}）」』】〉》]*$")


def passes(text):
    m, t = rules(text), text or ""
    words = t.split()
    lines = [x for x in t.split("\n") if x.strip(" \t\r\x0b\x0c")]
    up, low = sum("A" <= c <= "Z" for c in t), sum("a" <= c <= "z" for c in t)
    ends = sum(bool(END.search(w)) for w in words)
    n = m["n_words"]
    return not (n < 50 or 100 * m["n_repeat_words"] > 50 * n or 10 * m["n_symbols"] > n or m["word_chars"] < 2 * n
                or m["word_chars"] > 15 * n or (len(lines) >= 4 and 100 * m["n_dup_lines"] > 60 * len(lines))
                or up > low or 200 * ends < n)


def run_stages(spark, docs):
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF001), f"test-{name}")
        out.append(docs)
    return out


def as_rows(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is None, r[0], r[1] or ""))


def check(before, after):
    good, unique, near, rest, pieces = after
    want = [(k, t) for k, t in before if passes(t)]
    assert as_rows(good) == want
    first = {}
    for k, t in want:
        first[norm(t)] = min(k, first.get(norm(t), k))
    want = sorted({(k, t) for k, t in want if first[norm(t)] == k})
    assert as_rows(unique) == want
    low, _ = components(want, 5, 80, 100)
    want = [(k, t) for (k, t), c in zip(want, low) if c == k]
    assert as_rows(near) == want
    masks = repeated_bytes([t.encode() for _, t in want], 200)
    want = [(k, bytes(b for b, m in zip(t.encode(), mask) if not m).decode("utf-8", "ignore")) for (k, t), mask in zip(want, masks)]
    want = [(k, t) for k, t in want if t.strip(" \t\n\r\x0b\x0c")]
    assert as_rows(rest) == want
    check_packing(pieces.collect(), want)
    return len(want)


def test_pipeline_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    steps = run_stages(spark, docs)
    assert all(s.columns == COLUMNS for s in steps[:-1])
    assert check(as_rows(docs), steps) > 50
    texts = {r.doc_id: r.n_chars for r in steps[3].collect()}
    assert all(texts[k] == len(t) for k, t in as_rows(steps[3]))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF001).collect())) == sorted(map(tuple, steps[-1].collect()))


def test_pipeline_on_awkward_rows_and_empty_tables(spark):
    rows = [r for r in odd_rows() if r[0] is not None]
    passage = " ".join(f"shared{i % 60}z{i}" for i in range(70)) + "."
    rows += [(500 + i, " ".join(f"own{i}w{j}" for j in range(80)) + f". {passage} Tail {i} ends.", "en", "s", 0) for i in range(4)]
    docs = odd_docs(spark, rows)
    steps = run_stages(spark, docs)
    assert all(s.columns == docs.columns for s in steps[:-1])
    before = sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0], r[1] or ""))
    assert check(before, steps) >= 4
    assert all(s.count() == 0 for s in run_stages(spark, odd_docs(spark, [])))


def test_entry_registers_everything():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert set(entry.oracle_sql()) <= names and {"op1_exact_dedup", "op2_warc", "op8_rule_ledger"} <= set(entry.oracle_sql())


@pytest.mark.parametrize("gone", ["corpus_pipeline", "vocable.llm.queries"])
def test_entry_without_the_subpackage(monkeypatch, gone):
    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, gone, None)
    with pytest.raises(ModuleNotFoundError):
        __import__(gone)
    assert entry._training_data() is None and "c1_length_bounds" in entry.queries()
