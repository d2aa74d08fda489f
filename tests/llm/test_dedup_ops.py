import numpy as np
import pytest
from brute import components as brute_components
from brute import norm, odd_docs, odd_rows, repeated_bytes, sha
from hypothesis import given, settings
from hypothesis import strategies as st

from vocable.llm import components, exact_dedup, jaccard_join, suffix_dedup
from vocable.llm.textbytes import Texts, shingle_hashes


def docs_of(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# ---------------------------------------------------------------- exact dedup

def test_exact_dedup_matches_brute_force_on_awkward_rows(spark):
    rows = odd_rows() + [(100 + i, "p" * 5000 + "q" * i, "en", "s", 0) for i in range(4)] + [(99, "p" * 5000, "en", "s", 0)]
    got = exact_dedup.exact_dedup(odd_docs(spark, rows)).collect()
    groups = {}
    for k, t, *_ in rows:
        groups.setdefault(norm(t), []).append(k)
    want = sorted((k, min((x for x in groups[norm(t)] if x is not None), default=None), len(groups[norm(t)]), sha(norm(t)))
                  for k, t, *_ in rows if k is not None)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got if r.doc_id is not None) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    assert {(r.doc_id, r.keep_id, r.kept) for r in got if r.doc_id is None} == {(None, None, True)}


def test_exact_dedup_empty_table_and_kept_rows(spark):
    assert exact_dedup.exact_dedup(odd_docs(spark, [])).count() == 0
    docs = odd_docs(spark)
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    want = {}
    for k, t, *_ in odd_rows():
        if k is not None:
            want[norm(t)] = min(k, want.get(norm(t), k))
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want.values()) and ids.count(None) == 1


# ---------------------------------------------------------------- components

def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (300, 301), (301, 300)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 300: 300, 301: 300}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---------------------------------------------------------------- n-gram Jaccard

def family(n):
    """Near copies of one text, a few words changed in each, and unrelated texts."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(220)]
    out = []
    for i in range(n):
        w = list(base)
        for j in rng.choice(220, rng.integers(0, 7), replace=False):
            w[j] = f"e{rng.integers(0, 40)}"
        out.append((1000 + i, " ".join(w), "en", "s", 0))
    return out + [(5000 + i, " ".join(f"u{i}x{j}" for j in range(30)) + " the common ending of many texts", "en", "s", 0)
                  for i in range(20)]


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80)])
def test_jaccard_components_match_all_pairs(spark, n, num):
    rows = odd_rows() + family(60)
    got = jaccard_join.jaccard_components(odd_docs(spark, rows, 4), n, num).collect()
    want, sets = brute_components([(r[0], r[1]) for r in rows], n, num, 100)
    by_id = {}
    for r, w, s in zip(rows, want, sets):
        if r[0] is not None:
            by_id[r[0]] = (len(s), w if s else r[0])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == by_id
    assert len(got) == len(rows)


def small_sets(n):
    """Texts of 1 to 12 shingles of ``n`` words, each with one word more at its end or its start."""
    rows = []
    for k in range(1, 13):
        w = [f"k{k}w{i}" for i in range(k + n - 1)]
        rows += [w, w + ["more"], ["more"] + w]
    return [(7000 + i, " ".join(w), "en", "s", 0) for i, w in enumerate(rows)]


@pytest.mark.parametrize("n,num,first", [(3, 90, 9), (5, 80, 4)])
def test_jaccard_links_of_a_set_with_one_more_shingle(spark, n, num, first):
    """9 of 10 at 90 % and 4 of 5 at 80 % are links though the smaller set's prefix is one shingle."""
    rows = small_sets(n)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(odd_docs(spark, rows, 4), n, num).collect()}
    want, _ = brute_components([(r[0], r[1]) for r in rows], n, num, 100)
    assert got == {r[0]: w for r, w in zip(rows, want)}
    at = 7000 + 3 * (first - 1)
    assert got[at] == got[at + 1] == got[at + 2] == at and got[at - 2] == at - 2


def test_jaccard_small_lists_and_blocks(spark, monkeypatch):
    """Posting lists longer than a part are paired in blocks; nothing is lost."""
    monkeypatch.setattr(jaccard_join, "LIST_PART", 8)
    rows = family(60)
    got = jaccard_join.jaccard_components(odd_docs(spark, rows, 4)).collect()
    want, _ = brute_components([(r[0], r[1]) for r in rows], 3, 90, 100)
    assert {r.doc_id: r.component_id for r in got} == {r[0]: w for r, w in zip(rows, want)}


def test_jaccard_empty_table_and_keep_one(spark):
    assert jaccard_join.jaccard_components(odd_docs(spark, [])).count() == 0
    docs = odd_docs(spark, [r for r in odd_rows() if r[0] in (13, 14, 15, 16, 4, 2)])
    kept = jaccard_join.keep_one(docs, 5, 80)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {2, 4, 13}


def test_match_count_grows_only_where_lists_are_long():
    """More matches pay off until the next posting list costs more than they save."""
    assert jaccard_join.matches(np.full(10, 1), 10) == 1
    rare = np.full(100, 2)
    few, many = jaccard_join.matches(rare, 5), jaccard_join.matches(rare, 50)
    assert 1 < few < many <= jaccard_join.MAX_MATCHES
    assert jaccard_join.matches(np.r_[np.full(7, 2), np.full(20, 5000)], 5) == 3
    assert jaccard_join.matches(np.r_[np.full(4, 2), np.full(20, 5000)], 5) > 3


def test_frequent_counts_stay_within_their_bound():
    rng = np.random.default_rng(1)
    k, c = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = 0
    for _ in range(4):
        more = np.unique(rng.integers(1000, 1 << 60, 40000, dtype=np.uint64))
        more = np.concatenate([np.array([7], np.uint64), more])
        counts = np.concatenate([[3000], np.ones(len(more) - 1, np.int64)])
        total += counts.sum()
        k, c = jaccard_join._merge_counts(k, c, more, counts)
    assert len(k) <= jaccard_join.COUNTERS and c[k == 7][0] >= 12000 - total / jaccard_join.COUNTERS


# ---------------------------------------------------------------- repeated passages

def check_suffix(spark, rows, length=200):
    got = suffix_dedup.suffix_dedup(odd_docs(spark, rows), length).collect()
    texts = [(r[1] or "").encode() for r in rows]
    masks = repeated_bytes(texts, length)
    want = sorted((r[0] or -1, len(b), sum(m), sum(1 for i in range(len(m)) if m[i] and (i == 0 or not m[i - 1])),
                   sha(bytes(x for x, y in zip(b, m) if not y))) for r, b, m in zip(rows, texts, masks))
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def passages():
    rng = np.random.default_rng(3)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 6))
    shared = [" ".join(word() for _ in range(60)) for _ in range(3)]
    out = []
    for i in range(30):
        parts = [" ".join(word() for _ in range(30)), shared[i % 3][: 150 + 10 * i], " ".join(word() for _ in range(10))]
        out.append((200 + i, " ".join(parts), "en", "s", 0))
    return out


def test_suffix_dedup_matches_brute_force(spark):
    check_suffix(spark, odd_rows() + passages())


def test_suffix_dedup_of_many_rows_without_id(spark):
    """Each row gets its own spans only, equal rows one set of them."""
    rng = np.random.default_rng(1)
    shared = "a passage that several rows without an id hold, " * 6
    rows = [(None, f"{rng.integers(1 << 60)} " * 20 + (shared if i % 3 == 0 else "") + f"{rng.integers(1 << 60)} " * 15, "", "", 0) for i in range(120)]
    rows += [(None, "equal rows " * 40 + "end", "", "", 0)] * 60 + [(7, "one with an id " * 30, "", "", 0)]
    check_suffix(spark, rows)
    docs = odd_docs(spark, rows).select("doc_id", "text").selectExpr("coalesce(doc_id, xxhash64(text)) as doc_id", "text")
    per_row = suffix_dedup.repeated_spans(docs).distinct().groupBy("doc_id").count().collect()
    assert max(r["count"] for r in per_row) < 60


def test_suffix_dedup_of_hot_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    check_suffix(spark, passages() + [(900, "ab" * 400, "", "", 0), (901, "ab" * 300 + "c", "", "", 0)])


def test_suffix_dedup_empty_table_and_texts_without_repeats(spark):
    assert suffix_dedup.suffix_dedup(odd_docs(spark, [])).count() == 0
    rows = odd_rows()
    docs = odd_docs(spark, rows)
    kept = suffix_dedup.without_repeats(docs)
    assert kept.columns == docs.columns
    got = {r.doc_id: r for r in kept.collect()}
    assert got[23].text == "a b c a b c a b c d e f" and got[23].kind == "clash" and got[14].text == " extra"
    assert 8 not in got and 9 not in got                      # equal texts lose every byte
    assert got[10].text == " tail"[-len(got[10].text):] and got[10].n_chars == len(got[10].text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([0, 97, 98, 99, 255]), max_size=90))
def test_two_stage_order_is_the_suffix_order(data):
    text = bytes(data)
    order = suffix_dedup.two_stage_suffix_order(np.frombuffer(text, np.uint8), 200).tolist()
    assert order == sorted(range(len(text)), key=lambda i: text[i:])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 96, 97, 255]), min_size=2, max_size=70), st.sampled_from([24, 16, 40]))
def test_common_prefixes(data, depth):
    text = bytes(data)
    order = np.array(sorted(range(len(text)), key=lambda i: text[i:]))
    got = suffix_dedup.common_prefixes(np.frombuffer(text, np.uint8), order, depth).tolist()
    for k in range(1, len(order)):
        a, b, n = text[order[k - 1]:], text[order[k]:], 0
        while n < min(len(a), len(b), depth) and a[n] == b[n]:
            n += 1
        assert got[k] == n


def test_word_hashes_follow_the_words():
    import pyarrow as pa

    t = Texts(pa.array(["ab  cd ab", None, "", "ab\ncd"]))
    row, s, e = t.words()
    h = t.hash_ranges(s, e)
    assert row.tolist() == [0, 0, 0, 3, 3] and h[0] == h[2] == h[3] and h[1] == h[4] != h[0]
    assert shingle_hashes(row, h, 3)[0].tolist() == [0]
    assert [x.tolist() for x in t.lines()] == [[0, 1, 2, 3, 3], [0, 9, 9, 9, 12], [9, 9, 9, 11, 14]]
