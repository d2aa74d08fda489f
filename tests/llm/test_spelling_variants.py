import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from brute import odd_docs, odd_rows
from conftest_paths import SF001

from vocable.llm import spelling_variants as sv

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def brute_vocabulary(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            w = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1:]
            if len(w) >= 5:
                n[w] += 1
    return {w: c for w, c in n.items() if c >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, near=None):
    n = brute_vocabulary(rows)
    if near is None:
        near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return sorted(out)


def near_by_deletions(words):
    """All pairs one edit apart without comparing all of them: for larger vocabularies."""
    rest, near = {}, {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            rest.setdefault((i, w[:i] + w[i + 1:]), []).append(w)
            if w[:i] + w[i + 1:] in near:
                near[w].add(w[:i] + w[i + 1:])
                near[w[:i] + w[i + 1:]].add(w)
    for group in rest.values():
        for a in group:
            near[a].update(b for b in group if b != a)
    return near


def result(df):
    return sorted(tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in df.collect())


def family_rows():
    rnd = random.Random(5)
    letters = "abcdeéüßÿÀ"
    base = ["".join(rnd.choice(letters) for _ in range(k)) for k in (5, 6, 6, 7, 9, 12, 5, 8) for _ in range(4)]
    texts = []
    for i, w in enumerate(base):
        texts += [w] * (3 + 7 * (i % 5))
        for _ in range(4):
            k = rnd.randrange(len(w))
            texts += [w[:k] + rnd.choice(letters) + w[k + rnd.randrange(2):]] * rnd.randrange(1, 14)
    texts += ["aaaaa", "aaaaaa", "aaaaaaa"] * 3 + ["chain"] * 3 + ["chains"] * 6 + ["chainsx"] * 12 + ["chainsxy"] * 24 + ["bchain"] * 6
    texts += ["x" * 3000] * 4 + ["x" * 3001] * 9 + ["Ünïon×÷ union" * 3]
    rnd.shuffle(texts)
    return [(i % 40, " ".join(texts[i::40]), "en", "s", 1) for i in range(40)]


@pytest.mark.parametrize("symbols", [None, 4, 12])
def test_spelling_variants_against_all_pairs(spark, symbols):
    rows = family_rows() + odd_rows()
    got = result(sv.spelling_variants(odd_docs(spark, rows), symbols=symbols))
    assert got == brute([(r[0], r[1]) for r in rows])
    assert any(r[5] != r[3] and r[3] for r in got)          # a chain of two


def test_spelling_variants_of_a_given_table(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert result(sv.spelling_variants(docs)) == brute(rows, near_by_deletions(brute_vocabulary(rows)))


def test_neighbourhoods_are_whole_and_without_repeats():
    words, r = ["abcab", "aaaaa", "abÿéx", "zzz", "a"], 4
    red = sv.Reduced(pa.array(words), r)
    sym = sv.symbol_table(r)
    strings = ["".join(chr(65 + sym[ord(c)]) for c in w) for w in words]
    assert red.strings().to_pylist() == strings
    alphabet = [chr(65 + i) for i in range(r)]

    def key(s):                                              # the key of a reduced string
        value = sum((ord(c) - 64) * pow(int(sv._P), i, 1 << 64) for i, c in enumerate(s)) % (1 << 64)
        return int(sv.Reduced.key(np.array([value], np.uint64), np.array([len(s)]))[0])

    got = Counter((int(w), int(k)) for part in (red.deletions(), red.replacements(), red.insertions())
                  for ws, ks in part for w, k in zip(ws, ks))
    assert max(got.values()) == 1
    for i, s in enumerate(strings):
        around = {s[:j] + s[j + 1:] for j in range(len(s))} | {s[:j] + c + s[j:] for j in range(len(s) + 1) for c in alphabet}
        around |= {s[:j] + c + s[j + 1:] for j in range(len(s)) for c in alphabet} - {s}
        assert {k for w, k in got if w == i} == {key(x) for x in around}
    assert [int(k) for k in red.own()] == [key(s) for s in strings]


def test_crc32_of_ranges():
    buf = np.frombuffer(bytes(range(256)) * 3, np.uint8)
    s, e = np.array([0, 5, 5, 100, 300]), np.array([0, 6, 69, 700, 364])
    begin = np.array([zlib.crc32(b"p%d:" % i) for i in range(5)], np.uint32)
    want = [zlib.crc32(b"p%d:" % i + buf[a:b].tobytes()) for i, (a, b) in enumerate(zip(s, e))]
    assert sv.crc32_ranges(buf, s, e, begin).tolist() == want


def test_cost_chosen_symbols_grow_with_the_vocabulary():
    assert sv.best_symbols({8: 10}) <= sv.best_symbols({8: 10 ** 6}) <= sv.best_symbols({8: 10 ** 9})


def test_spelling_variants_empty_table(spark):
    assert sv.spelling_variants(odd_docs(spark, [])).collect() == []
