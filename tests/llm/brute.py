"""Plain Python versions of the operators and a table of awkward rows."""

import hashlib
import re
from collections import Counter

from pyspark.sql import types as T

SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns whose names the operators use inside, to see that they don't clash.
CLASHING = ["kind", "key", "n", "row", "digit", "rest", "token", "part", "n_words", "fp", "ctx", "spans", "grp", "sig"]


def odd_rows():
    long = " ".join(f"word{i % 977}x{i}" for i in range(6000))
    passage = "A passage that several documents share, long enough to count: " + "lorem ipsum dolor sit amet " * 9
    near = " ".join(f"term{i}" for i in range(100))
    texts = {
        1: None, 2: "", 3: " \t\n ", 4: "one", 5: "one two", 6: "One  two", 7: "one\ttwo", 8: long, 9: long,
        10: long + " tail", 11: passage + "one end", 12: "other start " + passage, 13: near, 14: near + " extra",
        15: near.replace("term50", "changed"), 16: near.replace("term50", "changed").replace("term10", "moved"),
        17: "a" * 700, 18: "é" * 300 + " ünï", 19: "漢字 😀 " * 120, 20: "x\x00y \x0b z\x0c", 21: "same line here\n" * 20,
        22: "one two", 23: "a b c a b c a b c d e f", 24: "<s> <|endoftext|> ▁ &amp;", 25: "A" * 64, 26: "A" * 65, 27: "A" * 64 + "B",
    }
    rows = [(k, t, "en", "s", None if t is None else len(t)) for k, t in texts.items()]
    return rows + [(13, near, "en", "s", len(near)), (None, "no id", None, None, 5)]


def odd_docs(spark, rows=None, partitions=3):
    rows = odd_rows() if rows is None else rows
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                           T.StructField("n_chars", T.LongType())]
                          + [T.StructField(c, T.StringType()) for c in CLASHING])
    data = [(*r, *(["clash"] * len(CLASHING))) for r in rows]
    return spark.createDataFrame(data, schema).repartition(partitions)


def norm(text):
    return SPACE.sub(" ", text or "")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def shingles(text, n):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) or frozenset([tuple(w)])


def components(rows, n, num, den):
    """{index: smallest id reachable} for (id, text) rows, by comparing all pairs."""
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[find(i)] = min(k, low.get(find(i), k))
    return [low.get(find(i), rows[i][0]) for i in range(len(rows))], sets


def repeated_bytes(texts, length):
    """Mask of removed bytes per text."""
    seen = {}
    for d, b in enumerate(texts):
        for i in range(len(b) - length + 1):
            seen.setdefault(b[i:i + length], []).append((d, i))
    masks = [bytearray(len(b)) for b in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                masks[d][i:i + length] = b"\x01" * length
    return masks


def rules(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    times = Counter(tri)
    covered = {i + o for i, x in enumerate(tri) if times[x] > 1 for o in range(3)}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}
