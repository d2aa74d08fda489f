"""The Spark BPE trainer equals a plain Python trainer with the same
rules (word counts, pair counts weighted by word count, best = higher count
then smaller pair, left-to-right merges), and encoding splits words into
vocabulary tokens that concatenate back to the word."""

import re
import unicodedata
from collections import Counter

from pyspark.sql import functions as F

from conftest import SF001


def _py_train(texts, vocab_size, min_freq, max_len, specials):
    words = Counter()
    for t in texts:
        t = unicodedata.normalize("NFKC", t).lower()
        words.update(re.findall(r"\w+|[^\w\s]+", t))
    sym = {w: list(w) for w in words}
    alphabet = sorted({c for w in words for c in w})
    vocab = list(specials) + [c for c in alphabet if c not in specials]
    merges = []
    while len(vocab) < vocab_size:
        pairs = Counter()
        for w, n in words.items():
            s = sym[w]
            for a, b in zip(s, s[1:]):
                if len(a) + len(b) <= max_len:
                    pairs[(a, b)] += n
        cands = [(-c, p) for p, c in pairs.items() if c >= min_freq]
        if not cands:
            break
        _, (a, b) = min(cands)
        merges.append((a, b))
        if a + b not in vocab:
            vocab.append(a + b)
        for w in sym:
            s, out, i = sym[w], [], 0
            while i < len(s):
                if i < len(s) - 1 and s[i] == a and s[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            sym[w] = out
    return vocab, merges


def test_bpe_train_and_encode(spark):
    from vocable.operators.bpe import SPECIAL_TOKENS, encode_bpe, train_bpe

    d = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text", "lang")
    vdf, merges = train_bpe(d, "text", vocab_size=140, min_frequency=3)
    texts = [r.text for r in d.collect()]
    exp_vocab, exp_merges = _py_train(texts, 140, 3, 20, SPECIAL_TOKENS)
    assert merges == exp_merges
    assert [r.token for r in vdf.orderBy("id").collect()] == exp_vocab

    vocab = {r.id: r.token for r in vdf.collect()}
    enc = encode_bpe(d.limit(20), "doc_id", "text", "lang", vdf, merges).collect()
    src = {r.doc_id: r for r in d.limit(20).collect()}
    for r in enc:
        toks = [vocab[i] for i in r.ids]
        assert toks[0] == f"[{src[r.doc_id].lang}]" or toks[0] == "[UNK]"
        body = "".join(t for t in toks[1:] if t != "[SPACE]")
        norm = unicodedata.normalize("NFKC", src[r.doc_id].text).lower()
        assert body == re.sub(r"\s+", "", norm)


def test_several_merges_a_round_share_no_symbol(spark):
    from vocable.operators.bpe import train_bpe

    d = spark.read.parquet(f"{SF001}/documents.parquet").select("text")
    vocab, merges = train_bpe(d, "text", vocab_size=260, min_frequency=3, merges_per_round=64)
    tokens = [r.token for r in vocab.orderBy("id").collect()]
    assert len(tokens) == len(set(tokens)) == 260
    known = set(tokens)
    assert all(a in known and b in known and a + b in known for a, b in merges)
