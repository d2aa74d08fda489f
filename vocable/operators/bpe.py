"""Byte-pair-encoding vocabulary training and encoding.

Training (J26): the heavy step -- normalising and pre-tokenising the corpus
and counting words -- is one Spark aggregation.  Merges are then learned on
the distinct-word table (symbol ids and count per word): each round is one job
in which the tasks replay the merges since the words were last written and add
up adjacent symbol pairs weighted by word count, and a grouping takes the best
pairs (higher count, then the smaller pair).  Every ``REPLAYED`` rounds the
words are written anew to the shared folder.

Encoding (J27): a document's pieces are encoded where the document is, by the
merge ranks of the model; a task encodes a word once while it remembers it.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocable.session import written

# Special tokens of the trained vocabulary, in id order.
SPECIAL_TOKENS = ["[STOP]", "[UNK]", "[SPACE]", "[en]", "[START]"]
# Whitespace pre-tokeniser: runs of word characters, or of other non-space characters.
PRETOKEN = r"(?U)\w+|[^\w\s]+"


@F.pandas_udf(T.StringType())
def nfkc_lower(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).lower())


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """``(word, n)`` over the normalised, pre-tokenised corpus (one shuffle)."""
    w = df.select(F.explode(F.regexp_extract_all(nfkc_lower(F.col(text)), F.lit(PRETOKEN), 0)).alias("word"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


#: Rounds whose merges are replayed before the words are written again.
REPLAYED = 8


def _char_ids(ids: dict):
    """Words as lists of the ids of their characters."""
    def run(batches):
        codes = np.array(sorted(map(ord, ids)), "uint32")
        of = np.array([ids[chr(c)] for c in codes], "int32")
        for batch in batches:
            words = batch.column(0).to_pylist()
            flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
            ends = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype("int32")
            sym = pa.ListArray.from_arrays(pa.array(ends), pa.array(of[np.searchsorted(codes, flat)] if len(flat) else flat.astype("int32")))
            yield pa.RecordBatch.from_arrays([batch.column(1), sym], names=["n", "sym"])
    return run


def _merged(word: np.ndarray, sym: np.ndarray, pairs: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Left-to-right, non-overlapping replacement of pairs ``(a, b, ab)`` that share no symbol; ``word`` is the number
    of each symbol's word."""
    size = max(int(sym.max(initial=0)), max(max(p) for p in pairs)) + 1
    right, made = np.full(size, -1, "int32"), np.zeros(size, "int32")
    for a, b, ab in pairs:
        right[a], made[a] = b, ab
    at = np.zeros(len(sym), bool)
    at[:-1] = (right[sym[:-1]] == sym[1:]) & (word[:-1] == word[1:])
    # only a pair of one symbol twice can overlap itself: of neighbouring matches every other one counts
    hit = np.flatnonzero(at)
    if len(hit):
        starts = np.concatenate([[True], np.diff(hit) != 1])
        first = np.flatnonzero(starts)
        hit = hit[(np.arange(len(hit)) - first[np.cumsum(starts) - 1]) % 2 == 0]
    out, keep = sym.copy(), np.ones(len(sym), bool)
    out[hit] = made[sym[hit]]
    keep[hit + 1] = False
    return word[keep], out[keep]


def _replayed(batch, rounds):
    """(count per word, word of each symbol, symbols) after the merges of ``rounds``."""
    col = batch.column(1)
    n, ends = batch.column(0).to_numpy(), np.asarray(col.offsets)
    word, sym = np.repeat(np.arange(len(n)), np.diff(ends)), np.asarray(col.flatten()).astype("int32")
    for pairs in rounds:
        if len(sym):
            word, sym = _merged(word, sym, pairs)
    return n, word, sym


def _rewrite(rounds):
    def run(batches):
        for batch in batches:
            n, word, sym = _replayed(batch, rounds)
            ends = np.searchsorted(word, np.arange(len(n) + 1)).astype("int32")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(sym))], names=["n", "sym"])
    return run


def _pair_counts(rounds, names: list[str]):
    """Adjacent pairs of a batch with the sum of their words' counts."""
    def run(batches):
        for batch in batches:
            n, word, sym = _replayed(batch, rounds)
            same = np.flatnonzero(word[:-1] == word[1:])
            keys, where = np.unique(sym[same].astype("int64") * len(names) + sym[same + 1], return_inverse=True)
            sums = np.zeros(len(keys), "int64")
            np.add.at(sums, where, n[word[same]])
            yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in keys // len(names)], pa.string()),
                                              pa.array([names[k] for k in keys % len(names)], pa.string()), pa.array(sums)], names=["a", "b", "n"])
    return run


def _disjoint(best: list, limit: int, room: int) -> list[tuple[str, str]]:
    """The best pairs, best first, none of which shares a symbol with a better one."""
    taken, out = set(), []
    made = {r.a + r.b for r in best}
    for r in best:
        if len(out) == min(limit, room):
            break
        if not {r.a, r.b} & taken and not {r.a, r.b} & made:
            taken |= {r.a, r.b}
            out.append((r.a, r.b))
    return out or [(best[0].a, best[0].b)]


def train_bpe(df: DataFrame, text: str, vocab_size: int = 3000, min_frequency: int = 10,
              max_token_length: int = 20, specials=tuple(SPECIAL_TOKENS), merges_per_round: int = 1):
    """Returns ``(vocab DataFrame (id, token), merges list[(a, b)])``.

    The alphabet is every character of the corpus words; merges are added
    until the vocabulary has ``vocab_size`` entries or no pair reaches
    ``min_frequency``.  With ``merges_per_round`` above one, a round applies
    several of the best pairs, as long as they share no symbol, which takes far
    fewer rounds; the default is the strict order.  The merge list and the
    alphabet (bounded by Unicode) are the model and are returned to the driver.
    Words are written to the shared folder and read by the rounds.
    """
    spark = df.sparkSession
    spread = spark.sparkContext.defaultParallelism
    counted = written(word_counts(df, text).repartition(spread), "bpe-words")
    alphabet = sorted(r.ch for r in counted.select(F.explode(F.split("word", "", -1)).alias("ch")).distinct().collect())
    vocab = list(specials) + [c for c in alphabet if c not in specials]
    ids = {t: i for i, t in enumerate(vocab)}
    words = written(counted.mapInArrow(_char_ids({c: ids[c] for c in alphabet if c}), "n long, sym array<int>"), "bpe-symbols")
    merges: list[tuple[str, str]] = []
    rounds: list[list[tuple[int, int, int]]] = []
    while len(vocab) < vocab_size:
        pairs = (words.mapInArrow(_pair_counts(rounds, list(vocab)), "a string, b string, n long")
                 .where(F.length("a") + F.length("b") <= max_token_length)
                 .groupBy("a", "b").agg(F.sum("n").alias("c")).where(F.col("c") >= min_frequency))
        best = pairs.orderBy(F.col("c").desc(), "a", "b").limit(4 * merges_per_round if merges_per_round > 1 else 1).collect()
        if not best:
            break
        now = _disjoint(best, merges_per_round, vocab_size - len(vocab))
        merges += now
        for a, b in now:
            if a + b not in ids:
                ids[a + b] = len(vocab)
                vocab.append(a + b)
        rounds.append([(ids[a], ids[b], ids[a + b]) for a, b in now])
        if len(rounds) == REPLAYED:
            words, rounds = written(words.mapInArrow(_rewrite(rounds), "n long, sym array<int>"), "bpe-symbols"), []
    vdf = spark.createDataFrame(list(enumerate(vocab)), "id long, token string")
    return vdf, merges


def _bpe_word(word: str, ranks: dict, vocab: dict, unk: int) -> list[int]:
    sym = list(word)
    while len(sym) > 1:
        best, at = None, -1
        for i in range(len(sym) - 1):
            r = ranks.get((sym[i], sym[i + 1]))
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        a, b = sym[at], sym[at + 1]
        out, i = [], 0
        while i < len(sym):
            if i < len(sym) - 1 and sym[i] == a and sym[i + 1] == b:
                out.append(a + b)
                i += 2
            else:
                out.append(sym[i])
                i += 1
        sym = out
    return [vocab.get(s, unk) for s in sym]


def encode_bpe(df: DataFrame, key: str, text: str, lang: str, vocab: DataFrame, merges, out: str = "ids") -> DataFrame:
    """``[lang]`` + text with spaces as ``[SPACE]`` → ids (zh → zh-cn).

    Pieces are special tokens or pre-tokenised words.  Rows of one key are brought
    together as texts; rows that share a key give their pieces in turn."""
    vmap = {r.token: r.id for r in vocab.collect()}     # the model: as large as training made it
    ranks = {tuple(m): i for i, m in enumerate(merges)}
    unk = vmap.get("[UNK]", 1)
    special = r"\[SPACE\]|\[STOP\]|\[UNK\]|\[START\]|\[[a-z]{2}(?:-[a-z]{2})?\]"

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def enc(docs: pd.Series) -> pd.Series:
        named = re.compile(special)

        @lru_cache(1 << 18)
        def piece_ids(piece: str) -> list[int]:
            if named.fullmatch(piece):
                return [vmap.get(piece, unk) if piece in SPECIAL_TOKENS else unk]
            return _bpe_word(unicodedata.normalize("NFKC", piece).lower(), ranks, vmap, unk)

        def ids(texts) -> list[int]:
            if len(texts) == 1:
                return [x for piece in texts[0] for x in piece_ids(piece)]
            return [x for _, p in sorted((i, piece_ids(piece)) for t in texts for i, piece in enumerate(t)) for x in p]
        return docs.map(ids)

    code = F.when(F.col(lang) == "zh", F.lit("zh-cn")).otherwise(F.split_part(F.col(lang), F.lit("-"), F.lit(1)))
    full = F.concat(F.lit("["), code, F.lit("]"), F.replace(F.col(text), F.lit(" "), F.lit("[SPACE]")))
    # Special tokens are split out first: a punctuation run never swallows a
    # following special token's bracket.
    piece_re = rf"(?U){special}|\w+|(?:(?!{special})[^\w\s])+"
    texts = df.select(key, full.alias("_t")).where(F.col("_t").isNotNull()).groupBy(key).agg(F.collect_list("_t").alias("_t"))
    pieces = F.transform("_t", lambda t: F.regexp_extract_all(t, F.lit(piece_re), F.lit(0)))
    return texts.select(key, enc(pieces).alias(out))


def decode_bpe(ids: Column, vocab_map: Column) -> Column:
    """J27 decode: tokens joined, ``[SPACE]`` → space, ``[STOP]``/``[UNK]`` dropped."""
    t = F.array_join(F.transform(ids, lambda i: F.try_element_at(vocab_map, i)), "")
    return F.replace(F.replace(F.replace(t, F.lit("[SPACE]"), F.lit(" ")), F.lit("[STOP]"), F.lit("")),
                     F.lit("[UNK]"), F.lit(""))
