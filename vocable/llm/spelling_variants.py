"""Spelling variants by full one-edit neighbourhoods over a reduced alphabet.

1. *Vocabulary*.  Maximal letter runs of the texts are counted, partially per
   chunk and task before the shuffle, so a word that makes up a third of the
   corpus is one row per task.
2. *Reduction*.  Letters are hashed to a few symbols.  Words one edit apart have
   reduced words at most one edit apart.  The number of symbols is chosen by
   cost: more symbols mean larger neighbourhoods but fewer chance meetings.  The
   result does not depend on it.
3. *Neighbourhoods*.  The reduced words one edit away from each distinct reduced
   word go out as 64-bit keys, each once.  An unordered pair needs one of its two
   sides: insertions of a word are the deletions of a longer one and are left to
   it, and replacements go towards the larger key.
4. *Join and verification*.  Keys meet the reduced vocabulary, pairs of reduced
   words are widened to words, and the original strings are compared.  Equal
   keys of different reduced words only add candidates.
5. *Forms and roots*.  A word's form is its near word of largest count where
   that count is at least twice its own.  Counts at least double along a chain
   of forms, so chains are short and end; pointers are doubled over written
   tables until none moves.

Edge cases: null and empty texts have no words; a run of any length is one word;
a null doc_id hashes as the empty string; repeated rows count each; ties in the
count go to the smaller word in code-point order; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocable.llm.store import written
from vocable.llm.textbytes import U64, Texts, chunks, mix, spans

#: Shortest word in code points, fewest occurrences, share of dropped letters.
MIN_LENGTH, MIN_COUNT, DROP_EVERY = 5, 3, 97
#: Numbers of symbols to choose from.
SYMBOLS = (4, 6, 8, 12, 16, 24, 32)
#: Cost of a candidate pair against that of a neighbourhood key, and the share of the
#: symbols that count, as some letters are frequent.
CANDIDATE_COST, EVENNESS = 2.0, 0.7

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LEAD = 0xC3                     # first byte of U+00C0 to U+00FF in UTF-8, and of nothing else
_P = U64(0x9E3779B97F4A7C15)
_PINV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LEN = U64(0xD6E8FEB86659FD93)


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def crc32_ranges(buf: np.ndarray, s: np.ndarray, e: np.ndarray, begin: np.ndarray, step: int = 64) -> np.ndarray:
    """crc32 of ``prefix + buf[s:e]`` for each range; ``begin`` holds the crc32 of the prefixes."""
    order = np.argsort(s - e, kind="stable")             # longest first: those still running are a head
    size, at = (e - s)[order], s[order]
    state = ~begin[order].astype(np.uint32)
    for j in range(min(step, int(size[0]) if len(size) else 0)):
        k = int(np.searchsorted(-size, -j, side="left"))  # longer than j
        state[:k] = _CRC[(state[:k] ^ buf[at[:k] + j]) & 255] ^ (state[:k] >> np.uint32(8))
    out = np.empty(len(s), np.uint32)
    out[order] = ~state
    for i in np.flatnonzero(e - s > step):               # the rest of very long runs
        out[i] = zlib.crc32(buf[s[i] + step:e[i]].tobytes(), int(out[i]))
    return out


def _strings(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.Array:
    """``buf[s:e]`` of each range as a string array."""
    flat = buf[spans(s, e - s)] if len(s) else buf[:0]
    off = np.r_[0, np.cumsum(e - s)].astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(s), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(flat))])


def _words(drop_every: int, min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", 1 << 22):
                t = Texts(part.column(part.schema.get_field_index("text")), lower=True)
                lead = t.buf == _LEAD
                row, s, e = t._runs(_LETTER[t.buf] | lead | np.r_[False, lead[:-1]])
                if not len(s):
                    continue
                doc_ids = part.column(part.schema.get_field_index("doc_id")).to_pylist()
                prefix = np.array([zlib.crc32(f"{'' if d is None else d}:".encode()) for d in doc_ids], np.uint32)
                h = crc32_ranges(t.buf, s, e, prefix[row]).astype(np.int64)
                leads = np.r_[0, np.cumsum(lead)]
                length = (e - s) - (leads[e] - leads[s])
                hit = h % drop_every == 0
                changed = {}
                for i in np.flatnonzero(hit & (length > min_length)):
                    w = t.buf[s[i]:e[i]].tobytes().decode()
                    at = int(h[i] % length[i])
                    w = w[:at] + w[at + 1:]
                    changed[w] = changed.get(w, 0) + 1
                plain = ~hit & (length >= min_length)
                s, e = s[plain], e[plain]
                _, first, n = np.unique(t.hash_ranges(s, e), return_index=True, return_counts=True)
                words = _strings(t.buf, s[first], e[first])
                yield pa.RecordBatch.from_arrays([words, pa.array(n.astype(np.int64))], names=["word", "n"])
                if changed:
                    yield pa.RecordBatch.from_arrays([pa.array(list(changed), pa.string()), pa.array(list(changed.values()), pa.int64())],
                                                     names=["word", "n"])
    return run


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", drop_every: int = DROP_EVERY,
               min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): lower-cased letter runs, one letter dropped in every ``drop_every``-th by hash."""
    d = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    counted = d.mapInArrow(_words(drop_every, min_length), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def symbol_table(symbols: int) -> np.ndarray:
    """Code point below 256 → symbol, by hash."""
    return (mix(np.arange(256, dtype=U64) + U64(1)) % U64(symbols)).astype(np.uint8)


class Reduced:
    """The reduced words of a chunk: symbols of all letters, one word after the other."""

    def __init__(self, words: pa.Array, symbols: int):
        t = Texts(words)
        lead = t.buf == _LEAD
        code = t.buf.astype(np.int64) + 64 * np.r_[False, lead[:-1]]
        leads = np.r_[0, np.cumsum(lead)]
        self.sym = symbol_table(symbols)[code[~lead]].astype(U64)
        self.start, end = t.start - leads[t.start], t.end - leads[t.end]
        self.size = end - self.start
        self.word = np.repeat(np.arange(t.n), self.size)
        self.pos = np.arange(len(self.sym)) - self.start[self.word]
        longest = int(self.size.max(initial=0)) + 2
        power = np.full(longest, _P, U64)
        power[0] = 1
        self.power = np.multiply.accumulate(power)
        # prefix sums inside each word: value of the letters before each letter, and of all
        term = (self.sym + U64(1)) * self.power[self.pos]
        total = np.r_[U64(0), np.cumsum(term)]
        self.before = total[:-1] - total[self.start][self.word]
        self.term, self.value = term, total[end] - total[self.start]
        self.symbols = symbols

    @staticmethod
    def key(value: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mix(value ^ mix(size.astype(U64) * _LEN))

    def own(self) -> np.ndarray:
        return self.key(self.value, self.size)

    def strings(self) -> pa.Array:
        return _strings((self.sym + U64(65)).astype(np.uint8), self.start, self.start + self.size)

    def deletions(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word, key) of every reduced word that is one symbol shorter, each once."""
        same = np.r_[False, (self.sym[1:] == self.sym[:-1]) & (self.pos[1:] > 0)]   # as the letter before
        after = self.value[self.word] - self.before - self.term
        cut = ~same                                                     # the first letter of a run
        yield self.word[cut], self.key((self.before + after * _PINV)[cut], self.size[self.word[cut]] - 1)

    def replacements(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word, key) of every reduced word with one other symbol, each once."""
        rest = self.value[self.word] - self.term
        for d in range(1, self.symbols):
            c = (self.sym + U64(d)) % U64(self.symbols)
            yield self.word, self.key(rest + (c + U64(1)) * self.power[self.pos], self.size[self.word])

    def insertions(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word, key) of every reduced word that is one symbol longer, each once."""
        last = np.full(len(self.size), U64(self.symbols))
        last[self.size > 0] = self.sym[(self.start + self.size - 1)[self.size > 0]]
        for c in range(self.symbols):                                   # never after the same symbol
            i = np.flatnonzero((self.pos == 0) | (np.r_[U64(self.symbols), self.sym[:-1]] != c))
            w = self.word[i]
            rest = (self.value[w] - self.before[i]) * _P
            yield w, self.key(self.before[i] + U64(c + 1) * self.power[self.pos[i]] + rest, self.size[w] + 1)
            k = np.flatnonzero(last != c)                               # at the end
            yield k, self.key(self.value[k] + U64(c + 1) * self.power[self.size[k]], self.size[k] + 1)


def _reduce(symbols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "word"):
                r = Reduced(part.column(part.schema.get_field_index("word")), symbols)
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index("word")), part.column(part.schema.get_field_index("n")),
                     r.strings(), pa.array(r.own().view(np.int64))], names=["word", "n", "reduced", "own"])
    return run


def _neighbourhoods(symbols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "word", 1 << 17):
                r = Reduced(part.column(part.schema.get_field_index("word")), symbols)
                own = r.own().view(np.int64)
                for w, key in r.deletions():
                    yield pa.RecordBatch.from_arrays([pa.array(own[w]), pa.array(key.view(np.int64))], names=["a", "b"])
                for w, key in r.replacements():
                    key, mine = key.view(np.int64), own[w]
                    up = key > mine
                    yield pa.RecordBatch.from_arrays([pa.array(mine[up]), pa.array(key[up])], names=["a", "b"])
    return run


def best_symbols(lengths: dict[int, int]) -> int:
    """The number of symbols of least estimated cost for {word length: words}: a reduced
    word of length L sends about L (r + 1) / 2 keys, and a word's neighbourhood of r L
    keys meets ``n / r**L`` words each, half of which it is compared with."""
    def cost(r: int) -> float:
        space = {L: (EVENNESS * r) ** L for L in lengths}
        return sum(min(n, space[L]) * L * (r + 1) / 2 + CANDIDATE_COST * n * r * L * n / space[L] / 2 for L, n in lengths.items())
    return min(SYMBOLS, key=cost)


def near_words(vocab: DataFrame, symbols: int | None = None) -> DataFrame:
    """(word, n, near, near_n), both directions: words of ``vocab`` (word, n; letters up to
    U+00FF, each word once) that differ by exactly one code point."""
    if symbols is None:
        size = vocab.groupBy(F.least(F.length("word"), F.lit(64)).alias("size")).agg(F.count(F.lit(1)).alias("words"))
        symbols = best_symbols({r["size"]: r["words"] for r in size.collect()})
    v = written(vocab.mapInArrow(_reduce(symbols), "word string, n long, reduced string, own long"), "spelling-reduced")
    reduced = v.groupBy("reduced").agg(F.min("word").alias("word"), F.min("own").alias("own"))
    keys = reduced.select("word").mapInArrow(_neighbourhoods(symbols), "a long, b long")
    met = keys.join(reduced.select(F.col("own").alias("b")).distinct().hint("merge"), "b")
    alone = v.groupBy("own").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("own").alias("a"), F.col("own").alias("b"))
    pairs = met.select("a", "b").unionByName(alone)
    left = v.select(F.col("own").alias("a"), F.col("word").alias("u"), F.col("n").alias("nu"))
    right = v.select(F.col("own").alias("b"), F.col("word").alias("w"), F.col("n").alias("nw"))
    cand = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").where(
        ((F.col("a") != F.col("b")) | (F.col("u") < F.col("w"))) & (F.levenshtein("u", "w", 1) == 1))
    cand = cand.select("u", "nu", "w", "nw")
    both = F.explode(F.array(F.struct(F.col("u").alias("word"), F.col("nu").alias("n"), F.col("w").alias("near"), F.col("nw").alias("near_n")),
                             F.struct(F.col("w").alias("word"), F.col("nw").alias("n"), F.col("u").alias("near"), F.col("nu").alias("near_n"))))
    return cand.select(both.alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the end of each chain; forms must not run in circles."""
    at = written(forms.select("word", F.col("form").alias("root")), "spelling-root")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ahead = at.join(step, "root", "left")
        if ahead.where("further is not null").isEmpty():
            return at
        at = written(ahead.select("word", F.coalesce("further", "root").alias("root")), "spelling-root")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", symbols: int | None = None) -> DataFrame:
    """Per word of the corpus: word, n, n_near, form, form_n, root."""
    vocab = written(vocabulary(docs, doc_id, text), "spelling-vocabulary")
    best = near_words(vocab, symbols).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    has = -F.col("best.less") >= 2 * F.col("n")
    words = written(vocab.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")), "spelling-forms")
    end = roots(words.where("form is not null").select("word", "form"))
    return words.join(end, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
