"""Lexical retrieval packing into windows of a fixed number of tokens.

Term weights are those of the whole table: tokenising counts, per task, the
documents of each term; the sums (as many as the tokenizer has ids) and the mean
length are broadcast.  Documents are sharded so that lexically close ones meet:
they are range partitioned by one of their terms, drawn by hash with a probability
that grows with the term's rarity, so that documents that share rare terms tend to
draw the same one (then by id, so that a group of copies of any size is cut into
even partitions).  Inside a partition, consecutive documents form index shards of
bounded token count; each shard holds a BM25 inverted index.  A seed document asks
the index for its unused neighbours, best first; those that fit fill its window,
the best one that does not is cut at the window's end and its rest opens the next
window.  An unfinished window is carried into the next shard of the task, and the
last one of a task is cut into sequences whose lengths are powers of two, which
need no padding.

A seed sees its own shard only.  README states, with figures, what share of the
neighbours over all documents that is, and what finding them would cost.

Texts are tokenised once; their ids are a table in the shared folder, so a lost
executor costs no second tokenisation.  One shuffle of ids; a shard's index and
documents are all that a task holds, whatever the partition's size.

Edge cases: null text counts as empty and yields the end id alone; repeated
rows are packed each on its own; ties in the score go to the earlier row of the
shard; a text longer than a window spans several; an empty table gives no
pieces; other columns are not passed on.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocable.llm.store import scratch
from vocable.llm.textbytes import LOWER, U64, Texts, chunks, mix, spans

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")
#: BM25 parameters, the size of an index shard in tokens, and the power of a term's rarity in the draw.
K1, B, SHARD_TOKENS, RARITY = 1.2, 0.75, 1 << 20, 5

PLAIN = re.compile("[a-z]+")
STOP, ALNUM = np.zeros(256, bool), np.zeros(256, bool)
STOP[[ord(c) for c in ".,;:!?"]] = True
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True


class WordCache:
    """Token ids of white-space separated words, encoded once per distinct word.

    Valid for lower-casing tokenizers that drop white space, never merge across
    it and split letters from punctuation.  Words are looked up lower-cased
    (ASCII) and without the full stops, commas and the like that end them;
    those are words of their own.  The cache is emptied at ``limit`` words.
    """

    def __init__(self, path: str, limit: int = 1 << 21):
        from tokenizers import Tokenizer

        self.tok, self.limit = Tokenizer.from_file(path), limit
        self.clear()

    def clear(self):
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.ptr = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _add(self, words: list[str], keys: np.ndarray) -> None:
        """Encode new ``words``; ``keys`` are their sorted hashes."""
        ids, n = [], []
        plain = [bool(PLAIN.fullmatch(w)) for w in words]
        model = self.tok.model
        rest = [w for w, p in zip(words, plain) if not p]
        other = iter(self._encode(rest))
        for w, p in zip(words, plain):
            # a run of a-z is one unit to every step before the model
            got = [x.id for x in model.tokenize(w)] if p else next(other)
            n.append(len(got))
            ids += got
        base = len(self.ptr) - 1
        self.flat = np.concatenate([self.flat, np.array(ids, np.uint32)])
        self.ptr = np.concatenate([self.ptr, self.ptr[-1] + np.cumsum(n, dtype=np.int64)])
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.slot = np.insert(self.slot, at, base + np.arange(len(keys)))

    def _encode(self, words: list[str]) -> Iterator[list[int]]:
        """Ids of each word through the whole tokenizer, a few hundred words a call."""
        for i in range(0, len(words), 512):
            some = words[i:i + 512]
            e = self.tok.encode(" ".join(some), add_special_tokens=False)
            start = np.cumsum([0] + [len(w) + 1 for w in some])
            at = np.searchsorted(start, [a for a, _ in e.offsets], side="right") - 1
            cut = np.searchsorted(at, np.arange(len(some) + 1))
            ids = e.ids
            yield from (ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text)."""
        t = Texts(texts)
        raw = t.buf.tobytes()
        if b"<|" not in raw:                     # upper-case look-alikes of special tokens keep their case
            t.buf = LOWER[t.buf]
            raw = t.buf.tobytes()
        row, s, e = self._split(t)
        word = t.hash_ranges(s, e)
        h, first, inv = np.unique(word, return_index=True, return_inverse=True)
        if len(self.keys) + len(h) > self.limit:
            self.clear()
        at = np.searchsorted(self.keys, h)
        new = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != h) if len(self.keys) else np.arange(len(h))
        if len(new):
            pos = first[new]
            self._add([raw[a:b].decode("utf-8", "replace") for a, b in zip(s[pos].tolist(), e[pos].tolist())], h[new])
        w = self.slot[np.searchsorted(self.keys, h)][inv]
        n = self.ptr[w + 1] - self.ptr[w]
        ids = self.flat[spans(self.ptr[w], n)]
        return ids, np.bincount(row, weights=n, minlength=t.n).astype(np.int64)

    @staticmethod
    def _split(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, the stops that end one after an ASCII letter or digit being separate."""
        row, s, e = t.words()
        if not len(s):
            return row, s, e
        b = t.buf
        cut = STOP[b[e - 1]] & (e - s > 1)
        alnum = ALNUM[b[np.maximum(e - 2, 0)]] & cut
        w = np.flatnonzero(alnum)
        order = np.argsort(np.concatenate([s, e[w] - 1]), kind="stable")
        row2 = np.concatenate([row, row[w]])[order]
        s2 = np.concatenate([s, e[w] - 1])[order]
        e2 = e.copy()
        e2[w] -= 1
        return row2, s2, np.concatenate([e2, e[w]])[order]


_CACHES: dict[str, WordCache] = {}


def word_cache(path: str) -> WordCache:
    """One cache per Python worker; tasks that follow each other share it."""
    if path not in _CACHES:
        _CACHES[path] = WordCache(path)
    return _CACHES[path]


class Corpus:
    """What a term's weight needs from all documents: their number, mean length and each term's documents."""

    def __init__(self, n: int, tokens: int, df: np.ndarray):
        self.n, self.tokens, self.df = n, tokens, df
        self.mean = tokens / max(1, n)
        self.idf = np.maximum(np.log((n - df + 0.5) / (df + 0.5)), 0.0)      # terms of half the documents say nothing
        draw = -np.log((mix(np.arange(len(df), dtype=U64) + U64(1)) >> U64(11)).astype(float) / (1 << 53) + 1e-18)
        with np.errstate(divide="ignore"):
            self.draw = np.where(self.idf > 0, draw / self.idf ** RARITY, np.inf)

    def signatures(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The term that each text draws, hashed; texts without a telling term come last."""
        out = np.full(len(size), np.iinfo(np.int64).max)
        full = np.flatnonzero(size)
        if len(full):
            begin = (np.cumsum(size) - size)[full]
            value = self.draw[ids]
            least = np.minimum.reduceat(value, begin)
            first = np.flatnonzero(value == np.repeat(least, size[full]))
            text = np.searchsorted(begin, first, side="right") - 1
            some, at = np.unique(text, return_index=True)
            told = np.isfinite(least[some])
            out[full[some[told]]] = (mix(ids[first[at[told]]].astype(U64)) >> U64(1)).astype(np.int64)
        return out


class Bm25:
    """Inverted index of one shard; documents are arrays of token ids.  Without ``corpus`` the shard is the corpus."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus | None = None):
        n = len(docs)
        size = np.array([len(d) for d in docs], np.int64)
        term = np.concatenate(docs).astype(np.int64)
        key = term * n + np.repeat(np.arange(n), size)
        key = np.sort(key.astype(np.uint32) if key.max(initial=0) < 1 << 32 else key)
        begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        tf = np.diff(np.r_[begin, len(key)])
        key = key[begin].astype(np.int64)
        self.doc, term = key % n, key // n
        first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        self.terms, df = term[first], np.diff(np.r_[first, len(term)])
        self.ptr = np.concatenate([[0], np.cumsum(df)])
        if corpus is None:
            known = np.zeros(int(self.terms.max(initial=0)) + 1, np.int64)
            known[self.terms] = df
            corpus = Corpus(n, int(size.sum()), known)
        idf = np.repeat(corpus.idf[self.terms], df)
        self.weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[self.doc] / max(1.0, corpus.mean)))
        self.useful = np.concatenate([idf, [0.0]])[self.ptr[:-1]] > 0
        self.n = n

    def scores(self, query: np.ndarray) -> np.ndarray:
        """BM25 score of every document of the shard for the distinct ids of ``query``."""
        q = np.unique(query)
        at = np.searchsorted(self.terms, q)
        at = at[(at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == q)]
        at = at[self.useful[at]]
        p = spans(self.ptr[at], self.ptr[at + 1] - self.ptr[at])
        return np.bincount(self.doc[p], weights=self.weight[p], minlength=self.n)


class Packer:
    """Fills windows from index shards; an open window survives from shard to shard."""

    def __init__(self, window: int, first_sequence: int, corpus: Corpus | None = None):
        self.window, self.seq, self.corpus = window, first_sequence, corpus
        self.open: list[tuple] = []       # pieces (doc_id, start, ids, doc_tokens)
        self.room = window
        self.seed: np.ndarray | None = None
        self.rows: list[tuple] = []

    def place(self, doc_id, ids: np.ndarray) -> None:
        """Append a document, cutting it at window ends."""
        at = 0
        while at < len(ids):
            take = min(self.room, len(ids) - at)
            self.open.append((doc_id, at, ids[at:at + take], len(ids)))
            self.room -= take
            at += take
            if self.room == 0:
                self._emit(self.open)
                self.open, self.room = [], self.window
        self.seed = ids if self.open else None

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.seq, offset))
            offset += len(ids)
        self.seq += 1

    def shard(self, doc_ids: list, docs: list[np.ndarray]) -> None:
        index = Bm25(docs, self.corpus)
        size = np.array([len(d) for d in docs])
        unused = np.ones(len(docs), bool)
        first = 0
        while True:
            while first < len(docs) and not unused[first]:
                first += 1
            if first == len(docs):
                return
            if self.seed is None:         # an empty window: the next unused document is the seed
                unused[first] = False
                self.place(doc_ids[first], docs[first])
                continue
            score = index.scores(self.seed)
            rest = np.flatnonzero(unused)
            ranked = rest[np.argsort(-score[rest], kind="stable")]
            seed = self.seed
            while len(ranked):            # neighbours that fit, best first
                fits = np.flatnonzero(size[ranked] < self.room)
                if not len(fits):
                    break
                d = ranked[fits[0]]
                unused[d] = False
                self.place(doc_ids[d], docs[d])
                self.seed = seed
                ranked = np.delete(ranked, fits[0])
            if len(ranked):               # the best that does not fit fills the gap and opens the next window
                unused[ranked[0]] = False
                self.place(doc_ids[ranked[0]], docs[ranked[0]])

    def finish(self) -> None:
        """Cut what is open into sequences whose lengths are powers of two."""
        pieces, self.open, self.room, self.seed = self.open, [], self.window, None
        left = sum(len(p[2]) for p in pieces)
        while left:
            take = 1 << (left.bit_length() - 1)
            left -= take
            now = []
            while take:
                doc_id, start, ids, total = pieces.pop(0)
                n = min(take, len(ids))
                now.append((doc_id, start, ids[:n], total))
                if n < len(ids):
                    pieces.insert(0, (doc_id, start + n, ids[n:], total))
                take -= n
            self._emit(now)

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        cols = list(zip(*rows)) or [()] * 7
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)


def _ids_column(ids: np.ndarray, n: np.ndarray) -> pa.Array:
    """The little-endian ids of each text as bytes."""
    off = np.r_[0, 4 * np.cumsum(n)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(off), pa.py_buffer(ids.astype("<u4").tobytes())])


def _tokens(tokenizer: str, end_id: int):
    """Rows (0, doc_id, ids) of the texts and at the task's end rows (1, term, null, documents with it);
    term -1 has the documents, -2 their tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"     # Spark runs a task per core
        cache = word_cache(tokenizer)
        df, texts, tokens = np.zeros(1, np.int64), 0, 0
        names = ["kind", "doc_id", "ids", "n"]
        for batch in batches:
            for part in chunks(batch, "text", 1 << 20):
                ids, n = cache.encode(part.column(part.schema.get_field_index("text")))
                at = np.cumsum(n) + np.arange(len(n))      # the end id follows every text
                full = np.full(len(ids) + len(n), end_id, "<u4")
                body = np.ones(len(full), bool)
                body[at] = False
                full[body] = ids
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.zeros(len(n), np.int32)), part.column(part.schema.get_field_index("doc_id")), _ids_column(full, n + 1),
                    pa.array(n + 1)], names=names)
                texts, tokens = texts + len(n), tokens + len(full)
                key = np.sort(full.astype(np.int64) * len(n) + np.repeat(np.arange(len(n)), n + 1))
                term = key[np.r_[True, key[1:] != key[:-1]]] // len(n) if len(key) else key
                seen = np.bincount(term)
                if len(seen) > len(df):
                    df = np.pad(df, (0, len(seen) - len(df)))
                df[:len(seen)] += seen
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.ones(len(some) + 2, np.int32)), pa.array(np.r_[some, -1, -2]), pa.nulls(len(some) + 2, pa.binary()),
            pa.array(np.r_[df[some], texts, tokens])], names=names)
    return run


def _split(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows, number of ids of each) of a column of little-endian bytes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.asarray(pa.compute.binary_length(column), np.int64) // 4
    return np.frombuffer(b"".join(column.to_pylist()), "<u4"), n


def _signer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "ids", 1 << 22):
                ids, n = _split(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.signatures(ids, n)), part.column(1)],
                                                 names=["doc_id", "sig", "ids"])
    return run


def _packer(window: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        packer = Packer(window, (task.partitionId() if task else 0) << 32, shared.value)
        doc_ids, docs, tokens = [], [], 0
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids.append(doc_id)
                docs.append(np.frombuffer(raw.as_py(), "<u4"))
                tokens += len(docs[-1])
                if tokens >= SHARD_TOKENS:
                    packer.shard(doc_ids, docs)
                    yield packer.take()
                    doc_ids, docs, tokens = [], [], 0
        if docs:
            packer.shard(doc_ids, docs)
        packer.finish()
        yield packer.take()
    return run


def tokenised(d: DataFrame, tokenizer: str, end_id: int) -> tuple[DataFrame, Corpus]:
    """(doc_id, ids) of the rows (doc_id, text), as a table in the shared folder, and the term statistics of all of them."""
    spark = d.sparkSession
    path, schema = scratch(spark, "packing-ids"), "doc_id long, ids binary, n long"
    d.mapInArrow(_tokens(tokenizer, end_id), "kind int, " + schema).write.partitionBy("kind").parquet(path)
    both = spark.read.schema(schema + ", kind int").parquet(path)
    # one row per id of the tokenizer
    df = both.where("kind = 1").groupBy("doc_id").agg(F.sum("n").alias("n")).toPandas().set_index("doc_id").n
    counts = np.zeros(max(1, int(df.index.max()) + 1 if len(df) else 1), np.int64)
    terms = df[df.index >= 0]
    counts[terms.index.to_numpy()] = terms.to_numpy()
    return both.where("kind = 0").select("doc_id", "ids"), Corpus(int(df.get(-1, 0)), int(df.get(-2, 0)), counts)


def retrieval_packing(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = 4096,
                      doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    ``tokenizer`` is the path of a tokenizers-library JSON file of the kind that
    :class:`WordCache` describes.  Pieces of one sequence are gapless from offset
    0; a sequence is ``window`` long or a power of two.
    """
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ids, corpus = tokenised(d, tokenizer, end_id)
    shared = docs.sparkSession.sparkContext.broadcast(corpus)
    ids = ids.mapInArrow(_signer(shared), "doc_id long, sig long, ids binary")
    ids = ids.repartitionByRange("sig", "doc_id").sortWithinPartitions("sig", "doc_id", "ids")
    return ids.select("doc_id", "ids").mapInArrow(_packer(window, shared), SCHEMA)
