"""SentencePiece models on the tokenizers library.

The ``.model`` file is parsed here (protobuf wire format) and rebuilt as a
``tokenizers.Tokenizer``: normaliser (character map, dummy prefix, white space
folding), the metaspace marker, unigram scores or the merges that BPE scores
imply, and byte fallback.  Batches are encoded and decoded by the library's own
threads.  Parity with the sentencepiece library is a column of the result.

Each row is handled alone, so the whole operator is one pass without a shuffle;
the model's bytes (``MAX_MODEL_BYTES`` at most, checked) go to the executors in
a broadcast.

Edge cases: null text counts as empty and has no ids; empty tables give empty
results; repeated rows are handled each on its own; a text of any length is
encoded whole; other columns are not passed on.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocable.llm.textbytes import Texts, chunks, spans

MARK = "▁"
MAX_MODEL_BYTES = 64 << 20
#: Fixed values of the model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    fold_spaces: bool = True
    escape_spaces: bool = True


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        c = b[i]
        out |= (c & 0x7F) << shift
        i, shift = i + 1, shift + 7
        if c < 0x80:
            return out, i


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protobuf message; nested messages stay bytes."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            v, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            v, i = b[i:i + n], i + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            v, i = b[i:i + n], i + n
        else:
            raise ValueError(f"wire type {kind} is not part of the format")
        yield key >> 3, v


def parse(data: bytes) -> Model:
    m = Model()
    for no, v in _fields(data):
        if no == 1:
            piece, score, kind = "", 0.0, NORMAL
            for k, x in _fields(v):
                if k == 1:
                    piece = x.decode("utf-8")
                elif k == 2:
                    score = struct.unpack("<f", x)[0]
                elif k == 3:
                    kind = x
            m.pieces.append((piece, score, kind))
        elif no == 2:
            for k, x in _fields(v):
                if k == 3:
                    m.model_type = x
                elif k == 35:
                    m.byte_fallback = bool(x)
        elif no == 3:
            for k, x in _fields(v):
                if k == 2:
                    m.charsmap = x
                elif k == 3:
                    m.dummy_prefix = bool(x)
                elif k == 4:
                    m.fold_spaces = bool(x)
                elif k == 5:
                    m.escape_spaces = bool(x)
    return m


def _merges(m: Model) -> list[tuple[str, str]]:
    """Every split of a piece into two pieces, best piece first; of one piece, the lower ids first."""
    known = {p: i for i, (p, _, kind) in enumerate(m.pieces) if kind in (NORMAL, USER_DEFINED)}
    out = []
    for p, i in known.items():
        for k in range(1, len(p)):
            a, b = known.get(p[:k]), known.get(p[k:])
            if a is not None and b is not None:
                out.append((-m.pieces[i][1], i, a, b, (p[:k], p[k:])))
    out.sort(key=lambda x: x[:4])
    return [x[4] for x in out]


def rebuild(m: Model):
    """The tokenizer of a parsed model."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unk = next((i for i, p in enumerate(m.pieces) if p[2] == UNKNOWN), None)
    if m.model_type == UNIGRAM:
        # control pieces are never produced from text: no score can win against them
        low = min((s for _, s, _ in m.pieces), default=0.0)
        scored = [(p, s if k in (NORMAL, USER_DEFINED, BYTE, UNKNOWN) else low - 1e6) for p, s, k in m.pieces]
        model = models.Unigram(scored, unk, m.byte_fallback)
    elif m.model_type == BPE:
        model = models.BPE({p: i for i, (p, _, _) in enumerate(m.pieces)}, _merges(m), fuse_unk=True,
                           unk_token=None if unk is None else m.pieces[unk][0], byte_fallback=m.byte_fallback)
    else:
        raise ValueError(f"model type {m.model_type} has no subword pieces to rebuild")
    tok = Tokenizer(model)
    steps = []
    if m.charsmap:
        steps.append(normalizers.Precompiled(m.charsmap))
    if m.fold_spaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ +| +$"), "")]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if m.escape_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    tok.normalizer = normalizers.Sequence(steps)
    if not any(MARK in p[1:].lstrip(MARK) for p, _, k in m.pieces if k in (NORMAL, USER_DEFINED)):
        # no piece holds a marker after another character: cutting before each
        # run of markers changes no segmentation, and words can be cached
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    user = [p for p, _, k in m.pieces if k == USER_DEFINED]
    if user:
        tok.add_tokens([AddedToken(p, normalized=False) for p in user])
    tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
                                    + ([decoders.Strip(" ", 1, 0)] if m.dummy_prefix else []))
    return tok


def _lists(ids: np.ndarray, n: np.ndarray) -> list[list[int]]:
    """The ids of each text."""
    flat, end = ids.tolist(), np.cumsum(n).tolist()
    return [flat[a:b] for a, b in zip([0] + end[:-1], end)]


class Codec:
    """Encodes and decodes batches of texts by a rebuilt model.

    Where the model's normaliser changes nothing but spaces and no piece crosses
    the start of a word, every distinct word is encoded once and looked up from
    then on; other models encode whole texts.  Either way the ids of every whole
    text are compared with the sentencepiece library's.
    """

    LIMIT, GROUP = 1 << 21, 512

    def __init__(self, data: bytes, threads: int = 2, verify: bool = True):
        os.environ.update(TOKENIZERS_PARALLELISM="true", RAYON_NUM_THREADS=str(threads))
        self.model, self.threads, self.sp = parse(data), threads, None
        self.tok = rebuild(self.model)
        if verify:
            import sentencepiece

            self.sp = sentencepiece.SentencePieceProcessor(model_proto=data)
        m = self.model
        self.by_word = (self.tok.pre_tokenizer is not None and m.dummy_prefix and m.escape_spaces
                        and not m.charsmap and not m.fold_spaces and not any(k == USER_DEFINED for _, _, k in m.pieces))
        self.marked = np.array([p.startswith(MARK) for p, _, _ in m.pieces])
        self.clear()

    def clear(self):
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.ptr = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tok.decode_batch(ids, skip_special_tokens=False)

    def encode_texts(self, texts: list[str]) -> tuple[list[list[int]], list[bool]]:
        """Ids of whole texts, and whether the sentencepiece library agrees."""
        ids = [e.ids if t else [] for t, e in
               zip(texts, self.tok.encode_batch_fast(texts, add_special_tokens=False))]
        return ids, [a == b for a, b in zip(ids, self.sp.encode(texts, num_threads=self.threads))] if self.sp else []

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, ids per text, parity per text)."""
        t = Texts(texts)
        raw = t.buf.tobytes()
        if not self.by_word or MARK.encode() in raw:
            ids, same = self.encode_texts([x or "" for x in texts.to_pylist()])
            n = np.array([len(x) for x in ids], np.int64)
            return np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum())), n, np.array(same, bool)
        row, s, e = self._words(t)
        h, first, inv = np.unique(t.hash_ranges(s, e), return_index=True, return_inverse=True)
        if len(self.keys) + len(h) > self.LIMIT:
            self.clear()
        at = np.searchsorted(self.keys, h)
        new = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != h) if len(self.keys) else np.arange(len(h))
        if len(new):
            pos = first[new]
            self._add([raw[a:b].decode("utf-8", "replace") for a, b in zip(s[pos].tolist(), e[pos].tolist())], h[new])
        w = self.slot[np.searchsorted(self.keys, h)][inv]
        n = self.ptr[w + 1] - self.ptr[w]
        ids, n = self.flat[spans(self.ptr[w], n)], np.bincount(row, weights=n, minlength=t.n).astype(np.int64)
        return ids, n, self._agrees(texts, ids, n) if self.sp else np.ones(t.n, bool)

    def _agrees(self, texts: pa.Array, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the library gives these ids for each whole text."""
        theirs = self.sp.encode([x or "" for x in texts.to_pylist()], num_threads=self.threads)
        return np.array([a == b for a, b in zip(_lists(ids, n), theirs)], bool)

    @staticmethod
    def _words(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of text from one run of spaces to the next, without the first
        space, which is the marker that encoding puts in front of any text."""
        space = t.buf == 32
        head = space.copy()
        head[1:] &= ~space[:-1]
        begin = t.start[t.end > t.start]
        head[begin] = True
        s = np.flatnonzero(head)
        e = np.r_[s[1:], len(t.buf)] if len(s) else s
        inner = np.ones(len(s), bool)
        inner[np.searchsorted(s, begin)] = False
        return np.searchsorted(t.end, s, side="right"), s + inner, e

    def _add(self, words: list[str], keys: np.ndarray) -> None:
        plain = [" " not in w and w != "" for w in words]
        some = [w for w, p in zip(words, plain) if p]
        groups = [" ".join(some[i:i + self.GROUP]) for i in range(0, len(some), self.GROUP)]
        ids = np.fromiter(chain.from_iterable(
            e.ids for i in range(0, len(groups), 8)
            for e in self.tok.encode_batch_fast(groups[i:i + 8], add_special_tokens=False)), np.int32)
        cut = np.r_[np.flatnonzero(self.marked[ids]), len(ids)]      # every word begins with a marked piece
        if len(cut) != len(some) + 1:
            raise ValueError("words and marked pieces do not match")
        lists, k = [], 0
        for w, p in zip(words, plain):
            if p:
                lists.append(ids[cut[k]:cut[k + 1]])
                k += 1
            else:                                                    # runs of spaces
                lists.append(np.array([x.id for x in self.tok.model.tokenize(MARK + w.replace(" ", MARK))], np.int32))
        base = len(self.ptr) - 1
        self.flat = np.concatenate([self.flat, *lists])
        self.ptr = np.concatenate([self.ptr, self.ptr[-1] + np.cumsum([len(x) for x in lists], dtype=np.int64)])
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.slot = np.insert(self.slot, at, base + np.arange(len(keys)))


_CODECS: dict[tuple, Codec] = {}


def _codec(shared, threads: int, verify: bool) -> Codec:
    """One codec per Python worker and model; tasks that follow each other share its words."""
    key = (zlib.crc32(shared.value), len(shared.value), threads, verify)
    if key not in _CODECS:
        _CODECS[key] = Codec(shared.value, threads, verify)
    return _CODECS[key]


def _coder(shared, threads: int, verify: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, threads, verify)
        for batch in batches:
            for part in chunks(batch, "text", 1 << 20):
                texts = part.column(part.schema.get_field_index("text"))
                ids, n, same = codec.encode(texts)
                off = np.r_[0, np.cumsum(n)]
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))
                little = ids.astype("<u4")
                back = pa.array(codec.decode(_lists(ids, n)), pa.string())
                yield pa.RecordBatch.from_arrays([
                    part.column(part.schema.get_field_index("doc_id")), lists,
                    pa.array([zlib.crc32(little[a:b]) for a, b in zip(off[:-1], off[1:])], pa.int64()), back,
                    pc.equal(pc.fill_null(texts, ""), back),
                    pa.array(same if verify else [None] * len(n), pa.bool_())],
                    names=["doc_id", "ids", "ids_crc32", "decoded", "round_trip", "parity"])
    return run


def sentencepiece_codec(docs: DataFrame, model_path: str, threads: int = 2, verify: bool = True,
                        doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ids and their CRC-32 (as little-endian unsigned 32-bit numbers), the decoded text, whether it equals the text, and
    whether the sentencepiece library gives the same ids (null without ``verify``).
    """
    with open(model_path, "rb") as f:
        data = f.read()
    if len(data) > MAX_MODEL_BYTES:
        raise ValueError(f"{model_path} has {len(data)} bytes, more than may be broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(data)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = (f"doc_id {d.schema['doc_id'].dataType.simpleString()}, ids array<int>, ids_crc32 long, decoded string, "
              "round_trip boolean, parity boolean")
    return d.mapInArrow(_coder(shared, threads, verify), schema)

