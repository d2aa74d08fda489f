"""Removal of repeated passages by two-stage suffix sorting.

Every byte is removed that lies in a string of ``length`` bytes which starts at
more than one place of the corpus.  Sorting all suffixes of a corpus in one
place is out of the question, so the work is cut into shards that lose no match:

1. *Anchors*.  Of the ``GRAM``-byte grams in each ``length``-byte window the one
   with the smallest hash is the window's anchor (ties: the last).  Equal
   windows have equal anchors at equal places, so two of them meet under the
   anchor's fingerprint.  About one byte in 70 is an anchor.  With it goes a
   hash of its context, the bytes of all windows that it is the anchor of.
2. *Pre-aggregation*.  Fingerprints seen once are dropped.  Occurrences with one
   and the same context become one class; a class of two or more is repeated
   over its whole context.  Only one representative of each class goes on, and
   only where a fingerprint has several classes.
3. *Shards*.  The contexts of several fingerprints form a shard of bounded size,
   whose suffixes are sorted in two stages: suffixes smaller than their
   successor are sorted directly (eight bytes at a time, ties only), the others
   are induced by scanning the buckets of first bytes from the smallest up.
   Common prefixes of neighbours in that order that reach ``length`` tell which
   windows of one fingerprint are equal.
4. *Hot fingerprints* with more than ``HOT`` classes (the edge of a passage that
   a large part of the corpus shares) would make an unbounded shard: their
   windows are counted by hash instead, pre-aggregated, exact for any number.
5. Repeated windows go back to all occurrences of their class and are merged per
   document.

Edge cases: null text counts as empty; texts shorter than ``length`` keep
everything; runs of one byte and other periodic texts match themselves and are
merged before the shuffle; rows that repeat an id are told apart by a checksum
of their text (equal rows get equal results, their spans are merged before they
are handed out); a null id is kept as null, and a hash of the text stands for it
inside, so that rows without an id don't meet; an empty table gives an empty
result; other columns are not read, or carried along whole, so their names can't
clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocable.llm.store import scratch, written
from vocable.llm.textbytes import U64, Texts, chunks, mix

GRAM = 64
#: Contexts of one fingerprint in a shard, and bytes of a shard.
HOT, SHARD = 4096, 1 << 18
#: Window starts that are handled at once.
SEGMENT = 1 << 19
_POS = U64((1 << 24) - 1)

OCCURRENCE = "fp long, ctx long, doc_id long, chk int, span long, n int"


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values."""
    m = len(x) - w + 1
    pad = -len(x) % w
    b = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, U64)]).reshape(-1, w)
    left = np.minimum.accumulate(b, axis=1).ravel()
    right = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:m], left[w - 1:w - 1 + m])


def anchors(t: Texts, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, first window, last window) of each anchor: the windows inside
    rows that it is the smallest gram of, which follow each other."""
    b, w = t.buf, length - GRAM + 1
    none = np.zeros(0, np.int64)
    if len(b) < length:
        return none, none, none
    room = np.zeros(len(b) + 1, np.int64)       # window starts: those with `length` bytes left in their row
    full = np.flatnonzero(t.end - t.start >= length)
    np.add.at(room, t.start[full], 1)
    np.add.at(room, t.end[full] - length + 1, -1)
    starts = np.cumsum(room[:-1]) > 0
    out = []
    for a in range(0, len(b) - length + 1, SEGMENT):
        stop = min(len(b) - length + 1, a + SEGMENT)
        at = np.flatnonzero(starts[a:stop])
        if not len(at):
            continue
        i = np.arange(a, stop + w - 1)
        h = t.hash_ranges(i, i + GRAM)
        low = _sliding_min((h & ~_POS) | (_POS - (i - a).astype(U64)), w)[at]
        new = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        out.append(np.stack([(_POS - (low[new] & _POS)).astype(np.int64) + a, at[new] + a,
                             at[np.r_[new[1:], len(at)] - 1] + a]))
    if not out:
        return none, none, none
    p, lo, hi = np.concatenate(out, axis=1)
    new = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])      # a run may go on in the next segment
    return p[new], lo[new], hi[np.r_[new[1:], len(p)] - 1]


def _merge(row: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Union of the intervals of each row; touching ones become one."""
    if not len(row):
        return row, a, b
    o = np.lexsort((a, row))
    row, a, b = row[o], a[o], b[o]
    base = row * (int(b.max()) + 2)              # rows laid out one after the other
    reach = np.maximum.accumulate(base + b)
    new = np.r_[True, (base + a)[1:] > reach[:-1]]
    at = np.flatnonzero(new)
    last = np.r_[at[1:], len(row)] - 1
    return row[at], a[at], reach[last] - base[at]


def _occurrences(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                t = Texts(part.column(part.schema.get_field_index("text")))
                ids = np.asarray(part.column(part.schema.get_field_index("doc_id")), np.int64)
                p, lo, hi = anchors(t, length)
                hi = hi + length
                row = np.searchsorted(t.end, p, side="right")
                fp = t.hash_ranges(p, p + GRAM)
                ctx = mix(t.hash_ranges(lo, hi) + (p - lo).astype(U64))
                chk = t.hash_ranges(t.start, t.end).view(np.int64).astype(np.int32)
                # occurrences of one class within the chunk: settled here, one of them goes on
                _, first, inv, n = np.unique(mix(fp ^ mix(ctx)), return_index=True, return_inverse=True, return_counts=True)
                many = n[inv] > 1
                one = np.sort(first)
                span = ((p - t.start[row]) << 16) | ((p - lo) << 8) | (hi - p)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(len(one), np.int32)), pa.array(fp[one].view(np.int64)), pa.array(ctx[one].view(np.int64)),
                     pa.array(ids[row[one]]), pa.array(chk[row[one]]), pa.array(span[one]),
                     pa.array(n[inv][one].astype(np.int32))],
                    names=["kind", "fp", "ctx", "doc_id", "chk", "span", "n"])
                r, a, b = _merge(row[many], (lo - t.start[row])[many], (hi - t.start[row])[many])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ones(len(r), np.int32)), pa.array(a), pa.array(b), pa.array(ids[r]), pa.array(chk[r]),
                     pa.array(np.zeros(len(r), np.int64)), pa.array(np.zeros(len(r), np.int32))],
                    names=["kind", "fp", "ctx", "doc_id", "chk", "span", "n"])
    return run


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, wanted anchors) → one row per wanted context with its bytes."""
    for batch in batches:
        for part in chunks(batch, "text", 1 << 20):
            t = Texts(part.column(part.schema.get_field_index("text")))
            chk = t.hash_ranges(t.start, t.end).view(np.int64).astype(np.int32)
            out = []
            for i, wanted in enumerate(part.column(part.schema.get_field_index("wanted")).to_pylist()):
                for w in wanted:
                    if w["chk"] == chk[i]:
                        pos, lo, hi = w["span"] >> 16, (w["span"] >> 8) & 255, w["span"] & 255
                        a = int(t.start[i]) + pos
                        out.append((w["fp"], w["ctx"], w["n"], lo, t.buf[a - lo:a + hi].tobytes()))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))],
                names=["fp", "ctx", "n", "lo", "bytes"])


def _words8(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as one big-endian number; zeros follow the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    out = np.zeros(len(text), U64)
    for j in range(8):
        out = (out << U64(8)) | padded[j:j + len(text)].astype(U64)
    return out


def two_stage_suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` in order of their first ``depth`` bytes (at least).

    Stage one sorts the suffixes that are smaller than their successor; stage two
    induces the others, bucket of the first byte by bucket.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    nxt = np.r_[text[1:], 0]
    differs = np.flatnonzero((text != nxt) | (np.arange(n) == n - 1))
    decide = differs[np.searchsorted(differs, np.arange(n))]       # end of the run of equal bytes
    small = (text[decide] < nxt[decide]) & (decide < n - 1)        # the last suffix is larger than the empty one

    # stage one: direct sort by the first `depth` bytes
    idx = np.flatnonzero(small)
    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, depth)[idx]
    # numpy compares fixed-width byte strings with zeros at the end as the shorter string
    idx = idx[np.argsort(np.ascontiguousarray(rows).view(f"S{depth}").ravel(), kind="stable")]

    # stage two: left to right, bucket by bucket
    first = text[idx]
    cut = np.searchsorted(first, np.arange(257))
    arrive: list[list[np.ndarray]] = [[] for _ in range(256)]
    arrive[text[n - 1]].append(np.array([n - 1]))                  # smallest of its bucket
    out = []

    def send(seen: np.ndarray, c: int) -> np.ndarray:
        """Hand on the larger predecessors of ``seen``; return those of the same bucket."""
        before = seen[seen > 0] - 1
        before = before[~small[before]]
        ch = text[before]
        o = np.argsort(ch, kind="stable")
        before, ch = before[o], ch[o]
        stops = np.flatnonzero(np.r_[True, ch[1:] != ch[:-1], True]) if len(ch) else np.zeros(1, np.int64)
        own = before[:0]
        for a, b in zip(stops[:-1], stops[1:]):
            if ch[a] == c:
                own = before[a:b]
            else:
                arrive[ch[a]].append(before[a:b])
        return own

    for c in range(256):
        queue = np.concatenate(arrive[c]) if arrive[c] else np.zeros(0, np.int64)
        arrive[c] = []
        while len(queue):
            out.append(queue)
            queue = send(queue, c)
        direct = idx[cut[c]:cut[c + 1]]
        if len(direct):
            out.append(direct)
            send(direct, c)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of each suffix in ``order`` and the one before
    it, up to ``depth``; the first has none."""
    words = np.concatenate([_words8(text), np.zeros(depth + 16, U64)])
    a, b = order[:-1], order[1:]
    lcp = np.minimum(depth, len(text) - np.maximum(a, b))
    alive = np.arange(len(a))
    for d in range(0, depth, 8):
        x = words[a[alive] + d] ^ words[b[alive] + d]
        end = np.flatnonzero(x)
        # leading zero bytes of the difference are common bytes
        same = sum((x[end] < U64(1 << 8 * k)).astype(np.int64) for k in range(1, 8))
        lcp[alive[end]] = np.minimum(lcp[alive[end]], d + same)
        alive = alive[x == 0]
        if not len(alive):
            break
    return np.r_[0, lcp]


def repeated_windows(fp: np.ndarray, n: np.ndarray, lo: np.ndarray, parts: list[bytes], length: int):
    """(context, window start relative to the anchor) of every window of a shard that
    another context of the same fingerprint holds at the same place."""
    size = np.array([len(x) for x in parts], np.int64)
    text = np.frombuffer(b"".join(parts), np.uint8)
    order = two_stage_suffix_order(text, length)
    start = np.r_[0, np.cumsum(size)[:-1]]
    inside = np.repeat(np.arange(len(parts)), size)
    whole = (np.arange(len(text)) - start[inside] + length <= size[inside])[order]   # suffixes that begin a window
    at = order[whole]
    # neighbours among the windows: the smallest common prefix on the way between them
    cls = np.cumsum(common_prefixes(text, order, length) < length)[whole]
    ctx = inside[at]
    rel = at - start[ctx] - lo[ctx]
    group = np.unique(fp, return_inverse=True)[1][ctx]
    key = mix(mix(cls.astype(U64) * U64(1 << 32) + group.astype(U64)) + rel.astype(U64))
    _, run = np.unique(key, return_inverse=True)
    count = np.bincount(run, weights=n[ctx])
    twice = count[run] > 1
    return ctx[twice], rel[twice]


def _shard_windows(length: int):
    def solve(rows):
        fp, ctx, n, lo = (np.array([r[k] for r in rows], np.int64) for k in range(4))
        c, rel = repeated_windows(fp, n, lo, [r[4] for r in rows], length)
        low = int(rel.min()) if len(rel) else 0
        k, a, b = _merge(c, rel - low, rel - low + length)
        return pa.RecordBatch.from_arrays([pa.array(fp[k]), pa.array(ctx[k]), pa.array((a + low).astype(np.int32)),
                                           pa.array((b + low).astype(np.int32))], names=["fp", "ctx", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for r in zip(*[c.to_pylist() for c in batch.columns]):
                if rows and rows[-1][:2] == r[:2]:            # the representative's row occurs again
                    continue
                if size > SHARD and rows[-1][0] != r[0]:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[4])
        if rows:
            yield solve(rows)
    return run


def _window_hashes(length: int):
    """One row per window of a context: (fp, window start relative to the anchor, hash, context, n)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "bytes", 1 << 17):
                t = Texts(part.column(part.schema.get_field_index("bytes")))
                fp, ctx, n, lo = (np.asarray(part.column(part.schema.get_field_index(c)), np.int64)
                                  for c in ("fp", "ctx", "n", "lo"))
                many = np.maximum(0, t.end - t.start - length + 1)
                row = np.repeat(np.arange(t.n), many)
                off = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                s = t.start[row] + off
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fp[row]), pa.array((off - lo[row]).astype(np.int32)),
                     pa.array(t.hash_ranges(s, s + length).view(np.int64)), pa.array(ctx[row]), pa.array(n[row])],
                    names=["fp", "rel", "h", "ctx", "n"])
    return run


def _fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The contexts of representatives (doc_id, w) with their bytes."""
    per_doc = wanted.groupBy("doc_id").agg(F.collect_list("w").alias("wanted"))
    return docs.join(per_doc.hint("merge"), "doc_id").select("text", "wanted").mapInArrow(
        _contexts, "fp long, ctx long, n long, lo int, bytes binary")


def repeated_spans(docs: DataFrame, length: int = 200) -> DataFrame:
    """(doc_id, chk, a, b): byte ranges to remove, possibly overlapping; ``docs`` has doc_id, text."""
    if not GRAM < length <= 255:
        raise ValueError("length must be above the gram size and below 256")
    spark = docs.sparkSession
    path = scratch(spark, "suffix-anchors")
    docs.mapInArrow(_occurrences(length), "kind int, " + OCCURRENCE).write.partitionBy("kind").parquet(path)
    back = spark.read.schema(OCCURRENCE + ", kind int").parquet(path)
    occ = back.where("kind = 0").drop("kind")
    local = back.where("kind = 1").select("doc_id", "chk", F.col("fp").alias("a"), F.col("ctx").alias("b"))

    seen_again = occ.groupBy("fp").agg(F.sum("n").alias("total")).where("total > 1").select("fp")
    occ = written(occ.join(seen_again.hint("merge"), "fp"), "suffix-shared")
    classes = written(occ.groupBy("fp", "ctx").agg(F.sum("n").alias("n"),
                                                   F.min(F.struct("doc_id", "chk", "span")).alias("rep")), "suffix-classes")
    crowd = classes.groupBy("fp").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1")
    crowd = written(crowd, "suffix-crowd")

    wanted = classes.join(crowd.select("fp", "m"), "fp").select("rep.doc_id", "m", F.struct(
        "rep.chk", "rep.span", "fp", "ctx", "n").alias("w"))
    shards = _fetch(docs, wanted.where(F.col("m") <= HOT)).repartition("fp").sortWithinPartitions("fp", "ctx")
    found = shards.mapInArrow(_shard_windows(length), "fp long, ctx long, a int, b int")
    hot = _fetch(docs, wanted.where(F.col("m") > HOT)).mapInArrow(
        _window_hashes(length), "fp long, rel int, h long, ctx long, n long")
    twice = hot.groupBy("fp", "rel", "h").agg(F.sum("n").alias("total")).where("total > 1").drop("total")
    found_hot = hot.join(twice, ["fp", "rel", "h"]).select("fp", "ctx", F.col("rel").alias("a"))
    # windows of a hot fingerprint that follow each other become one range
    found_hot = found_hot.groupBy("fp", "ctx").agg(F.sort_array(F.collect_list("a")).alias("at")).select(
        "fp", "ctx", F.explode(_ranges("at", length)).alias("r")).select("fp", "ctx", "r.a", "r.b")
    whole = classes.where("n > 1").select(
        "fp", "ctx", (-F.shiftright("rep.span", 8).bitwiseAND(F.lit(255))).cast("int").alias("a"),
        F.col("rep.span").bitwiseAND(F.lit(255)).cast("int").alias("b"))
    ranges = whole.unionByName(found)
    if not crowd.where(F.col("m") > HOT).isEmpty():
        ranges = ranges.unionByName(found_hot)
    pos = F.shiftright("span", 16)
    spread = occ.select("fp", "ctx", "doc_id", "chk", "span").join(ranges.hint("merge"), ["fp", "ctx"]).select(
        "doc_id", "chk", (pos + F.col("a")).cast("long").alias("a"), (pos + F.col("b")).cast("long").alias("b"))
    return spread.unionByName(local)


def _ranges(col: str, length: int):
    """Sorted window starts → merged ranges (a, b)."""
    empty = F.array().cast("array<struct<a:int,b:int>>")
    return F.aggregate(col, empty, lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["b"] >= x),
        F.concat(F.slice(acc, 1, F.size(acc) - 1),
                 F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), (x + length).cast("int").alias("b"))))
    ).otherwise(F.concat(acc, F.array(F.struct(x.alias("a"), (x + length).cast("int").alias("b"))))))


def _remover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            t = Texts(part.column(part.schema.get_field_index("text")))
            chk = t.hash_ranges(t.start, t.end).view(np.int64).astype(np.int32)
            removed, n_spans, kept = [], [], []
            for i, spans in enumerate(part.column(part.schema.get_field_index("spans"))):
                body = t.buf[t.start[i]:t.end[i]]
                n_spans.append(0)
                if spans.is_valid:
                    c, a, b = (np.asarray(spans.values.field(k)) for k in ("chk", "a", "b"))
                    own = c == chk[i]
                    _, a, b = _merge(np.zeros(int(own.sum()), np.int64), a[own], b[own])
                    edge = np.zeros(len(body) + 1, np.int64)
                    edge[a] += 1
                    edge[b] -= 1
                    body = body[np.cumsum(edge[:-1]) == 0]
                    n_spans[-1] = len(a)
                kept.append(body.tobytes())
                removed.append(int(t.end[i] - t.start[i]) - len(kept[-1]))
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index("row")), pa.array((t.end - t.start).astype(np.int64)),
                 pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()),
                 pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(kept, pa.binary()),
                 pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())],
                names=["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text"])


def _removed(docs: DataFrame, length: int, doc_id: str, text: str) -> DataFrame:
    """``row`` (all columns but the text, as a struct) and what stays of the text."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text])
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    d = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.xxhash64(body)).alias("doc_id"), body.alias("text"), row.alias("row"))
    spans = repeated_spans(d.select("doc_id", "text"), length).groupBy("doc_id").agg(
        F.collect_set(F.struct("chk", "a", "b")).alias("spans"))
    return d.join(spans.hint("merge"), "doc_id", "left").select("row", "text", "spans").mapInArrow(
        _remover, f"row {d.schema['row'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, "
                  "kept_sha256 string, kept binary, kept_text string")


def suffix_dedup(docs: DataFrame, length: int = 200, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay)."""
    out = _removed(docs.select(doc_id, text), length, doc_id, text)
    return out.select(F.col(f"row.{doc_id}").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def without_repeats(docs: DataFrame, length: int = 200, doc_id: str = "doc_id", text: str = "text",
                    size: str = "n_chars") -> DataFrame:
    """``docs`` with the bytes that stay as text (a character that a cut splits
    goes too) and its new length in ``size`` where that column exists; documents
    of which nothing but white space stays are left out."""
    out = _removed(docs, length, doc_id, text).where(
        F.col("kept_text").rlike(r"[^\x20\x09-\x0D]") | (F.col("n_removed") == 0))
    cols = {c: F.col(f"row.`{c}`") for c in docs.columns if c != text} | {text: F.col("kept_text")}
    if size in cols:
        cols[size] = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(cols[size]).cast(docs.schema[size].dataType)
    return out.select(*[cols[c].alias(c) for c in docs.columns])
