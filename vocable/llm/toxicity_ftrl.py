"""Toxicity by FTRL-proximal logistic regression over hashed n-grams.

Features of a text, each present or not: words, pairs of neighbours, pairs that
skip one word, and words cut to their first 3 to 7 characters (a stem that needs
no language), hashed to ``2**BITS``.  Training is sequential by nature
and sees a bounded sample (``max_docs`` labelled documents, hash order): one
task runs FTRL with per-coordinate learning rates and L1, and hands back only
the weights that L1 left non-zero.  The features of the bounded sample bound
that model's size, all of it is broadcast; more than ``MAX_WEIGHTS`` weights
(64 MB) are an error that names their number, never a silent cut.  Scoring is
one pass over whole texts without a shuffle.

Edge cases: null and empty texts get the score of the bias; without any
training row every score is 0.5; labels of unknown documents and null labels are
ignored; repeated rows are scored each on its own; a text of any length is read
whole; an empty table gives an empty result; other columns are not read, so their
names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocable.llm.labelled import fold, in_one_task, training_sample
from vocable.llm.textbytes import U64, Texts, chunks, mix, shingle_hashes

BITS = 30
#: Features seen in fewer training documents can't be told from chance.
MIN_DOCS = 3
MAX_WEIGHTS = 1 << 22
STEMS = (3, 4, 5, 6, 7)
ALPHA, BETA, L1, L2, EPOCHS = 0.2, 1.0, 5.0, 1.0, 6

#: Word bytes: ASCII letters, digits, apostrophe, and everything beyond ASCII.
WORD = np.zeros(256, bool)
WORD[128:] = WORD[48:58] = WORD[65:91] = WORD[97:123] = True
WORD[39] = True


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, feature) pairs of a chunk, a feature possibly more than once a row."""
    t = Texts(texts, lower=True)
    row, s, e = t._runs(WORD[t.buf])
    w = t.hash_ranges(s, e)
    at2, h2 = shingle_hashes(row, w, 2)
    skip = np.flatnonzero(row[2:] == row[:-2]) if len(row) > 2 else np.zeros(0, np.int64)
    h3 = mix(w[skip] * U64(3) + mix(w[skip + 2] + U64(7))) if len(skip) else w[:0]
    lead = np.flatnonzero((t.buf & 0xC0) != 0x80)
    first, stop = np.searchsorted(lead, s), np.searchsorted(lead, e)
    rows, hashes = [row, row[at2], row[skip]], [w, h2, h3]
    for k in STEMS:
        longer = np.flatnonzero(stop - first > k)
        rows.append(row[longer])
        hashes.append(mix(t.hash_ranges(s[longer], lead[first[longer] + k]) + U64(k)))
    return np.concatenate(rows), (np.concatenate(hashes) >> U64(64 - BITS)).astype(np.int64), t.n


def ftrl(rows: list[np.ndarray], y: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """Weights by FTRL-proximal; ``rows`` are feature indices, ``size`` is the bias."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for i, t in zip(rows, y):
            w = weights(i)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -30, 30))) - t
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange(size + 1))
    return w[:-1], float(w[-1])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs, ys = [], []
    for batch in batches:
        for part in chunks(batch, "text"):
            row, f, n = features(part.column(0))
            pairs = np.unique((row.astype(np.int64) << BITS) | f)
            cut = np.searchsorted(pairs >> BITS, np.arange(n + 1))
            docs += [(pairs[a:b] & ((1 << BITS) - 1)).astype(np.int32) for a, b in zip(cut[:-1], cut[1:])]
            ys += part.column(1).to_pylist()
    if not docs:
        return
    keys, seen = np.unique(np.concatenate(docs), return_counts=True)
    keys = keys[seen >= MIN_DOCS]
    rows = []
    for d in docs:
        at = np.searchsorted(keys, d)
        at = at[(at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == d)] if len(keys) else at[:0]
        rows.append(np.append(at, len(keys)))
    w, bias = ftrl(rows, np.asarray(ys, float), len(keys))
    best = np.flatnonzero(w)
    if len(best) > MAX_WEIGHTS:
        raise ValueError(f"{len(best)} weights: raise L1 or lower max_docs")
    yield pa.RecordBatch.from_arrays([pa.array(np.append(keys[best], -1), pa.int64()),
                                      pa.array(np.append(w[best], bias), pa.float64())], names=["feature", "weight"])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", n_folds: int = 5, held_out: int = 0,
          max_docs: int = 12_000) -> tuple[np.ndarray, np.ndarray, float]:
    """(sorted feature ids, weights, bias) learned from the bounded sample."""
    sample = training_sample(docs, labels, label, n_folds, held_out, max_docs)
    got = in_one_task(sample).select("text", "y").mapInArrow(_train, "feature long, weight double").toPandas()
    got = got.sort_values("feature")
    bias = got.weight[got.feature == -1]
    body = got[got.feature >= 0]
    return body.feature.to_numpy(np.int64), body.weight.to_numpy(float), float(bias.iloc[0]) if len(bias) else 0.0


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, w, bias = shared.value
        low = np.zeros(1 << 20, bool)        # most features are ruled out by 20 bits
        low[keys & 0xFFFFF] = True
        for batch in batches:
            for part in chunks(batch, "text"):
                row, f, n = features(part.column(part.schema.get_field_index("text")))
                hit = low[f & 0xFFFFF]
                row, f = row[hit], f[hit]
                at = np.searchsorted(keys, f)
                ok = keys[np.minimum(at, len(keys) - 1)] == f if len(keys) else np.zeros(len(f), bool)
                pair = np.unique(row[ok] * np.int64(len(keys) + 1) + at[ok])
                r, k = pair // (len(keys) + 1), pair % (len(keys) + 1)
                total = bias + np.bincount(r, weights=w[k] if len(k) else None, minlength=n)
                yield pa.RecordBatch.from_arrays([
                    part.column(part.schema.get_field_index("doc_id")),
                    pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))), pa.float64())], names=["doc_id", "score"])
    return run


def toxicity(docs: DataFrame, labels: DataFrame, max_docs: int = 12_000, threshold: float = 0.5) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_docs=max_docs))
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, score double"
    return d.mapInArrow(_scorer(model), schema).select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
