"""Document quality by a linear-chain conditional random field over lines.

Every line of a text is a node with two states, bad and good.  A node sees the
measurements of its own line and of its neighbours; edges carry a 2x2
transition.  Training documents lend their label to all their lines; the
parameters maximise the conditional likelihood of a bounded sample
(``max_docs`` labelled documents in hash order) by gradient steps whose
expectations come from forward-backward, in one task.  The model is a few dozen
numbers.  Scoring runs forward-backward over whole texts, one pass without a
shuffle; a document's score is the mean of its lines' marginals weighted by
line length.

Edge cases: null and empty texts are one empty line and get its marginal;
without a training row every score is 0.5; documents of any number of lines are
handled whole; repeated rows are scored each on its own; an empty table gives an
empty result; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocable.llm.labelled import fold, in_one_task, training_sample
from vocable.llm.textbytes import SPACE, U64, Texts, chunks, mix, shingle_hashes

L2, STEPS, RATE = 1e-3, 300, 0.1
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>{}[]=_~^\\@+"]] = True


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines per text, line length in bytes, feature matrix with neighbours)."""
    t = Texts(texts)
    b = t.buf
    row, ls, le = t.lines()
    n = len(row)

    def per_line(mask):
        c = np.zeros(len(b) + 1, np.int64)
        np.cumsum(mask, out=c[1:])
        return (c[le] - c[ls]).astype(float)

    wrow, ws, we = t._runs(~SPACE[b])
    line_of = np.searchsorted(le, ws, side="right") if len(ws) else ws
    words = np.bincount(line_of, minlength=n).astype(float)
    length = (le - ls).astype(float)
    end = b[we - 1] if len(we) else b[:0]
    h = t.hash_ranges(ws, we)
    distinct = np.unique(np.stack([line_of.astype(U64), h]), axis=1)[0].astype(np.int64) if len(h) else line_of
    at, tri = shingle_hashes(wrow, h, 3)
    # windows of three words met before in the same text
    key = mix(tri ^ mix(wrow[at].astype(U64))) if len(at) else tri
    first = np.zeros(len(key), bool)
    first[np.unique(key, return_index=True)[1]] = True
    again = np.bincount(line_of[at][~first], minlength=n)
    lkey = mix(t.hash_ranges(ls, le) ^ mix(row.astype(U64)))
    seen = np.ones(n, bool)
    seen[np.unique(lkey, return_index=True)[1]] = False
    w1, l1 = np.maximum(words, 1), np.maximum(length, 1)
    letters = np.maximum(per_line(((b | 32) >= 97) & ((b | 32) <= 122)), 1)
    own = np.stack([
        np.log1p(words) / 5,
        np.minimum(length / w1 / 10, 3),
        np.minimum(5 * per_line(_SYMBOL[b]) / l1, 2),
        per_line((b >= 65) & (b <= 90)) / letters,
        np.minimum(10 * per_line((b >= 48) & (b <= 57)) / l1, 2),
        np.minimum(10 * np.bincount(line_of[(end == 46) | (end == 33) | (end == 63)], minlength=n) / w1, 2),
        np.minimum(10 * per_line(b == 33) / w1, 2),
        np.minimum(10 * per_line(b == 124) / w1, 2),
        1 - np.bincount(distinct, minlength=n) / w1,
        again / w1,
        (seen & (words > 0)).astype(float),
        (words == 0).astype(float),
        ((words > 0) & (words < 5)).astype(float),
    ], axis=1)
    begin = np.r_[True, row[1:] != row[:-1]] if n else np.zeros(0, bool)
    stop = np.r_[row[1:] != row[:-1], True] if n else begin
    before, after = np.zeros_like(own), np.zeros_like(own)
    if n > 1:
        before[1:] = own[:-1]
        after[:-1] = own[1:]
    before[begin], after[stop] = 0, 0
    x = np.concatenate([own, before, after, begin[:, None], stop[:, None], np.ones((n, 1))], axis=1)
    return np.bincount(row, minlength=t.n), length + 1, x


def marginals(n_lines: np.ndarray, node: np.ndarray, trans: np.ndarray, with_pairs: bool = False):
    """P(good) of every line, and expected transition counts.

    ``node`` is the log-odds of good per line; all documents step together, the
    longest first, so that step *t* works on those with more than *t* lines.
    """
    order = np.argsort(-n_lines, kind="stable")
    start = np.r_[0, np.cumsum(n_lines)[:-1]][order]
    size = n_lines[order]
    steps = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(1, steps + 1), side="right")
    pot = np.stack([np.zeros(len(node)), node], axis=1)
    fwd, bwd = np.zeros((len(node), 2)), np.zeros((len(node), 2))
    fwd[start[size > 0]] = pot[start[size > 0]]
    for t in range(1, steps):
        i = start[:alive[t]] + t
        prev = fwd[i - 1]
        a0 = np.logaddexp(prev[:, 0] + trans[0, 0], prev[:, 1] + trans[1, 0])
        a1 = np.logaddexp(prev[:, 0] + trans[0, 1], prev[:, 1] + trans[1, 1])
        m = np.maximum(a0, a1 + node[i])
        fwd[i, 0], fwd[i, 1] = a0 - m, a1 + node[i] - m
    for t in range(steps - 2, -1, -1):
        i = start[:alive[t + 1]] + t
        nxt = bwd[i + 1] + pot[i + 1]
        b0 = np.logaddexp(trans[0, 0] + nxt[:, 0], trans[0, 1] + nxt[:, 1])
        b1 = np.logaddexp(trans[1, 0] + nxt[:, 0], trans[1, 1] + nxt[:, 1])
        m = np.maximum(b0, b1)
        bwd[i, 0], bwd[i, 1] = b0 - m, b1 - m
    d = fwd + bwd
    p = 1 / (1 + np.exp(np.clip(d[:, 0] - d[:, 1], -60, 60)))
    if not with_pairs:
        return p, None
    inner = np.ones(len(node), bool)
    inner[np.cumsum(n_lines)[n_lines > 0] - 1] = False
    i = np.flatnonzero(inner)
    joint = fwd[i][:, :, None] + trans[None] + (bwd[i + 1] + pot[i + 1])[:, None, :]
    joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
    return p, (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def fit(n_lines: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature weights, transition) by Adam on the mean log-likelihood per document."""
    line_y = np.repeat(y, n_lines).astype(float)
    edges = np.maximum(n_lines - 1, 0)
    seen = np.diag([edges[y == 0].sum(), edges[y == 1].sum()]).astype(float)
    # every document weighs the same, however many lines it has
    share = np.repeat(1 / np.maximum(n_lines, 1), n_lines)
    w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    m = [np.zeros_like(w), np.zeros_like(trans)]
    v = [np.zeros_like(w), np.zeros_like(trans)]
    for step in range(1, STEPS + 1):
        p, pairs = marginals(n_lines, x @ w, trans, True)
        grads = [x.T @ ((line_y - p) * share) / len(y) - L2 * w,
                 (seen - pairs) / max(1.0, edges.sum()) - L2 * trans]
        for k, (g, target) in enumerate(zip(grads, (w, trans))):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            target += RATE * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return w, trans


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, ys = [], []
    for batch in batches:
        for part in chunks(batch, "text"):
            parts.append(line_features(part.column(0)))
            ys += part.column(1).to_pylist()
    if not ys:
        return
    w, trans = fit(np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts]), np.asarray(ys))
    yield pa.RecordBatch.from_arrays([pa.array([w.tolist()]), pa.array([trans.ravel().tolist()])], names=["w", "trans"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", n_folds: int = 4, held_out: int = 2,
          max_docs: int = 6_000) -> tuple[np.ndarray, np.ndarray] | None:
    sample = training_sample(docs, labels, label, n_folds, held_out, max_docs)
    got = in_one_task(sample).select("text", "y").mapInArrow(_train, "w array<double>, trans array<double>").collect()
    return (np.array(got[0].w), np.array(got[0].trans).reshape(2, 2)) if got else None


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                n_lines, weight, x = line_features(part.column(part.schema.get_field_index("text")))
                if model is None:
                    score = np.full(part.num_rows, 0.5)
                else:
                    p, _ = marginals(n_lines, x @ model[0], model[1])
                    doc = np.repeat(np.arange(part.num_rows), n_lines)
                    score = np.bincount(doc, weights=p * weight, minlength=part.num_rows) / np.bincount(
                        doc, weights=weight, minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")),
                                                  pa.array(np.clip(score, 0, 1), pa.float64())], names=["doc_id", "score"])
    return run


def quality(docs: DataFrame, labels: DataFrame, max_docs: int = 6_000, threshold: float = 0.7) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    model = train(docs, labels, max_docs=max_docs)
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, score double"
    return d.mapInArrow(_scorer(model), schema).select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
