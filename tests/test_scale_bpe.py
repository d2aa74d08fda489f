"""Merges of flat symbol arrays against a plain left-to-right pass."""

import numpy as np


def _plain(symbols, pairs):
    made = {(a, b): ab for a, b, ab in pairs}
    out, fresh = [], False
    for s in symbols:
        if out and not fresh and (out[-1], s) in made:
            out[-1], fresh = made[out[-1], s], True
        else:
            out.append(s)
            fresh = False
    return out


def test_merges_left_to_right():
    from vocable.operators.bpe import _merged

    rng = np.random.default_rng(3)
    words = [rng.integers(0, 5, rng.integers(1, 12)).tolist() for _ in range(500)] + [[1] * 7]
    pairs = [(1, 1, 7), (2, 3, 8)]
    word, sym = np.repeat(np.arange(len(words)), [len(w) for w in words]), np.array([s for w in words for s in w], "int32")
    at, got = _merged(word, sym, pairs)
    assert [got[at == k].tolist() for k in range(len(words))] == [_plain(w, pairs) for w in words]
