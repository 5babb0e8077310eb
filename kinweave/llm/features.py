"""Hashed features of texts for the classifiers, computed on whole Arrow batches.

A token is a run of word bytes (ASCII letters, digits, ``_`` and all bytes of
non-ASCII characters) or a run of other bytes that are not white space.
"""

from __future__ import annotations

import numpy as np

from . import bytetext as bt

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_PUNCT = ~_WORD & ~bt.SPACE

_A, _B, _C, _D = (np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, is a word) of all tokens, in order."""
    ws, we = bt.runs(_WORD[data], offsets)
    ps, pe = bt.runs(_PUNCT[data], offsets)
    starts = np.concatenate([ws, ps])
    order = np.argsort(starts, kind="stable")
    return starts[order], np.concatenate([we, pe])[order], (np.arange(len(starts)) < len(ws))[order]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased word runs: (hash, start, end, words before each text and in all)."""
    starts, ends = bt.runs(_WORD[data], offsets)
    return bt.hash_runs(bt.FOLD[data], starts, ends), starts, ends, np.searchsorted(starts, offsets)


def prefix_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(word's place, hash) for the first ``length`` bytes of each word that is longer."""
    at = np.flatnonzero(ends - starts > length)
    return at, bt.mix(bt.hash_runs(bt.FOLD[data], starts[at], starts[at] + length) + np.uint64((length * int(_A)) % (1 << 64)))


def ngrams(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of each feature, features before each text and in all) of the quality model.

    For each token: the lower-cased token, its bigram, its shape, and the
    shapes of three tokens in a row. A token that repeats the one before it
    counts as one special token in all but the first, so repetition itself is
    a feature.
    """
    starts, ends, is_word = tokens(data, offsets)
    n = len(starts)
    h = bt.hash_runs(bt.FOLD[data], starts, ends)
    cut = np.searchsorted(starts, offsets)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first = np.zeros(n, dtype=bool)
    first[cut[:-1][cut[:-1] < n]] = True
    length = ends - starts
    uppers = np.concatenate([[0], np.cumsum(_UPPER[data])])
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    up, dig = uppers[ends] - uppers[starts], digits[ends] - digits[starts]
    shape = np.where(~is_word, 1 + np.minimum(length, 4), np.where(up == 0, 6, np.where(up == length, 7, np.where((up == 1) & _UPPER[data[starts]], 8, 9))))
    shape = np.where(is_word & (dig > 0), np.where(dig == length, 10, 11), shape)
    shape = np.where(is_word, shape + 8 * np.minimum(length // 6, 3), shape).astype(np.uint64)
    again = np.zeros(n, dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & ~first[1:]
    shape = np.where(again, np.uint64(99), shape)
    marked = np.where(again, np.uint64(99), h)
    before = np.concatenate([[np.uint64(0)], marked[:-1]])
    before[first] = 0
    s1 = np.concatenate([[np.uint64(0)], shape[:-1]])
    s1[first] = 0
    s2 = np.concatenate([[np.uint64(0)], s1[:-1]])
    s2[first] = 0
    out = np.empty((n, 4), np.uint64)
    out[:, 0] = h
    out[:, 1] = bt.mix(marked * _A + before * _B)
    out[:, 2] = bt.mix(shape * _C + np.uint64(1))
    out[:, 3] = bt.mix(shape * _D + s1 * _C + s2 * _A)
    return (out.ravel() >> np.uint64(64 - bits)).astype(np.int64), cut * 4
