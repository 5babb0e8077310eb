"""String similarities of pairs, in [0, 1], as one Arrow UDF over distinct pairs of a batch.

``ratio`` is the normalised indel similarity ``2 * LCS / (|a| + |b|)``; the LCS
is bit-parallel on Python integers. ``partial`` is the best ratio of the
shorter text with a window of the longer: every window of its length, and the
shorter ones at both ends. One combing of the two texts' strands gives the LCS
of the shorter with every window, and many pairs are combed together in numpy.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of the pairs that are combed together.
COMBED_TOGETHER = 1 << 16


def lcs(a: str, b: str) -> int:
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        hit = state & where.get(c, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 2 * lcs(a, b) / n if n else 1.0


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    if not a and not b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free: dict[str, int] = {}
    for j, c in enumerate(b):
        free[c] = free.get(c, 0) | 1 << j
    used, first = 0, []
    for i, c in enumerate(a):
        lo = max(0, i - reach)
        near = (free.get(c, 0) & ((1 << i + reach + 1) - 1)) >> lo
        if near:
            at = (near & -near) << lo
            free[c] ^= at
            used |= at
            first.append(c)
    m = len(first)
    if not m:
        return 0.0
    second = [c for c, u in zip(b, f"{used:b}"[::-1], strict=False) if u == "1"]
    moved = sum(x != y for x, y in zip(first, second, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + prefix * weight * (1 - jaro)


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common = x & y
    if common and (x == common or y == common):
        return 1.0
    both = " ".join(sorted(common))
    left, right = (" ".join(filter(None, [both, " ".join(sorted(s - common))])) for s in (x, y))
    n = len(both)  # both begin with what is common, which an LCS keeps
    found = [2 * (n + lcs(left[n:], right[n:])) / (len(left) + len(right))]
    if common:
        found += [2 * n / (n + len(left)), 2 * n / (n + len(right))]
    return max(found)


def partial(a: str, b: str) -> float:
    return partials([(a, b)])[0]


def partials(pairs: list[tuple[str, str]]) -> list[float]:
    """:func:`partial` of each pair."""
    out, tasks = [0.0] * len(pairs), []
    for k, (a, b) in enumerate(pairs):
        if len(a) > len(b):
            a, b = b, a
        if not a:
            out[k] = float(not b)
            continue
        tasks.append((k, a, b))
        if len(a) == len(b):  # neither is the shorter one, so both slide
            tasks.append((k, b, a))
    # texts of like lengths together, so little is padding
    tasks.sort(key=lambda x: (len(x[2]).bit_length(), len(x[1]) // 8, len(x[2])))
    at = 0
    while at < len(tasks):
        end = m = n = 0
        for end in range(at, len(tasks)):
            wide = max(m, len(tasks[end][1])), max(n, len(tasks[end][2]))
            if end > at and (end + 1 - at) * sum(wide) > COMBED_TOGETHER:
                break
            m, n = wide
        else:
            end += 1
        part = tasks[at:end]
        for (k, _, _), best in zip(part, _best_windows([x[1] for x in part], [x[2] for x in part], m, n), strict=True):
            out[k] = max(out[k], best)
        at = end
    return out


def _codes(texts: list[str], size: int, pad: int) -> np.ndarray:
    """Characters by place and text."""
    out = np.full((size, len(texts)), pad, np.int32)
    for k, t in enumerate(texts):
        out[: len(t), k] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.int32)
    return out


def _best_windows(short: list[str], long: list[str], m: int, n: int) -> list[float]:
    """The best ratio of each ``short`` text with the windows of ``long`` that it slides over; the longest have ``m`` and ``n`` characters.

    Strands enter a grid of the characters at its left and top edge and cross
    at most once, or where characters are equal. Those that enter at column
    ``i`` or later and leave below before ``j`` are the characters of
    ``long[i:j]`` that its LCS with ``short`` leaves out.
    """
    kind = np.int16 if m + n < 1 << 15 else np.int32
    a, b = _codes(short, m, -1)[::-1], _codes(long, n, -2)
    left = np.repeat(np.arange(m, dtype=kind)[:, None], len(short), axis=1)
    top = np.repeat(np.arange(m, m + n, dtype=kind)[:, None], len(short), axis=1)
    for d in range(m + n - 1):
        lo, hi = max(0, d - n + 1), min(m - 1, d)  # rows that the diagonal meets
        row, col = slice(m - 1 - hi, m - lo), slice(d - hi, d - lo + 1)
        h, v = left[row], top[col]
        swap = (a[row] == b[col]) | (h > v)
        left[row], top[col] = np.where(swap, v, h), np.where(swap, h, v)
    width, length = np.array([len(t) for t in short]), np.array([len(t) for t in long])
    column, entered = np.arange(n)[:, None], top.astype(np.int64) - m
    # a strand counts for the windows that begin after column - width and not after where it entered
    counts = (entered >= 0) & (entered + width > column) & (column < length)
    change = np.zeros((m + n + 1, len(short)), np.int32)
    change[:n] = counts
    where, who = np.nonzero(counts)
    change[entered[where, who] + width[who], who] -= 1
    place = np.arange(m + n - 1)[:, None]  # of a window that begins at place - width + 1
    size = np.minimum(length, place + 1) - np.maximum(0, place - width + 1)
    found = 2 * (size - np.cumsum(change, axis=0)[: m + n - 1]) / np.maximum(width + size, 1)
    return np.where(place < width + length - 1, found, 0.0).max(axis=0).tolist()


SCORERS: dict[str, Callable[[str, str], float]] = {"ratio": ratio, "jw": jaro_winkler, "token_sort": token_sort, "token_set": token_set, "partial": partial}


def scores(a: Column, b: Column, names: tuple[str, ...] = tuple(SCORERS), empty_is_null: bool = True) -> Column:
    """A struct of ``names``; null fields where a side is null, or empty unless ``empty_is_null`` is false."""

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def run(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        found = dict.fromkeys(zip(left, right, strict=True))
        known = [p for p in found if None not in p and (all(p) or not empty_is_null)]
        columns = [partials(known) if n == "partial" else [SCORERS[n](x, y) for x, y in known] for n in names]
        found |= zip(known, zip(*columns, strict=True), strict=True)
        unknown = (None,) * len(names)
        return pd.DataFrame([found[p] or unknown for p in zip(left, right, strict=True)], columns=list(names), dtype="float64")

    return run(a, b)
