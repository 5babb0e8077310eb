"""Vectorised word and shingle hashing over Arrow string columns.

Text is handled as UTF-8 bytes. A word is a maximal run of bytes outside
``0x20`` and ``0x09``-``0x0D``; only ``A``-``Z`` are lower-cased. Words are
hashed with polynomials modulo two primes (modulo a power of two some words
would agree for every base) whose prefix sums give every word of a batch in a
few numpy passes; work is cut into segments of ``SEGMENT`` bytes at word starts,
so memory follows the batch and not the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
#: Bytes of text that one numpy pass handles.
SLICE_BYTES = 4 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_TRIPLE = _rng.integers(1, 2**63, 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: (prime, base) of the two polynomials.
_FIELDS = (((1 << 31) - 1, 1_327_217_885), ((1 << 31) - 19, 902_433_331))
#: Bytes whose codes times powers, below 2^39 each, add up to less than 2^63.
_UNREDUCED = 1 << 23

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

_powers = [np.ones(1, np.int64)] * (2 * len(_FIELDS))


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of each base and of its inverse, modulo its prime."""
    if len(_powers[0]) < n:
        size = max(n, SEGMENT + (1 << 16))
        for k, (prime, base) in enumerate((p, x) for p, b in _FIELDS for x in (b, pow(b, -1, p))):
            table = np.ones(1, np.int64)
            while len(table) < size:
                table = np.concatenate([table, table * pow(base, len(table), prime) % prime])
            _powers[k] = table[:size]
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place on a fresh array."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose text has about ``limit`` bytes; one long text is a range of its own."""
    _, offsets = buffers(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end
        at = end


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes, cut where a text ends."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    start = member.copy()
    start[1:] &= ~member[:-1] | edge[1:n]
    end = member.copy()
    end[:-1] &= ~member[1:] | edge[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run ``data[starts[i]:ends[i]]``, 62 bits mixed into 64; the runs ascend and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        lo = int(starts[at])
        stop = max(int(np.searchsorted(starts, lo + SEGMENT)), at + 1)
        hi = int(ends[stop - 1])
        tables = _power_tables(hi - lo + 1)
        code = data[lo:hi].astype(np.int64) + 1
        s, e = starts[at:stop] - lo, ends[at:stop] - lo
        found = np.zeros(stop - at, np.int64)
        for k, (prime, _) in enumerate(_FIELDS):
            terms = code * tables[2 * k][: hi - lo]
            if hi - lo > _UNREDUCED:
                terms %= prime
            sums = np.zeros(hi - lo + 1, np.int64)
            np.cumsum(terms, out=sums[1:])
            found = found << 31 | (sums[e] - sums[s]) % prime * tables[2 * k + 1][s] % prime
        out[at:stop] = found.view(np.uint64)
        at = stop
    return mix(out)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words before each text and in all)."""
    starts, ends = runs(~SPACE[data], offsets)
    return hash_runs(FOLD[data], starts, ends), np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 3) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes.

    Fewer words than ``width``: the whole sequence is the one shingle. No
    words: an empty set.
    """
    hashes, cut = words(data, offsets)
    code = _codes(width)
    n = len(hashes)
    rolled = np.zeros(max(n - width + 1, 0), np.uint64)
    for k in range(width):
        rolled += hashes[k : n - width + 1 + k] * code[k] if n >= width else np.uint64(0)
    rolled = mix(rolled)
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            out.append(mix((hashes[a:b] * code[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _codes(width: int) -> np.ndarray:
    if width <= 3:
        return _TRIPLE[:width]
    return np.random.Generator(np.random.PCG64(width)).integers(1, 2**63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
