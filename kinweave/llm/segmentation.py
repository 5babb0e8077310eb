"""SentencePiece encoding, decoding and sampled segmentations (operator 2).

Encoding is what the library gives; decoding joins the pieces' bytes. Sampling
draws ``k`` distinct segmentations of a whole text, without replacement and
each with its inclusion score, by Gumbel top-k: every segmentation has its log
probability plus Gumbel noise, and a best-first search over the lattice emits
those of the largest sum. A subtree's largest perturbed value is drawn from its
exact log mass, conditioned on its parent's, so the search is A-star with a
perfect bound and expands nothing it doesn't emit. Masses of what remains are
sums of positive terms, never differences, so no segmentation is too unlikely
to be found. All noise comes from a counter-based generator keyed by a digest
of the row's id.

Where two neighbouring bytes are neighbours in no piece, every segmentation of a
text has a cut, so its lattice is the product of those of its chunks between
such places (a word with the space before it, a punctuation mark). A worker
keeps the lattices and encodings of the chunks it met, found by their bytes, up
to a bound, beyond which only those that several batches had stay; those that a
batch lacks are built together in numpy: edges by a walk of all positions down a
trie of the pieces, masses backward by distance from the end. A node of the search tree fixes the chunks before it; its
children are the chosen path of the next chunk, and all its other paths
together.

A piece's probability falls with its merge rank as ``1 / (rank + 1)``; bytes
rank last. The model file's scores are ranks, not probabilities.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .common import drop_kept, keep_in_worker, unused

#: Bytes of text that are sampled together, and edges of lattices that a worker keeps for the next ones.
BATCH_BYTES = 640 << 10
KEPT_EDGES = 3 << 19
#: Bytes of a chunk whose masses are summed without logarithms: the least chance of a byte to this power is a normal number.
LINEAR_BYTES = 40
#: Chunks that the library encodes as one text.
CHUNKS_TOGETHER = 32
#: Bits of a slot in the table of the trie's steps.
SLOT_BITS = 19

_META = "\u2581".encode()


class Model:
    """The pieces of a ``.model`` file as byte strings, with hashes and log probabilities."""

    def __init__(self, path: str):
        import sentencepiece as spm

        self.library = spm.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        texts: list[bytes] = []
        usable = np.zeros(n, dtype=bool)
        for i in range(n):
            if self.library.is_byte(i):
                texts.append(bytes([int(self.library.id_to_piece(i)[1:-1], 16)]))
            elif self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i):
                texts.append(b"")
            else:
                texts.append(self.library.id_to_piece(i).replace("▁", " ").encode())
                usable[i] = True
        if not any(self.library.is_byte(i) for i in range(n)):
            raise ValueError("a model without byte pieces can't hold every text")
        self.first_byte = next((i for i in range(n) if self.library.is_byte(i)), None)
        rank = np.array([-self.library.get_score(i) for i in range(n)])
        worst = rank[usable & (rank < 1e8)].max(initial=1.0) + 1
        rank = np.where(usable & (rank < 1e8), rank, worst)
        weight = np.where(usable, 1 / (rank + 1), 0.0)
        fallback = 1 / (worst + 2)
        total = weight.sum() + 256 * fallback
        with np.errstate(divide="ignore"):
            self.logp = np.log(weight / total)
        self.byte_logp = float(np.log(fallback / total))
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.longest = int(self.lengths[usable].max(initial=1))
        # bytes that are neighbours in a piece, and a character that is in none and so merges with nothing
        self.joined, known = np.zeros(1 << 16, dtype=bool), np.zeros(256, dtype=bool)
        for i in np.flatnonzero(usable).tolist():
            raw = np.frombuffer(texts[i], np.uint8).astype(np.int64)
            known[raw] = True
            self.joined[raw[:-1] * 256 + raw[1:]] = True
        free = [b for b in range(1, 128) if not known[b]]
        if not free:
            raise ValueError("a model needs a character outside its pieces to tell chunks apart")
        self.mark = chr(free[-1])
        # the trie's steps (state * 256 + byte, next state) in a table by slot; steps of a slot are neighbours
        state: dict[bytes, int] = {b"": 0}
        for i in np.flatnonzero(usable).tolist():
            for n in range(1, len(texts[i]) + 1):
                state.setdefault(texts[i][:n], len(state))
        self.piece_of = np.full(len(state), -1, np.int64)
        for i in np.flatnonzero(usable).tolist():
            self.piece_of[state[texts[i]]] = i
        step = np.array([state[x[:-1]] * 256 + x[-1] for x in state if x], np.int64)
        after = np.array([at for x, at in state.items() if x], np.int64)
        slot = _slot(step)
        order = np.argsort(slot, kind="stable")
        self.steps, self.after, slot = step[order], after[order], slot[order]
        self.table = np.full(1 << SLOT_BITS, len(slot), np.int64)
        self.table[slot[::-1]] = np.arange(len(slot))[::-1]
        self.crowd = int(np.bincount(slot).max(initial=1))
        self.steps = np.append(self.steps, np.full(self.crowd, -1))
        self.chunks = Chunks(self)

    def down(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The state after ``byte``, -1 where no piece goes on so."""
        want = state * 256 + byte
        k = self.table[_slot(want)]
        for _ in range(self.crowd - 1):
            k = k + ((self.steps[k] != want) & (k < len(self.after)))
        hit = self.steps[k] == want
        out = np.full(len(want), -1, np.int64)
        out[hit] = self.after[k[hit]]
        return out

    def encode_chunks(self, chunks: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start of each chunk's ids, their number).

        The library encodes some together, each after a character that merges
        with nothing; a text begins with the encoder's own space.
        """
        words, mark, n = [x.decode() for x in chunks], self.mark, CHUNKS_TOGETHER
        found = self.library.encode([mark + mark.join(words[at : at + n]) for at in range(0, len(words), n)], num_threads=1)
        ids = np.fromiter(chain.from_iterable(found), np.int64)
        begin = np.cumsum(size + 1) - size + np.arange(len(size)) // n + 1
        ends = np.concatenate([[0], np.cumsum(self.lengths[ids])])
        at, to = np.searchsorted(ends, begin), np.searchsorted(ends, begin + size)
        if len(size) and not ((ends[at] == begin).all() and (ends[to] == begin + size).all()):
            raise ValueError("the model changes texts before it splits them")
        return ids, at, to - at

    def piece_bytes(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ``ids`` in a row, spaces in place of the meta symbol."""
        return self.bytes[_ranges(self.offsets[ids], self.lengths[ids])]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``: the first space is the encoder's own; stray bytes become U+FFFD."""
        raw = self.piece_bytes(np.asarray(ids, np.int64)).tobytes()
        return raw.removeprefix(b" ").decode("utf-8", "replace")


def _slot(step: np.ndarray) -> np.ndarray:
    return ((step.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices ``starts[i] .. starts[i] + lengths[i] - 1`` of all i in a row."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
        keep_in_worker("segmentation", _models.clear)
    return _models[path]


class Lattices:
    """The lattices of distinct chunks in a row. Node ``position + chunk`` is a byte position of a chunk; edges ascend by node."""

    def __init__(self, m: Model, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        n, chunks = len(data), len(starts)
        chunk = np.repeat(np.arange(chunks), ends - starts)
        room = np.repeat(ends, ends - starts) - np.arange(n)
        is_char = (data & 0xC0) != 0x80
        at = np.flatnonzero(is_char)
        char_length = np.zeros(n, np.int64)
        char_length[at] = np.diff(np.append(at, n))
        has_char = np.zeros(n, dtype=bool)
        state = np.zeros(len(at), np.int64)
        src, length, piece = [], [], []
        for size in range(1, m.longest + 1):
            alive = room[at] >= size
            at = at[alive]
            state = m.down(state[alive], data[at + (size - 1)])
            alive = state >= 0
            at, state = at[alive], state[alive]
            if not len(at):
                break
            ids = m.piece_of[state]
            hit = ids >= 0
            p = at[hit]
            src.append(p)
            length.append(np.full(len(p), size, np.int32))
            piece.append(ids[hit])
            if size <= 4:
                has_char[p[char_length[p] == size]] = True
        bare = np.flatnonzero(is_char & ~has_char)
        src.append(bare)
        length.append(char_length[bare])
        piece.append(np.full(len(bare), -1, np.int64))
        nodes = n + chunks
        degree = np.zeros(nodes, np.int64)
        for p in src:  # a position has at most one edge of a size
            degree[p + chunk[p]] += 1
        self.edge_at = np.concatenate([[0], np.cumsum(degree)])
        # long pieces first: they are the likeliest, so a walk seldom looks further
        free, total = self.edge_at[:-1].copy(), int(self.edge_at[-1])
        self.src, self.byte_at, self.size, self.piece = (np.empty(total, np.int64) for _ in range(4))
        for p, size, ids in zip(src[::-1], length[::-1], piece[::-1], strict=True):
            node = p + chunk[p]
            at = free[node]
            free[node] = at + 1
            self.src[at], self.byte_at[at], self.size[at], self.piece[at] = node, p, size, ids
        self.data, self.dst = data, self.src + self.size
        self.first, self.last = starts + np.arange(chunks), ends + np.arange(chunks)
        byte_edges = self.piece < 0
        self.logp = m.logp[self.piece]
        self.logp[byte_edges] = self.size[byte_edges] * m.byte_logp
        owner = chunk[self.byte_at]
        self._masses(nodes, self.last[owner] - self.src, (ends - starts)[owner] > LINEAR_BYTES)

    def _masses(self, nodes: int, distance: np.ndarray, long: np.ndarray) -> None:
        """The chance of each edge given its node, from the masses of all paths to the chunk's end."""
        self.q = np.zeros(len(self.src))
        self._backward(nodes, np.flatnonzero(~long), distance, self._linear)
        self._backward(nodes, np.flatnonzero(long), distance, self._logarithmic)
        group = np.flatnonzero(np.append(True, self.src[1:] != self.src[:-1])) if len(self.src) else np.zeros(0, np.int64)
        degree = np.diff(np.append(group, len(self.src)))
        # running sums within each node, by place, so they don't depend on the other chunks
        self.upto, run = self.q.copy(), self.q[group] if len(group) else np.zeros(0)
        more, place = np.flatnonzero(degree > 1), 1
        while len(more):
            e = group[more] + place
            run[more] += self.q[e]
            self.upto[e] = run[more]
            place += 1
            more = more[degree[more] > place]
        if len(group):
            self.upto[group + degree - 1] = 2.0  # the last edge takes what rounding leaves
            # the chance of a node's other edges: a sum where the difference would lose digits
            few = np.add.reduceat(np.where(self.q > 0.5, 0.0, self.q), group)
            self.other = np.where(self.q > 0.5, np.repeat(few, degree), 1 - self.q)
            top = np.flatnonzero(self.q == np.repeat(np.maximum.reduceat(self.q, group), degree))[::-1]
        else:
            self.other, top = np.zeros(0), group
        # each node's likeliest edge, of equal ones the longest piece: it is written last
        self.best_edge = np.full(nodes, -1, np.int64)
        self.best_edge[self.src[top]] = top

    def _backward(self, nodes: int, edges: np.ndarray, distance: np.ndarray, step) -> None:
        if not len(edges):
            return
        d = distance[edges]
        if d.max() < 1 << 16:
            d = d.astype(np.uint16)  # sorted by radix
        order = np.argsort(d, kind="stable")
        d, edges = d[order], edges[order]
        cuts = np.flatnonzero(np.append(True, d[1:] != d[:-1])).tolist()
        step(nodes, edges, list(zip(cuts, [*cuts[1:], len(d)], strict=True)))

    def _linear(self, nodes: int, edges: np.ndarray, slices: list[tuple[int, int]]) -> None:
        """Masses as they are: a chunk of ``LINEAR_BYTES`` can't make them vanish."""
        mass = np.zeros(nodes)
        mass[self.last] = 1.0
        s, t, w = self.src[edges], self.dst[edges], np.exp(self.logp[edges])
        new = np.append(True, s[1:] != s[:-1])
        for lo, hi in slices:
            w[lo:hi] *= mass[t[lo:hi]]
            group = np.flatnonzero(new[lo:hi])
            mass[s[lo:hi][group]] = np.add.reduceat(w[lo:hi], group)
        self.q[edges] = w / mass[s]

    def _logarithmic(self, nodes: int, edges: np.ndarray, slices: list[tuple[int, int]]) -> None:
        mass = np.full(nodes, -np.inf)
        mass[self.last] = 0.0
        s, t, w = self.src[edges], self.dst[edges], self.logp[edges]
        new = np.append(True, s[1:] != s[:-1])
        for lo, hi in slices:
            w[lo:hi] += mass[t[lo:hi]]
            group = np.flatnonzero(new[lo:hi])
            most = np.maximum.reduceat(w[lo:hi], group)
            n = np.append(group[1:], hi - lo) - group
            mass[s[lo:hi][group]] = most + np.log(np.add.reduceat(np.exp(w[lo:hi] - np.repeat(most, n)), group))
        self.q[edges] = np.exp(w - mass[s])

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(edges of every chunk's favourite path, which takes the likeliest edge of each node, in a row; edges in each;
        the chance of having left the path by each of its nodes; the path's log probability)."""
        node, who, taken, owner, left = self.first.copy(), np.arange(len(self.first)), [], [], []
        logq, gone = np.zeros(len(node)), np.zeros(len(node))
        while len(who):
            e = self.best_edge[node]
            gone[who] += np.exp(logq[who]) * self.other[e]
            logq[who] += np.log(self.q[e])
            taken.append(e)
            owner.append(who)
            left.append(gone[who])
            node = self.dst[e]
            more = node != self.last[who]
            node, who = node[more], who[more]
        edges, n = _in_order(taken, owner, len(self.first))
        return edges, n, _in_order(left, owner, len(self.first))[0], logq


class _Row:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self.room, self.n = np.empty(1024, dtype), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.room):
            self.room = np.concatenate([self.room[: self.n], np.empty(self.n // 8 + len(values), self.room.dtype)])
        self.room[self.n : self.n + len(values)] = values
        self.n += len(values)

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.n]


class Chunks:
    """The chunks that a worker met lately: by their bytes, with encoding, lattice, favourite path and the batches that had them."""

    _ROWS = {
        "data": np.uint8, "edge_at": np.int64, "first": np.int64, "last": np.int64, "dst": np.int32, "src": np.int32, "byte_at": np.int32, "piece": np.int32, "q": np.float64, "upto": np.float64,
        "best_edges": np.int32, "left": np.float64, "best_at": np.int64, "best_n": np.int64, "best_logq": np.float64, "rest": np.float64, "ids": np.int32, "ids_at": np.int64, "ids_n": np.int64, "hits": np.int64,
    }

    def __init__(self, m: Model):
        self.m = m
        self.rows = {name: _Row(kind) for name, kind in self._ROWS.items()}
        self.clear()

    def clear(self) -> None:
        """Forget all chunks; the arrays keep their room."""
        self.place: dict[bytes, int] = {}
        for row in self.rows.values():
            row.n = 0
        self.rows["edge_at"].add(np.zeros(1, np.int64))
        self._bind()

    def _bind(self) -> None:
        for name, row in self.rows.items():
            setattr(self, name, row.all)

    def places(self, found: list[bytes]) -> np.ndarray:
        """The place of each chunk; places hold until :meth:`forget`."""
        new = [x for x in dict.fromkeys(found) if x not in self.place]
        if new:
            self._add(new)
        places = np.fromiter(map(self.place.__getitem__, found), np.int64, len(found))
        self.hits[places] += 1
        return places

    def forget(self) -> None:
        """If more than ``KEPT_EDGES`` edges are held, keep those of the chunks that most batches had, half as many at most."""
        if len(self.dst) <= KEPT_EDGES:
            return
        edges = self.edge_at[self.last] - self.edge_at[self.first]
        order = np.argsort(-self.hits, kind="stable")
        order = order[self.hits[order] > 1]
        self._retain(np.sort(order[np.cumsum(edges[order]) <= KEPT_EDGES // 2]))

    def _retain(self, kept: np.ndarray) -> None:
        """Move the chunks ``kept`` (ascending) to the front and drop the others."""
        first, last = self.first[kept], self.last[kept]
        byte, size = first - kept, last - first  # a chunk has one node more than bytes
        edge, edges = self.edge_at[first], self.edge_at[last] - self.edge_at[first]
        best, best_n, at, n = self.best_at[kept], self.best_n[kept], self.ids_at[kept], self.ids_n[kept]

        def moved(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
            return np.cumsum(lengths) - lengths - starts

        e, b = _ranges(edge, edges), _ranges(best, best_n)
        by_node, by_edge = np.repeat(moved(first, size + 1), edges), moved(edge, edges)
        held = {
            "data": self.data[_ranges(byte, size)], "edge_at": np.append(0, self.edge_at[_ranges(first + 1, size + 1)] + np.repeat(by_edge, size + 1)), "first": first + moved(first, size + 1), "last": last + moved(first, size + 1),
            "dst": self.dst[e] + by_node, "src": self.src[e] + by_node, "byte_at": self.byte_at[e] + np.repeat(moved(byte, size), edges), "piece": self.piece[e], "q": self.q[e], "upto": self.upto[e],
            "best_edges": self.best_edges[b] + np.repeat(by_edge, best_n), "left": self.left[b], "best_at": best + moved(best, best_n), "best_n": best_n, "best_logq": self.best_logq[kept], "rest": self.rest[kept],
            "ids": self.ids[_ranges(at, n)], "ids_at": at + moved(at, n), "ids_n": n, "hits": self.hits[kept] // 2,
        }
        names = list(self.place)
        self.place = {names[k]: i for i, k in enumerate(kept.tolist())}
        for name, row in self.rows.items():
            row.n = 0
            row.add(held[name])
        self._bind()

    def _add(self, new: list[bytes]) -> None:
        data, size = np.frombuffer(b"".join(new), np.uint8), np.array([len(x) for x in new], np.int64)
        ends = np.cumsum(size)
        lat = Lattices(self.m, data, ends - size, ends)
        best_edges, best_n, left, best_logq = lat.best()
        ids, ids_at, ids_n = self.m.encode_chunks(new, size)
        with np.errstate(divide="ignore"):
            rest = np.log(left[np.cumsum(best_n) - 1])
        nodes, edges, before = len(self.edge_at) - 1, len(self.dst), len(self.first)
        added = {
            "data": data, "edge_at": lat.edge_at[1:] + edges, "first": lat.first + nodes, "last": lat.last + nodes, "dst": lat.dst + nodes, "src": lat.src + nodes, "byte_at": lat.byte_at + len(self.data), "piece": lat.piece, "q": lat.q, "upto": lat.upto,
            "best_edges": best_edges + edges, "left": left, "best_at": np.cumsum(best_n) - best_n + len(self.best_edges), "best_n": best_n, "best_logq": best_logq, "rest": rest, "ids": ids, "ids_at": ids_at + len(self.ids), "ids_n": ids_n, "hits": np.zeros(len(new), np.int64),
        }
        for name, values in added.items():
            self.rows[name].add(values)
        self.place.update(zip(new, range(before, before + len(new)), strict=True))
        self._bind()

    def choose(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge of each node at which its edges' chances add up to more than ``u``."""
        e = self.edge_at[node]
        beyond = np.flatnonzero(u >= self.upto[e])
        while len(beyond):
            e[beyond] += 1
            beyond = beyond[u[beyond] >= self.upto[e[beyond]]]
        return e

    def walk(self, chunks: np.ndarray, node: np.ndarray, draw) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Edges, and whose they are, of a sampled path of each of ``chunks`` from ``node`` to its end, by step."""
        who = np.flatnonzero(node != self.last[chunks])
        node = node[who]
        taken, owner, step = [], [], 0
        while len(who):
            e = self.choose(node, draw(step, who))
            taken.append(e)
            owner.append(who)
            node = self.dst[e].astype(np.int64)
            more = node != self.last[chunks[who]]
            node, who = node[more], who[more]
            step += 1
        return taken, owner

    def logq_of(self, edges: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The log probability of paths of ``n`` edges each."""
        return np.add.reduceat(np.log(self.q[edges]), np.cumsum(n) - n) if len(n) else np.zeros(0)

    def ids_of(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids of ``edges``, byte pieces for characters outside the vocabulary; ids of each edge)."""
        piece = self.piece[edges]
        n = np.where(piece < 0, self.dst[edges] - self.src[edges], 1)
        out = np.repeat(piece, n)
        raw = np.flatnonzero(piece < 0)
        if len(raw):
            at = np.cumsum(n)[raw] - n[raw]
            out[_ranges(at, n[raw])] = self.m.first_byte + self.data[_ranges(self.byte_at[edges[raw]].astype(np.int64), n[raw])].astype(np.int64)
        return out, n


class Others:
    """All paths of a chunk but some, as a tree of the excluded ones: their log mass, and samples of them.

    A tree node's mass is the sum of its edges' chances, those that begin an
    excluded path by the mass that remains below them; every term is positive.
    """

    def __init__(self, chunks: Chunks, chunk: int, excluded: list[list[int]]):
        first, self.end = int(chunks.first[chunk]), int(chunks.last[chunk])
        base = int(chunks.edge_at[first])
        self.base, self.first = base, first
        self.edge_at = (chunks.edge_at[first : self.end + 1] - base).tolist()
        span = slice(base, base + self.edge_at[-1])
        self.logq, self.dst = np.log(chunks.q[span]).tolist(), chunks.dst[span].tolist()
        self.nodes, self.kids, self.mass = [first], [{}], [0.0]
        for path in excluded:
            self.exclude(path)

    def exclude(self, path: list[int]) -> None:
        at, passed = 0, [0]
        for e in path:
            below = self.kids[at].get(e - self.base)
            if below is None:
                below = self.kids[at][e - self.base] = len(self.nodes)
                self.nodes.append(self.dst[e - self.base])
                self.kids.append({})
                self.mass.append(0.0)
            at = below
            passed.append(at)
        for t in reversed(passed):
            self.mass[t] = _log_sum(self._terms(t))

    def _edges(self, node: int) -> tuple[int, int]:
        return self.edge_at[node - self.first], self.edge_at[node - self.first + 1]

    def _terms(self, t: int) -> list[float]:
        if self.nodes[t] == self.end:
            return []
        lo, hi = self._edges(self.nodes[t])
        terms = self.logq[lo:hi]
        for e, below in self.kids[t].items():
            terms[e - lo] += self.mass[below]
        return terms

    def sample(self, draws: Iterator[float]) -> list[int]:
        node, t, path = self.first, 0, []
        while node != self.end:
            lo, hi = self._edges(node)
            terms = self.logq[lo:hi] if t is None else self._terms(t)
            top = max(terms)
            weights = [math.exp(x - top) for x in terms]
            goal, chosen = next(draws) * sum(weights), None
            for k, w in enumerate(weights):
                if w > 0:
                    chosen = k
                    if goal < w:
                        break
                    goal -= w
            e = lo + chosen
            path.append(e + self.base)
            t = None if t is None else self.kids[t].get(e)
            node = self.dst[e]
        return path


def _log_sum(terms: list[float]) -> float:
    top = max(terms, default=-math.inf)
    return top if top == -math.inf else top + math.log(sum(math.exp(x - top) for x in terms))


def _in_order(taken: list[np.ndarray], owner: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(values in a row by owner, values of each owner)."""
    if not taken:
        return np.zeros(0, np.int64), np.zeros(n, np.int64)
    e, o = np.concatenate(taken), np.concatenate(owner)
    return e[np.argsort(o, kind="stable")], np.bincount(o, minlength=n)


def split_texts(m: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of each chunk among ``m.chunks``, chunks before each text and in all, whether a text has a literal meta symbol).

    The encoder puts a space before each non-empty text and can't tell the meta symbol from a space.
    """
    meta = np.zeros(len(offsets) - 1, dtype=bool)
    if _META in (raw := data.tobytes()):
        texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        meta = np.array([_META in x for x in texts])
        texts = [x.replace(_META, b" ") for x in texts]
        data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    full = np.diff(offsets) > 0
    padded = np.insert(data, offsets[:-1][full], 0x20)
    where = offsets + np.concatenate([[0], np.cumsum(full)])
    start = np.zeros(len(padded), dtype=bool)
    start[1:] = ~m.joined[padded[:-1].astype(np.int64) * 256 + padded[1:]] & ((padded[1:] & 0xC0) != 0x80)
    start[where[:-1][full]] = True
    starts = np.flatnonzero(start)
    m.chunks.forget()
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(padded))), pa.py_buffer(padded)]).dictionary_encode()
    places = m.chunks.places(column.dictionary.to_pylist())[column.indices.to_numpy()]
    return places, np.searchsorted(starts, where), meta


class Noise:
    """Uniforms in (0, 1) as a function of a key and counters; no state."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys

    def base(self, who: np.ndarray, kind: int, place: np.ndarray) -> np.ndarray:
        """The counters of step 0."""
        return self.keys[who] + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(kind * 0xA0761D6478BD642F % (1 << 64))

    @staticmethod
    def at(base: np.ndarray, step: int = 0) -> np.ndarray:
        h = base + np.uint64(step * 0xE7037ED1A0B428DB % (1 << 64)) if step else base
        return ((bt.mix(h) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53

    def __call__(self, who: np.ndarray, kind: int, place: np.ndarray) -> np.ndarray:
        return self.at(self.base(who, kind, place))


    def one(self, who: int, kind: int, place: int, step: int = 0) -> float:
        """One uniform, without arrays."""
        h = (int(self.keys[who]) + place * 0xD6E8FEB86659FD93 + kind * 0xA0761D6478BD642F + step * 0xE7037ED1A0B428DB) & _MASK
        h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & _MASK
        return (((h ^ (h >> 31)) >> 11) + 0.5) * 2.0**-53


_MASK = (1 << 64) - 1


def key_of(value: object, seed: int) -> int:
    """64 bits of a digest of the id's text, keyed by the seed."""
    return int.from_bytes(hashlib.blake2b(str(value).encode(), digest_size=8, key=seed.to_bytes(8, "little", signed=True)).digest(), "little")


@dataclass
class Sample:
    """One segmentation: its piece ids, log probability, perturbed value and log inclusion score."""

    ids: np.ndarray
    logp: float
    gumbel: float
    log_inclusion: float


def _below(log_mass: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A Gumbel of location ``log_mass`` conditioned on being below ``top``."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        g = log_mass - np.log(np.exp(np.minimum(log_mass - top, 700.0)) - np.log(u))
    return np.where(np.isneginf(log_mass), -np.inf, np.minimum(g, top))


def _draw(lat: Chunks, chunks: np.ndarray, noise: Noise, who: np.ndarray, place: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each chunk of some texts a freshly sampled path: (edges in a row, edges in each, log probability of each, of all its other paths).

    It is the favourite path by that one's mass. Another path leaves the
    favourite at the first node where it takes another edge; that node and
    edge are drawn from their exact chances, and the rest of the path is a
    free walk.
    """
    n, logq, rest, begin = lat.best_n[chunks], lat.best_logq[chunks], lat.rest[chunks], lat.best_at[chunks]
    is_best = np.ones(len(chunks), dtype=bool)
    open_ = np.flatnonzero(rest > -np.inf)  # a chunk of one path leaves no choice
    base = noise.base(who[open_], kind, place[open_])
    is_best[open_] = Noise.at(base) < np.exp(logq[open_])
    leaves = np.flatnonzero(~is_best[open_])
    other, base = open_[leaves], base[leaves]
    walked, walked_n = _leave(lat, chunks[other], base)
    n[other] = walked_n
    logq[other] = lat.logq_of(walked, walked_n)
    # no path but the favourite has more than half of the mass
    rest[other] = np.log1p(-np.exp(logq[other]))
    edges = np.empty(int(n.sum()), np.int64)
    at = np.cumsum(n) - n
    edges[_ranges(at[is_best], n[is_best])] = lat.best_edges[_ranges(begin[is_best], n[is_best])]
    edges[_ranges(at[other], walked_n)] = walked
    return edges, n, logq, rest


def _leave(lat: Chunks, chunks: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edges in a row, edges in each) of a path other than the favourite for each of ``chunks``."""
    start = lat.best_at[chunks]
    at, goal = start.copy(), Noise.at(base, 1) * lat.left[start + lat.best_n[chunks] - 1] if len(chunks) else np.zeros(0)
    beyond = np.flatnonzero(lat.left[at] < goal)
    while len(beyond):
        at[beyond] += 1
        beyond = beyond[lat.left[at[beyond]] < goal[beyond]]
    favourite = lat.best_edges[at].astype(np.int64)
    node, q = lat.src[favourite].astype(np.int64), lat.q[favourite]
    u = Noise.at(base, 2) * (1 - q)
    e = lat.choose(node, np.where(u >= lat.upto[favourite] - q, u + q, u))
    # rounding can land on the favourite itself
    e = np.where(e == favourite, np.where(favourite + 1 < lat.edge_at[node + 1], favourite + 1, np.maximum(favourite - 1, lat.edge_at[node])), e)
    taken, owner = lat.walk(chunks, lat.dst[e].astype(np.int64), lambda step, who: Noise.at(base[who], 3 + step))
    every = np.arange(len(chunks))
    return _in_order([lat.best_edges[_ranges(start, at - start)].astype(np.int64), e, *taken], [np.repeat(every, at - start), every, *owner], len(chunks))


def sample_texts(m: Model, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, k: int, split: tuple | None = None) -> list[list[Sample]]:
    """Up to ``k`` distinct segmentations of each text, by descending perturbed value."""
    chunk, cut, _ = split or split_texts(m, data, offsets)
    texts, lat = len(offsets) - 1, m.chunks
    noise = Noise(keys)
    out: list[list[Sample]] = [[] for _ in range(texts)]

    # the search tree's root has mass 1, so its largest value is a standard Gumbel
    top = -np.log(-np.log(noise(np.arange(texts), 0, np.zeros(texts, np.int64))))
    paths: list[list[dict]] = [[] for _ in range(texts)]  # the emitted paths of each text
    extra: dict[tuple[int, int, int], list[list[int]]] = {}
    work = [(t, 0, None, float(top[t])) for t in range(texts)]  # text, first fresh chunk, path to branch from, value
    for turn in range(k):
        lo = np.array([cut[t] + at for t, at, _, _ in work], np.int64)
        n_fresh = np.array([cut[t + 1] for t, _, _, _ in work], np.int64) - lo
        who = np.repeat(np.array([t for t, _, _, _ in work], np.int64), n_fresh)
        where = _ranges(lo, n_fresh)
        place = where - cut[who]
        edges, n, logq, rest = _draw(lat, chunk[where], noise, who, place, 1 + 4 * turn)
        e_at, c_at = np.concatenate([[0], np.cumsum(n)]).tolist(), np.concatenate([[0], np.cumsum(n_fresh)]).tolist()
        # log probability of all chunks before each fresh one
        prefix, totals = np.empty(len(logq)), []
        for j, (_, _, branch, _) in enumerate(work):
            a, b = c_at[j], c_at[j + 1]
            run = np.cumsum(logq[a:b])
            head = 0.0 if branch is None else branch[2]
            prefix[a:b] = head + (run - logq[a:b])
            totals.append(head + (float(run[-1]) if b > a else 0.0))
        side = np.full(len(rest), -np.inf)
        open_ = np.flatnonzero(rest > -np.inf)
        u = noise(who[open_], 2 + 4 * turn, place[open_])
        side[open_] = _below((prefix + rest)[open_], np.repeat(np.array([v for _, _, _, v in work]), n_fresh)[open_], u)
        for j, (t, at, branch, value) in enumerate(work):
            a, b = c_at[j], c_at[j + 1]
            all_edges, all_n = edges[e_at[a] : e_at[b]], n[a:b]
            if branch is not None:
                all_edges, all_n = np.concatenate([branch[0], all_edges]), np.concatenate([branch[1], all_n])
            paths[t].append({"edges": all_edges, "n": all_n, "at": at, "prefix": prefix[a:b], "side": side[a:b]})
            out[t].append(Sample(all_edges, totals[j], value, 0.0))
        # the text's open node of the largest value
        work = []
        for t in range(texts):
            if len(out[t]) <= turn:
                continue
            best, source = -math.inf, None
            for r, path in enumerate(paths[t]):
                if len(path["side"]):
                    c = int(path["side"].argmax())
                    if path["side"][c] > best:
                        best, source = float(path["side"][c]), (r, c)
            if source is None or turn == k - 1:
                for s in out[t]:
                    s.log_inclusion = _inclusion(s.logp, best)
                continue
            r, c = source
            path = paths[t][r]
            position = path["at"] + c
            hi = int(path["n"][: position + 1].sum())
            lo_e = hi - int(path["n"][position])
            gone = extra.setdefault((t, r, c), [path["edges"][lo_e:hi].tolist()])
            which = int(chunk[cut[t] + position])
            stream = (noise.one(t, 3 + 4 * turn, 0, s) for s in count())
            tree = Others(lat, which, gone)
            new = tree.sample(stream)
            gone.append(new)
            tree.exclude(new)
            before = float(path["prefix"][c])
            left = before + tree.mass[0]
            path["side"][c] = -math.inf if left == -math.inf else min(left - math.log(math.exp(min(left - best, 700.0)) - math.log(noise.one(t, 3 + 4 * turn, 1))), best)
            new_edges = np.array(new, np.int64)
            head = (np.concatenate([path["edges"][:lo_e], new_edges]), np.append(path["n"][:position], len(new)), before + float(np.log(lat.q[new_edges]).sum()))
            work.append((t, position + 1, head, best))
        if not work:
            break
    every = [s for x in out for s in x]
    if every:
        ids, n = lat.ids_of(np.concatenate([s.ids for s in every]))
        n = np.concatenate([[0], np.cumsum(n)])
        at = 0
        for s in every:
            end = at + len(s.ids)
            s.ids, at = ids[n[at] : n[end]], end
    return out


def _inclusion(logp: float, threshold: float) -> float:
    """log(1 - exp(-exp(logp - threshold))): the chance that a perturbed value exceeds the first one not emitted."""
    if np.isneginf(threshold):
        return 0.0
    x = logp - threshold
    return x - np.exp(x) / 2 if x < -20 else float(np.log(-np.expm1(-np.exp(min(x, 700.0)))))


def encode_texts(m: Model, data: np.ndarray, offsets: np.ndarray, split: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all texts in a row, ids before each text and in all, whether each text decodes to itself).

    Equal to the library's ``encode`` of each text: no merge crosses a chunk.
    """
    chunk, cut, _ = split or split_texts(m, data, offsets)
    lat = m.chunks
    n = lat.ids_n[chunk]
    ids = lat.ids[_ranges(lat.ids_at[chunk], n)]
    at = np.concatenate([[0], np.cumsum(n)])[cut]
    return ids, at, decodes_to(m, ids, at, data, offsets)


def decodes_to(m: Model, ids: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether the ids ``at[i]:at[i + 1]`` decode to text i, by the bytes of both; a text that isn't empty follows the encoder's space."""
    raw, ends = m.piece_bytes(ids), np.concatenate([[0], np.cumsum(m.lengths[ids])])[at]
    size = np.diff(offsets)
    same = np.diff(ends) == size + (size > 0)
    full = np.flatnonzero(same & (size > 0))
    wrong = raw[_ranges(ends[full] + 1, size[full])] != data[_ranges(offsets[full], size[full])]
    begin = np.cumsum(size[full]) - size[full]
    same[full] = (raw[ends[full]] == 0x20) & (np.add.reduceat(wrong, begin) == 0 if len(full) else True)
    return same


def segment(docs: DataFrame, path: str, k: int = 2, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, with_sample_ids: bool = False) -> DataFrame:
    """One row a document: ``doc_id, n_tokens, ids, ids_crc, round_trip, samples``.

    ``ids`` is the library's encoding of the whole text, null as empty;
    ``round_trip`` tells whether it decodes to the text (a literal meta symbol
    decodes to a space). ``samples`` holds up to ``k`` distinct segmentations
    by descending perturbed value (fewer where the text has fewer) with log
    probability, that value, and the log inclusion score: the log chance that
    a segmentation of its probability is among those emitted, given the first
    value that isn't. The empty text has one segmentation, of no piece. The
    noise is keyed by the id's text and ``seed``, so repeated ids with equal
    texts give equal samples. ``ids`` of the text and of the samples are null
    unless asked for; ``ids_crc`` is their crc32 as little-endian int32. Other
    columns are left out.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    i, t = unused(docs, "x_id", "x_text")

    def crc(ids: np.ndarray) -> int:
        return zlib.crc32(ids.astype("<i4").tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept("segmentation")
        m = model(path)
        sample_type = pa.struct([("n_tokens", pa.int32()), ("logp", pa.float64()), ("gumbel", pa.float64()), ("log_inclusion", pa.float64()), ("ids", pa.list_(pa.int32())), ("ids_crc", pa.int64())])
        for batch in batches:
            for lo, hi in bt.slices(batch.column(1), BATCH_BYTES):
                part = batch.slice(lo, hi - lo)
                data, offsets = bt.buffers(part.column(1))
                split = split_texts(m, data, offsets)
                ids, at, same = encode_texts(m, data, offsets, split)
                keys = np.array([key_of(x, seed) for x in part.column(0).to_pylist()], np.uint64)
                samples = sample_texts(m, data, offsets, bt.mix(keys), k, split)
                flat = [s for x in samples for s in x]
                n = np.array([len(s.ids) for s in flat], np.int32)
                pieces = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(np.concatenate([s.ids for s in flat] or [ids[:0]]), pa.int32())) if with_sample_ids else pa.nulls(len(flat), pa.list_(pa.int32()))
                columns = [pa.array(n), *[pa.array([getattr(s, c) for s in flat], pa.float64()) for c in ("logp", "gumbel", "log_inclusion")], pieces, pa.array([crc(s.ids) for s in flat], pa.int64())]
                drawn = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in samples])).astype(np.int32)), pa.StructArray.from_arrays(columns, fields=list(sample_type)))
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)) if with_ids else pa.nulls(hi - lo, pa.list_(pa.int32()))
                crcs = [crc(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), lists, pa.array(crcs, pa.int64()), pa.array(same), drawn], names=["doc_id", "n_tokens", "ids", "ids_crc", "round_trip", "samples"])

    schema = f"doc_id {kind}, n_tokens long, ids array<int>, ids_crc long, round_trip boolean, samples array<struct<n_tokens:int,logp:double,gumbel:double,log_inclusion:double,ids:array<int>,ids_crc:bigint>>"
    return docs.select(F.col(id_col).alias(i), F.col(text_col).cast("string").alias(t)).mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``rows`` with the text of the ids in ``ids_col`` added as ``text_col``; null ids give null, none give ''."""
    @F.pandas_udf("string")
    def texts(ids: pd.Series) -> pd.Series:
        m = model(path)
        return ids.map(lambda x: None if x is None else m.decode(np.asarray(x, np.int64)))

    return rows.withColumn(text_col, texts(F.col(ids_col)))
