"""Toxicity by nearest labelled examples (operator 1).

Each text is a TF-IDF vector over all words (lower-cased) of the labelled
examples, document frequencies counted over all documents. A word that the
examples tie to the label, by a likelihood-ratio test and a least lift, weighs
``1``, any other ``LIGHT``; none is dropped. The examples are held in an
inverted index whose postings are cut into blocks with the block's largest
weight. A query visits the blocks of the largest upper bounds and then those
whose bound reaches the k-th best cosine, so the neighbours are exact. Their
labels vote by cosine, the votes are calibrated on the examples themselves
(each without itself), and the neighbours are the evidence.

A score depends on the text alone: an example of the same text is never
evidence, whatever its id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .common import cut, drop_kept, id_remainder, unused
from .features import word_hashes
from .quality import TRAIN_BYTES, labelled

#: Labelled rows read at most, neighbours, examples in a block, and examples that calibrate the votes at most.
TRAIN_ROWS = 4096
NEIGHBOURS = 15
BLOCK = 64
CALIBRATION_ROWS = 2048
#: Least test statistic (G squared) and lift of a word that is tied to the label, and the weight of all others.
LEAST_G2 = 12.0
LEAST_LIFT = 8
LIGHT = 0.05
#: Blocks of the largest bounds that are scored before the others are pruned.
FIRST_BLOCKS = 6
#: Cosine mass that the share of the label among examples without a tied word adds to a vote.
PRIOR = 0.25


def word_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word hash, count) of the distinct words of each text, texts ascending."""
    h, _, _, at = word_hashes(data, offsets)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))) if len(h) else np.zeros(0, np.int64)
    return owner[new], h[new], np.diff(np.append(new, len(h)))


class Vocabulary:
    """Sorted word hashes with a table from their leading bits, so a look-up reads two or three neighbours."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.shift = np.uint64(64 - max(8, int(len(hashes)).bit_length()))
        slot = (hashes >> self.shift).astype(np.int64)
        slots = 1 << (64 - int(self.shift))
        self.start = np.searchsorted(slot, np.arange(slots))
        self.crowd = int(np.bincount(slot).max(initial=0))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``h`` of known words, their indices)."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = self.start[(h >> self.shift).astype(np.int64)]
        last = len(self.hashes) - 1
        for _ in range(self.crowd):
            k = k + ((k < last) & (self.hashes[np.minimum(k, last)] < h))
        k = np.minimum(k, last)
        at = np.flatnonzero(self.hashes[k] == h)
        return at, k[at]


def label_weights(term: np.ndarray, owner: np.ndarray, labels: np.ndarray, size: int, least: float = LEAST_G2, lift: float = LEAST_LIFT) -> np.ndarray:
    """1 for the words tied to the label, ``LIGHT`` for all others; ``term`` and ``owner`` list each example's distinct words."""
    pos = float(labels.sum())
    neg = float(len(labels) - pos)
    if not pos or not neg:
        return np.full(size, LIGHT)
    p = np.bincount(term, weights=labels[owner], minlength=size)
    n = np.bincount(term, minlength=size) - p

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(seen > 0, seen * np.log(seen / expected), 0.0)

    share = (p + n) / (pos + neg)
    g2 = 2 * (part(p, share * pos) + part(n, share * neg) + part(pos - p, pos - share * pos) + part(neg - n, neg - share * neg))
    return np.where((p >= 2) & (p * neg >= lift * n * pos) & (g2 >= least), 1.0, LIGHT)


@dataclass
class BlockMaxIndex:
    """Unit vectors of labelled examples: postings by word, and for each word the blocks it occurs in with its largest weight there."""

    labels: np.ndarray
    texts: np.ndarray  # a hash of each example's text
    weight: np.ndarray  # of each word: idf times what the label makes of it
    prior: float
    a: float = 1.0
    b: float = 0.0

    @classmethod
    def build(cls, labels: np.ndarray, texts: np.ndarray, owner: np.ndarray, term: np.ndarray, counts: np.ndarray, weight: np.ndarray, prior: float) -> BlockMaxIndex:
        """``owner, term, counts`` list the examples' distinct words, examples ascending."""
        index = cls(labels.astype(np.float64), texts, weight, prior)
        n = len(labels)
        w = (1 + np.log(counts)) * weight[term]
        w = w / np.sqrt(np.bincount(owner, weights=w * w, minlength=n))[owner]
        order = np.lexsort((term, owner))
        owner, term, w = owner[order], term[order], w[order]
        order = np.lexsort((owner, term))
        index.example, index.value = owner[order].astype(np.int32), w[order]
        block, term = index.example // BLOCK, term[order]
        # runs of one word in one block
        at = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1]))) if len(term) else np.zeros(0, np.int64)
        index.entry_at = np.append(at, len(term))
        index.entry_block = block[at].astype(np.int64)
        index.entry_most = np.maximum.reduceat(index.value, at) if len(at) else np.zeros(0)
        index.word_at = np.searchsorted(term[at], np.arange(len(weight) + 1))
        index.blocks = -(-n // BLOCK)
        return index

    def unit(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.weight[terms]
        return w / math.sqrt(float(w @ w))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS, text: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(cosines, examples) of the ``k`` largest positive cosines, ties by place; never examples of the text ``text``."""
        lo = self.word_at[terms]
        n = self.word_at[terms + 1] - lo
        entries = _ranges(lo, n)
        w, block = np.repeat(weights, n), self.entry_block[entries]
        bound = np.bincount(block, w * self.entry_most[entries], minlength=self.blocks)
        scores = np.zeros(len(self.labels))
        banned = np.flatnonzero(self.texts == text) if text is not None else ()
        first = bound >= np.partition(bound, -FIRST_BLOCKS)[-FIRST_BLOCKS] if self.blocks > FIRST_BLOCKS else np.ones(self.blocks, dtype=bool)
        self._add(scores, entries, w, first[block])
        scores[banned] = 0
        if not first.all():
            # bounds and scores are sums in different orders
            least = np.partition(scores, -k)[-k] - 1e-9 if len(scores) >= k else 0.0
            rest = ~first & (bound >= least) & (bound > 0)
            if rest.any():
                self._add(scores, entries, w, rest[block])
                scores[banned] = 0
        least = np.partition(scores, -k)[-k] if len(scores) >= k else 0.0
        found = np.flatnonzero((scores >= least) & (scores > 0))
        found = found[np.argsort(-scores[found], kind="stable")][:k]
        return scores[found], found

    def _add(self, scores: np.ndarray, entries: np.ndarray, w: np.ndarray, chosen: np.ndarray) -> None:
        """Add to ``scores`` the products of the chosen runs."""
        entries, w = entries[chosen], w[chosen]
        lo = self.entry_at[entries]
        n = self.entry_at[entries + 1] - lo
        at = _ranges(lo, n)
        scores += np.bincount(self.example[at], self.value[at] * np.repeat(w, n), minlength=len(scores))

    def vote(self, cosines: np.ndarray, examples: np.ndarray) -> float:
        return (float(cosines @ self.labels[examples]) + PRIOR * self.prior) / (float(cosines.sum()) + PRIOR)

    def score(self, cosines: np.ndarray, examples: np.ndarray) -> float:
        v = min(max(self.vote(cosines, examples), 1e-6), 1 - 1e-6)
        return 1 / (1 + math.exp(-(self.a * math.log(v / (1 - v)) + self.b)))

    def judge(self, terms: np.ndarray, counts: np.ndarray, text: int | None) -> tuple[float, np.ndarray, np.ndarray]:
        """(score, cosines, examples) of a text's known words."""
        if len(terms) and len(self.labels):
            cosines, examples = self.nearest(terms, self.unit(terms, counts), text=text)
        else:
            cosines, examples = np.zeros(0), np.zeros(0, np.int64)
        return self.score(cosines, examples), cosines, examples

    def calibrate(self, votes: np.ndarray, y: np.ndarray) -> None:
        """Fit the logistic curve from vote to label."""
        v = np.clip(votes, 1e-6, 1 - 1e-6)
        x = np.log(v / (1 - v))
        if len(x) < 10 or y.min() == y.max():
            return
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -35, 35)))
            w = p * (1 - p)
            # a weak pull to a = 1, b = 0 keeps separable votes finite
            grad = np.array([((p - y) * x).sum() + (a - 1), (p - y).sum() + b])
            hess = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 1]])
            step = np.linalg.solve(hess, grad)
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-9:
                break
        if a > 0:
            self.a, self.b = float(a), float(b)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


@dataclass
class Fitted:
    """What scoring needs: the words, the index, and the examples' ids as an Arrow array."""

    vocabulary: Vocabulary
    index: BlockMaxIndex
    ids: pa.Array

    def judge(self, texts: pa.Array, marks: np.ndarray) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """:meth:`BlockMaxIndex.judge` of each text; ``marks`` holds a hash of each."""
        for lo, hi in bt.slices(texts):
            owner, h, n = word_counts(*bt.buffers(texts.slice(lo, hi - lo)))
            at, term = self.vocabulary.find(h)
            begin = np.searchsorted(owner[at], np.arange(hi - lo + 1)).tolist()
            n = n[at]
            for k, (a, b) in enumerate(zip(begin, begin[1:], strict=False)):
                yield self.index.judge(term[a:b], n[a:b], int(marks[lo + k]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", folds: int = 4, held: int = 2, train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> Fitted:
    """Examples from rows whose crc32(id) mod ``folds`` is not ``held``, see :func:`toxicity`; one pass over ``docs`` counts document frequencies."""
    spark = docs.sparkSession
    marks = labels.where(id_remainder("doc_id", folds) != held)
    sample = labelled(docs, marks, label, id_col, text_col, train_rows, train_bytes)
    # of equal texts one is an example, so copies don't outvote the rest
    (row,) = unused(sample, "x_row")
    sample = sample.groupBy(F.sha2("x_text", 256)).agg(F.min(F.struct("x_id", "x_label", "x_text")).alias(row)).select(f"{row}.*", F.xxhash64(f"{row}.x_text").alias("x_mark"))
    sample = cut(sample, "toxicity-sample")
    kind = sample.schema["x_id"].dataType.simpleString()

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in bt.slices(batch["x_text"]):
                part = batch.slice(lo, hi - lo)
                owner, h, n = word_counts(*bt.buffers(part["x_text"]))
                at = pa.array(np.searchsorted(owner, np.arange(hi - lo + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part["x_id"], part["x_label"], part["x_mark"], pa.ListArray.from_arrays(at, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(at, pa.array(n.astype(np.int32)))], names=["id", "label", "mark", "words", "counts"])

    # bounded by train_rows and train_bytes
    found = sample.mapInArrow(vectors, f"id {kind}, label int, mark long, words array<long>, counts array<int>").toArrow().combine_chunks()
    marks_, y = found["mark"].to_numpy(), (found["label"].to_numpy() > 0).astype(np.float64)
    lists = found["words"].combine_chunks()
    owner = np.repeat(np.arange(len(y)), lists.value_lengths().to_numpy(zero_copy_only=False)) if len(y) else np.zeros(0, np.int64)
    hashes = lists.flatten().to_numpy().view(np.uint64) if len(y) else np.zeros(0, np.uint64)
    counts = found["counts"].combine_chunks().flatten().to_numpy() if len(y) else np.zeros(0, np.int32)
    known, term = np.unique(hashes, return_inverse=True)
    vocabulary = Vocabulary(known)

    shared = spark.sparkContext.broadcast(vocabulary)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        vocabulary, rows = shared.value, 0
        seen = np.zeros(len(vocabulary.hashes) + 1, np.int64)
        for batch in batches:
            rows += batch.num_rows
            for lo, hi in bt.slices(batch.column(0)):
                _, h, _ = word_counts(*bt.buffers(batch.column(0).slice(lo, hi - lo)))
                seen[:-1] += np.bincount(vocabulary.find(h)[1], minlength=len(seen) - 1)
        seen[-1] = rows
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["term", "n"])

    (t,) = unused(docs, "x_text")
    counted = docs.select(F.col(text_col).cast("string").alias(t)).mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # one row a word of the examples
    df = np.zeros(len(known) + 1)
    df[counted["term"].to_numpy()] = counted["n"].to_numpy()
    idf = np.log((df[-1] + 1) / (df[:-1] + 1)) + 0.1  # a word of every text tells little, but not nothing
    tied = label_weights(term, owner, y, len(known)) if len(y) else np.zeros(0)

    # alike examples side by side, so their blocks' bounds are tight: by the weightiest tied word, then by the most repeated one
    weight = idf * tied
    best = _best_term(owner, term, np.where(tied[term] == 1.0, weight[term], 0.0), len(y))
    most = _best_term(owner, term, counts, len(y))
    order = np.lexsort((marks_, most, best)) if len(y) else np.zeros(0, np.int64)
    place = np.argsort(order)
    plain = best < 0
    prior = (float(y[plain].sum()) + 0.1) / (int(plain.sum()) + 1)
    index = BlockMaxIndex.build(y[order], marks_[order], place[owner] if len(y) else owner, term, counts, weight, prior)
    fitted = Fitted(vocabulary, index, found["id"].combine_chunks().take(pa.array(order)))

    at = np.searchsorted(owner, np.arange(len(y) + 1))
    step = max(1, -(-len(y) // CALIBRATION_ROWS))
    tried = np.argsort(marks_, kind="stable")[::step].tolist()  # by a hash of the text
    votes = [index.vote(*index.judge(term[at[e] : at[e + 1]], counts[at[e] : at[e + 1]], int(marks_[e]))[1:]) for e in tried]
    index.calibrate(np.array(votes), y[tried])
    return fitted


def _best_term(owner: np.ndarray, term: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` examples the word of the largest positive value, the least of equal ones; -1 without."""
    out = np.full(n, -1, np.int64)
    order = np.lexsort((-term, value, owner))
    order = order[value[order] > 0]
    out[owner[order]] = term[order]
    return out


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", folds: int = 4, held: int = 2, threshold: float = 0.3, **bounds: int) -> DataFrame:
    """One row a document: ``doc_id, held_out, score, predicted, evidence``.

    Labels are learnt from rows whose crc32(id) mod ``folds`` is not ``held``,
    at most ``train_rows`` of them (``train_bytes`` of text) in the order of a
    hash of the id. The score depends on the text alone, so equal texts score
    alike. ``evidence`` lists ``doc_id, cosine, label`` of the nearest
    examples, best first; an example of the same text is never evidence.
    Texts without a word of any example, empty and null ones too, have no
    evidence and get the calibrated share of the label among examples without a
    tied word. Without labels every text gets the same score. Repeated and null
    ids each give a row; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label, folds, held, **bounds))
    kind = docs.schema[id_col].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        fitted = shared.value
        for batch in batches:
            scores, cosines, examples = [], [np.zeros(0)], [np.zeros(0, np.int64)]
            for score, c, e in fitted.judge(batch.column(1), batch.column(2).to_numpy()):
                scores.append(score)
                cosines.append(c)
                examples.append(e)
            at, e = np.cumsum([len(x) for x in cosines]).astype(np.int32), np.concatenate(examples)
            rows = pa.StructArray.from_arrays([fitted.ids.take(pa.array(e)), pa.array(np.concatenate(cosines)), pa.array(fitted.index.labels[e].astype(np.int32))], names=["doc_id", "cosine", "label"])
            verdicts = pa.array([int(s >= threshold) for s in scores], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), verdicts, pa.ListArray.from_arrays(pa.array(at), rows)], names=["doc_id", "score", "predicted", "evidence"])

    i, t, m = unused(docs, "x_id", "x_text", "x_mark")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.select(F.col(id_col).alias(i), text.alias(t), F.xxhash64(text).alias(m)).mapInArrow(judge, f"doc_id {kind}, score double, predicted int, evidence array<struct<doc_id:{kind},cosine:double,label:int>>")
    return out.select("doc_id", (id_remainder("doc_id", folds) == held).alias("held_out"), "score", "predicted", "evidence")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **options) -> DataFrame:
    """``docs`` without the rows whose text :func:`toxicity` rejects; same columns. Each row is judged by its own text, whatever its id."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, **options))
    t, m = unused(docs, "x_text", "x_mark")
    text, names = F.coalesce(F.col(text_col).cast("string"), F.lit("")), docs.columns
    # a column of texts is read where it is: a second copy would double what the executors hold
    plain = text_col in names and docs.schema[text_col].dataType.simpleString() == "string"
    added = {m: F.xxhash64(text)} if plain else {t: text, m: F.xxhash64(text)}

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        for batch in batches:
            texts = batch[text_col if plain else t]
            for lo, hi in bt.slices(texts):
                part, marks = texts.slice(lo, hi - lo), batch[m].slice(lo, hi - lo).to_numpy()
                scores = [s for s, _, _ in shared.value.judge(part, marks)]
                yield batch.select(names).slice(lo, hi - lo).filter(pa.array(np.array(scores) < threshold, pa.bool_()))

    return docs.withColumns(added).mapInArrow(keep, docs.schema)
