"""Quality classifier (operator 4): hashed n-gram logistic regression by FTRL.

Training reads a bounded sample of labelled rows, in the order of a hash, and
runs follow-the-regularised-leader with per-coordinate rates; only weights that
the L1 term leaves non-zero are kept. Scoring is one map over all documents: a
sparse dot product of a text's n-gram counts, over the root of their number,
with the weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytetext as bt
from .common import id_remainder, unused
from .features import ngrams

#: Labelled rows that training reads at most, bytes of their texts, and the features' index bits.
TRAIN_ROWS = 12_000
TRAIN_BYTES = 96 << 20
BITS = 20


@dataclass
class Model:
    """Weights of the hashed features (dense, float32) and the bias."""

    weights: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        at, cut = ngrams(data, offsets, BITS)
        sums = np.concatenate([[0.0], np.cumsum(self.weights[at], dtype=np.float64)])
        n = np.maximum(np.diff(cut), 1)
        return 1 / (1 + np.exp(-np.clip((sums[cut[1:]] - sums[cut[:-1]]) / np.sqrt(n) + self.bias, -35, 35)))


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 1.0, epochs: int = 2) -> Model:
    """``rows``: (distinct feature indices, counts over the root of their sum, label).

    Without rows the model answers 0.5; with one label only it leans to that label.
    """
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0

    def solve(z, n):
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for at, x, label in rows:
            zi, ni = z[at], n[at]
            w = solve(zi, ni)
            b = -zb / ((beta + nb**0.5) / alpha)
            p = 1 / (1 + np.exp(-np.clip(w @ x + b, -35, 35)))
            g = (p - label) * x
            s = np.sqrt(ni + g * g)
            z[at] = zi + g - (s - np.sqrt(ni)) / alpha * w
            n[at] = ni + g * g
            gb = p - label
            zb += gb - ((nb + gb * gb) ** 0.5 - nb**0.5) / alpha * b
            nb += gb * gb
    return Model(solve(z, n).astype(np.float32), float(-zb / ((beta + nb**0.5) / alpha)))


def labelled(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, train_rows: int, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """A bounded sample ``(x_id, x_text, x_label)`` of the rows with a label, those of the smallest hash of the id.

    Rows without id or label are left out; of several labels of an id the
    largest counts; of several texts that of the least SHA-256, so reruns
    agree. Rows are read in the order of the hash as long as their texts have
    ``train_bytes`` together, one text at most a sixteenth of that.
    """
    marks = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("x_label"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).withColumnRenamed("doc_id", "x_key")
    texts = docs.select(F.col(id_col).alias("x_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("x_text"))
    # bounded by train_rows, so it may be broadcast
    rows = texts.join(F.broadcast(marks), F.col("x_id") == F.col("x_key"))
    rows = rows.groupBy("x_id", "x_label").agg(F.min(F.struct(F.sha2("x_text", 256).alias("sha"), F.col("x_text").alias("text")))["text"].alias("x_text"))
    size = F.octet_length("x_text")
    # one task for train_rows rows at most
    so_far = Window.orderBy(F.xxhash64("x_id"), "x_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.where(size <= train_bytes // 16).withColumn("x_sum", F.sum(size).over(so_far))
    return rows.where(F.col("x_sum") <= train_bytes).select("x_id", "x_text", "x_label")


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on the labelled rows of ``docs``; at most ``train_rows``, in the order of a hash of the id."""
    found = labelled(docs, labels, label, id_col, text_col, train_rows)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in bt.slices(batch.column(1)):
                data, offsets = bt.buffers(batch.column(1).slice(lo, hi - lo))
                at, cut = ngrams(data, offsets, BITS)
                idx, val = [], []
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    u, c = np.unique(at[a:b], return_counts=True)
                    idx.append(u.astype(np.int32).tobytes())
                    val.append((c / max(b - a, 1) ** 0.5).astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(idx, pa.binary()), pa.array(val, pa.binary()), batch.column(2).slice(lo, hi - lo)], names=["id", "at", "x", "label"])

    kind = found.schema["x_id"].dataType.simpleString()
    rows = found.mapInArrow(featurise, f"id {kind}, at binary, x binary, label int").toArrow()
    data = sorted(zip(*(rows[c].to_pylist() for c in ("id", "at", "x", "label")), strict=True), key=lambda r: (hash_order(r[0]), str(r[0])))
    data = [(np.frombuffer(at, np.int32), np.frombuffer(x, np.float32), 1 if y > 0 else 0) for _, at, x, y in data]
    return train_ftrl(data)


def hash_order(value) -> int:
    import zlib

    return zlib.crc32(str(value).encode())


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row a document: ``doc_id, score, predicted``; every whole text, null as empty.

    An empty text gets the score of the bias alone. Repeated ids each give a row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    i, t = unused(docs, "x_id", "x_text")
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in bt.slices(batch.column(1)):
                data, offsets = bt.buffers(batch.column(1).slice(lo, hi - lo))
                p = shared.value.scores(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).alias(i), F.col(text_col).cast("string").alias(t)).mapInArrow(score, f"doc_id {kind}, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, **names) -> DataFrame:
    """Train on labels whose crc32(id) mod ``folds`` is not ``held``, score all documents.

    Returns ``doc_id, held_out, score, predicted``.
    """
    model = train_quality(docs, labels.where(id_remainder("doc_id", folds) != held), **names)
    id_col = names.get("id_col", "doc_id")
    return score_quality(docs, model, id_col, names.get("text_col", "text")).select("doc_id", (id_remainder("doc_id", folds) == held).alias("held_out"), "score", "predicted")
