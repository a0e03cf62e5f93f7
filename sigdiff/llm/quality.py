"""Quality classifier: logistic regression on hashed word n-grams, trained with
follow-the-regularised-leader updates; a score is a sparse dot product.

Features of a text are its words, pairs of words, and n-grams (1 to 3) of word shapes. A shape holds
which kinds of characters a word has, how it ends, a coarse length and whether it repeats one of
the two words before. Each feature's value is the square root of its share of the text.

Null and empty texts have no features: their score is that of the bias. Texts of any length are read
whole. Repeated rows get equal scores. Without any labelled row every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigdiff.llm.common import Words, blocks, label_sample, mix, sum_by_doc, training_texts, two_columns

#: log2 of the number of weights.
BITS = 18
#: Labelled rows that a model is fitted on, at most, and bytes of their texts, at most.
TRAIN_ROWS, TRAIN_BYTES = 8_000, 32_000_000
EPOCHS = 4

_KIND = np.full(256, 8, np.uint8)  # other ASCII
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 4
_KIND[128:] = 16


def shapes(w: Words) -> np.ndarray:
    if not len(w.start):
        return np.zeros(0, np.uint64)
    kind = _KIND[w.raw]
    edges = np.empty(2 * len(w.start), np.int64)
    edges[0::2], edges[1::2] = w.start, w.end
    if edges[-1] == len(kind):
        kind = np.append(kind, np.uint8(0))
    has = np.bitwise_or.reduceat(kind, edges)[0::2].astype(np.uint64)
    length = np.minimum(np.log2((w.end - w.start) + 1).astype(np.uint64), np.uint64(6))
    again = np.zeros(len(has), np.uint64)
    for back, bit in ((1, 1), (2, 2)):
        same = (w.hash[back:] == w.hash[:-back]) & (w.doc[back:] == w.doc[:-back])
        again[back:] |= np.where(same, np.uint64(bit), np.uint64(0))
    last = kind[w.end - 1].astype(np.uint64)
    return has | (last << np.uint64(8)) | (length << np.uint64(16)) | (again << np.uint64(24))


def features(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, feature, value) by text and feature, and the number of features of each text."""
    w = Words(texts)
    shape, shift, step = shapes(w), np.uint64(64 - bits), np.uint64(0x9E3779B97F4A7C15)
    parts = []
    for salt, unit, longest in ((1, w.hash, 2), (2, shape, 3)):
        run = unit
        for n in range(1, longest + 1):
            if n > 1:
                run = run[:-1] * step + unit[n - 1 :]
            inside = w.doc[n - 1 :] == w.doc[: len(w.doc) - n + 1]
            key = mix(run + np.uint64(salt * 16 + n)) >> shift
            parts.append((w.doc[: len(key)][inside].astype(np.uint64) << np.uint64(bits)) | key[inside])
    keys, counts = np.unique(np.concatenate(parts), return_counts=True)
    doc = (keys >> np.uint64(bits)).astype(np.int64)
    total = np.bincount(np.repeat(doc, counts), minlength=len(texts))
    value = np.sqrt(counts / total[doc]) if len(doc) else np.zeros(0)
    return doc, (keys & np.uint64((1 << bits) - 1)).astype(np.int64), value, np.bincount(doc, minlength=len(texts))


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    bits: int = BITS

    def score(self, texts: list[str]) -> np.ndarray:
        doc, key, value, _ = features(texts, self.bits)
        return 1 / (1 + np.exp(-(self.bias + sum_by_doc(self.weights[key] * value, doc, len(texts)))))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, seed: int = 7) -> QualityModel:
    """rows: (features, values, label). Per-coordinate follow-the-regularised-leader, one text at a time."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    bias = 1 << bits

    def weights(i: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z[i]) * np.maximum(np.abs(z[i]) - np.where(i == bias, 0, l1), 0)
        return -shrunk / ((beta + np.sqrt(n[i])) / alpha + l2)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            key, value, label = rows[r]
            i, x = np.append(key, bias), np.append(value, 1.0)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange((1 << bits) + 1))
    return QualityModel(w[:-1].astype(np.float32), float(w[-1]), bits)


def _feature_rows(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches):
            doc, key, value, n = features(texts, bits)
            ends = np.cumsum(n)[:-1]
            yield pa.record_batch([part.column("doc_id"), part.column("label"), pa.array(np.split(key.astype(np.int32), ends), pa.list_(pa.int32())), pa.array(np.split(value.astype(np.float32), ends), pa.list_(pa.float32()))], ["doc_id", "label", "key", "value"])

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, keep, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, bits: int = BITS, train_bytes: int = TRAIN_BYTES) -> QualityModel:
    """Fitted on at most ``rows`` labelled texts of ``train_bytes`` bytes together for which ``keep`` (over the labels) holds; only their features reach the driver."""
    sample = label_sample(labels, label_col, keep, rows)
    known = training_texts(docs, sample, id_col, text_col, train_bytes)
    got = known.mapInArrow(_feature_rows(bits), "doc_id long, label int, key array<int>, value array<float>").toArrow().sort_by("doc_id")
    key, value, label = got["key"].combine_chunks(), got["value"].combine_chunks(), got["label"].to_pylist()
    # views of the Arrow buffers; nothing is copied before training, and the buffers go back after it
    model = ftrl([(k.values.to_numpy(), v.values.to_numpy(), y) for k, v, y in zip(key, value, label, strict=True)], bits)
    del got, key, value
    pa.default_memory_pool().release_unused()
    return model


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row for each row of docs: doc_id, score, predicted (1 from the threshold on)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches):
            yield pa.record_batch([part.column("doc_id"), pa.array(held.value.score(texts), pa.float64())], ["doc_id", "score"])

    scored = two_columns(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _filter_rows(held, threshold: float, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, column=text_col):
            yield part.filter(pa.array(held.value.score([t or "" for t in texts]) >= threshold))

    return run


def keep_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text scores at least the threshold."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_filter_rows(held, threshold, text_col), docs.schema)
