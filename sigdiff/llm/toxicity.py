"""Toxicity by a bidirectional gated recurrent network with attention pooling, over word and character inputs.

A word's input is its own embedding (hashed) beside the mean embedding of its character trigrams, spaces at its ends included. A text is
cut in windows of WIDTH words that overlap by half; in each the states of both directions are pooled by attention to
one logit. The greatest logit of a text's windows, put on the scale of whole documents, gives its score.

Training, in numpy: windows of labelled texts take their text's label; after the first pass only those windows of toxic texts stay
that the network finds most toxic, for most of their windows hold nothing toxic.

Null and empty texts have no words: their score is that of the bias. Texts are read whole. Repeated rows get equal scores.
Without labelled rows of both kinds every score is the share of toxic ones (0 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigdiff.llm.common import blocks, label_sample, training_texts, two_columns
from sigdiff.llm.gru import Adam, RowSteps, backward, forward, step
from sigdiff.llm.langid import WordFeatures, _spans

BITS = 15
WORD, CHARS, UNITS, ATTENTION = 12, 8, 8, 8
#: Words of a window, and words from one window to the next.
WIDTH, STRIDE = 32, 16
#: Labelled texts of each label that a model is fitted on, at most, and bytes of all of them, at most. Every window of these texts is trained on.
TRAIN_ROWS, TRAIN_BYTES = 1_000, 16_000_000

#: Steps of training, at least, but for 4 to 20 epochs.
STEPS = 450


class Windows:
    """Inputs of the words of some texts, and the texts' windows as rows of word numbers."""

    def __init__(self, texts: list[str]):
        self.f = f = WordFeatures(texts, BITS, (3,))
        n, first = f.n, f.first
        count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WIDTH) // STRIDE)), 0)
        self.doc = np.repeat(np.arange(len(n)), count)
        within = np.arange(len(self.doc)) - np.repeat(np.concatenate(([0], np.cumsum(count)[:-1])) if len(n) else count, count)
        at = within * STRIDE
        self.length = np.minimum(WIDTH, n[self.doc] - at)
        self.first = first[self.doc] + at

    def words(self, which: slice | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(steps, windows) word numbers, and 1 where there is a word."""
        t = np.arange(WIDTH)[:, None]
        inside = t < self.length[which]
        return np.where(inside, self.first[which] + t, 0), inside.astype(np.float32)


def new_params(seed: int = 1, dtype=np.float32) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    size = WORD + CHARS
    normal = lambda *shape: (rng.normal(0, 1 / np.sqrt(shape[0]), shape)).astype(dtype)
    p = {"word": rng.normal(0, 0.05, (1 << BITS, WORD)).astype(dtype), "chars": rng.normal(0, 0.05, (1 << BITS, CHARS)).astype(dtype)}
    for d in ("f", "b"):
        p |= {f"w{d}": normal(size, 3 * UNITS), f"u{d}": normal(UNITS, 3 * UNITS), f"c{d}": np.zeros(3 * UNITS, dtype)}
    return p | {"a": normal(2 * UNITS, ATTENTION), "v": normal(ATTENTION), "o": normal(2 * UNITS), "bias": np.zeros(1, dtype)}


def inputs(p: dict[str, np.ndarray], f: WordFeatures, low: int, high: int) -> np.ndarray:
    """(high - low, WORD + CHARS): of the words from low to high."""
    rows, start, end = f.grams[0]
    start, end = start[low:high], end[low:high]
    base = start[0] if len(start) else 0
    chars = _spans(p["chars"][rows[base : end[-1] if len(end) else 0]], start - base, end - base) / (end - start).astype(p["chars"].dtype)[:, None]
    return np.concatenate((p["word"][f.lexicon[low:high]], chars), 1)


def _pool(p: dict[str, np.ndarray], states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
    t = np.tanh(states @ p["a"])
    s = np.where(mask > 0, t @ p["v"], -1e9)
    w = np.exp(s - s.max(0)) * (mask > 0)
    w /= np.maximum(w.sum(0), 1e-30)
    pooled = (w[:, :, None] * states).sum(0)
    return t, w, pooled, pooled @ p["o"] + p["bias"][0]


def logits(p: dict[str, np.ndarray], windows: Windows, batch: int = 4096) -> np.ndarray:
    """Of every window."""
    out = np.empty(len(windows.doc), np.float32)
    for at in range(0, len(out), batch):
        part = slice(at, at + batch)
        low, high = int(windows.first[part][0]), int((windows.first[part] + windows.length[part]).max())
        x = inputs(p, windows.f, low, high)
        project = {d: x @ p[f"w{d}"] + p[f"c{d}"] for d in ("f", "b")}
        words, mask = windows.words(part)
        words = np.maximum(words - low, 0)
        states = np.zeros((WIDTH, words.shape[1], 2 * UNITS), x.dtype)
        whole = bool(mask.all())
        for d, order, where in (("f", range(WIDTH), slice(0, UNITS)), ("b", range(WIDTH - 1, -1, -1), slice(UNITS, None))):
            h = np.zeros((words.shape[1], UNITS), x.dtype)
            for t in order:
                new = step(project[d][words[t]], h, p[f"u{d}"])
                h = new if whole else h + mask[t][:, None] * (new - h)
                states[t, :, where] = h
        out[part] = _pool(p, states, mask)[3]
    return out


def gradients(p: dict[str, np.ndarray], x: np.ndarray, words: np.ndarray, mask: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
    """Mean loss of a batch of windows, gradients of the dense parameters, and those of the inputs (steps, windows, inputs)."""
    e = x[words]
    cache, states = {}, []
    for d, flip in (("f", slice(None)), ("b", slice(None, None, -1))):
        s, cache[d] = forward((e @ p[f"w{d}"] + p[f"c{d}"])[flip], p[f"u{d}"], np.zeros((words.shape[1], UNITS), e.dtype), mask[flip])
        states.append(s[flip])
    states = np.concatenate(states, 2)
    t, w, pooled, z = _pool(p, states, mask)
    q = 1 / (1 + np.exp(-z))
    loss = float(-(weight * (label * np.log(q + 1e-12) + (1 - label) * np.log(1 - q + 1e-12))).sum() / weight.sum())
    dz = (weight * (q - label) / weight.sum()).astype(e.dtype)
    g = {"o": pooled.T @ dz, "bias": dz.sum(keepdims=True)}
    d_pool = dz[:, None] * p["o"]
    dw = (states * d_pool).sum(2)
    ds = w * (dw - (w * dw).sum(0))
    dt = ds[:, :, None] * p["v"] * (1 - t * t)
    g["v"] = np.einsum("tb,tbk->k", ds, t)
    g["a"] = np.einsum("tbi,tbk->ik", states, dt)
    d_states = w[:, :, None] * d_pool + dt @ p["a"].T
    de = np.zeros_like(e)
    for d, flip, part in (("f", slice(None), slice(0, UNITS)), ("b", slice(None, None, -1), slice(UNITS, None))):
        dx, g[f"u{d}"] = backward(np.ascontiguousarray(d_states[flip][:, :, part]), cache[d], p[f"u{d}"])
        dx = dx[flip]
        g[f"w{d}"] = np.einsum("tbi,tbk->ik", e, dx)
        g[f"c{d}"] = dx.sum((0, 1))
        de += dx @ p[f"w{d}"].T
    return loss, g, de


@dataclass
class ToxicityModel:
    params: dict[str, np.ndarray] | None
    slope: float
    shift: float

    def score(self, texts: list[str]) -> np.ndarray:
        top = np.zeros(len(texts), np.float32)
        if self.params is not None:
            w = Windows(texts)
            top[:] = self.params["bias"][0]
            if len(w.doc):
                value = logits(self.params, w)
                firsts = np.flatnonzero(np.diff(w.doc, prepend=-1))
                top[w.doc[firsts]] = np.maximum.reduceat(value, firsts)
        return 1 / (1 + np.exp(-np.clip(self.slope * top.astype(np.float64) + self.shift, -40, 40)))


def fit_network(texts: list[str], labels: list[int], batch: int = 128, seed: int = 1) -> ToxicityModel:
    y = np.array(labels, np.float32)
    share = float(y.mean()) if len(y) else 0.0
    if not 0 < share < 1:
        return ToxicityModel(None, 0.0, 40.0 if share else -40.0)
    rng = np.random.default_rng(seed)
    p, windows = new_params(seed), Windows(texts)
    adam, word_steps, char_steps = Adam(0.01), RowSteps(p["word"], 0.05), RowSteps(p["chars"], 0.05)
    rows, start, end = windows.f.grams[0]
    use = np.arange(len(windows.doc))
    # small samples are gone over more often
    steps = max(1, len(use) // batch)
    for epoch in range(int(np.clip(STEPS // steps, 4, 20))):
        if epoch:
            value = logits(p, windows)
            order = np.lexsort((-value, windows.doc))
            place = np.arange(len(order)) - np.searchsorted(windows.doc[order], windows.doc[order])
            n = np.bincount(windows.doc, minlength=len(y))[windows.doc[order]]
            use = np.sort(order[(y[windows.doc[order]] == 0) | (place < np.maximum(1, n / 2 ** min(epoch + 1, 3)))])
        picked = rng.permutation(use)
        positive = max(1.0, float(y[windows.doc[picked]].sum()))
        balance = min(8.0, (len(picked) - positive) / positive)
        for at in range(0, len(picked), batch):
            part = picked[at : at + batch]
            words, mask = windows.words(part)
            known, inverse = np.unique(words, return_inverse=True)
            inverse = inverse.reshape(words.shape)
            gram_counts = end[known] - start[known]
            gram_owner = np.repeat(np.arange(len(known)), gram_counts)
            gram_rows = np.concatenate([rows[a:b] for a, b in zip(start[known], end[known], strict=True)])
            chars = np.zeros((len(known), CHARS), np.float32)
            np.add.at(chars, gram_owner, p["chars"][gram_rows])
            x = np.concatenate((p["word"][windows.f.lexicon[known]], chars / gram_counts[:, None].astype(np.float32)), 1)
            label = y[windows.doc[part]]
            _, grads, de = gradients(p, x, inverse, mask, label, np.where(label > 0, balance, 1).astype(np.float32))
            adam(p, grads)
            total = np.zeros((len(known), WORD + CHARS), np.float32)
            np.add.at(total, inverse.ravel(), (de * mask[:, :, None]).reshape(-1, WORD + CHARS))
            word_steps(windows.f.lexicon[known], total[:, :WORD])
            char_steps(gram_rows, (total[:, WORD:] / gram_counts[:, None].astype(np.float32))[gram_owner])
    model = ToxicityModel(p, 1.0, 0.0)
    score = model.score(texts)
    return ToxicityModel(p, *_scale(np.log(score / (1 - score)), y))


def _scale(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic regression on one number, with a small penalty."""
    a, b = 1.0, 0.0
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        h = q * (1 - q)
        g = np.array([((q - y) * x).sum() + 0.5 * (a - 1), (q - y).sum() + 0.01 * b])
        hessian = np.array([[(h * x * x).sum() + 0.5, (h * x).sum()], [(h * x).sum(), h.sum() + 0.01]])
        move = np.linalg.solve(hessian, g)
        a, b = a - float(np.clip(move[0], -1, 1)), b - float(np.clip(move[1], -1, 1))
    return a, b


def fit_toxicity(docs: DataFrame, labels: DataFrame, keep: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> ToxicityModel:
    """Fitted on at most ``rows`` labelled texts of each label (``train_bytes`` bytes together), those whose ids hash lowest, for which ``keep`` (over the labels) holds."""
    of = lambda y: label_sample(labels, label_col, keep & (F.col(label_col) == y), rows)
    sample = of(0).unionByName(of(1)).groupBy("doc_id").agg(F.max("label").alias("label"))
    got = training_texts(docs, sample, id_col, text_col, train_bytes).orderBy("doc_id").toArrow()
    y = got["label"].to_pylist()
    model = fit_network(got["text"].to_pylist(), y)
    # the sample has as many toxic texts as it can get: back to their share among all labels
    total = {r.label: r.n for r in labels.where(keep).groupBy((F.col(label_col) > 0).alias("label")).agg(F.count("*").alias("n")).collect()}
    if model.params is not None and total.get(True) and total.get(False):
        model.shift += float(np.log(total[True] / total[False]) - np.log(sum(y) / (len(y) - sum(y))))
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted (1 from the threshold on) of every row; no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches):
            yield pa.record_batch([part.column("doc_id"), pa.array(held.value.score(texts), pa.float64())], ["doc_id", "score"])

    return two_columns(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
