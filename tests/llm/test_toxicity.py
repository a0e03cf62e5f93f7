import numpy as np
from pyspark.sql import functions as F

from sigdiff.llm import gru, toxicity as tx
from tests.llm.helpers import awkward, docs, none

LABELS = "doc_id long, toxic int"


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    p = tx.new_params(2, np.float64)
    x = rng.normal(size=(50, tx.WORD + tx.CHARS))
    words = rng.integers(0, 50, (tx.WIDTH, 6))
    mask = (np.arange(tx.WIDTH)[:, None] < np.array([32, 5, 1, 20, 32, 9])).astype(float)
    y, weight = np.array([1.0, 0, 1, 0, 1, 0]), np.array([1.0, 2, 1, 1, 3, 1])
    _, g, de = tx.gradients(p, x, words, mask, y, weight)
    loss = lambda: tx.gradients(p, x, words, mask, y, weight)[0]
    for name in ("wf", "wb", "uf", "ub", "cf", "cb", "a", "v", "o", "bias"):
        flat = p[name].reshape(-1)
        for i in rng.integers(0, len(flat), 3):
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-5 - g[name].reshape(-1)[i]) < 1e-6, name
    old = x[words[0, 0], 0]
    x[words[0, 0], 0] += 1e-5
    up = loss()
    x[words[0, 0], 0] = old
    assert abs((up - loss()) / 1e-5 - de[words == words[0, 0], 0].sum()) < 1e-4


def test_step_is_forward():
    rng = np.random.default_rng(1)
    x, u, h = rng.normal(size=(4, 3, 24)), rng.normal(size=(8, 24)), rng.normal(size=(3, 8))
    states, _ = gru.forward(x, u, h)
    for t in range(4):
        h = gru.step(x[t], h, u)
        assert np.allclose(h, states[t])


def test_windows_cover_every_word_and_overlap():
    w = tx.Windows(["a " * n for n in (0, 1, 31, 32, 33, 48, 100)])
    seen = [np.zeros(n, int) for n in w.f.n]
    for d, a, k in zip(w.doc, w.first - w.f.first[w.doc], w.length, strict=True):
        seen[d][a : a + k] += 1
    assert all(s.min(initial=1) >= 1 for s in seen) and seen[-1][20:80].min() == 2


def test_learns_words_that_are_rare_in_a_text(spark):
    rng = np.random.default_rng(3)
    say = lambda n: [f"w{i}" for i in rng.zipf(1.4, n) % 500]
    texts, toxic = [], []
    for i in range(500):
        words = say(int(rng.integers(20, 150)))
        if i % 3 == 0:
            words[int(rng.integers(0, len(words)))] = ("vile", "scum", "trash")[i % 9 // 3]
        texts.append(" ".join(words))
        toxic.append(int(i % 3 == 0))
    d, labels = docs(spark, texts), spark.createDataFrame(list(enumerate(toxic)), LABELS)
    model = tx.fit_toxicity(d, labels, F.col("doc_id") < 350)
    rows = tx.score_toxicity(d, model).where("doc_id >= 350").collect()
    assert sum((r.score >= 0.5) == toxic[r.doc_id] for r in rows) >= 0.9 * len(rows)


def test_awkward_and_empty_tables(spark):
    labels = spark.createDataFrame([(5, 1), (6, 1), (9, 0), (1, 0), (None, 1), (4, None)], LABELS)
    model = tx.fit_toxicity(awkward(spark), labels, F.lit(True))
    got = tx.score_toxicity(awkward(spark), model).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert len({r.score for r in got if r.doc_id in (5, 6)}) == 1 and len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    blank = tx.fit_toxicity(none(spark), spark.createDataFrame([], LABELS), F.lit(True))
    assert {r.predicted for r in tx.score_toxicity(awkward(spark), blank).collect()} == {0}
    assert tx.score_toxicity(none(spark), blank).count() == 0


def test_score_equals_plain_loops():
    """The whole score, written out word by word and window by window."""
    rng = np.random.default_rng(6)
    p = {k: v.astype(np.float64) for k, v in tx.new_params(3).items()}
    p["word"] += rng.normal(0, 0.3, p["word"].shape)
    texts = ["", "one", " ".join(f"w{i % 13}" for i in range(33)), " ".join(f"Bad{i % 5}" for i in range(90))]
    f = tx.WordFeatures(texts, tx.BITS, (3,))
    rows, start, end = f.grams[0]
    sig = lambda x: 1 / (1 + np.exp(-x))
    tops = []
    for n, first in zip(f.n.tolist(), f.first.tolist(), strict=True):
        logits = [p["bias"][0]] if not n else []
        for at in range(0, max(1, n - tx.WIDTH + tx.STRIDE) if n > tx.WIDTH else min(n, 1), tx.STRIDE):
            x = [np.concatenate((p["word"][f.lexicon[k]], p["chars"][rows[start[k] : end[k]]].mean(0))) for k in range(first + at, first + min(n, at + tx.WIDTH))]
            both = []
            for d in ("f", "b"):
                h, states, u = np.zeros(tx.UNITS), [], tx.UNITS
                for e in x if d == "f" else x[::-1]:
                    a, g = e @ p[f"w{d}"] + p[f"c{d}"], h @ p[f"u{d}"]
                    z, r = sig(a[:u] + g[:u]), sig(a[u : 2 * u] + g[u : 2 * u])
                    c = np.tanh(a[2 * u :] + r * g[2 * u :])
                    h = c + z * (h - c)
                    states.append(h)
                both.append(states if d == "f" else states[::-1])
            s = np.array([np.concatenate(y) for y in zip(*both, strict=True)])
            w = np.exp(np.tanh(s @ p["a"]) @ p["v"])
            logits.append((w / w.sum()) @ s @ p["o"] + p["bias"][0])
        tops.append(max(logits))
    got = tx.ToxicityModel(p, 1.3, -0.2).score(texts)
    assert np.allclose(got, [sig(1.3 * t - 0.2) for t in tops], rtol=1e-4)
