import math
import time
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sigdiff.llm import gru, lm
from tests.llm.helpers import awkward, docs, none


def words(t):
    return (t or "").encode().lower().split() + [None]


def made(seed=0):
    rng = np.random.default_rng(seed)
    nouns, verbs = [f"n{i}" for i in range(60)], [f"v{i}" for i in range(60)]
    texts = []
    for _ in range(300):
        side = rng.integers(0, 2)
        texts.append(" ".join(rng.choice((nouns, verbs)[(k + side) % 2]) for k in range(int(rng.integers(5, 90)))))
    return texts + [f"only once {i}" for i in range(40)] + ["", None, "The THE the"]


def test_base_counts_and_better_scores(spark, monkeypatch):
    monkeypatch.setattr(lm, "KEPT", 90)  # so that rare tokens go through the join
    monkeypatch.setattr(lm, "TOP", 80)
    texts = made()
    d = docs(spark, texts)
    model, counts = lm.fit_language_model(d, F.col("doc_id") % 5 != 1)
    c = Counter(w for i, t in enumerate(texts) if i % 5 != 1 for w in words(t))
    n, v = sum(c.values()), len(c)
    rows = lm.score_documents(d, model, counts).orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        w = words(t)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in c for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
    out = [r for r in rows if r.doc_id % 5 == 1]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_segments_cover_every_token(spark):
    texts = ["", "a", " ".join(f"w{i % 70}" for i in range(47)), " ".join(f"w{i % 70}" for i in range(48)), " ".join(f"w{i % 70}" for i in range(1000))]
    d = docs(spark, texts)
    hashes = np.unique(lm.tokens(texts)[0])
    v = lm.Vocabulary(hashes, np.ones(len(hashes), np.int64), np.arange(len(hashes)), len(hashes), len(hashes))
    rows = lm.segments_of(d.select("doc_id", "text"), spark.sparkContext.broadcast(v)).orderBy("doc_id", "at").collect()
    for i, t in enumerate(texts):
        own = v.ids(v.look_up(lm.tokens([t])[0])).tolist()
        mine = [np.frombuffer(r.ids, np.int32).tolist() for r in rows if r.doc_id == i]
        assert len(mine) == (len(own) - 1) // 48 + 1
        assert [x for r in mine for x in r[1:] if x >= 0] == own
        assert [r[0] for r in mine] == [v.top + 1, *(own[k * 48 - 1] for k in range(1, len(mine)))]


def test_every_segment_is_trained_on_once_and_follows_its_own(monkeypatch):
    seen = []

    def gradients(p, ids, h, top):
        seen.extend((ids[k, 1], h[k, 0]) for k in range(len(ids)))
        return 0.0, {}, np.repeat(ids[:, -1:], lm.UNITS, 1).astype(np.float32)

    monkeypatch.setattr(lm, "segment_gradients", gradients)
    for sizes in ([1] * 500, [700], [300, 1, 2, 5, 40], [1]):
        seen.clear()
        n = sum(sizes)
        segments = np.arange(1, n * 48 + 1).reshape(n, 48)
        segments = np.concatenate([segments[:, :1] - 1, segments], 1)
        first = np.zeros(n, bool)
        first[np.cumsum([0, *sizes[:-1]])] = True
        lm.train_runs({"u": np.zeros(1, np.float32)}, segments, first, 10**9, lambda p, g: None)
        assert sorted(x for x, _ in seen) == list(range(1, n * 48, 24))
        begins = {int(s) * 48 + 1 for s in np.flatnonzero(first)}
        fresh = {int(x) for x, h in seen if h == 0}
        assert begins <= fresh and all(h == x - 1 for x, h in seen if h) and len(fresh) <= len(sizes) + lm.BATCH[1]


def test_few_long_texts_train_the_network(spark):
    rng = np.random.default_rng(5)
    nouns, verbs = [f"n{i}" for i in range(60)], [f"v{i}" for i in range(60)]
    texts = [" ".join(rng.choice((nouns, verbs)[k % 2]) for k in range(30_000)) for _ in range(4)]
    d = docs(spark, texts)
    rows = lm.score_documents(d, *lm.fit_language_model(d, F.col("doc_id") > 0)).collect()
    held_out = next(r for r in rows if r.doc_id == 0)
    assert (held_out.score - held_out.base_score) / held_out.n_tokens > 0.2  # of log10(2) = 0.30 at most


def test_probabilities_sum_to_one(spark):
    d = docs(spark, made())
    model, _ = lm.fit_language_model(d, F.lit(True))
    v, p = model.vocabulary, model.params
    h = np.random.default_rng(0).normal(size=(3, lm.UNITS)).astype(np.float32)
    total = np.zeros(3)
    for target in range(v.top):
        total += np.exp(lm.log_probabilities(p, h, np.full(3, target), v.top)[0])
    other = np.exp(lm.log_probabilities(p, h, np.full(3, v.top), v.top)[0])
    rest = sum((c + 1) / v.rest for c, r in zip(v.counts, v.ranks, strict=True) if r >= v.top) + 1 / v.rest
    assert np.allclose(total + other * rest, 1, atol=1e-4)


def test_lanes_equal_one_document_at_a_time():
    v = lm.Vocabulary(np.arange(100, dtype=np.uint64), np.full(100, 5), np.arange(100), 500, 100)
    p = lm.new_params(v)
    rng = np.random.default_rng(2)
    for k in ("wc", "wt"):
        p[k] += rng.normal(0, 0.5, p[k].shape).astype(np.float32)
    ids = [rng.integers(0, 101, int(n)).astype(np.int32) for n in rng.integers(1, 400, 30)]
    together = lm.network_scores(p, v.top, ids)
    assert np.allclose(together, [lm.network_scores(p, v.top, [i])[0] for i in ids], rtol=1e-4)


def test_long_texts_are_laid_out_in_slices(monkeypatch):
    v = lm.Vocabulary(np.arange(100, dtype=np.uint64), np.full(100, 5), np.arange(100), 500, 100)
    p = lm.new_params(v)
    rng = np.random.default_rng(2)
    for k in ("wc", "wt"):
        p[k] += rng.normal(0, 0.5, p[k].shape).astype(np.float32)
    ids = [rng.integers(0, 101, n).astype(np.int32) for n in (3000, 1, 40, 40, 700, 129, 5)]
    whole = lm.network_scores(p, v.top, ids)
    monkeypatch.setattr(lm, "SLICE", 64)
    monkeypatch.setattr(lm, "LANES", 3)
    assert np.allclose(lm.network_scores(p, v.top, ids), whole, rtol=1e-5)


def test_tokens_of_a_long_text(monkeypatch):
    text = " ".join(f"Wort{i % 91}\t\nß{i % 7}" for i in range(3000))
    whole, n = lm.tokens(["a b", text, ""])
    monkeypatch.setattr(lm, "BLOCK_CHARS", 1000)
    parts, m = lm.tokens(["a b", text, ""])
    assert (whole == parts).all() and (n == m).all()


def test_scores_do_not_depend_on_the_layout(spark, monkeypatch):
    texts = made() * 3
    monkeypatch.setattr(lm, "SHARD", 5_000)
    scores = []
    for parts in (1, 7):
        d = docs(spark, texts).repartition(parts)
        rows = lm.score_documents(d, *lm.fit_language_model(d, F.col("doc_id") % 5 != 1)).orderBy("doc_id").collect()
        scores.append([r.score for r in rows])
    assert np.allclose(*scores, rtol=1e-6)


def test_gradients_equal_differences():
    v = lm.Vocabulary(np.arange(90, dtype=np.uint64), np.arange(90) + 1, np.arange(90)[::-1].copy(), 4095, 90)
    p = lm.new_params(v, dtype=np.float64)
    rng = np.random.default_rng(3)
    for k in ("wc", "wt"):
        p[k] += rng.normal(0, 0.3, p[k].shape)
    ids = rng.integers(0, 91, (5, 8))
    ids[2, 5:] = -1
    h = rng.normal(size=(5, lm.UNITS))
    _, g, _ = lm.segment_gradients(p, ids, h, v.top)
    for name, x in p.items():
        flat = x.reshape(-1)
        for i in rng.integers(0, len(flat), 4):
            old = flat[i]
            flat[i] = old + 1e-5
            up = lm.segment_gradients(p, ids, h, v.top)[0]
            flat[i] = old - 1e-5
            down = lm.segment_gradients(p, ids, h, v.top)[0]
            flat[i] = old
            assert abs((up - down) / 2e-5 - g[name].reshape(-1)[i]) < 1e-6, name


def test_awkward_and_empty_tables(spark):
    model, counts = lm.fit_language_model(awkward(spark), F.lit(True))
    got = lm.score_documents(awkward(spark), model, counts).collect()
    assert len(got) == 10 and {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1} and all(r.score < 0 for r in got)
    blank, counts = lm.fit_language_model(none(spark), F.lit(True))
    assert lm.score_documents(none(spark), blank, counts).count() == 0
    assert all(r.base_score == 0 and r.n_known == 0 for r in lm.score_documents(awkward(spark), blank, counts).collect())


def test_copies_go_to_many_shards_and_large_ones_are_cut(spark, monkeypatch):
    text = "a b c d e f g h " * 40
    some = spark.createDataFrame([(i, text if i % 4 else f"{i} {text}") for i in range(400)] + [(None, text)] * 40, "doc_id long, text string")
    _, counts = lm.fit_language_model(some, F.lit(True))
    top = counts.orderBy(F.desc("n"), "hash").toArrow()
    hashes, n = top["hash"].to_numpy().view(np.uint64), top["n"].to_numpy()
    by = np.argsort(hashes)
    v = lm.Vocabulary(hashes[by], n[by], np.argsort(np.argsort(-n, kind="stable"))[by], int(n.sum()), len(n), lm.TOP)
    rows = lm.segments_of(some, spark.sparkContext.broadcast(v)).withColumn("shard", F.pmod("key", F.lit(50)))
    most = rows.where("doc_id IS NOT NULL").groupBy("shard").count().agg(F.max("count"), F.avg("count")).first()
    assert most[0] < 4 * most[1]
    sizes = []
    monkeypatch.setattr(lm, "LARGEST", 5 * lm.STEPS * lm.PIECES)
    monkeypatch.setattr(lm, "train_runs", lambda p, s, *_: sizes.append(len(s)))
    monkeypatch.setattr(lm, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 0)}))}))
    table = rows.where("doc_id IS NULL").withColumn("shard", F.lit(1).cast("long")).select("shard", "at", "ids").toArrow()
    first = type("B", (), {"value": lm.new_params(v)})
    assert list(lm._trained(first, v.top)(iter(table.to_batches(max_chunksize=7)))) and max(sizes) == 5 and sum(sizes) == table.num_rows


def test_long_texts_are_scored_apart_and_all_rows_come_back(spark, monkeypatch):
    texts = made() + ["v1 n2 " * 700, "n3 " * 900]
    d = docs(spark, texts).coalesce(1)
    model, counts = lm.fit_language_model(d, F.lit(True))
    whole = lm.score_documents(d, model, counts).orderBy("doc_id").collect()
    seen = []
    scores = lm.network_scores
    monkeypatch.setattr(lm, "network_scores", lambda p, top, ids: seen.append(max(map(len, ids))) or scores(p, top, ids))
    monkeypatch.setattr(lm, "GROUP", 2_000)
    monkeypatch.setattr(lm, "LONG", 500)
    monkeypatch.setattr(lm, "TaskContext", type("Context", (), {"get": staticmethod(lambda: type("Task", (), {"partitionId": staticmethod(lambda: 3)}))}))
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array([t or "" for t in texts])], ["doc_id", "text"])
    held = type("Held", (), {"value": model})
    got = pa.Table.from_batches(lm._parts(held)(iter([batch])))
    assert sorted(got["doc_id"].to_pylist()) == list(range(len(texts))) and len(set(got["uid"].to_pylist())) == len(texts)
    assert sum(m > 500 for m in seen) == 1 and len(seen) > 1
    assert dict(zip(got["doc_id"].to_pylist(), got["n_tokens"].to_pylist(), strict=True)) == {r.doc_id: r.n_tokens for r in whole}


def test_gates_apart_equal_the_plain_layer_and_save_time():
    rng = np.random.default_rng(4)
    apart = lambda x: np.ascontiguousarray(np.moveaxis(x.reshape(*x.shape[:-1], 3, lm.UNITS), -2, 0))
    x, u = rng.normal(0, 2, (24, 512, 3 * lm.UNITS)).astype(np.float32), rng.normal(0, 0.3, (lm.UNITS, 3 * lm.UNITS)).astype(np.float32)
    h, d = (rng.normal(0, 0.5, shape).astype(np.float32) for shape in ((512, lm.UNITS), (24, 512, lm.UNITS)))
    x[0, :3, :] = 300  # gates at their ends
    x[0, 3:6, :] = -300
    x2, u2 = apart(x), apart(u)
    plain, ours = [], []
    for _ in range(7):
        at = time.process_time()
        states, cache = gru.forward(x, u, h)
        right = gru.backward(d, cache, u)
        plain.append(time.process_time() - at)
        at = time.process_time()
        mine, cache = gru.forward_apart(x2, u2, h)
        own = gru.backward_apart(d, cache, u2)
        ours.append(time.process_time() - at)
    assert np.allclose(mine, states, atol=1e-5) and np.allclose(mine[0], gru.step_apart(x2[:, 0], h, u2))
    assert all(np.allclose(a, apart(b), rtol=1e-3, atol=1e-3) for a, b in zip(own, right, strict=True))
    assert min(ours) < 0.9 * min(plain)  # measured: about half


def test_sums_of_rows(monkeypatch):
    rng = np.random.default_rng(6)
    for rows in ([3], [2] * 40, [0, 1, 2, 1, 0, 1], np.minimum(rng.geometric(0.02, 3000), 90).tolist()):
        rows, values = np.array(rows), rng.normal(size=(3, len(rows), 5))
        right = np.zeros((3, 100, 5))
        for k in range(3):
            np.add.at(right[k], rows, values[k])
        for few in (1, 4, 16):
            monkeypatch.setattr(lm, "FEW", few)
            found, total = lm._sums(rows, values, 100)
            mine = np.zeros_like(right)
            mine[:, found] = total
            assert sorted(found.tolist()) == np.unique(rows).tolist() and np.allclose(mine, right)


def test_logits_out_of_reach_are_shifted():
    h = np.random.default_rng(7).uniform(-1, 1, (300, lm.UNITS)).astype(np.float32)
    for scale, near in ((0.1, True), (40, False)):
        w = np.random.default_rng(8).normal(0, scale, (64, lm.UNITS)).astype(np.float32)
        z = h @ w.T
        assert lm._near(w, np.zeros(64, np.float32), 1) is near
        assert not near or (z.max() < 60 and z.min() > -80)


def test_look_up_finds_what_a_search_finds_in_less_time():
    rng = np.random.default_rng(9)
    for n in (1, 2, 7, 1000, 200_000):
        hashes = np.unique(np.append(rng.integers(0, 2**64 - 1, n - 1, np.uint64, True), lm.END))
        v = lm.Vocabulary(hashes, np.ones(len(hashes), np.int64), np.arange(len(hashes)), n, n)
        asked = np.concatenate([rng.permutation(np.repeat(hashes, 400_000 // n // 2)), hashes + np.uint64(1), rng.integers(0, 2**64 - 1, 1000, np.uint64, True), np.array([0, 2**64 - 1], np.uint64)])
        at = np.minimum(np.searchsorted(hashes, asked), len(hashes) - 1)
        assert (v.look_up(asked) == np.where(hashes[at] == asked, at, -1)).all()
    times = [[], []]
    for _ in range(5):
        for k, look_up in enumerate((v.look_up, lambda x: np.searchsorted(hashes, x))):
            since = time.process_time()
            look_up(asked)
            times[k].append(time.process_time() - since)
    assert min(times[0]) < 0.8 * min(times[1])


def test_softmax_of_any_size():
    for scale in (1, 50, 300):
        z = np.random.default_rng(0).normal(0, scale, (50, 64)).astype(np.float32)
        own, x = np.arange(50), z.astype(float)
        right = x[own, own] - x.max(1) - np.log(np.exp(x - x.max(1, keepdims=True)).sum(1))
        assert np.allclose(lm._softmax(z.copy(), own, False), right, rtol=1e-5, atol=1e-4)
