import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sigdiff.llm import quality as q
from sigdiff.llm.common import fold
from tests.llm.helpers import awkward, docs, none

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int"


def test_held_out_accuracy(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = q.fit_quality(d, labels, fold("doc_id", 4) != 2)
    rows = q.score_quality(d, model).join(labels, "doc_id").where(fold("doc_id", 4) == 2).collect()
    assert sum((r.score >= 0.5) == r.quality for r in rows) >= 0.95 * len(rows)


def test_score_is_a_sparse_dot_product():
    model = q.ftrl([q.features([t])[1:3] + (y,) for t, y in [("good words here", 1), ("bad bad bad", 0)] * 20])
    text = "good bad words"
    _, key, value, _ = q.features([text])
    dense = sum(float(model.weights[k]) * v for k, v in zip(key, value, strict=True))
    assert abs(model.score(["x", text])[1] - 1 / (1 + 2.718281828459045 ** -(model.bias + dense))) < 1e-6


def test_steps_equal_a_plain_loop():
    texts = ["good words here", "bad bad bad", "good bad", "words", ""]
    rows = [q.features([t], 12)[1:3] + (y,) for t, y in zip(texts, (1, 0, 1, 0, 1), strict=True)]
    alpha, beta, l1, l2, seed, epochs = 0.5, 1.0, 0.02, 0.05, 7, 3
    z, n = Counter(), Counter()

    def weight(i):
        limit = 0 if i == "bias" else l1
        return 0.0 if abs(z[i]) <= limit else -(z[i] - math.copysign(limit, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            x = [*zip(rows[r][0].tolist(), rows[r][1].tolist(), strict=True), ("bias", 1.0)]
            w = {i: weight(i) for i, _ in x}
            error = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x))) - rows[r][2]
            for i, v in x:
                g = error * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    model = q.ftrl(rows, 12, epochs, alpha, beta, l1, l2, seed)
    assert abs(model.bias - weight("bias")) < 1e-9
    assert all(abs(float(model.weights[i]) - weight(i)) < 1e-6 for i in range(1 << 12))


def test_labels_that_are_held_out_do_not_matter(spark):
    texts = [f"word{i} and {'bad bad' if i % 2 else 'fine'}" for i in range(60)]
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], LABELS)
    other = labels.withColumn("quality", F.when(fold("doc_id", 4) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (q.fit_quality(d, x, fold("doc_id", 4) != 2) for x in (labels, other))
    assert (one.weights == two.weights).all() and one.bias == two.bias


def test_awkward_and_empty_tables(spark):
    labels = spark.createDataFrame([(5, 1), (5, 0), (None, 1), (4, None), (6, 0)], LABELS)
    model = q.fit_quality(awkward(spark), labels, F.lit(True))
    got = q.score_quality(awkward(spark), model).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    blank = q.fit_quality(none(spark), spark.createDataFrame([], LABELS), F.lit(True))
    assert {r.score for r in q.score_quality(awkward(spark), blank).collect()} == {0.5}
    assert q.score_quality(none(spark), blank).count() == 0
    kept = q.keep_quality(awkward(spark), blank)
    assert kept.columns == awkward(spark).columns and kept.count() == 10 and q.keep_quality(none(spark), blank).count() == 0
