from itertools import product

import numpy as np
from pyspark.sql import functions as F

from sigdiff.llm import langid as li
from tests.llm.helpers import awkward, docs, none

SF = "/root/testdata/sf0.001"


def plain(emissions, transition):
    """Marginals by the usual recursion, word by word."""
    e = np.exp(emissions - emissions.max(1, keepdims=True))
    n, size = e.shape
    a, b = np.zeros_like(e), np.ones_like(e)
    now = np.full(size, 1 / size)
    for t in range(n):
        now = now @ transition * e[t]
        now = a[t] = now / now.sum()
    for t in range(n - 2, -1, -1):
        b[t] = transition @ (e[t + 1] * b[t + 1])
        b[t] /= b[t].sum()
    p = a * b
    return p / p.sum(1, keepdims=True)


def test_segments_equal_plain_recursion():
    rng = np.random.default_rng(0)
    n = np.array([0, 1, 5, 64, 65, 700, 0, 128])
    e, t = rng.normal(0, 2, (n.sum(), 4)), rng.random((4, 4)) + 0.1
    got = li.posteriors(e, t, n)
    at = 0
    for k in n:
        if k:
            assert np.allclose(got[at : at + k], plain(e[at : at + k], t))
        at += k


def test_features_do_not_depend_on_neighbours():
    model = np.random.default_rng(1).normal(size=(1 << li.BITS, 3))
    alone = [li.WordFeatures([w]).emissions(model)[0] for w in ("a", "été", "Words", "x1")]
    assert np.allclose(li.WordFeatures(["a  été", "Words\tx1"]).emissions(model), alone)
    f = li.WordFeatures(["a Words"])
    assert np.allclose(model[f.rows_of(1)].sum(0), f.emissions(model)[1])


def test_held_out_accuracy_and_code_switching(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = li.fit_languages(d, F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    rows = li.predict_languages(d, model).join(d.select("doc_id", "lang"), "doc_id").where("crc32(cast(doc_id as string)) % 3 = 1").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    mixed = "thering of the nation and the onwhen is that " * 3 + "der die und ung nicht keit das ist mit " * 3
    got = li.label_words(docs(spark, [mixed]), model).first().langs
    half = len(got) // 2
    assert got[:half].count("en") > 0.8 * half and got[half:].count("de") > 0.8 * half


def test_awkward_and_empty_tables(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = li.fit_languages(d, F.lit(True))
    got = li.predict_languages(awkward(spark), model).collect()
    assert len(got) == 10 and sum(r.lang_pred == "und" and r.score == 0 for r in got) == 4
    only = li.predict_languages(docs(spark, ["12 34 !", "\U0001f600", "é"]), model).collect()
    assert [r.lang_pred == "und" for r in only] == [True, True, False]
    blank = li.fit_languages(none(spark), F.lit(True))
    assert li.predict_languages(none(spark), blank).count() == 0
    assert {r.lang_pred for r in li.predict_languages(awkward(spark), blank).collect()} == {"und"}


def test_rare_languages_keep_examples(spark):
    rows = [(i, "the cat of the house and the dog", "en") for i in range(3000)] + [(9000 + i, "żółw łódź źdźbło ćma", "pl") for i in range(2)]
    model = li.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), rows=40)
    assert sorted(model.languages) == ["en", "pl"]


def test_texts_in_pieces_equal_whole_texts(monkeypatch):
    rng = np.random.default_rng(4)
    model = li.LanguageModel(["a", "b", "c"], rng.normal(size=(1 << 10, 3)).astype(np.float32), rng.random((3, 3)) + 0.1, 10)
    texts = ["one two", "", "12 34", " ".join(f"word{i % 83} x{i % 7}" for i in range(2000)), "é", " ".join(f"w{i}" for i in range(300))]
    whole = model.predict(texts)
    f = li.WordFeatures(texts, 10)
    every = np.concatenate([p for *_, p in model.marginals(f)])
    monkeypatch.setattr(li, "AT_ONCE", 3000)
    monkeypatch.setattr(li, "BLOCK_CHARS", 2000)
    f = li.WordFeatures(texts, 10)
    pieces = [p for *_, p in model.marginals(f)]
    assert len(pieces) > 20 and np.allclose(np.concatenate(pieces), every)
    again = model.predict(texts)
    assert again[0] == whole[0] and np.allclose(again[1], whole[1])


def test_no_language_is_left_out(spark):
    rows = [(i, f"tongue{i % 300} word{i % 300}a", f"l{i % 300}") for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(li.fit_languages(d, F.lit(True), rows=100).languages) == 300


def test_labelled_texts_without_words(spark):
    some = spark.createDataFrame([(1, "", "en", None, None, None, None), (2, "any text", None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long, score double, label int")
    model = li.fit_languages(some, F.lit(True))
    assert sorted(tuple(r) for r in li.predict_languages(some, model).collect()) == [(1, "und", 0.0), (2, "und", 0.0)]


def test_long_texts_leave_no_language_out(spark):
    rows = [(i, f"w{i % 20}x y{i % 20} " * (200 if i % 20 else 400), f"l{i % 20}") for i in range(200)] + [(500, "", "l3")]
    model = li.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), train_bytes=8000)
    assert len(model.languages) == 20
    picked = li.fair_share([(i, lang, k, size, blank) for i, lang, k, size, blank in ((1, "a", 1, 90, 0), (2, "a", 2, 50, 0), (3, "b", 1, 0, 1), (4, "b", 2, 70, 0), (5, "b", 3, 10, 0), (6, "a", 3, 5, 0))], 100)
    assert picked == [6, 5, 3, 2]
    assert li.fair_share([(1, "a", 1, 500, 0)], 100) == [1] and li.fair_share([], 100) == []


def test_more_values_than_languages(spark, monkeypatch):
    monkeypatch.setattr(li, "LANGUAGES", 4)
    rows = [(i, f"word{k}a word{k}b", f"l{k}") for i, k in enumerate([0] * 9 + [1] * 8 + [2] * 7 + [3] * 3 + [4, 5, 6])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.fit_languages(df, F.lit(True))
    assert model.languages == ["l0", "l1", "l2", "l3"]
    got = {r.doc_id: r.lang_pred for r in li.predict_languages(df, model).collect()}
    assert all(got[i] == lang for i, _, lang in rows[:24]) and {got[i] for i, _, _ in rows[24:]} == {"l3"}


def likelihood(model, text, lang):
    """Log probability of one language for all words, by going over every sequence of languages."""
    f = li.WordFeatures([text], model.bits)
    e = np.array([model.weights[f.rows_of(k)].sum(0) if f.letters[k] else np.zeros(len(model.languages)) for k in range(int(f.n.sum()))])
    score = lambda seq: sum(e[k, y] for k, y in enumerate(seq)) + sum(np.log(model.transition[a, b]) for a, b in zip(seq, seq[1:], strict=False))
    every = np.array([score(seq) for seq in product(range(len(model.languages)), repeat=len(e))])
    own = score([model.languages.index(lang)] * len(e))
    return own - (every.max() + np.log(np.exp(every - every.max()).sum()))


def test_training_raises_the_exact_likelihood():
    texts, langs = ["the cat and the dog", "der hund und die", "le chien et le chat", "the hund"], ["en", "de", "fr", "en"]
    fits = [li.fit_crf(texts * 8, langs * 8, 10, epochs=n, length=12, batch=8) for n in (1, 6)]
    one, six = ([likelihood(m, t, lang) for t, lang in zip(texts[:3], langs, strict=False)] for m in fits)
    # without any training each sequence is as likely as any other
    blank = [-len(t.split()) * np.log(3) for t in texts[:3]]
    assert all(b < a for a, b in zip(one, blank, strict=True)) and sum(six) > sum(one) and min(six) > -1.5
