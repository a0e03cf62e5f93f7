import random
import re

from pyspark.sql import functions as F

from sigdiff.llm import decontaminate as dc
from tests.llm.helpers import awkward, docs, none

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, doc_id long"


def low(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(rows, items):
    out = []
    for i, t in rows:
        w, hit, by = low(t), set(), set()
        for item, text in items:
            b = low(text)
            n = min(len(b), 10)
            wins = {tuple(b[s : s + n]) for s in range(len(b) - n + 1)} if n else set()
            for s in range(len(w) - n + 1):
                if n and tuple(w[s : s + n]) in wins:
                    hit |= set(range(s + 1, s + n + 1))
                    by.add(str(item))
        out.append((i, len(w), sorted(hit), sorted(by)))
    return sorted(out)


def bench(spark, items):
    return spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)


def made(seed=3):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Été", "a1", "x", "É", "and", "tion"]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, say(rng.randint(8, 30))) for i in range(12)] + [(50, "only five words in here"), (51, None), (52, "?! --"), (53, "The of")]
    texts = []
    for _ in range(80):
        part = rng.choice([t for _, t in items if t])
        texts.append(say(rng.randint(0, 40)) + (", " + part.upper().replace(" ", "\n") + ". " if rng.random() < 0.5 else " ") + say(9))
    return texts, items


def test_equals_brute_force(spark):
    texts, items = made()
    rows = list(enumerate(texts))
    for limit in (10**6, 1_000):
        got = dc.contamination(docs(spark, texts), bench(spark, items), broadcast_bytes=limit).collect()
        assert sorted((r.doc_id, r.n_words, list(r.hit), list(r["items"])) for r in got) == brute(rows, items)


def test_equal_hashes_are_not_hits_by_themselves(spark):
    windows = dc.benchmark_windows(bench(spark, [(1, "one two three four five six seven eight nine ten")]))
    assert [(r.item, " ".join(r.window)) for r in windows.collect()] == [("1", "one two three four five six seven eight nine ten")]
    d = docs(spark, ["one two three four five six seven eight nine ten", "one two three four five six seven eight nine eleven"])
    other = windows.withColumn("window", F.split(F.lit("one two three four five six seven eight nine eleven"), " "))
    assert dc.hits(d, windows).count() == 1 and dc.hits(d, other).count() == 0


def test_removal(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    d = docs(spark, ["Before this, Alpha beta gamma DELTA epsilon zeta eta theta iota-kappa. After.", "clean text", None])
    got = {r.doc_id: r.text for r in dc.remove_spans(d, bench(spark, [(1, item)])).collect()}
    assert got == {0: "Before this. After.", 1: "clean text", 2: None}
    kept = dc.remove_documents(d, bench(spark, [(1, item)]))
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {1, 2}


def test_awkward_and_empty_tables(spark):
    b = bench(spark, [(7, "the same text of both"), (8, "a text without an id")])
    got = dc.contamination(awkward(spark), b).collect()
    assert len(got) == 10
    assert sorted((r.doc_id or 0, r["items"][0]) for r in got if r["items"]) == [(0, "8"), (5, "7"), (6, "7"), (6, "7")]
    assert dc.contamination(none(spark), b).count() == 0
    assert {len(r.hit) for r in dc.contamination(awkward(spark), bench(spark, [])).collect()} == {0}


def test_columns_with_clashing_names(spark):
    d = spark.createDataFrame([(1, "a clean text", 3, "x", 0.5), (2, "The same text of BOTH, and more", 4, "y", 0.25)], "doc_id long, text string, hit int, items string, `n.words` double")
    d = d.withColumns({"n_words": F.lit(1), "w": F.lit(2), "own": F.lit(3), "row": F.lit(4), "pairs": F.lit(5)})
    b = bench(spark, [(7, "the same text of both")])
    assert [tuple(r) for r in dc.remove_documents(d, b).collect()] == [(1, "a clean text", 3, "x", 0.5, 1, 2, 3, 4, 5)]
    got = sorted(tuple(r) for r in dc.remove_spans(d, b).collect())
    assert got == [(1, "a clean text", 3, "x", 0.5, 1, 2, 3, 4, 5), (2, ", and more", 4, "y", 0.25, 1, 2, 3, 4, 5)]
    assert dc.remove_spans(d, b).columns == d.columns
    assert dc.contamination(d, b).count() == 2


def test_text_that_is_all_benchmark(spark):
    words = [f"w{i}" for i in range(3000)]
    d = docs(spark, [" ".join(words)])
    b = bench(spark, [(1, " ".join(words))])
    assert dc.contamination(d, b).first().hit == list(range(1, 3001))
    assert dc.remove_spans(d, b).first().text == ""
