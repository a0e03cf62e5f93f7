import random

import numpy as np

from sigdiff.llm import neardup as nd
from sigdiff.llm.components import components
from tests.llm.helpers import awkward, docs, none


def brute(texts, k, per_cent=80):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    low = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and low[j] < low[i] and 100 * len(a & b) >= per_cent * len(a | b):
                    low[i], changed = low[j], True
    return [(i, len(s), low[i]) for i, s in enumerate(sets)]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def corpus(seed=1):
    rng = random.Random(seed)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(60, 300))]
        chain = base
        for _ in range(rng.randint(0, 6)):
            texts.append(" ".join(edited(rng, base, rng.randint(0, 6))))
            chain = edited(rng, chain, 3)  # ends may be unlike while neighbours are alike
            texts.append(" ".join(chain).upper())
        texts.append(" ".join(base))
    texts += ["one two", "ONE  two", "one", None, "", "a b c d", "a b c d e"] * 2
    rng.shuffle(texts)
    return texts


def test_equals_brute_force(spark):
    texts = corpus()
    for k in (4, 5):
        got = sorted(tuple(r) for r in nd.near_duplicates(docs(spark, texts), k).collect())
        assert got == brute(texts, k)


def test_large_group_of_near_copies(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(edited(rng, base, 3)) for _ in range(400)] + [" ".join(base)] * 300
    got = [r.component_id for r in nd.near_duplicates(docs(spark, texts), 4).orderBy("doc_id").collect()]
    assert got == [low for *_, low in brute(texts, 4)]


def test_estimate_and_merge():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.6, 0.8, 0.95):
        n = 2000
        both = rng.integers(0, 2**63, int(n * share), dtype=np.uint64)
        a, b = (np.concatenate((both, rng.integers(0, 2**63, m, dtype=np.uint64))) for m in ((n - len(both)) // 2, n - len(both)))
        true = len(both) / len(np.union1d(a, b))
        r = nd.registers([a, b, np.concatenate((a, b))])
        assert abs(nd.estimate(nd.packed(r[:1]), nd.packed(r[1:2]), np.array([len(a)]), np.array([len(b)]))[0] - true) < 0.09
        assert (nd.merge(r[0], r[1]) == r[2]).all()


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 105), (105, 103), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 103: 100, 105: 100}


def test_awkward_and_empty_tables(spark):
    got = nd.near_duplicates(awkward(spark), 4).withColumn("kept", nd.kept()).collect()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert len(got) == 10 and by[6].component_id == 5 and not by[6].kept and by[1].kept and by[1].n_shingles == 0
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    left = nd.one_of_each(awkward(spark))
    assert left.columns == awkward(spark).columns and left.count() == 8
    assert nd.near_duplicates(none(spark)).count() == 0


def test_rows_of_one_id_count_as_one_document(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    d = spark.createDataFrame([(1, a), (2, b), (5, a), (5, b), (6, c)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in nd.near_duplicates(d).collect()) == [(1, 1), (2, 1), (5, 1), (5, 1), (6, 6)]
