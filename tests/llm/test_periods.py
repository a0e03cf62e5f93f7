import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sigdiff.llm import periods
from tests.llm.helpers import awkward, docs, none


def lyndon(w):
    return all(w < w[k:] for k in range(1, len(w)))


def brute_runs(w):
    """Every period of every stretch, by its definition."""
    n, found = len(w), []
    for q in range(1, n // 4 + 1):
        k = 0
        while k + q < n:
            m = k
            while m + q < n and w[m] == w[m + q]:
                m += 1
            start, length = k, m + q - k
            if length >= max(6, 4 * q) and not any(all(w[i] == w[i + d] for i in range(start, start + length - d)) for d in range(1, q)):
                found.append((start, length, q))
            k = m + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


@given(st.lists(st.integers(0, 3), min_size=1, max_size=40))
@settings(max_examples=300, deadline=None)
def test_lyndon_lengths(s):
    assert periods.lyndon_lengths(s) == [max(k for k in range(1, len(s) - i + 1) if lyndon(s[i : i + k])) for i in range(len(s))]


repeats = st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=6), st.integers(1, 7)), max_size=6).map(lambda parts: [x for w, k in parts for x in w * k])


@given(repeats | st.lists(st.integers(0, 2), max_size=60))
@settings(max_examples=400, deadline=None)
def test_runs_equal_their_definition(w):
    assert periods.find_runs(np.array(w, np.int64)) == brute_runs(w)


def test_runs_of_words_that_double_themselves():
    a, b = [0], [0, 1]
    while len(b) < 2000:
        a, b = b, b + a
    for w in (b, [0] * 500, [0, 1] * 300 + [2] + [0, 1] * 300, [k.bit_count() % 2 for k in range(1500)]):
        assert periods.find_runs(np.array(w, np.int64)) == brute_runs(w)


def brute(doc_id, text, repeat=True):
    words = [w.decode() for w in (text or "").encode().split()]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if repeat and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = brute_runs(words)
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, best[1] * 1000 // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


TEXTS = ["no run here", "a b " * 9 + "c", "x " * 5, "x " * 6, "p q r s " * 4 + "p q", "A a " * 8, "u v w " * 3, "\t\n", None, "one two " * 4 + "three " + "one two " * 4]


def test_rows_equal_brute_force(spark):
    some = docs(spark, TEXTS * 6)
    want = [brute(r.doc_id, r.text) for r in some.orderBy("doc_id").collect()]
    assert [tuple(r) for r in periods.periodic_runs(some, repeat=True).orderBy("doc_id").collect()] == want
    assert any(zlib.crc32(str(w[0]).encode()) % 10 == 0 for w in want)


def test_collapsed_text(spark):
    got = periods.periodic_runs(docs(spark, ["say la la la la la la la now", "a b c a b c a b c a b c a"]), texts=True).orderBy("doc_id").collect()
    assert [r.collapsed for r in got] == ["say la now", "a b c"]
    assert [[tuple(x) for x in r.runs] for r in got] == [[(1, 7, 1)], [(0, 13, 3)]]


def test_awkward_rows(spark):
    got = periods.periodic_runs(awkward(spark)).collect()
    want = [brute(r.doc_id, r.text, False) for r in awkward(spark).collect() if r.doc_id != 4]
    assert sorted(str(tuple(r)) for r in got if r.doc_id != 4) == sorted(map(str, want))
    long = next(r for r in got if r.doc_id == 4)
    assert (long.n_runs, long.start, long.length, long.period) == (1, 0, 36000, 6)


@pytest.mark.parametrize("texts", [False, True])
def test_no_rows(spark, texts):
    assert periods.periodic_runs(none(spark), texts=texts).collect() == []


def test_registered_query(spark):
    from sigdiff.llm import queries

    sf = "/root/testdata/sf0.001"
    got = queries.queries()["op11_periods"](spark, sf).orderBy("doc_id")
    assert dict(got.dtypes) == {**dict.fromkeys(("doc_id", "n_runs", "start", "length", "period", "exponent_milli"), "bigint"), "runs_sha256": "string", "collapsed_sha256": "string"}
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    for r, d in zip(got.collect(), rows, strict=True):
        if len((d.text or "").split()) < 1500:
            assert tuple(r) == brute(d.doc_id, d.text)
        else:
            assert r.doc_id == d.doc_id and r.n_runs >= (zlib.crc32(str(d.doc_id).encode()) % 10 == 0 and zlib.crc32(str(d.doc_id).encode()) // 10 % 8 > 0)
