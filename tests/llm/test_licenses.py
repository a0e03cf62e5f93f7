import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sigdiff.llm import licenses as li
from tests.llm.helpers import awkward, docs, none


def brute(text, notices=li.NOTICES, phrases=li.PHRASES, containment=li.CONTAINMENT):
    w = li.words_of(text or "")
    base = sorted((i, n, label) for n, (p, label) in enumerate(phrases) for q in [li.words_of(p)] for i in range(len(w)) if w[i : i + len(q)] == q)
    met = []
    for k, (label, family, t) in enumerate(notices):
        t = li.words_of(t)
        for start in range(0, len(w), len(t)):
            share = len(set(t) & set(w[start : start + 2 * len(t)])) / len(set(t))
            if share >= containment - 1e-12:
                met.append((k, start, share, label, family, 2 * len(t), len(set(t))))
    better = lambda y, x: y[4] == x[4] and y[3] != x[3] and y[1] < x[1] + x[5] and x[1] < y[1] + y[5] and (y[2], y[6], -y[0]) > (x[2], x[6], -x[0])
    kept = sorted((x[1], x[0], x[3], x[2]) for x in met if not any(better(y, x) for y in met))
    return len(w), [(label, i) for i, _, label in base], [(k, label, s, share) for s, k, label, share in kept]


def plain(r):
    return r.n_words, [tuple(x) for x in r.base], [tuple(x) for x in r.found]


BY = dict((n[0], n[2]) for n in li.NOTICES)
TEXTS = [
    "Released under the MIT License. And under the mit-license; Under The MIT License",
    f"{'some words before ' * 20}{BY['bsd'].title()}, {'and after ' * 30}",
    BY["cc-by"],
    BY["cc-by-nc"],
    BY["gpl-3"].replace("software", "soft ware"),
    "This work is licensed under the GNU General Public License, version 3.",
    f"{BY['apache-2']} {BY['isc']} {BY['reserved']}",
    " ".join(BY["mit"].split()[:12]),
    "Licensed under the Apache License, Version 2.0. CC BY-NC 4.0 cc by nc",
    "nothing of that kind is here",
    None,
    "\x00 \x7f --- ",
]


def test_rows_equal_brute_force(spark):
    some = docs(spark, TEXTS)
    got = {r.doc_id: r for r in li.find_licenses(some).collect()}
    for r in some.collect():
        assert plain(got[r.doc_id]) == brute(r.text), r.text
    label = lambda k: {x.label for x in got[k].found}
    assert (label(1), label(2), label(3), label(5), label(9)) == ({"bsd"}, {"cc-by"}, {"cc-by-nc"}, {"gpl-3"}, set())


SMALL = [("x", "f", "a b c d e"), ("y", "f", "a b c d f g"), ("z", "h", "b b c h"), ("w", "h", "h g f e d c b a")]


@given(st.lists(st.sampled_from("abcdefghijk"), max_size=60), st.sampled_from([0.5, 0.8, 1.0]))
@settings(max_examples=300, deadline=None)
def test_filters_lose_nothing(words, containment):
    counts = {w: words.count(w) for w in words}
    known = sorted(set("abcdefgh"), key=lambda w: (counts.get(w, 0), w))
    index = li.Index.of(li.Vocabulary(known), SMALL, containment)
    n, doc, place, rank = index.vocabulary.places(["q a b", " ".join(words)])
    met = sorted((k, s, share) for d, k, s, share in index.join(doc, place, rank, n) if d == 1)
    want = []
    for k, (_, _, t) in enumerate(SMALL):
        t = t.split()
        need = math.ceil(containment * len(set(t)) - 1e-9)
        want += [(k, s, len(own) / len(set(t))) for s in range(0, len(words), len(t)) if len(own := set(t) & set(words[s : s + 2 * len(t)])) >= need]
    assert met == sorted(want)


def test_long_texts_in_parts(spark):
    long = "word " * 60_000 + BY["bsd"] + " word" * 60_000 + " under the mit license"
    assert plain(li.find_licenses(docs(spark, [long])).first()) == brute(long)


def test_awkward_rows(spark):
    got = sorted(str((r.doc_id, plain(r))) for r in li.find_licenses(awkward(spark)).collect())
    assert got == sorted(str((r.doc_id, brute(r.text))) for r in awkward(spark).collect())


@pytest.mark.parametrize("notices", [li.NOTICES, []])
def test_no_rows_or_notices(spark, notices):
    assert li.find_licenses(none(spark), notices=notices).collect() == []
    assert [x.found for x in li.find_licenses(docs(spark, ["a b"]), notices=notices).collect()] == [[]]


def test_registered_query(spark):
    from sigdiff.llm import queries

    sf = "/root/testdata/sf0.001"
    got = queries.queries()["op12_licenses"](spark, sf).orderBy("doc_id")
    assert dict(got.dtypes) == {"doc_id": "bigint", **dict.fromkeys(("n_words", "n_base", "first_word", "last_word"), "bigint"), "base_labels": "string", "labels": "string", "score": "double"}
    for r, d in zip(got.collect(), spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect(), strict=True):
        n, base, found = brute(d.text)
        starts = [s for _, s in base]
        labels = {label for label, _ in base}
        want = (d.doc_id, n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {x[1] for x in found})), 1.0 if base else max((x[3] for x in found), default=0.0))
        assert tuple(r) == want
