import hashlib

from sigdiff.llm import fingerprints as fp
from tests.llm.helpers import awkward, docs, none


def expected(rows):
    rows = sorted(rows)
    out = {}
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(t) // 4
        e = t[: len(t) - q] + nxt[:q]
        same = [j for j, u in rows if fp.canonical(u or "") == fp.canonical(t)]
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), fp.fingerprint(t), fp.fingerprint(e), float(fp.fingerprint(t) == fp.fingerprint(e)), float(fp.fingerprint(t) == fp.fingerprint(nxt)), min(same))
    return out


def test_edits_equal_brute_force(spark):
    texts = [f"Word{i % 7} the  End{i % 3}\n" * (i % 5) for i in range(300)] + ["Straße", "STRASSE", "strasse ", None, ""]
    d = docs(spark, texts, first_id=-20).repartition(5)
    got = {r[0]: tuple(r[1:]) for r in fp.edited_fingerprints(d).collect()}
    assert got == expected([(i - 20, t) for i, t in enumerate(texts)])


def test_canonical_folds_case_width_and_space():
    assert fp.fingerprint("Straße  x") == fp.fingerprint("STRASSE\tX ")
    assert fp.fingerprint("ﬁne") == fp.fingerprint("Fine")
    assert fp.fingerprint("a b") != fp.fingerprint("ab")


def test_colliding_bucket_is_split_by_bytes(spark):
    rows = [(1, "h", "a"), (2, "h", "b"), (3, "h", "a"), (4, "k", None)]
    got = {r.doc_id: r.group_id for r in fp.group_by_bytes(spark.createDataFrame(rows, "doc_id long, fingerprint string, canonical string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4}


def test_exact_groups(spark):
    got = {r.doc_id: r.group_id for r in fp.exact_groups(docs(spark, ["A b", "c", " a  B", None, ""])).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 3, 4: 3}


def test_awkward_and_empty_tables(spark):
    got = fp.edited_fingerprints(awkward(spark)).collect()
    assert len(got) == 10 and sum(r.doc_id is None for r in got) == 2
    assert {r.group_id for r in got if r.doc_id in (5, 6)} == {5}
    assert fp.edited_fingerprints(none(spark)).count() == 0
