import os

import numpy as np
import pyarrow as pa
import pytest

from sigdiff.llm import common
from sigdiff.llm.common import Words, blocks


def test_words_and_hashes():
    texts = ["The of\tthe  OF\n", "", "été \x0b ÉTÉ 中文", " ", "the"]
    w = Words(texts)
    assert w.n.tolist() == [4, 0, 3, 0, 1] and w.first.tolist() == [0, 4, 4, 7, 7]
    h = w.hash
    assert h[0] == h[2] == h[7] and h[1] == h[3] and h[4] != h[5]
    many = sorted({f"{a}{b}{c}{d}" for a in "abcdefghij" for b in "xyzé1" for c in "klmnop" for d in "uvwqrst" * 2})
    assert len(np.unique(Words([" ".join(many)]).hash)) == len(many)


def test_hash_does_not_depend_on_place():
    a, b = Words(["x " * 70000 + "word"]), Words(["word"])
    assert a.hash[-1] == b.hash[0]


def test_cut_keeps_words_whole():
    text = "ab  cdé\tf " * 50
    for size in (1, 7, 10_000):
        parts = common.cut(text, size)
        assert "".join(parts) == text and [w for x in parts for w in x.split()] == text.split()
    assert common.cut("", 5) == [""] and common.cut("x" * 20, 5) == ["x" * 20]


def test_training_texts_keep_to_the_limit(spark):
    d = spark.createDataFrame([(i, "x" * 100) for i in range(50)] + [(3, "zz")], "doc_id long, text string")
    sample = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, label int")
    got = common.training_texts(d, sample, "doc_id", "text", 1050).collect()
    assert len(got) == 10 + (3 in {r.doc_id for r in got}) and len({r.doc_id for r in got}) == len(got) or len(got) == 10
    assert all(r.label == r.doc_id % 2 for r in got) and sum(len(r.text) for r in got) <= 1050


def test_stored_tables_are_deleted_afterwards(spark):
    with common.tidied(spark):
        kept = common.stored(spark.range(5), "five")
        assert kept.count() == 5
        path = common._written[-1].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path)


def test_no_local_folder_on_a_cluster(spark):
    class Far:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        common.shared_dir(Far, "x")


def test_memory_goes_back_after_the_last_block():
    def anonymous():
        with open("/proc/self/smaps_rollup") as f:
            return next(int(x.split()[1]) for x in f if x.startswith("Anonymous:")) / 1024

    before = anonymous()
    many = [bytes(1000) for _ in range(100_000)]
    last = many[-1]  # keeps the C library from giving back what is below it
    del many
    assert anonymous() - before > 80
    for _ in blocks(iter([pa.record_batch([pa.array(["a"])], ["text"])])):
        pass
    assert last and anonymous() - before < 40
