import re

import pytest
from pyspark.sql import functions as F

from sigdiff.llm import common
from tests.llm.helpers import awkward, none
from tests.llm.test_neardup import brute
from tests.llm.test_secret_scan import brute as secret_spans

SF = "/root/testdata/sf0.001"
corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")


def test_stages_equal_brute_force(spark):
    import sentencepiece
    import public_tokenizers

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at, seen = docs, [docs.orderBy("doc_id").collect()]
    for _, stage in corpus_pipeline.STAGES:
        at = spark.createDataFrame(stage(spark, at, SF).collect(), stage(spark, at, SF).schema)
        seen.append(at.orderBy("doc_id").collect())
    start, good, single, clean, redacted, last = seen
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in good}
    known = [r.doc_id for r in start if r.doc_id in labels]
    assert sum((i in kept) == (labels[i] == 1) for i in known) >= 0.9 * len(known)
    assert [r.doc_id for r in single] == [r.doc_id for r, (i, _, low) in zip(good, brute([r.text for r in good], 5), strict=True) if i == low]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall("".join(c.lower() if c.isascii() else c for c in t))
    windows = {tuple(w[i : i + 10]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if (w := low(r.text)) for i in range(max(1, len(w) - 9))}
    free = lambda w: not any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))
    assert [r.doc_id for r in clean] == [r.doc_id for r in single if free(low(r.text))]
    assert [r.doc_id for r in redacted] == [r.doc_id for r in clean] and not any(secret_spans(r.text) for r in redacted)
    assert all(r.text == s.text for r, s in zip(redacted, clean, strict=True) if not secret_spans(s.text))
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert [(r.doc_id, r.ids) for r in last] == [(r.doc_id, library.encode(r.text, add_bos=True, add_eos=True)) for r in redacted]
    assert all(r[0].__fields__ == seen[0][0].__fields__ for r in seen[1:-1] if r)


def test_stages_take_empty_tables(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none(spark), SF).count() == 0


def test_stages_take_awkward_rows_and_clashing_columns(spark):
    names = {c: F.lit(1) for c in ("hit", "items", "n_words", "n_shingles", "registers", "component_id", "predicted", "row", "_gone", "found")}
    docs = awkward(spark).withColumns(names)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        rows = got.collect()
        if name == "pieces":
            assert len(rows) == 10
        else:
            assert got.columns == docs.columns and 0 < len(rows) <= 10
        if name == "near_dedup":
            assert len(rows) == 8 and sum(r.doc_id is None for r in rows) == 2


def test_run_leaves_only_the_stages(spark, tmp_path):
    before = len(common._written)
    assert corpus_pipeline.run(spark, SF).count() > 0 and len(common._written) == before
