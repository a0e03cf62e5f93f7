"""From raw documents to token ids: quality filter, near-dedup, decontamination, secret redaction, encoding.

Each stage reads what the one before kept, as Parquet in the cluster's shared folder, so a lost executor
costs a part of one stage. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sigdiff.llm.common import fold, shared_dir, table, tidied

#: The stages do not come out of SQL: the first one is a trained model.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.5. Labels of ids whose crc32 mod 4 is 2 stay unseen, as in op8."""
    from sigdiff.llm.quality import fit_quality, keep_quality

    return keep_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near duplicates (5-word shingles, similarity 0.8)."""
    from sigdiff.llm.neardup import one_of_each

    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any 10-word window of the benchmark."""
    from sigdiff.llm.decontaminate import remove_documents

    return remove_documents(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by the name of their kind."""
    from sigdiff.llm.secret_scan import redact

    return redact(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of every document that is left."""
    from sigdiff.llm.pieces import encode_decode

    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    return encode_decode(docs, model_path, with_ids=True)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("pieces", pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, f"stage-{name}")
        with tidied(spark):  # what a stage stores on its way goes once its result is written
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
