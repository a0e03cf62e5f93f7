"""Document fingerprints: an exact digest of the canonical text.

Canonical text: NFKC, full case folding, NFKC again, and every run of white space made one space, none
at the ends. The fingerprint is its 128-bit xxhash in hex. Documents with equal fingerprints form a
bucket; inside a bucket the canonical bytes themselves are compared, so that a chance collision of
the hash never joins two documents.

Null texts are empty; empty texts share the fingerprint of the empty string. Rows may repeat; each is
kept. Rows with a null id come first in the order of ids.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigdiff.llm.common import blocks, stored, two_columns

#: Fingerprints that are broadcast, at most (some 100 bytes each); beyond it rows are shuffled.
BROADCAST_PRINTS = 500_000


def canonical(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split())


def fingerprint(text: str) -> str:
    return xxhash.xxh3_128_hexdigest(canonical(text).encode("utf-8", "surrogatepass"))


def likeness(a: str, b: str) -> float:
    """Of two exact digests: 1 if equal, else 0."""
    return float(a == b)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches):
            yield pa.record_batch([part.column("doc_id"), pa.array([fingerprint(t) for t in texts], pa.string())], ["doc_id", "fingerprint"])

    return two_columns(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string")


def _beside(rows: DataFrame, keyed: DataFrame, key: str, how: str) -> DataFrame:
    """rows joined to stored rows with distinct keys; these are broadcast if they are few enough, so that no key's rows need meet."""
    return rows.join(F.broadcast(keyed) if keyed.count() <= BROADCAST_PRINTS else keyed, key, how)


def repeated_ids(prints: DataFrame) -> DataFrame:
    """doc_id of the documents whose fingerprint another document has too."""
    several = stored(prints.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint"), "repeated")
    return _beside(prints, several, "fingerprint", "left_semi").select("doc_id").distinct()


def group_by_bytes(canon: DataFrame) -> DataFrame:
    """canon: doc_id, fingerprint, canonical text (null for documents alone in their bucket); read several times, so it should be stored.

    Adds group_id, the least id of the documents with the same canonical bytes. The grouping is by fingerprint and
    bytes, with a row for each task and text before the shuffle, so that a text that very many documents share is moved once a task.
    Other rows move without their texts, but for those of buckets with different texts.
    """
    texts = canon.where("canonical IS NOT NULL").groupBy("fingerprint", "canonical").agg(F.min("doc_id").alias("group_id"))
    buckets = stored(texts.groupBy("fingerprint").agg(F.min("group_id").alias("group_id"), F.count("*").alias("n_texts")), "buckets")
    names = [c for c in canon.columns if c != "canonical"]
    alone = canon.where("canonical IS NULL").select(*names, F.col("doc_id").alias("group_id"))
    same = _beside(canon.where("canonical IS NOT NULL").select(*names), buckets.where("n_texts = 1").drop("n_texts"), "fingerprint", "inner").select(*names, "group_id")
    out = alone.unionByName(same)
    clashing = buckets.where("n_texts > 1").select("fingerprint")
    if not clashing.isEmpty():
        own = lambda rows: _beside(rows, clashing, "fingerprint", "left_semi")
        out = out.unionByName(own(canon.where("canonical IS NOT NULL")).join(own(texts), ["fingerprint", "canonical"]).select(*names, "group_id"))
    return out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, group_id of every row, for documents with distinct ids."""
    prints = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    again = two_columns(docs, id_col, text_col).join(repeated_ids(prints), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches):
            yield pa.record_batch([part.column("doc_id"), pa.array([canonical(t) for t in texts], pa.string())], ["doc_id", "canonical"])

    texts = again.mapInArrow(run, "doc_id long, canonical string").dropDuplicates(["doc_id"])
    return group_by_bytes(stored(prints.join(texts, "doc_id", "left"), "canonical"))


# ---- each document beside the next one ----


def with_next(docs: DataFrame, marked: DataFrame, run, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Streams the documents in ascending order of ids through run, block of ids by block of ids.

    A block is a range of ids, cut at their approximate quantiles, and is shuffled and sorted as one; its rows have kind 1.
    The first row of each block also goes, as kind 2, to the end of the block before, and of the first block to the last one's
    end: a row for each block. The ids in marked come as rows of kind 0 before the document's own. Equal ids are in order of texts.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = F.lit(-(2**63)).cast("long")
    rows = two_columns(docs, id_col, text_col).withColumn("key", F.coalesce("doc_id", least))
    cuts = np.unique(np.array(rows.approxQuantile("key", list(np.arange(1, 4 * tasks) / (4 * tasks)), 1 / (16 * tasks)), np.float64).astype(np.int64))

    @F.pandas_udf("int")
    def bucket(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, keys.to_numpy(np.int64), side="right").astype(np.int32))

    rows = rows.withColumn("bucket", bucket("key"))
    # one row for each block reaches the driver, and goes back to the tasks
    first = {r.bucket: r.low for r in rows.groupBy("bucket").agg(F.min("key").alias("low")).collect()}
    full = sorted(first)
    heads = spark.createDataFrame([(first[b], full[k - 1]) for k, b in enumerate(full)], "key long, before int")
    places = F.when(F.col("before").isNull(), F.array(F.struct("bucket", F.lit(1).alias("kind")))).otherwise(F.array(F.struct("bucket", F.lit(1).alias("kind")), F.struct(F.col("before").alias("bucket"), F.lit(2).alias("kind"))))
    placed = rows.join(F.broadcast(heads), "key", "left").select(F.explode(places).alias("place"), "key", "doc_id", "text")
    marks = marked.withColumn("key", F.coalesce("doc_id", least)).select(bucket("key").alias("bucket"), F.lit(0).alias("kind"), "key", "doc_id", F.lit("").alias("text"))
    every = placed.select("place.bucket", "place.kind", "key", "doc_id", "text").unionByName(marks)
    # kind 2 is last in its block, although the very first document has the least id
    ordered = every.repartition(tasks, "bucket").sortWithinPartitions("bucket", F.col("kind") == 2, "key", "kind", F.xxhash64("text"))
    return ordered.select("bucket", "kind", "doc_id", "text").mapInArrow(run, schema)


EDIT_COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, canonical string"


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    held, held_bucket, marked = None, None, set()
    for part, texts in blocks(batches):
        for bucket, kind, doc_id, text in zip(part.column("bucket").to_pylist(), part.column("kind").to_pylist(), part.column("doc_id").to_pylist(), texts, strict=True):
            if kind == 0:
                marked = {doc_id}
                continue
            if held_bucket != bucket:
                held = None
            canon = canonical(text)
            own = xxhash.xxh3_128_hexdigest(canon.encode("utf-8", "surrogatepass"))
            if held is not None:
                last_id, last, last_print, last_canon = held
                k = len(last) // 4
                edited = last[: len(last) - k] + text[:k]
                edited_print = fingerprint(edited)
                out.append((last_id, len(last), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), last_print, edited_print, likeness(last_print, edited_print), likeness(last_print, own), last_canon))
            held = (doc_id, text, own, canon if doc_id in marked else None) if kind == 1 else None
            held_bucket = bucket
        yield _table(out)
        out = []


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    names, types = zip(*(x.split() for x in EDIT_COLUMNS.split(", ")), strict=True)
    return pa.record_batch([pa.array([r[i] for r in rows], kinds[t]) for i, t in enumerate(types)], list(names))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, that of the text with its last quarter taken from the next document, and its exact group."""
    marked = repeated_ids(stored(fingerprints(docs, id_col, text_col), "fingerprints"))
    edits = stored(with_next(docs, marked, _edits, EDIT_COLUMNS, id_col, text_col), "edits")
    return group_by_bytes(edits)
