"""Reading tables, cutting Arrow batches to size, and hashing words with numpy.

Every operator takes a DataFrame and the names of its id and text columns and looks at no
other column, so tables with further or clashing columns need no care by the caller.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a task handles at once.
BLOCK_CHARS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n. Null ids are in no fold."""
    return F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")) % n


def held_out(id_col: str, n: int, rest: int) -> Column:
    return F.coalesce(fold(id_col, n) == rest, F.lit(False))


def two_columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id, as doc_id, and the text, as text with null made empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def blocks(batches: Iterator[pa.RecordBatch], chars: int = BLOCK_CHARS, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches whose texts have about that many bytes, with the texts.

    A text is never cut, so a longer one makes a block of its own. After the last one the process gives its free memory back:
    workers are kept for later tasks, and what they hold meanwhile is missing to joins and sorts.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(column)
        ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + chars, side="right")))
            part = batch.slice(at, to - at)
            yield part, part.column(column).to_pylist()
            at = to
        del batch, text, part
    give_back()


def give_back() -> None:
    """Free memory of Arrow and of the C library goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_WHITE = re.compile("[\\x09-\\x0D\\x20]")


def cut(text: str, size: int) -> list[str]:
    """text in parts of about size characters, each but the last ending in ASCII white space: no word is cut."""
    parts, at = [], 0
    while len(text) - at > size and (m := _WHITE.search(text, at + size)):
        parts.append(text[at : m.end()])
        at = m.end()
    return [*parts, text[at:]]


def label_sample(labels: DataFrame, label_col: str, keep: Column, rows: int) -> DataFrame:
    """(doc_id, label): the given number of labelled rows, those whose ids hash lowest.

    Of an id with several labels the greatest counts. The result has at most ``rows`` rows, so it may be broadcast.
    """
    ids = F.col("doc_id").cast("long").alias("doc_id")
    one = labels.where(keep & F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).select(ids, F.col(label_col).cast("int").alias("label"))
    return one.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def training_texts(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    """doc_id, label and text of the sample's documents, in the order of hashes of their ids as long as all texts together have at most limit bytes.

    sample: doc_id, label; a bounded number of rows. A text that does not fit any more is left out; of rows that share an id the greatest text counts.
    The ids and lengths go to the driver, the result can.
    """
    known = two_columns(docs, id_col, text_col).join(F.broadcast(sample), "doc_id")
    sizes = known.groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    left, fitting = limit, []
    for r in sizes:
        if r["size"] <= left:
            left -= r["size"]
            fitting.append((r["doc_id"],))
    some = docs.sparkSession.createDataFrame(fitting, "doc_id long")
    return known.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.max(F.struct("text", "label")).alias("one")).select("doc_id", "one.label", "one.text")


# ---- words of a block as numpy arrays ----

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.full(max(n, 1 << 16), base, np.uint64)
            have[0] = 1
            have = np.cumprod(have)
        _powers[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Words:
    """The words of some texts, split at ASCII white space or at the bytes that gap marks; A-Z is lower-cased for the hashes.

    hash: 64 bits for each word. doc: the text's number. start, end: byte positions in raw.
    raw: the UTF-8 bytes of the texts, joined by line feeds. n: words in each text.
    """

    def __init__(self, texts: list[str], gap: np.ndarray = _SPACE):
        joined = "\n".join(texts).encode("utf-8", "surrogatepass")
        self.raw = np.frombuffer(joined, np.uint8)
        space = gap[self.raw]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        size = len(self.raw)
        low = np.frombuffer(joined.lower(), np.uint8)
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTE[low] * _power(_BASE, size, "up"), out=total[1:])
        span = total[self.end] - total[self.start]
        self.hash = mix(span * _power(_BASE_INV, size + 1, "down")[self.start] + (self.end - self.start).astype(np.uint64))
        lengths = np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], np.int64)
        firsts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1])) if len(texts) else np.zeros(0, np.int64)
        self.doc = np.searchsorted(firsts, self.start, side="right") - 1
        self.n = np.bincount(self.doc, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.n)[:-1])) if len(texts) else np.zeros(0, np.int64)


def sum_by_doc(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=n)


_written: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below spark.checkpoint.dir, which the whole cluster shares.

    Where that is unset, a temporary folder takes its place, but only if driver and executors are one process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='sigdiff-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: computed once, safe from lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what stored() has written inside; use the results before that."""
    before = len(_written)
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        while len(_written) > before:
            path = jvm.org.apache.hadoop.fs.Path(_written.pop())
            path.getFileSystem(conf).delete(path, True)
