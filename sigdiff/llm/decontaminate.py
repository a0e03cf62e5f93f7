"""Benchmark decontamination with DataFrame functions alone.

Words are runs of letters, digits and characters beyond ASCII, after lower-casing A-Z. A benchmark item's windows are its
runs of N words (one shorter window if it has fewer). Each word of a document is hashed once; the hashes of its windows of every
size come from those of neighbouring words, joined two, four, eight and so on at a time. They are looked up in the
broadcast set of the benchmark's hashes, and on a hit the words themselves are compared, in the same pass over the texts. So
texts are read and split once and never shuffled; what is shuffled is a narrow row for each document and hit. A benchmark of more
than BROADCAST_BYTES is looked up in several such passes, each with a part of its windows.

Null and empty texts have no words and are never hit. Items without words have no windows. Rows that repeat an
id are scored by their own texts. Rows with a null id are scored as well. Further columns of docs may have any names.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigdiff.llm.common import stored

#: Words in a window.
N = 10
#: Bytes of windows that are broadcast at once, about.
BROADCAST_BYTES = 64_000_000
#: Keys of hit documents that are broadcast, at most (some 50 bytes each); beyond it the documents are shuffled.
BROADCAST_KEYS = 1_000_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def words(text: Column) -> Column:
    """What stands between words becomes spaces, A-Z lower case, in one go over the characters."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase + _BETWEEN, string.ascii_lowercase + " " * len(_BETWEEN))
    return F.array_remove(F.split(low, " "), "")


def _hashed(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """docs: w (words) and others. Adds h: the hashes of the runs of each of the sizes, one size after another."""
    names = docs.columns
    run = docs.withColumn("h1", F.transform("w", lambda x: F.xxhash64(x)))
    after = lambda h, k: F.slice(h, k + 1, F.greatest(F.size(h) - k, F.lit(0)))
    both = lambda a, b, k: F.zip_with(a, after(b, k), lambda x, y: F.xxhash64(x, y))
    # each step is a column of its own, so that it is computed once; the last places of h2, h4, ... mean nothing
    made = {1}
    for k in (2**i for i in range(1, max(sizes).bit_length())):
        run, made = run.withColumn(f"h{k}", both(f"h{k // 2}", f"h{k // 2}", k // 2)), made | {k}
    for size in sizes:
        at = 1 << (size.bit_length() - 1)
        while at < size:
            step = 1 << ((size - at).bit_length() - 1)
            if at + step not in made:
                run, made = run.withColumn(f"h{at + step}", both(f"h{at}", f"h{step}", at)), made | {at + step}
            at += step
    whole = [F.slice(f"h{s}", 1, F.greatest(F.size("w") - s + 1, F.lit(0))) for s in sizes]
    return run.select(*names, F.concat(*whole).alias("h"))


def _offset(sizes: list[int], size: Column) -> Column:
    """Hashes in h before those of the given size."""
    out, before = F.lit(0), F.lit(0)
    for s in sizes:
        out = F.when(size == s, before).otherwise(out)
        before = before + F.greatest(F.col("n_words") - s + 1, F.lit(0))
    return out


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = N) -> DataFrame:
    """size, window (its words), hash, item (id as string) of each distinct window of each item."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    items = items.withColumn("size", F.least(F.size("w"), F.lit(n)))
    # at most n distinct sizes reach the driver
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())
    parts = [items.where("false").selectExpr("size", "w AS window", "bigint(0) AS hash", "item")]
    for s in sizes:
        runs = _hashed(items.where(F.col("size") == s), [s]).select("item", "w", "size", F.posexplode_outer("h").alias("pos", "hash"))
        parts.append(runs.select("size", F.slice("w", F.col("pos") + 1, s).alias("window"), "hash", "item"))
    return reduce(DataFrame.unionByName, parts).distinct()


def hits(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES, every: bool = False) -> DataFrame:
    """doc_id, print (hash of the text), n_words, start (from 1), size and item of each window of a document that is one of the benchmark's.

    every: also a row with start 0 and nothing after it for each row of docs.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    split = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("print"), words(text).alias("w"))
    split = split.withColumn("n_words", F.size("w"))
    facts = windows.groupBy("size").agg(F.sum(F.octet_length(F.array_join("window", " ")) + F.coalesce(F.octet_length("item"), F.lit(0)) + 64).alias("bytes")).collect()
    sizes, total = sorted(r["size"] for r in facts), sum(r["bytes"] for r in facts)
    start = F.lit(0).alias("start")
    if not sizes:
        none = split.select("doc_id", "print", "n_words", start, F.lit(None).cast("int").alias("size"), F.lit(None).cast("string").alias("item"))
        return none if every else none.where("false")
    hashed, passes, found = _hashed(split, sizes), -(-total // broadcast_bytes), []
    for part in range(passes):
        own = windows.where(F.pmod(F.xxhash64("hash", "item"), F.lit(passes)) == part).withColumnRenamed("hash", "own")
        first = every and part == 0
        # an outer explode, for the filter that an inner one brings would compute h again
        runs = hashed.select("doc_id", "print", "n_words", "w", F.posexplode_outer(F.concat(F.array(F.lit(0).cast("long")), "h") if first else "h").alias("pos", "hash"))
        at = F.col("pos") - _offset(sizes, F.col("size")) + (0 if first else 1)
        same = (F.col("hash") == F.col("own")) & (at >= 1) & (at + F.col("size") <= F.col("n_words") + 1) & (F.slice("w", at, F.col("size")) == F.col("window"))
        joined = runs.join(F.broadcast(own), same, "left" if first else "inner")
        if first:
            joined = joined.where("size IS NOT NULL OR pos = 0")
        found.append(joined.select("doc_id", "print", "n_words", F.coalesce(at, F.lit(0)).alias("start"), "size", "item"))
    return reduce(DataFrame.unionByName, found)


def _documents(found: DataFrame) -> DataFrame:
    """doc_id, print, n_words, rows (of docs), hit (positions of hit words, from 1, ascending), items (sorted) of each document in found."""
    span = F.when(F.col("size").isNotNull(), F.struct("start", "size"))
    one = found.groupBy("doc_id", "print", "n_words").agg(F.count_if(F.col("size").isNull()).alias("rows"), F.collect_set(span).alias("spans"), F.collect_set("item").alias("items"))
    hit = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1)))))
    return one.select("doc_id", "print", "n_words", "rows", hit.alias("hit"), F.array_sort("items").alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", n: int = N, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """For each row of docs: doc_id, n_words, hit (positions of its hit words, from 1, ascending), items."""
    windows = stored(benchmark_windows(benchmark, item_id_col, item_text_col, n), "windows")
    one = _documents(hits(docs, windows, id_col, text_col, broadcast_bytes, every=True))
    # rows that agree in id and text were one
    return one.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "hit", "items", F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int"))).alias("row")).drop("row")


def _marked(docs: DataFrame, benchmark: DataFrame, how: str, id_col: str, text_col: str, item_id_col: str, item_text_col: str, n: int, broadcast_bytes: int) -> DataFrame:
    """row (all columns of docs, as one), joined to the hit documents; of those, hit."""
    windows = stored(benchmark_windows(benchmark, item_id_col, item_text_col, n), "windows")
    one = stored(_documents(hits(docs, windows, id_col, text_col, broadcast_bytes)).select(F.col("doc_id").alias("hit_id"), F.col("print").alias("hit_print"), "hit"), "hits")
    if how == "left_anti":
        one = one.select("hit_id", "hit_print")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("own_id"), F.xxhash64(text).alias("own_print"))
    few = one.agg(F.count("*").alias("n"), F.sum(F.size("hit") if "hit" in one.columns else F.lit(0)).alias("words")).first()
    small = few["n"] + (few["words"] or 0) // 8 <= BROADCAST_KEYS
    same = F.col("own_id").eqNullSafe(F.col("hit_id")) & (F.col("own_print") == F.col("hit_print"))
    return rows.join(F.broadcast(one) if small else one, same, how)


def remove_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", n: int = N, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of docs without a hit word."""
    return _marked(docs, benchmark, "left_anti", id_col, text_col, item_id_col, item_text_col, n, broadcast_bytes).select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", n: int = N, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """All rows of docs; hit words are cut from the texts, each with what stands between it and the word before."""
    marked = _marked(docs, benchmark, "left", id_col, text_col, item_id_col, item_text_col, n, broadcast_bytes)
    text = F.col("row").getField(text_col)
    any_case = WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")
    whole, gaps = F.regexp_extract_all(text, F.lit(any_case), F.lit(0)), F.split(text, any_case, -1)
    # a column that is named twice below, so that it is computed once
    marked = marked.withColumn("pairs", F.when(F.col("hit").isNotNull(), F.zip_with(gaps, F.concat(whole, F.array(F.lit(""))), lambda g, w: F.concat(g, w))))
    kept = F.array_except(F.sequence(F.lit(1), F.size("pairs")), "hit")
    cut = F.array_join(F.transform(kept, lambda i: F.element_at("pairs", i)), "")
    new = F.when(F.col("hit").isNull(), text).otherwise(cut)
    return marked.select(*(new.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))
