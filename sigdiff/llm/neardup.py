"""Near-duplicate documents by SetSketch registers.

A document's set is its distinct shingles of k words (all words as one shingle if there are fewer). Each of M
registers takes floor(1 - log_B x) of the least of exponentially distributed hashes x of the shingles: registers of a union are the
greater of both, and registers of similar sets are often equal. Runs of ROWS registers are the bands; documents that agree in a band
are candidates. With 64 bands of 8, a pair of similarity 0.8 shares no band with a chance of about 1 in 130,000.

Documents with the same words in the same order (by a 128-bit hash of them, lower-cased and joined by single spaces) are one node from the
start; all other links are confirmed on full sets. In a band's bucket each node is held against a few centres rather
than against every other node, at most BEST centres a node and round, so a round costs what it has nodes; the links are joined to
components. After ROUNDS rounds the nodes of a bucket that are still in different components are held against each other, but for pairs that cannot be links by
their sizes and by how many of their shingles no other of these nodes has: an exact bound. Candidates whose
joint maximum-likelihood estimate is more than seven standard errors below the threshold are left out; the others are verified on the full sets.

Null and empty texts have no shingles and are linked with nothing. Rows of one id count as one document. Rows with a null id are kept and linked
with nothing; their component is null. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigdiff.llm.common import Words, blocks, mix, stored, two_columns
from sigdiff.llm.components import components

M, ROWS = 512, 8
BANDS = M // ROWS
#: Base of the registers' scale. A register is kept modulo 256: 256 steps are a factor of 160, far more than two similar sets' minima differ by.
BASE = 1.02
#: Estimates below this are not verified (the threshold less 0.13; a standard error at 0.8 with 512 registers is 0.018).
SLACK = 0.13
#: Centres of a bucket in a round, centres that a node is held against in a round, and rounds.
CENTRES, BEST, ROUNDS = 4, 2, 2
MASKS = tuple(int(x) for x in np.concatenate(([0], np.random.default_rng(11).integers(1, 2**40, CENTRES * ROUNDS - 1))))
#: Documents whose registers are made at once, and groups at most into which the documents compared with one centre are dealt.
AT_ONCE, SALTS = 1024, 64
#: Ids or keys that are broadcast to pick their rows, at most (some 30 bytes each); beyond it the rows are shuffled.
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(5)
_TIMES = _rng.integers(1, 2**31, M, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _rng.integers(0, 2**32, M, dtype=np.uint64).astype(np.uint32)


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = Words(texts)
    step = np.uint64(0x9E3779B97F4A7C15)
    run = w.hash
    for n in range(2, k + 1):
        run = run[:-1] * step + w.hash[n - 1 :] if len(run) > 1 else run[:0]
    run = mix(run)
    out = []
    for first, n in zip(w.first.tolist(), w.n.tolist(), strict=True):
        if n >= k:
            out.append(np.unique(run[first : first + n - k + 1]))
        elif n:
            whole = np.uint64(n)
            for h in w.hash[first : first + n]:
                whole = (np.array([whole]) * step + h)[0]
            out.append(mix(np.array([whole])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, M) registers; sets must not be empty."""
    every = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    halves = ((every >> np.uint64(32)).astype(np.uint32), every.astype(np.uint32))
    low = np.empty((M, len(sets)), np.uint32)
    mixed = np.empty_like(halves[0])
    for i in range(M):
        np.multiply(halves[i & 1], _TIMES[i], out=mixed)
        np.add(mixed, _PLUS[i], out=mixed)
        low[i] = np.minimum.reduceat(mixed, starts)
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32)
    return np.floor(1 - np.log(x) / np.log(BASE)).astype(np.int16).T


def packed(regs: np.ndarray) -> np.ndarray:
    """Registers modulo 256, as they are kept in tables."""
    return (regs & 255).astype(np.uint8)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood similarity of pairs of sets from their packed registers and sizes."""
    diff = (a - b).astype(np.int8)
    more, less = (diff > 0).sum(1), (diff < 0).sum(1)
    same = a.shape[1] - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u
    top = np.minimum(u / v, v / u)
    at = np.linspace(0, 1, 201)[None, :] * top[:, None]
    chance = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = chance(u[:, None] - v[:, None] * at), chance(v[:, None] - u[:, None] * at)
    fit = more[:, None] * np.log(up) + less[:, None] * np.log(down) + same[:, None] * np.log(np.maximum(1 - up - down, 1e-12))
    return at[np.arange(len(at)), fit.argmax(1)]


def _words_hash(text: str) -> int:
    return xxhash.xxh3_128_intdigest(b" ".join(text.encode("utf-8", "surrogatepass").lower().split()))


def sketches(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, t1, t2 (of the words in their order) and registers (null for the empty set); no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches):
            sets = shingle_sets(texts, k)
            full = [i for i, s in enumerate(sets) if len(s)]
            regs: list[bytes | None] = [None] * len(sets)
            for at in range(0, len(full), AT_ONCE):  # some memory for each set and register
                some = full[at : at + AT_ONCE]
                for i, r in zip(some, packed(registers([sets[i] for i in some])), strict=True):
                    regs[i] = r.tobytes()
            whole = np.array([divmod(_words_hash(t), 2**64) for t in texts], np.uint64).view(np.int64).reshape(-1, 2)
            yield pa.record_batch([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(whole[:, 0]), pa.array(whole[:, 1]), pa.array(regs, pa.binary())], ["doc_id", "n_shingles", "t1", "t2", "registers"])

    return two_columns(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_shingles long, t1 long, t2 long, registers binary")


def _beside(pairs: DataFrame, rows: DataFrame, run, schema: str) -> DataFrame:
    """Streams the pairs through run, each centre's row (of rows: doc_id, n, text) before those of the documents held against it.

    pairs: a, b, centre (a stands in for a null one). A centre's pairs are dealt into SALTS groups at most, and its row goes once to each
    group that has pairs, so that a centre of very many documents is neither one task's work nor copied for each of them.
    """
    own = F.coalesce("centre", "a")
    each = pairs.select("a", "b", "centre", own.alias("own"), F.when(own == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("doc_id"))
    each = each.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    heads = each.select(F.col("own").alias("doc_id"), "salt").distinct().join(rows, "doc_id").select(F.col("doc_id").alias("own"), "salt", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("long").alias("centre"), "n", "text")
    others = each.join(rows, "doc_id").select("own", "salt", F.lit(1).alias("kind"), "a", "b", "centre", "n", "text")
    return heads.unionByName(others).repartition("own", "salt").sortWithinPartitions("own", "salt", "kind", "a", "b").mapInArrow(run, schema)


def _grouped(batches: Iterator[pa.RecordBatch], prepare) -> Iterator[tuple[pa.RecordBatch, list, list]]:
    """Of _beside()'s rows: those of pairs, their centres' prepared values and their own. prepare: texts and n of a block to values."""
    key, held = None, []
    for part, texts in blocks(batches):
        values = prepare(texts, part.column("n").to_numpy())
        keep, centres = [], []
        for i, (kind, *own) in enumerate(zip(*(part.column(c).to_pylist() for c in ("kind", "own", "salt")), strict=True)):
            if kind == 0:
                # an id with rows of several texts has several heads
                held = [*held, values[i]] if key == own else [values[i]]
                key = own
            else:
                keep += [i] * len(held)
                centres += held
        if keep:
            yield part.take(pa.array(keep)), centres, [values[i] for i in keep]


def _likely(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, centres, own in _grouped(batches, lambda regs, n: list(zip(regs, n.tolist(), strict=True))):
            for at in range(0, len(own), 2000):
                x, y = centres[at : at + 2000], own[at : at + 2000]
                a, b = (np.frombuffer(b"".join(r for r, _ in z), np.uint8).reshape(-1, M) for z in (x, y))
                n_a, n_b = (np.array([n for _, n in z], float) for z in (x, y))
                keep = (estimate(a, b, n_a, n_b) >= threshold - SLACK) & (np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b) - 1e-6)
                yield part.slice(at, len(y)).select(["a", "b", "centre"]).filter(pa.array(keep))

    return run


def _compared(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, centres, own in _grouped(batches, lambda texts, _: shingle_sets(texts, k)):
            common = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(centres, own, strict=True)]
            sizes = [len(x) + len(y) for x, y in zip(centres, own, strict=True)]
            yield pa.record_batch([*(part.column(c) for c in ("a", "b", "centre")), pa.array(common, pa.int64()), pa.array(sizes, pa.int64())], ["a", "b", "centre", "common", "sizes"])

    return run


def _few(stored_rows: DataFrame) -> DataFrame:
    """To be broadcast if they are few enough, so that the rows they are joined to stay where they are, whatever their keys."""
    return F.broadcast(stored_rows) if stored_rows.count() <= BROADCAST_IDS else stored_rows


def _centre_pairs(members: DataFrame, masks: tuple[int, ...]) -> DataFrame:
    """members: key, rep, component. Pairs (a < b) of nodes with centres of their buckets that are in other components.

    A centre is the node with the least id after a bit mask, found by an aggregate with a row for each task and key before the
    shuffle. Of a node's centres the BEST ones are taken that share the most buckets with it.
    """
    least = [F.min(F.col("rep").bitwiseXOR(F.lit(m))).alias(f"c{i}") for i, m in enumerate(masks)]
    centres = _few(stored(members.groupBy("key").agg(*least, F.min("component").alias("c_low"), F.max("component").alias("c_high")).where("c_low <> c_high"), "centres"))
    every = F.array_distinct(F.array(*(F.col(f"c{i}").bitwiseXOR(F.lit(m)) for i, m in enumerate(masks))))
    found = members.join(centres, "key").select("rep", F.explode(every).alias("centre")).where("rep <> centre").groupBy("rep", "centre").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("n"), "centre"))
    best = found.withColumn("place", place).where(F.col("place") <= BEST)
    return best.select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b"), "centre").dropDuplicates(["a", "b"])


def _unshared(nodes: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """rep and lone: how many of the node's shingles no other of the nodes has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches):
            sets = shingle_sets(texts, k)
            ids = np.repeat(part.column("doc_id").to_numpy(), [len(s) for s in sets])
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(np.concatenate(sets).view(np.int64))], ["rep", "shingle"])

    shingles = _picked(texts, nodes.select(F.col("rep").alias("doc_id"))).mapInArrow(run, "rep long, shingle long")
    owners = shingles.groupBy("shingle").agg(F.min("rep").alias("rep"), F.max("rep").alias("other")).where("rep = other")
    return owners.groupBy("rep").agg(F.count("*").alias("lone"))


def _remaining_pairs(members: DataFrame, held: DataFrame, reps: DataFrame, texts: DataFrame, k: int, per_cent: int) -> DataFrame:
    """Pairs of nodes that share a bucket but not a component and that may be links.

    held: a, b, centre, common of the pairs compared so far. Of two nodes, the shingles in common are at most the lesser of what each shares with any other
    node; and where both were held against one centre, at most the lesser of what they have in common with it and the lesser of what
    they share outside it, together.
    """
    own = held.select(F.expr("if(a = centre, b, a)").alias("rep"), F.struct(F.col("centre").alias("c"), F.col("common").alias("m")).alias("one"))
    own = own.groupBy("rep").agg(F.collect_list("one").alias("centres"))  # BEST a round at most
    nodes = members.select("rep").unionByName(own.select(F.explode("centres.c").alias("rep"))).distinct()
    sizes = _picked(reps.withColumnRenamed("rep", "doc_id"), nodes.select(F.col("rep").alias("doc_id"))).groupBy(F.col("doc_id").alias("rep")).agg(F.max("n_shingles").alias("n"), F.count("*").alias("texts"))
    facts = sizes.join(_unshared(nodes, texts, k), "rep", "left").join(own, "rep", "left").where(F.col("rep").isNotNull())
    facts = facts.select("rep", F.when(F.col("texts") == 1, F.col("n")).alias("n"), (F.col("n") - F.coalesce("lone", F.lit(0))).alias("shared"), F.coalesce("centres", F.expr("cast(array() as array<struct<c:bigint,m:bigint>>)")).alias("centres"))
    able = members.join(facts, "rep").where(f"n IS NULL OR 100 * shared >= {per_cent} * n")
    x, y = able.alias("x"), able.alias("y")
    enough = lambda common: f"{100 + per_cent} * ({common}) >= {per_cent} * (x.n + y.n)"
    by_centre = enough("least(p.m, q.m) + least(x.shared - p.m, y.shared - q.m)")
    possible = F.expr(f"x.n IS NULL OR y.n IS NULL OR {enough('least(x.shared, y.shared)')} AND forall(x.centres, p -> forall(y.centres, q -> p.c <> q.c OR {by_centre}))")
    found = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") < F.col("y.component")) & possible)
    return found.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct().withColumn("centre", F.lit(None).cast("long"))


def _picked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is among the ids; those are broadcast if they are few enough."""
    return rows.join(_few(stored(ids.distinct(), "ids")), "doc_id", "left_semi")


def _labelled(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Members with their components, of buckets that hold several components."""
    found = members.select("key", "rep").join(comps, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    several = found.groupBy("key").agg(F.min("component").alias("c_low"), F.max("component").alias("c_high")).where("c_low <> c_high").select("key")
    return found.join(_few(stored(several, "keys")), "key", "left_semi")


def _buckets(reps: DataFrame) -> DataFrame:
    """key, rep, component (the node itself) of the buckets that hold several nodes."""
    key = F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(registers, i * {ROWS} + 1, {ROWS})))")
    bands = reps.select(F.explode(key).alias("key"), "rep")
    # most keys have one node; the others are few enough, as a rule, to pick their rows without a shuffle
    several = stored(bands.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high").select("key"), "keys")
    return bands.join(_few(several), "key", "left_semi").select("key", "rep", F.col("rep").alias("component"))


def _same_id(full: DataFrame, classes: DataFrame, same: list[str]) -> DataFrame:
    """Links from ids that have rows of several texts to the nodes of those texts."""
    ids = stored(full.groupBy("doc_id").agg(F.min("t1").alias("x"), F.max("t1").alias("y")).where("x <> y").select("doc_id"), "ids")
    some = full.join(ids, "doc_id", "left_semi").select("doc_id", *same)
    return stored(some.join(classes, same).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct(), "links")


def near_duplicates(docs: DataFrame, k: int = 5, per_cent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable over links, its own included) of every row.

    Documents are linked if 100 * common shingles >= per_cent * shingles of either.
    """
    sig = stored(sketches(docs, k, id_col, text_col), "sketches")
    same = ["n_shingles", "t1", "t2"]
    full = sig.where("registers IS NOT NULL AND doc_id IS NOT NULL")
    classes = stored(full.groupBy(*same).agg(F.min("doc_id").alias("rep")), "classes")
    reps = stored(full.join(classes.withColumnRenamed("rep", "doc_id"), [*same, "doc_id"]).select(F.col("doc_id").alias("rep"), "n_shingles", "registers").distinct(), "nodes")
    members = stored(_buckets(reps), "buckets")
    texts = two_columns(docs, id_col, text_col)
    tested, held, comps = None, None, components(_same_id(full, classes, same))
    for number in range(ROUNDS + 1):
        if number < ROUNDS:
            pairs = _centre_pairs(members, MASKS[number * CENTRES : (number + 1) * CENTRES])
        elif held is not None:
            pairs = _remaining_pairs(members, held, reps, texts, k, per_cent)
        else:
            break  # no bucket held two nodes
        pairs = stored(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            continue
        found = compare(pairs, reps, texts, k, per_cent)
        new = found.where(f"common > 0 AND 100 * common >= {per_cent} * (sizes - common)").select("a", "b")
        tested = pairs.select("a", "b") if tested is None else tested.unionByName(pairs.select("a", "b"))
        held = found if held is None else held.unionByName(found)
        if new.isEmpty():
            continue
        comps = components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(new))
        if number < ROUNDS:
            members = stored(_labelled(members, comps), "buckets")
            if members.isEmpty():
                break
    ends = classes.join(comps, F.col("rep") == F.col("node"), "left").select(*same, F.coalesce("component", "rep").alias("component_id"))
    out = sig.select("doc_id", *same).join(ends, same, "left")
    alone = F.when(F.col("n_shingles") > 0, F.col("component_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce(alone, "doc_id")).alias("component_id"))


def compare(pairs: DataFrame, reps: DataFrame, texts: DataFrame, k: int, per_cent: int) -> DataFrame:
    """a, b, centre, common, sizes (of both full sets together) of the pairs whose registers do not rule a link out. Written and read again."""
    ids = lambda p: p.select(F.col("a").alias("doc_id")).unionByName(p.select(F.col("b").alias("doc_id")))
    some = _picked(reps.withColumnRenamed("rep", "doc_id"), ids(pairs)).select("doc_id", F.col("n_shingles").alias("n"), F.col("registers").alias("text"))
    likely = stored(_beside(pairs, some, _likely(per_cent / 100), "a long, b long, centre long").distinct(), "likely")
    read = _picked(texts, ids(likely)).select("doc_id", F.lit(0).alias("n"), "text")
    return stored(_beside(likely, stored(read, "texts"), _compared(k), "a long, b long, centre long, common long, sizes long"), "compared")


def one_of_each(docs: DataFrame, k: int = 5, per_cent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, but of each group of near duplicates only those of the least id. Rows with a null id stay."""
    found = near_duplicates(docs, k, per_cent, id_col, text_col)
    gone = stored(found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    # columns of docs of any names lie within row
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("own"))
    return rows.join(_few(gone), F.col("own") == F.col("gone"), "left_anti").select("row.*")


def kept(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))
