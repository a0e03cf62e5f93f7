"""Language-model scores of whole documents: a gated recurrent network with a class-factored softmax, in numpy.

Tokens are words between ASCII white space, A-Z lower-cased, and one end after each text. All training texts are counted. The
TOP most frequent tokens are outputs of the network: they lie by rank in classes of CLASS tokens, and a token's probability is that of its class times
that within the class. All other tokens share one more class, within which a token has probability (c + 1) / Z, Z summing c + 1 over the
class and one unseen token; so unseen words have a probability, too. The state is carried over a whole
document, from its first token to its end.

Training, by backpropagation cut to STEPS tokens: the output biases start at the counts of the whole corpus; the driver
fits a first model to WARM segments; then the segments of all texts are dealt by hashes of texts and ids, so that copies of a text go apart, to shards of about SHARD tokens; a larger one is
cut after every LARGEST tokens. Each shard goes once over all its segments from the first model on, and the shards' models are averaged. The state is carried from segment to segment. What is
counted and what is trained on so grow with the corpus, and neither depends on how the rows lie in tasks: shards and their order come from the texts, and
the average is a sum of whole numbers.

Counts of the KEPT most frequent tokens are broadcast; those of rarer ones are joined by shuffle, a row for each document and
rare token. Tokens are told apart by 64-bit hashes. Null texts are empty: only their end is scored. Rows may repeat, and rows with a null id count as training texts.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigdiff.llm.common import BLOCK_CHARS, Words, blocks, cut, mix, stored, two_columns
from sigdiff.llm.gru import Adam, backward_apart, forward_apart, step_apart

#: Outputs of the network and tokens in a class; units of the state.
TOP, CLASS, UNITS = 4096, 64, 24
#: Tokens whose counts are broadcast, at most (16 bytes each).
KEPT = 200_000
#: Tokens that gradients go back, and such pieces in a segment; segments for the first model; segments of a step, at least and at most.
STEPS, PIECES, WARM, BATCH = 24, 2, 4_000, (128, 512)
#: Tokens of a shard, about; segments of a text that stay in one shard, in a row; tasks that train, at most.
SHARD, RUN, TASKS = 2_000_000, 4_096, 10_000
#: Tokens after which a shard is cut: rows that agree in text and id, or copies without ids, cannot be dealt apart.
LARGEST = 3_000_000
#: Tokens that a task scores at once, about; documents side by side in scoring; steps of the lanes that are laid out at once; tokens from which on documents are scored apart from shorter ones.
GROUP, LANES, SLICE, LONG = 1_000_000, 512, 2_048, 2_500
#: Tokens whose softmax over the classes is taken at once; rows of an input that are added up side by side, the rest of a frequent one's on its own.
ROWS, FEW = 2_048, 16
#: Parameters in a row of a shard's model; a parameter is summed as a multiple of 1 / SCALE.
CHUNK, SCALE = 4_096, 2.0**18
END = np.uint64(0x1D0C_E4D0_F00D_5EED)


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens in order, and the number of tokens of each text."""
    if any(len(t) > 2 * BLOCK_CHARS for t in texts):  # a piece of a long text at a time
        each = [np.concatenate([*(Words([part]).hash for part in cut(t, BLOCK_CHARS)), [END]]) for t in texts]
        return np.concatenate(each), np.array([len(x) for x in each])
    w = Words(texts)
    n = w.n + 1
    out = np.empty(int(n.sum()), np.uint64)
    ends = np.cumsum(n) - 1
    out[ends] = END
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = w.hash
    return out, n


def count_tokens(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. hash and n of every token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in blocks(batches, 8 * BLOCK_CHARS):
            found, n = np.unique(tokens(texts)[0], return_counts=True)
            yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(n, pa.int64())], ["hash", "n"])

    return docs.mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """hashes (sorted) and counts of the tokens kept, their ranks; total and types over all training tokens."""

    hashes: np.ndarray
    counts: np.ndarray
    ranks: np.ndarray
    total: int
    types: int
    limit: int = TOP

    @property
    def top(self) -> int:
        return min(self.limit, len(self.hashes))

    @property
    def rest(self) -> int:
        """Z of the class of all other tokens."""
        return self.total - int(self.counts[self.ranks < self.top].sum()) + self.types - self.top + 1

    @cached_property
    def firsts(self) -> tuple[np.uint64, np.ndarray]:
        """How far hashes are shifted to their first bits, and where in hashes each value of these begins."""
        bits = len(self.hashes).bit_length()
        shift = np.uint64(64 - bits)
        places = np.searchsorted(self.hashes >> shift, np.arange(1 << bits, dtype=np.uint64))
        return shift, np.minimum(places, len(self.hashes) - 1).astype(np.int32)

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Places in hashes, -1 where the token is not kept."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        shift, firsts = self.firsts
        last = len(self.hashes) - 1
        at = firsts[(hashes >> shift).astype(np.int64)]
        on = np.flatnonzero((self.hashes[at] < hashes) & (at < last))
        while len(on):
            at[on] += 1
            on = on[at[on] < last]
            on = on[self.hashes[at[on]] < hashes[on]]
        return np.where(self.hashes[at] == hashes, at, -1)

    def ids(self, place: np.ndarray) -> np.ndarray:
        """Network ids: the rank, or top for any other token."""
        return np.minimum(np.where(place >= 0, self.ranks[np.maximum(place, 0)] if len(self.ranks) else 0, self.top), self.top)


def new_params(v: Vocabulary, seed: int = 1, dtype=np.float32) -> dict[str, np.ndarray]:
    """Inputs: the tokens, the rest (number top) and the start (top + 1), for each gate. The biases are those of the counts."""
    rng = np.random.default_rng(seed)
    classes = -(-v.top // CLASS)
    counts = np.full(classes * CLASS, 1e-30)
    counts[v.ranks[v.ranks < v.top]] = v.counts[v.ranks < v.top] + 1.0
    mass = np.append(counts.reshape(classes, CLASS).sum(1), v.rest)
    normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(dtype)
    apart = lambda x: np.ascontiguousarray(x.reshape(len(x), 3, UNITS).transpose(1, 0, 2))
    return {
        "x": apart(normal(0.2, v.top + 2, 3 * UNITS)),
        "u": apart(normal(1 / math.sqrt(UNITS), UNITS, 3 * UNITS)),
        "wc": np.zeros((UNITS, classes + 1), dtype),
        "bc": np.log(mass / mass.sum()).astype(dtype),
        "wt": np.zeros((classes * CLASS, UNITS), dtype),
        "bt": np.log(counts).astype(dtype),
    }


def _order(keys: np.ndarray, below: int) -> np.ndarray:
    """Places by key, equal ones in order; keys of 16 bits are sorted digit by digit."""
    return np.argsort(keys.astype(np.min_scalar_type(below)), kind="stable")


def _near(weights: np.ndarray, bias: np.ndarray, most: float) -> bool:
    """Whether no product of weights (outputs, units) and a state of numbers up to most, with its bias, needs _softmax's shift."""
    reach = np.abs(weights).sum(1) * most
    return bool((bias + reach < 60).all() and (bias - reach > -80).all())


def _softmax(z: np.ndarray, own: np.ndarray, gradient: bool, near: bool = False) -> np.ndarray:
    """Logarithms of the softmax at own; z becomes the gradient of their negative sum, if asked for. near: z is known to lie between -80 and 60."""
    if not near and len(z) and (z.max() > 60 or z.min() < -80):  # else no exponential or sum leaves the range of 32 bits
        z -= z.max(1, keepdims=True)
    at = np.arange(len(z))
    out = z[at, own]
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], z.dtype)
    if gradient:
        z *= (1 / total)[:, None]
        z[at, own] -= 1
    return out - np.log(total)


def log_probabilities(p: dict[str, np.ndarray], h: np.ndarray, target: np.ndarray, top: int, grads: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural logarithms for targets (of the class alone for other tokens); adds to grads, if given, and gives the states' gradients of the negative sum."""
    kind = np.minimum(target // CLASS, len(p["bc"]) - 1)
    kind[target >= top] = len(p["bc"]) - 1
    order = _order(kind, len(p["bc"]))
    kind, target, h = kind[order], target[order], h.take(order, axis=0)
    most = max(h.max(), -h.min(), 0) if len(h) else 0
    near = _near(p["wc"].T, p["bc"], most)
    logs, dh = np.empty(len(h), h.dtype), None if grads is None else np.empty_like(h)
    for at in range(0, len(h), ROWS):
        rows = slice(at, at + ROWS)
        d = h[rows] @ p["wc"]
        d += p["bc"]
        logs[rows] = _softmax(d, kind[rows], grads is not None, near)
        if grads is not None:
            grads["wc"] += h[rows].T @ d
            grads["bc"] += np.ones(len(d), d.dtype) @ d
            np.matmul(d, p["wc"].T, out=dh[rows])
    near = _near(p["wt"], p["bt"], most)
    edges = np.searchsorted(kind, np.arange(len(p["bc"]))).tolist()
    for c in range(len(p["bc"]) - 1):
        rows = slice(edges[c], edges[c + 1])
        if rows.start == rows.stop:
            continue
        of = slice(c * CLASS, (c + 1) * CLASS)
        d = h[rows] @ p["wt"][of].T
        d += p["bt"][of]
        logs[rows] += _softmax(d, target[rows] - c * CLASS, grads is not None, near)
        if grads is not None:
            grads["wt"][of] += d.T @ h[rows]
            grads["bt"][of] += np.ones(len(d), d.dtype) @ d
            dh[rows] += d @ p["wt"][of]
    out = np.empty_like(logs)
    out[order] = logs
    if grads is None:
        return out, None
    back = np.empty_like(dh)
    back[order] = dh
    return out, back


def _sums(rows: np.ndarray, values: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows and, of each, the sum of its values (gates, rows, units)."""
    order = _order(rows, below)
    ordered = rows[order]
    new = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    sizes = np.diff(np.append(new, len(rows)))
    often = np.argsort(-sizes, kind="stable")  # so that those with a k-th value come first
    new, sizes = new[often], sizes[often]
    total = values.take(order[new], axis=1)
    for k in range(1, FEW):
        n = int((sizes > k).sum())
        if not n:
            break
        total[:, :n] += values.take(order[new[:n] + k], axis=1)
    for i in range(int((sizes > FEW).sum())):
        total[:, i] += values.take(order[new[i] + FEW : new[i] + sizes[i]], axis=1).sum(1)
    return ordered[new], total


def segment_gradients(p: dict[str, np.ndarray], ids: np.ndarray, h: np.ndarray, top: int) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
    """ids: (segments, 1 + steps), -1 after the end. Mean loss of a token, gradients, and the last state."""
    before, after = ids[:, :-1].T, ids[:, 1:].T
    real = after >= 0
    inputs = np.where(before >= 0, before, top)
    states, cache = forward_apart(p["x"].take(inputs, axis=1), p["u"], h)
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    n = max(1, int(real.sum()))
    logs, dh = log_probabilities(p, states[real], after[real], top, grads)
    d_states = np.zeros_like(states)
    d_states[real] = dh
    dx, grads["u"] = backward_apart(d_states, cache, p["u"])
    rows, total = _sums(inputs.ravel(), dx.reshape(3, -1, dx.shape[3]), top + 2)
    grads["x"][:, rows] = total
    for g in grads.values():
        g /= n
    return -float(logs.sum()) / n, grads, states[-1]


def train(p: dict[str, np.ndarray], segments: np.ndarray, top: int, rate: float, epochs: int = 1, seed: int = 1) -> None:
    """In place; the state is carried from each piece of a segment to the next."""
    adam, rng = Adam(rate), np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(segments))
        for at in range(0, len(order), BATCH[0]):
            part = segments[order[at : at + BATCH[0]]]
            h = np.zeros((len(part), UNITS), p["u"].dtype)
            for k in range(PIECES):
                _, g, h = segment_gradients(p, part[:, k * STEPS : (k + 1) * STEPS + 1], h, top)
                adam(p, g)


def train_runs(p: dict[str, np.ndarray], segments: np.ndarray, first: np.ndarray, top: int, adam: Adam, seed: int = 1) -> None:
    """In place, over every segment once; the state is carried from each segment to the next, unless first, which marks the segments that begin a text.

    Runs lie one after another in lanes (more of them for more segments), which are trained side by side. A run longer than a lane's share goes on in
    another lane, from a blank state, so that a few long texts fill all lanes, too.
    """
    wide = int(np.clip(len(segments) // 64, *BATCH))
    share = -(-len(segments) // wide)
    starts = np.flatnonzero(first)
    starts = np.concatenate([np.arange(a, b, share) for a, b in zip(starts, np.append(starts[1:], len(first)), strict=True)])
    sizes = np.diff(np.append(starts, len(segments)))
    lanes: list[list[int]] = [[] for _ in range(min(wide, len(starts)))]
    filled = [(0, k) for k in range(len(lanes))]
    for r in np.argsort(-sizes, kind="stable").tolist():
        n, k = filled[0]
        lanes[k].append(r)
        heapq.heapreplace(filled, (n + int(sizes[r]), k))
    lengths = np.array([n for n, _ in sorted(filled, key=lambda x: (-x[0], x[1]))])
    rng = np.random.default_rng(seed)
    rows = np.full((int(lengths[0]), len(lanes)), -1)
    for column, (_, k) in enumerate(sorted(filled, key=lambda x: (-x[0], x[1]))):
        own = np.concatenate([np.arange(starts[r], starts[r] + sizes[r]) for r in rng.permutation(lanes[k])])
        rows[: len(own), column] = own
    new = np.zeros(len(segments), bool)
    new[starts] = True
    h = np.zeros((len(lanes), UNITS), p["u"].dtype)
    for row in rows:
        row = row[row >= 0]
        part = segments[row]
        h = h[: len(row)] * ~new[row][:, None]
        for k in range(PIECES):
            piece = part[:, k * STEPS : (k + 1) * STEPS + 1]
            if (piece[:, 1:] >= 0).any():
                _, g, h = segment_gradients(p, piece, h, top)
                adam(p, g)


def segments_of(docs: DataFrame, held) -> DataFrame:
    """key, doc_id, at and ids (32 bits each) of all segments of every text, in order; at counts from 0 in each text. The last one ends in -1.

    The key is a hash of the text, the id and at // RUN.
    """
    length = STEPS * PIECES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value
        for part, texts in blocks(batches):
            hashes, n = tokens(texts)
            ids = v.ids(v.look_up(hashes)).astype(np.int32)
            rows = (n - 1) // length + 1
            doc = np.repeat(np.arange(len(n)), rows)
            at = np.arange(len(doc)) - np.repeat(np.cumsum(rows) - rows, rows)
            place = (at * length)[:, None] + np.arange(-1, length)
            out = np.where(place < n[doc][:, None], ids[np.clip((np.cumsum(n) - n)[doc][:, None] + place, 0, len(ids) - 1)], np.int32(-1))
            out[at == 0, 0] = v.top + 1
            own = np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in texts], np.uint64)
            given = part.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            key = mix((own + mix(given))[doc] + (at // RUN).astype(np.uint64)).view(np.int64)
            for i in range(0, len(doc), 100_000):
                rows = out[i : i + 100_000]
                ids_column = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * (4 * (length + 1))), pa.py_buffer(rows.tobytes())])
                at_rows = slice(i, i + len(rows))
                yield pa.record_batch([pa.array(key[at_rows]), part.column("doc_id").take(pa.array(doc[at_rows])), pa.array(at[at_rows], pa.int32()), ids_column], ["key", "doc_id", "at", "ids"])

    return docs.mapInArrow(run, "key long, doc_id long, at int, ids binary")


def _flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _shaped(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


@dataclass
class LanguageModel:
    vocabulary: Vocabulary
    params: dict[str, np.ndarray]


def fit_language_model(docs: DataFrame, keep: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[LanguageModel, DataFrame]:
    """The model, and the stored counts (hash, n) of all training tokens. The driver gets KEPT counts, WARM segments and one average model."""
    spark = docs.sparkSession
    known = two_columns(docs.where(keep), id_col, text_col)
    counts = stored(count_tokens(known), "counts")
    total, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("n"), "hash").limit(KEPT).toArrow()
    hashes, n = top["hash"].to_numpy().view(np.uint64), top["n"].to_numpy()
    ranked, by_hash = np.lexsort((hashes, -n)), np.argsort(hashes)
    ranks = np.empty(len(hashes), np.int64)
    ranks[ranked] = np.arange(len(hashes))
    v = Vocabulary(hashes[by_hash], n[by_hash], ranks[by_hash], int(total), int(types), TOP)
    held = spark.sparkContext.broadcast(v)
    segments = stored(segments_of(known, held), "segments")
    params = new_params(v)
    warm = segments.orderBy(F.xxhash64("key", "at"), "doc_id", "at").limit(WARM).toArrow()["ids"].to_pylist()
    if not warm:
        return LanguageModel(v, params), counts
    train(params, _rows(warm).astype(np.int64), v.top, 0.01, 2)
    first = spark.sparkContext.broadcast(params)
    shards = max(1, -(-int(total) // SHARD))
    dealt = segments.withColumn("shard", F.pmod("key", F.lit(shards))).repartition(min(shards, TASKS), "shard").sortWithinPartitions("shard", "key", "doc_id", "at")
    models = dealt.select("shard", "at", "ids").mapInArrow(_trained(first, v.top), "chunk int, part int, value array<long>, n long")
    some = models.groupBy("chunk", "part").applyInArrow(_summed, "chunk int, value array<long>, n long")
    mean = some.groupBy("chunk").applyInArrow(_summed, "chunk int, value array<long>, n long").toArrow().sort_by("chunk")
    flat = np.concatenate([np.array(x, float) / n / SCALE for x, n in zip(mean["value"].to_pylist(), mean["n"].to_pylist(), strict=True)])
    return LanguageModel(v, _shaped(flat, params)), counts


def _rows(ids: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(ids), np.int32).reshape(-1, STEPS * PIECES + 1)


def _summed(rows: pa.Table) -> pa.Table:
    value = np.sum([x.values.to_numpy() for c in rows["value"].chunks for x in c], axis=0)
    return pa.table({"chunk": rows["chunk"][:1], "value": pa.array([value], pa.list_(pa.int64())), "n": pa.array([sum(rows["n"].to_pylist())], pa.int64())})


def _trained(first, top: int):
    """Rows of segments (shard, at, ids), shard by shard, to the sum of the shards' models in pieces of CHUNK parameters, and of their weights.

    A shard's weight is its number of segments in sixty-fourths of a usual shard's. Of a shard no more than LARGEST tokens are held.
    """
    most = max(1, LARGEST // (STEPS * PIECES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = None, 0
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def learn() -> None:
            nonlocal total, weight
            p, at = {k: x.copy() for k, x in first.value.items()}, np.concatenate([x for x, _ in waiting])
            train_runs(p, np.concatenate([x for _, x in waiting]).astype(np.int64), (at % RUN == 0) | (np.diff(at, prepend=-2) != 1), top, Adam(0.003))
            n = max(1, 64 * STEPS * PIECES * len(at) // SHARD)
            own = np.rint(_flat(p).astype(np.float64) * SCALE).astype(np.int64) * n
            total, weight = own if total is None else total + own, weight + n
            waiting.clear()

        last = None
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            for rows in np.split(np.arange(len(shard)), np.flatnonzero(np.diff(shard)) + 1):
                if not len(rows):
                    continue
                if waiting and shard[rows[0]] != last:
                    learn()
                last = shard[rows[0]]
                at = 0
                while at < len(rows):
                    held = sum(len(x) for x, _ in waiting)
                    if held == most:
                        learn()
                        held = 0
                    some = batch.slice(int(rows[0]) + at, min(len(rows) - at, most - held))
                    waiting.append((some.column("at").to_numpy(), _rows(some.column("ids").to_pylist())))
                    at += some.num_rows
        if waiting:
            learn()
        if total is not None:
            parts = [total[i : i + CHUNK] for i in range(0, len(total), CHUNK)]
            yield pa.record_batch([pa.array(range(len(parts)), pa.int32()), pa.array([TaskContext.get().partitionId() % 32] * len(parts), pa.int32()), pa.array(parts, pa.list_(pa.int64())), pa.array([weight] * len(parts), pa.int64())], ["chunk", "part", "value", "n"])

    return run


def network_scores(p: dict[str, np.ndarray], top: int, ids: list[np.ndarray]) -> np.ndarray:
    """Natural log probability that the network gives each document (of other tokens: their class), the state carried from start to end.

    Documents are laid into lanes, one after another, so that few lanes run short.
    """
    out = np.zeros(len(ids))
    lanes: list[list[int]] = [[] for _ in range(min(LANES, len(ids)))]
    filled = np.zeros(len(lanes), np.int64)
    for d in sorted(range(len(ids)), key=lambda d: -len(ids[d])):
        k = int(filled.argmin())
        lanes[k].append(d)
        filled[k] += len(ids[d])
    order = np.argsort(-filled, kind="stable")
    # of each lane: its documents one after another, and where they begin
    goals = [np.concatenate([ids[d] for d in lanes[k]]).astype(np.int32) for k in order]
    begins = [np.cumsum([0, *(len(ids[d]) for d in lanes[k])])[:-1] for k in order]
    filled, h = filled[order], np.zeros((len(lanes), UNITS), np.float32)
    for low in range(0, int(filled.max()), SLICE):
        high = min(low + SLICE, int(filled.max()))
        live = (filled[None, :] > np.arange(low, high)[:, None]).sum(1)
        target = np.full((high - low, int(live[0])), -1, np.int32)
        before, owner = np.zeros_like(target), np.zeros_like(target)
        for column in range(target.shape[1]):
            goal, begin = goals[column], begins[column]
            to = min(high, len(goal))
            target[: to - low, column] = goal[low:to]
            before[: to - low, column] = goal[low - 1 : to - 1] if low else np.append(0, goal[: to - 1])
            own = begin[(begin >= low) & (begin < to)]
            before[own - low, column] = top + 1
            owner[: to - low, column] = np.array(lanes[order[column]])[np.searchsorted(begin, np.arange(low, to), side="right") - 1]
        held: list[np.ndarray] = []
        since = waiting = 0
        goes_on = before != top + 1
        begins_at = ~goes_on.all(1)  # steps at which some lane's state is made blank
        for t in range(high - low):
            n = int(live[t])
            h = h[:n]
            if begins_at[t]:
                h = h * goes_on[t, :n, None]
            h = step_apart(p["x"].take(before[t, :n], axis=1), h, p["u"])
            held.append(h)
            waiting += n
            if t + 1 == high - low or waiting >= 16384:
                real = target[since : t + 1] >= 0
                logs, _ = log_probabilities(p, np.concatenate(held), target[since : t + 1][real], top)
                out += np.bincount(owner[since : t + 1][real], weights=logs, minlength=len(ids))
                held, since, waiting = [], t + 1, 0
    return out


_PARTS = "uid long, doc_id long, n_tokens long, n_kept long, n_rare long, base double, score double, rare array<long>, times array<int>"


def _parts(held):
    def flush(docs: list[tuple[int | None, np.ndarray]], first: int) -> pa.RecordBatch:
        v, p = held.value.vocabulary, held.value.params
        hashes, n = np.concatenate([t for _, t in docs]), np.array([len(t) for _, t in docs])
        doc = np.repeat(np.arange(len(docs)), n)
        place = v.look_up(hashes)
        ids = v.ids(place).astype(np.int32)
        kept = place >= 0
        logs = np.zeros(len(hashes))
        logs[kept] = np.log10(v.counts[place[kept]] + 1.0)
        score = network_scores(p, v.top, np.split(ids, np.cumsum(n)[:-1])) / math.log(10)
        other = kept & (ids >= v.top)
        score += np.bincount(doc[other], weights=logs[other] - math.log10(v.rest), minlength=len(docs))
        rare, own = hashes[~kept], doc[~kept]
        order = np.lexsort((rare, own))
        rare, own = rare[order], own[order]
        new = np.flatnonzero(np.concatenate(([True], (rare[1:] != rare[:-1]) | (own[1:] != own[:-1]))) if len(rare) else np.zeros(0, bool))
        times = np.diff(np.append(new, len(rare))).astype(np.int32)
        cut = np.cumsum(np.bincount(own[new], minlength=len(docs)))[:-1]
        columns = [
            pa.array(first + np.arange(len(docs)), pa.int64()),
            pa.array([d for d, _ in docs], pa.int64()),
            pa.array(n, pa.int64()),
            pa.array(np.bincount(doc[kept], minlength=len(docs)), pa.int64()),
            pa.array(np.bincount(own, minlength=len(docs)), pa.int64()),
            pa.array(np.bincount(doc, weights=logs, minlength=len(docs))),
            pa.array(score),
            pa.array(np.split(rare[new].view(np.int64), cut), pa.list_(pa.int64())),
            pa.array(np.split(times, cut), pa.list_(pa.int32())),
        ]
        return pa.record_batch(columns, [c.split()[0] for c in _PARTS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 36
        # short and long documents: lanes of one group are about equally long, so that few steps have few lanes
        groups: tuple[list[tuple[int | None, np.ndarray]], ...] = [], []
        sizes = [0, 0]
        for part, texts in blocks(batches):
            hashes, n = tokens(texts)
            for d, own in zip(part.column("doc_id").to_pylist(), np.split(hashes, np.cumsum(n)[:-1]), strict=True):
                long = len(own) > LONG
                groups[long].append((d, own.copy() if long else own))  # else a long one keeps the whole block
                sizes[long] += len(own)
            for k in (0, 1):
                if sizes[k] >= GROUP:
                    yield flush(groups[k], first)
                    first += len(groups[k])
                    groups[k].clear()
                    sizes[k] = 0
        left = sum(groups, [])
        if left and sum(sizes) > GROUP:
            for docs in filter(None, groups):
                yield flush(docs, first)
                first += len(docs)
        elif left:
            yield flush(left, first)

    return run


def score_documents(docs: DataFrame, model: LanguageModel, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score (unigrams, add one) and score (the model), both log10, of every row."""
    v = model.vocabulary
    held = docs.sparkSession.sparkContext.broadcast(model)
    parts = stored(two_columns(docs, id_col, text_col).mapInArrow(_parts(held), _PARTS), "scores")
    rare = parts.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("uid", F.col("r.rare").alias("hash"), F.col("r.times").alias("times"))
    found = rare.join(counts, "hash").groupBy("uid").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("logs"))
    joined = parts.drop("rare", "times").join(found, "uid", "left").withColumn("logs", F.coalesce("logs", F.lit(0.0)))
    return joined.select(
        "doc_id",
        "n_tokens",
        (F.col("n_kept") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("logs") - F.col("n_tokens") * F.lit(math.log10(v.total + v.types + 1))).alias("base_score"),
        (F.col("score") + F.col("logs") - F.col("n_rare") * F.lit(math.log10(v.rest))).alias("score"),
    )
