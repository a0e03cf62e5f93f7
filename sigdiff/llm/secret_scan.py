"""Secret scans: three fixed patterns, and a battery of randomness tests over other long tokens.

The patterns (base spans) are an assignment to a name such as password, an access key that begins with AKIA, and lower-case hex
of at least 24 characters. Further candidates are at least 20 characters of the base64 alphabets in a run, outside
base spans. For each the smallest fitting alphabet is inferred, and the symbols' places in it go through a chi-squared test of
uniformity, a runs test about the middle and a test of serial correlation; Fisher's method joins the three to one
p-value of randomness.

Ordinary writing gives the null distribution: all characters of each document, laid into each of the alphabets and
cut to windows of each of the length classes, go through the same battery. A candidate's p-value is the share of such windows, of its alphabet and of no higher length class,
that look at least as random. Longer candidates get more weight in a weighted Benjamini-Hochberg procedure over the candidates
of all documents, which fixes the accepted (alphabet, length class, bin) cells. Spans of kind random are added, base spans stay.

Null and empty texts have no spans. Repeated rows get equal spans. Texts are read whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigdiff.llm.common import blocks, stored, two_columns

KINDS = ("assign", "access", "hex", "random")
# On lower-cased bytes; positions are the same as in the text itself.
ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX_LENGTH, ACCESS_LENGTH, VALUE_LENGTH = 24, 20, 6
#: Shortest candidate of the battery, and the lower ends of the length classes.
CLASSES = (20, 28, 40, 64, 128)
#: Steps of a quarter of a power of ten in the p-value of randomness.
BINS = 40
#: Characters of windows that go through the battery at once.
AT_ONCE = 32768
#: False discoveries among accepted candidates, at most.
RATE = 0.05

_LOW, _UP, _NUM = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: From the smallest; an encoding is the first that has all of a candidate's characters.
ALPHABETS = {"hex": _NUM + "abcdef", "HEX": _NUM + "ABCDEF", "lower": _LOW, "upper": _UP, "base32": _UP + "234567", "lower36": _NUM + _LOW, "upper36": _NUM + _UP, "letters": _UP + _LOW, "alnum": _NUM + _UP + _LOW, "base64": _UP + _LOW + _NUM + "+/", "base64url": _UP + _LOW + _NUM + "-_", "any": _UP + _LOW + _NUM + "+/-_"}
NAMES = tuple(ALPHABETS)
_PLACE = np.full((len(NAMES), 256), -1, np.int16)
for _i, _a in enumerate(ALPHABETS.values()):
    _PLACE[_i, list(_a.encode())] = np.arange(len(_a))
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_RUN = np.zeros(256, bool)
_RUN[list(ALPHABETS["any"].encode())] = True


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(x: np.ndarray, size: int) -> float:
    """p-value of the hypothesis that the symbols x (0 to size - 1) are independent and uniform."""
    n = len(x)
    counts = np.bincount(x, minlength=size)
    df = size - 1
    chi = float((counts * counts).sum()) * size / n - n
    # Wilson and Hilferty's cube root
    p_chi = _tail(((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))) if chi > 0 else 1.0
    high = x >= size / 2
    n1 = int(high.sum())
    n0 = n - n1
    if n0 and n1:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 1 + 2 * n0 * n1 / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = 2 * _tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    d = x - (size - 1) / 2
    z = float((d[1:] * d[:-1]).sum()) / ((size * size - 1) / 12) / math.sqrt(n - 1)
    p_serial = 2 * _tail(abs(z))
    half = -sum(math.log(max(p, 1e-300)) for p in (p_chi, p_runs, p_serial))
    return min(1.0, math.exp(-half) * (1 + half + half * half / 2))


def length_class(n: int) -> int:
    return sum(n >= c for c in CLASSES) - 1


def cell(encoding: int, n: int, p: float) -> int:
    """Number of the (alphabet, length class, bin)."""
    b = min(BINS - 1, int(-4 * math.log10(max(p, 1e-30))))
    return (encoding * len(CLASSES) + length_class(n)) * BINS + b


def infer(raw: np.ndarray) -> int:
    return int(np.argmax((_PLACE[:, raw] >= 0).all(1)))


def _long_runs(member: np.ndarray, least: int) -> tuple[list[int], list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], member, [False])).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    keep = end - start >= least
    return start[keep].tolist(), end[keep].tolist()


@lru_cache(None)
def _tables(n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Minus the logarithms of battery()'s first two p-values, by the sum of squared counts, and by n1 and runs."""
    df = size - 1
    chi = np.zeros(n * n + 1)
    for k in range(n, n * n + 1):
        x = k * size / n - n
        if x > 0:
            chi[k] = -math.log(max(_tail(((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))), 1e-300))
    runs = np.full((n + 1, n + 1), (n - 1) * math.log(2))
    for n1 in range(1, n):
        mean = 1 + 2 * (n - n1) * n1 / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        for k in range(n + 1):
            runs[n1, k] = -math.log(max(2 * _tail(abs(k - mean) / math.sqrt(var)), 1e-300)) if var > 0 else 0
    return chi, runs


#: Minus the logarithm of the third p-value at steps of 1 / 512 of |z|.
_LOG_Z = -np.log([2 * _tail(z / 512) for z in range(37 * 512)])


def _level(n: int, size: int, squares: np.ndarray, n1: np.ndarray, turns: np.ndarray, products: np.ndarray) -> np.ndarray:
    """Minus the logarithm of the product of battery()'s three p-values. squares: sums of squared counts; n1: symbols of the upper half; turns: changes between halves; products: of
    neighbours' distances from the middle, doubled."""
    chi, runs = _tables(n, size)
    z = np.abs(products) * (512 / ((size * size - 1) / 3) / math.sqrt(n - 1))
    z = np.minimum(z, len(_LOG_Z) - 2)
    low = z.astype(np.int64)
    return chi[squares] + runs[n1, 1 + turns] + _LOG_Z[low] + (z - low) * (_LOG_Z[low + 1] - _LOG_Z[low])


def batteries(x: np.ndarray, size: int) -> np.ndarray:
    """battery() of each row of x."""
    w, n = x.shape
    d = 2 * x.astype(np.int64) - (size - 1)
    side = d > 0
    half = _level(n, size, _squares(x, size), side.sum(1), (side[:, 1:] != side[:, :-1]).sum(1), (d[:, 1:] * d[:, :-1]).sum(1))
    return np.minimum(1.0, np.exp(-half) * (1 + half + half * half / 2))


def _squares(x: np.ndarray, size: int) -> np.ndarray:
    """Sums of the squared counts of symbols in each row."""
    w = len(x)
    counts = np.bincount((x + (np.arange(w) * size)[:, None]).ravel(), minlength=w * size).reshape(w, size)
    return np.einsum("ij,ij->i", counts, counts)


def _bin_edges() -> np.ndarray:
    """The levels from which on a window lies in bins 1, 2, ...: there Fisher's p-value is a quarter of a power of ten further down."""
    edges = []
    for k in range(1, BINS):
        low, high = 0.0, 200.0
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if -4 * math.log10(max(math.exp(-mid) * (1 + mid + mid * mid / 2), 1e-30)) < k else (low, mid)
        edges.append(high)
    return np.array(edges)


_EDGES = _bin_edges()


def controls(raw: np.ndarray, first: np.ndarray) -> dict[int, int]:
    """Numbers of windows of ordinary writing by cell: all of each text's own characters, in every alphabet, cut to every length class. first: where texts begin.

    What a window's tests need but for its counts are differences of running sums over the alphabet's characters.
    """
    out: dict[int, int] = {}
    up = np.where((raw >= 97) & (raw <= 122), raw - 32, raw)
    for encoding, name in enumerate(NAMES):
        size = len(ALPHABETS[name])
        x = _PLACE[encoding, up if name in ("HEX", "upper", "base32", "upper36") else raw]
        kept = x >= 0
        before = np.concatenate(([0], np.cumsum(kept)))[np.minimum(first, len(raw))]
        x, own = x[kept].astype(np.int64), np.diff(before)
        if not len(x):
            continue
        d = 2 * x - (size - 1)
        side = d > 0
        sums = [np.concatenate(([0], np.cumsum(v))) for v in (side, side[1:] != side[:-1], d[1:] * d[:-1])]
        for n in CLASSES:
            k = own // n
            if not k.sum():
                continue
            starts = np.repeat(before[:-1] - n * (np.cumsum(k) - k), k) + n * np.arange(k.sum())
            rows, base = np.lib.stride_tricks.sliding_window_view(x, n), cell(encoding, n, 1.0)
            found = np.zeros(BINS, np.int64)
            for i in range(0, len(starts), AT_ONCE // n):  # a few at a time stay in the processor's cache
                a = starts[i : i + AT_ONCE // n]
                half = _level(n, size, _squares(rows[a], size), sums[0][a + n] - sums[0][a], *(v[a + n - 1] - v[a] for v in sums[1:]))
                found += np.bincount(np.searchsorted(_EDGES, half, side="right"), minlength=BINS)
            for b in np.flatnonzero(found).tolist():
                out[base + b] = out.get(base + b, 0) + int(found[b])
    return out


def scan(texts: list[str], ordinary: bool = True) -> tuple[list[list[tuple[int, int, int]]], list[list[tuple[int, int, int]]], dict[int, int]]:
    """For each text: base spans (start, end, kind) and candidates (start, end, cell), both in code points; the numbers of all texts' windows by cell, if asked for."""
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    joined = b"\n".join(encoded)  # no pattern crosses a line feed
    raw = np.frombuffer(joined, np.uint8)
    first = np.concatenate(([0], np.cumsum([len(e) + 1 for e in encoded]))).astype(np.int64)
    spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    chars = None if len(joined) == sum(map(len, texts)) + max(0, len(texts) - 1) else np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64)))

    def place(a: int, b: int) -> tuple[int, int, int]:
        d = int(np.searchsorted(first, a, side="right")) - 1
        start = a - int(first[d]) if chars is None else int(chars[a] - chars[first[d]])
        return d, start, start + b - a  # the spans themselves are ASCII

    base = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(joined.lower()) if m.end(1) - m.start(1) >= VALUE_LENGTH]
    base += [(m.start(), m.end(), 1) for m in ACCESS.finditer(joined) if m.end() - m.start() >= ACCESS_LENGTH]
    base += [(a, b, 2) for a, b in zip(*_long_runs(_HEX[raw], HEX_LENGTH), strict=True)]
    for a, b, kind in base:
        d, start, end = place(a, b)
        spans[d].append((start, end, kind))
    # the base spans, joined where they overlap, in order
    taken: list[list[int]] = []
    for a, b, _ in sorted(base):
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    ends = np.array([b for _, b in taken], np.int64)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for left, right in zip(*_long_runs(_RUN[raw], CLASSES[0]), strict=True):
        d = int(np.searchsorted(first, left, side="right")) - 1
        # what base spans leave of the run
        held, at = [], int(np.searchsorted(ends, left, side="right"))
        while at < len(taken) and taken[at][0] < right:
            held.append(taken[at])
            at += 1
        for a, b in zip([left, *(y for _, y in held)], [*(x for x, _ in held), right], strict=True):
            if b - a < CLASSES[0]:
                continue
            encoding = infer(raw[a:b])
            size = len(ALPHABETS[NAMES[encoding]])
            where = cell(encoding, b - a, battery(_PLACE[encoding, raw[a:b]].astype(np.int64), size))
            _, start, end = place(a, b)
            found[d].append((start, end, where))
    windows = controls(raw, first) if ordinary else {}
    for s in spans:
        s.sort(key=lambda x: (x[0], x[2]))
    return spans, found, windows


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda x: (x[0], x[2])))


SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32())]))
SPAN_SQL = "array<struct<start:int,end:int,kind:int>>"
NULL = pa.list_(pa.struct([("cell", pa.int32()), ("n", pa.int64())]))
NULL_SQL = "array<struct<cell:int,n:bigint>>"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base (spans), base_sha256, found (candidates with their cell in place of the kind), windows (numbers of windows of ordinary writing by cell, of a block of rows at once); no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches):
            spans, found, windows = scan(texts)
            rows = lambda every: pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in one] for one in every], SPAN)
            digest = pa.array([hashlib.sha256(written(s).encode()).hexdigest() for s in spans], pa.string())
            # the block's first row has the windows of all its texts
            null = pa.array([[{"cell": c, "n": n} for c, n in windows.items()], *[[]] * (len(texts) - 1)], NULL)
            yield pa.record_batch([part.column("doc_id"), rows(spans), digest, rows(found), null], ["doc_id", "base", "base_sha256", "found", "windows"])

    return two_columns(docs, id_col, text_col).mapInArrow(run, f"doc_id long, base {SPAN_SQL}, base_sha256 string, found {SPAN_SQL}, windows {NULL_SQL}")


def accepted_cells(seen: DataFrame, rate: float = RATE) -> list[int]:
    """Weighted Benjamini-Hochberg over all candidates; a count for each cell (at most 2,400) reaches the driver."""
    tests = {r.cell: r.n for r in seen.select(F.explode("found.kind").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).collect()}
    null = {r.cell: r.n for r in seen.select(F.explode("windows").alias("w")).groupBy("w.cell").agg(F.sum("w.n").alias("n")).collect()}
    total = sum(tests.values())
    if not total:
        return []
    weight = np.array(CLASSES, float)
    mean = sum(n * weight[c // BINS % len(CLASSES)] for c, n in tests.items()) / total
    rows = []
    for c, n in tests.items():
        group, b = divmod(c, BINS)
        # shorter windows look at least as random, so they may count too
        shorter = range(group - group % len(CLASSES), group + 1)
        of = [sum(null.get(g * BINS + i, 0) for g in shorter) for i in range(BINS)]
        p = (1 + sum(of[: b + 1])) / (1 + sum(of))
        rows.append((p * mean / weight[group % len(CLASSES)], n, c))
    rows.sort()
    seen_so_far, last = 0, -1
    for i, (p, n, _) in enumerate(rows):
        seen_so_far += n
        if p <= rate * seen_so_far / total:
            last = i
    return [c for *_, c in rows[: last + 1]]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """doc_id, base, base_sha256 and spans (base ones and those of kind random, by start and kind) of every row."""
    seen = stored(candidates(docs, id_col, text_col), "secrets")
    cells = accepted_cells(seen, rate)
    extra = F.filter("found", lambda c: c["kind"].isin(cells) if cells else F.lit(False))
    extra = F.transform(extra, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    own = F.transform("base", lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    return seen.select("doc_id", "base", "base_sha256", F.array_sort(F.concat(own, extra)).alias("spans"))


def span_text(spans: str):
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rate: float = RATE) -> DataFrame:
    """All rows and columns of docs; each secret in the text becomes [kind]. The column n_chars, if any, follows the text."""
    cells = frozenset(accepted_cells(stored(candidates(docs, id_col, text_col), "secrets"), rate))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, column=text_col):
            base, found, _ = scan([t or "" for t in texts], False)
            out = []
            for text, spans, more in zip(texts, base, found, strict=True):
                spans = [*spans, *((a, b, 3) for a, b, c in more if c in cells)]
                if spans:
                    made, at = [], 0
                    for a, b, kind in sorted(spans):
                        if a >= at:
                            made += [text[at:a], f"[{KINDS[kind]}]"]
                        at = max(at, b)
                    text = "".join(made) + text[at:]
                out.append(text)
            columns = {n: part.column(n) for n in names}
            columns[text_col] = pa.array(out, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([n if t == o else len(o) for n, t, o in zip(columns["n_chars"].to_pylist(), texts, out, strict=True)], columns["n_chars"].type)
            yield pa.record_batch([columns[n] for n in names], names)

    return docs.mapInArrow(run, docs.schema)
