"""Periodic runs of words: stretches that repeat one period at least four times, and texts collapsed to one period of each.

A run is a maximal stretch of words with smallest period q and a length of at least max(6, 4 q). Each of its words occurs at least
four times in it, so a text is first cut at words that occur fewer than four times, and each piece again by its own counts, until
nothing changes: no run crosses a cut, and ordinary writing leaves hardly any piece.

On each piece the first phase of Baier's suffix sorter groups suffixes by their longest Lyndon prefix, once with the words
ordered by rank and once the other way round; the lengths of the groups' contexts are the piece's two Lyndon arrays. By the runs theorem
each run has a Lyndon root of its period among the entries of one of them. Each entry is extended to both sides by longest common extensions, which
are exact: they compare names of stretches of doubling lengths.

Words are what stands between ASCII white space, case matters. Null and empty texts have no words and no runs; a null id
changes no words in ``op11_periods``. Repeated rows get equal results. Texts are read whole; a worker's memory follows the longest one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sigdiff.llm.common import blocks, two_columns

#: Least length of a run, and least number of its periods.
LENGTH, TIMES = 6, 4


def lyndon_lengths(ranks: list[int]) -> list[int]:
    """The length of the longest Lyndon word that starts at each place, by phase one of Baier's suffix sorter.

    Suffixes are held in groups, in ascending order of what their members are known to start with, the context. From the highest group down, each member
    points to the nearest place before it in a lower group; places pointed to as often and of one group move to a new group just
    above, whose context is longer by as many contexts of the pointing group. A group that is reached is final.
    """
    n = len(ranks)
    places = sorted(range(n), key=ranks.__getitem__)
    at = [0] * n
    first = [0] * n
    end, context = [0] * n, [0] * n
    low = 0
    for k, i in enumerate(places):
        at[i] = k
        if ranks[i] != ranks[places[low]]:
            low = k
        first[i] = low
        end[low], context[low] = k + 1, 1
    before, length = [-1] * n, [0] * n
    top = n
    while top:
        own = first[places[top - 1]]
        size = context[own]
        times: dict[int, int] = {}
        for i in sorted(places[own:top]):
            length[i] = size
            j = i - 1
            while j >= 0 and first[j] >= own:
                j = before[j]
            before[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for j, t in times.items():
            moved.setdefault((t, first[j]), []).append(j)
        # what is pointed to more often ends up higher
        for t, group in sorted(moved, reverse=True):
            members = moved[t, group]
            stop = end[group]
            new = stop - len(members)
            for k, j in enumerate(members, new):
                other, hole = places[k], at[j]
                places[hole], at[other] = other, hole
                places[k], at[j] = j, k
            if new > group:
                end[group] = new
            grown = context[group] + t * size
            for j in members:
                first[j] = new
            end[new], context[new] = stop, grown
        top = own
    return length


class Extensions:
    """Longest common extensions in one sequence: names of its stretches of 1, 2, 4, ... elements, equal only for equal stretches."""

    def __init__(self, words: np.ndarray, longest: int):
        n = len(words)
        self.names = [np.unique(words, return_inverse=True)[1].astype(np.int64)]
        while 1 << len(self.names) <= longest:
            step, last = 1 << (len(self.names) - 1), self.names[-1]
            if n <= 2 * step:
                break
            pair = last[: n - 2 * step + 1] * (int(last.max()) + 1) + last[step : n - step + 1]
            self.names.append(np.unique(pair, return_inverse=True)[1].astype(np.int64))

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many elements from a on equal those from b on; a < b."""
        out = np.zeros(len(a), np.int64)
        for k, names in reversed(list(enumerate(self.names))):
            for _ in range(2 if k == len(self.names) - 1 else 1):
                fits = b + out < len(names)
                x, y = np.where(fits, a + out, 0), np.where(fits, b + out, 0)
                out += np.where(fits & (names[x] == names[y]), 1 << k, 0)
        return out

    def back(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many elements before a equal those before b; a < b."""
        out = np.zeros(len(a), np.int64)
        for k, names in reversed(list(enumerate(self.names))):
            for _ in range(2 if k == len(self.names) - 1 else 1):
                x, y = a - out - (1 << k), b - out - (1 << k)
                fits = x >= 0
                x, y = np.where(fits, x, 0), np.where(fits, np.minimum(y, len(names) - 1), 0)
                out += np.where(fits & (names[x] == names[y]), 1 << k, 0)
        return out


def pieces(ids: np.ndarray) -> list[tuple[int, int]]:
    """Stretches [from, to) outside of which no word is in a run, none of which a run crosses."""
    keep = np.ones(len(ids), bool)
    piece = np.zeros(len(ids), np.int64)
    at = np.arange(len(ids))
    while len(at):
        key = piece[at] * (int(ids.max()) + 1) + ids[at]
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        stays = count[inverse] >= TIMES
        keep[at[~stays]] = False
        at = at[stays]
        # neighbours stay together, short pieces go
        number = np.cumsum(np.concatenate(([1], np.diff(at) > 1))) if len(at) else at
        long = np.bincount(number)[number] >= LENGTH if len(at) else at.astype(bool)
        keep[at[~long]] = False
        same = bool(stays.all() and long.all())
        at, piece = at[long], piece.copy()
        piece[at] = number[long]
        if same:
            break
    edge = np.flatnonzero(np.diff(np.concatenate(([False], keep, [False])).astype(np.int8)))
    return list(zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True))


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a text's words, given as numbers from 0, by start, then period."""
    found: set[tuple[int, int, int]] = set()
    for low, high in pieces(ids) if len(ids) >= LENGTH else []:
        part = np.unique(ids[low:high], return_inverse=True)[1]
        n, most = high - low, int(part.max())
        root = np.stack([lyndon_lengths(part.tolist()), lyndon_lengths((most - part).tolist())]).astype(np.int64)
        start = np.broadcast_to(np.arange(n), root.shape)
        # a root that its run repeats often enough has its run's second period within the piece
        fits = (TIMES * root <= n) & (start + root < n)
        start, q = start[fits], root[fits]
        lce = Extensions(part, n)
        ahead = lce.ahead(start, start + q)
        back = lce.back(start, start + q)
        length = back + ahead + q
        good = length >= np.maximum(LENGTH, TIMES * q)
        found |= set(zip((low + start - back)[good].tolist(), length[good].tolist(), q[good].tolist(), strict=True))
    return sorted(found, key=lambda r: (r[0], r[2]))


def numbered(words: list[bytes]) -> np.ndarray:
    """Each word's number, by first occurrence."""
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def repeated(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which word each of the n words becomes in the documents that are to repeat themselves; None for the others."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


def collapse(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay if each run is cut down to its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


PERIODS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeat: bool = False, texts: bool = False) -> DataFrame:
    """For each row of docs: the number of its runs, its longest run (of equal ones that of least start, then period; nulls if there is none) and the SHA-256 of
    the list of runs and of the collapsed text, the words that stay joined by single blanks.

    repeat: first lets a tenth of the documents, by the checksum of their ids, repeat themselves from some word on. texts: adds runs (start, length, period) and
    collapsed. One pass, no shuffle.
    """
    schema = PERIODS + (", runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string" if texts else "")
    names = [c.split()[0] for c in schema.split(", ")]
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    types = [pa.int64()] * 6 + [pa.string()] * 2 + [run_type, pa.string()] * texts

    def row(doc_id: int | None, text: str) -> tuple:
        words = text.encode("utf-8", "surrogatepass").split()
        becomes = repeated(doc_id, len(words)) if repeat else None
        if becomes is not None:
            words = [words[i] for i in becomes.tolist()]
        runs = find_runs(numbered(words))
        kept = b" ".join(words[i] for i in np.flatnonzero(collapse(len(words), runs)).tolist()) if runs else b" ".join(words)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        start, length, q = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
        out = (doc_id, len(runs), start, length, q, 1000 * length // q if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
        return (*out, [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], kept.decode("utf-8", "surrogatepass")) if texts else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, some in blocks(batches):
            rows = [row(i, t) for i, t in zip(part.column("doc_id").to_pylist(), some, strict=True)]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return two_columns(docs, id_col, text_col).mapInArrow(run, schema)
