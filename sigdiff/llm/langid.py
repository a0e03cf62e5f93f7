"""Language identification by a linear-chain conditional random field over words.

A word's features are its character n-grams of 2 to 4 with one space on each side (so affixes are among them) and the word itself, the
lexicon feature; each is hashed to a row of weights, one for each language. Transitions between the languages of neighbouring
words are learned with them, from sequences that splice pieces of different languages, by gradient steps on the
exact likelihood. Forward-backward gives each word's distribution over languages, so that code-switched text is
labelled word by word; a document's score is the mean over its words with letters, and its language the greatest.

Texts that are null or have no letter are und with score 0. Without any labelled text everything is und. Long texts run in segments whose
transfer matrices are multiplied, which is the same recursion; nothing is cut off. Texts are handled in groups, and very long ones
in pieces with the recursion's state carried both ways, so that memory does not grow with a text's length times the languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigdiff.llm.common import BLOCK_CHARS, Words, blocks, cut, mix, two_columns

#: log2 of the rows of weights, at most; with more languages there are fewer rows, so that the weights are no more than 2 ** WEIGHTS.
BITS, WEIGHTS = 16, 23
#: Labelled texts that a model is fitted on (one of each language at least), and bytes of all of them, at most, but for the shortest text of each language, which is always among them.
TRAIN_ROWS, TRAIN_BYTES = 1_200, 16_000_000
#: Different values of lang that the model tells apart; all rarer ones are learned as one, and predicted as the most frequent of them.
LANGUAGES = 4_000
#: Numbers that the recursion holds at once, about.
AT_ONCE = 8_000_000
#: Words of a segment in the matrix form of the recursion.
SEGMENT = 64
UNKNOWN = "und"

_rng = np.random.default_rng(77)
_CODE = _rng.integers(0, 2**63, (5, 256), dtype=np.uint64)
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[_SPACES] = 32


def _spans(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of rows start to end (exclusive, not empty) of values."""
    edges = np.empty(2 * len(start), np.int64)
    edges[0::2], edges[1::2] = start, end
    if len(edges) and edges[-1] >= len(values):
        values = np.concatenate((values, np.zeros((1, *values.shape[1:]), values.dtype)))
    return np.add.reduceat(values, edges, axis=0)[0::2] if len(edges) else np.zeros((0, *values.shape[1:]), values.dtype)


def _features(texts: list[str], bits: int, sizes: tuple[int, ...]) -> dict:
    w = Words(texts)
    raw = _FOLD[np.concatenate(([32], w.raw, [32, 32, 32, 32])).astype(np.uint8)]
    shift, grams = np.uint64(64 - bits), []
    for n in sizes:
        code = _CODE[0][raw[: len(raw) - 4]]
        for j in range(1, n):
            code += _CODE[j][raw[j : len(raw) - 4 + j]] * np.uint64(2 * j + 1)
        # in raw the word is from start + 1 to end + 1, and has a space before and after
        grams.append(((mix(code + np.uint64(n)) >> shift).astype(np.int32), w.start, np.maximum(w.end + 3 - n, w.start + 1)))
    letters = _spans(_LETTER[w.raw].astype(np.int32), w.start, w.end) > 0 if len(w.start) else np.zeros(0, bool)
    return {"n": w.n, "lexicon": (mix(w.hash + np.uint64(99)) >> shift).astype(np.int32), "letters": letters, "grams": grams}


class WordFeatures:
    """Feature rows of the words of some texts: for each n-gram size the row at each byte position, and where each word's begin and end.

    n, first: words of each text, and the number of its first word. doc: each word's text. letters: whether a word has any.
    """

    def __init__(self, texts: list[str], bits: int = BITS, sizes: tuple[int, ...] = (2, 3, 4)):
        # long texts in pieces, for which memory is needed one after another
        pieces = [(i, piece) for i, text in enumerate(texts) for piece in cut(text, BLOCK_CHARS)]
        parts, at, size = [], 0, 0
        for i, (_, piece) in enumerate(pieces):
            size += len(piece)
            if size >= BLOCK_CHARS or i + 1 == len(pieces):
                parts.append(_features([t for _, t in pieces[at : i + 1]], bits, sizes))
                at, size = i + 1, 0
        join = lambda k, kind: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kind)
        self.n = np.bincount([i for i, _ in pieces], weights=join("n", np.int64), minlength=len(texts)).astype(np.int64) if texts else np.zeros(0, np.int64)
        self.lexicon, self.letters = join("lexicon", np.int32), join("letters", bool)
        self.first = np.concatenate(([0], np.cumsum(self.n)[:-1])) if len(self.n) else self.n
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.grams = []
        for g in range(len(sizes)):
            shift = np.concatenate(([0], np.cumsum([len(p["grams"][g][0]) for p in parts])))
            self.grams.append(tuple(np.concatenate([p["grams"][g][k] + (s if k else 0) for p, s in zip(parts, shift, strict=False)]) if parts else np.zeros(0, np.int64) for k in range(3)))

    def emissions(self, weights: np.ndarray, low: int = 0, high: int | None = None) -> np.ndarray:
        """(words, languages) of the words from low to high; zero for words without a letter."""
        total = weights[self.lexicon[low:high]]
        for rows, start, end in self.grams:
            start, end = start[low:high], end[low:high]
            if len(start):
                total = total + _spans(weights[rows[start[0] : end.max()]], start - start[0], end - start[0])
        total[~self.letters[low:high]] = 0
        return total

    def rows_of(self, k: int) -> np.ndarray:
        return np.concatenate([[self.lexicon[k]], *(rows[start[k] : end[k]] for rows, start, end in self.grams)])


def posteriors(emissions: np.ndarray, transition: np.ndarray, n: np.ndarray, before: np.ndarray | None = None, behind: np.ndarray | None = None) -> np.ndarray:
    """(words, languages) marginals; n: words of each text, in order. transition: row-stochastic or any positive matrix.

    before, behind: the recursion's states at the ends, where the words are a piece of a text.
    """
    size = emissions.shape[1]
    if not len(emissions):
        return np.zeros((0, size))
    factor = np.exp(emissions - emissions.max(1, keepdims=True))
    segments = -(-n // SEGMENT)
    text_of = np.repeat(np.arange(len(n)), segments)
    first_segment = np.concatenate(([0], np.cumsum(segments)[:-1]))
    within = np.arange(len(text_of)) - first_segment[text_of]
    first_word = np.concatenate(([0], np.cumsum(n)[:-1]))
    at = first_word[text_of] + within * SEGMENT
    length = np.minimum(n[text_of] - within * SEGMENT, SEGMENT)
    steps = int(length.max())
    place = np.minimum(at[:, None] + np.arange(steps), len(factor) - 1)
    real = np.arange(steps) < length[:, None]
    e = factor[place]  # segments, steps, languages
    product = np.broadcast_to(np.eye(size), (len(at), size, size)).copy()
    for t in range(steps):
        on = real[:, t]
        moved = product[on] @ transition * e[on, t][:, None, :]
        product[on] = moved / moved.sum((1, 2), keepdims=True)
    into = np.full((len(at), size), 1 / size)  # distribution before each segment
    after = np.ones((len(at), size))
    last_segment = first_segment + segments - 1
    if before is not None:
        into[0], after[-1] = before, behind
    for k in range(1, int(segments.max())):
        on = first_segment[segments > k] + k
        moved = np.einsum("si,sij->sj", into[on - 1], product[on - 1])
        into[on] = moved / moved.sum(1, keepdims=True)
        on = last_segment[segments > k] - k
        moved = np.einsum("sij,sj->si", product[on + 1], after[on + 1])
        after[on] = moved / moved.sum(1, keepdims=True)
    forward = np.empty((len(at), steps, size))
    now = into
    for t in range(steps):
        moved = now @ transition * e[:, t]
        moved /= moved.sum(1, keepdims=True)
        now = np.where(real[:, t][:, None], moved, now)
        forward[:, t] = now
    back = after
    for t in range(steps - 1, -1, -1):
        forward[:, t] *= back
        moved = (e[:, t] * back) @ transition.T
        moved /= moved.sum(1, keepdims=True)
        back = np.where(real[:, t][:, None], moved, back)
    out = forward[real]
    return out / out.sum(1, keepdims=True)


def _states(emissions, transition: np.ndarray, cuts: list[int]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The states before each piece of a text and behind it; emissions(low, high) gives those of words."""
    size = len(transition)
    before, behind = [np.full(size, 1 / size)], [np.ones(size)]

    def factor(low: int, high: int) -> np.ndarray:
        e = emissions(low, high)
        return np.exp(e - e.max(1, keepdims=True))

    for low, high in zip(cuts[:-2], cuts[1:-1], strict=True):
        now = before[-1]
        for e in factor(low, high):
            now = now @ transition * e
            now /= now.sum()
        before.append(now)
    for low, high in zip(cuts[-2:0:-1], cuts[:1:-1], strict=True):
        now = behind[-1]
        for e in factor(low, high)[::-1]:
            now = transition @ (e * now)
            now /= now.sum()
        behind.append(now)
    return before, behind[::-1]


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray
    transition: np.ndarray
    bits: int = BITS

    def marginals(self, f: WordFeatures) -> Iterator[tuple[int, int, np.ndarray]]:
        """Low, high and (words, languages) marginals of the words from low to high, to the last word."""
        size = len(self.languages)
        most = max(SEGMENT, AT_ONCE // (size * size // SEGMENT + 6 * size))
        emissions = lambda low, high: f.emissions(self.weights, low, high).astype(np.float64)
        at = 0
        while at < len(f.n):
            to, words = at + 1, int(f.n[at])
            while to < len(f.n) and words + int(f.n[to]) <= most:
                words += int(f.n[to])
                to += 1
            low = int(f.first[at])
            if words <= most:
                if words:
                    yield low, low + words, posteriors(emissions(low, low + words), self.transition, f.n[at:to][f.n[at:to] > 0])
            else:
                cuts = [*range(low, low + words, most), low + words]
                for a, b, *ends in zip(cuts[:-1], cuts[1:], *_states(emissions, self.transition, cuts), strict=True):
                    yield a, b, posteriors(emissions(a, b), self.transition, np.array([b - a]), *ends)
            at = to

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        f = WordFeatures(texts, self.bits)
        total = np.zeros((len(texts), len(self.languages)))
        for low, high, p in self.marginals(f):
            real, base = f.letters[low:high], int(f.doc[low])
            own = f.doc[low:high][real] - base
            for j in range(total.shape[1]):
                found = np.bincount(own, weights=p[real, j])
                total[base : base + len(found), j] += found
        count = np.bincount(f.doc[f.letters], minlength=len(texts))
        share = total / np.maximum(count, 1)[:, None]
        best = share.argmax(1)
        known = [c > 0 and any(map(str.isalpha, t)) for c, t in zip(count, texts, strict=True)]
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, share.max(1), 0.0)


def fit_crf(texts: list[str], langs: list[str], bits: int = BITS, seed: int = 3, epochs: int = 3, length: int = 48, batch: int = 64) -> LanguageModel:
    """Sequences are length words, spliced from one to three texts; gradient steps with per-weight rates. Texts without words teach nothing; without any word there is no language."""
    languages = sorted(set(langs))
    size = len(languages)
    if not size:
        return LanguageModel([], np.zeros((1, 1), np.float32), np.ones((1, 1)), bits)
    rng = np.random.default_rng(seed)
    label = np.array([languages.index(x) for x in langs])
    f = WordFeatures(texts, bits)
    first, n = f.first, f.n
    usable = np.flatnonzero(n > 0)
    if not len(usable):
        return LanguageModel([], np.zeros((1, 1), np.float32), np.ones((1, 1)), bits)
    weights, seen = np.zeros((1 << bits, size)), np.full((1 << bits, size), 1e-2)
    moves, moves_seen = np.zeros((size, size)), np.full((size, size), 1e-2)
    for _ in range(epochs * max(1, len(usable) // batch)):
        words, truth = np.empty((batch, length), np.int64), np.empty((batch, length), np.int64)
        for i in range(batch):
            at = 0
            while at < length:
                d = rng.choice(usable)
                take = min(length - at, int(n[d]), int(rng.integers(4, length)))
                k = int(rng.integers(0, n[d] - take + 1))
                words[i, at : at + take], truth[i, at : at + take] = np.arange(first[d] + k, first[d] + k + take), label[d]
                at += take
        rows = [f.rows_of(k) for k in words.ravel()]
        counts = np.array([len(r) for r in rows])
        rows = np.concatenate(rows)
        owner = np.repeat(np.arange(batch * length), counts)
        e = np.add.reduceat(weights[rows], np.concatenate(([0], np.cumsum(counts)[:-1])), axis=0)
        voiced = f.letters[words.ravel()]
        e[~voiced] = 0
        e = np.exp(e - e.max(1, keepdims=True)).reshape(batch, length, size)
        trans = np.exp(moves)
        alpha, beta = np.empty_like(e), np.ones_like(e)
        alpha[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
        for t in range(1, length):
            a = alpha[:, t - 1] @ trans * e[:, t]
            alpha[:, t] = a / a.sum(1, keepdims=True)
        for t in range(length - 2, -1, -1):
            b = (e[:, t + 1] * beta[:, t + 1]) @ trans.T
            beta[:, t] = b / b.sum(1, keepdims=True)
        p = alpha * beta
        p /= p.sum(2, keepdims=True)
        pair = alpha[:, :-1, :, None] * trans * (e[:, 1:] * beta[:, 1:])[:, :, None, :]
        pair /= pair.sum((2, 3), keepdims=True)
        grad = p.reshape(-1, size).copy()
        grad[np.arange(batch * length), truth.ravel()] -= 1
        grad[~voiced] = 0
        of = grad[owner] / batch
        unique, inverse = np.unique(rows, return_inverse=True)
        step = np.stack([np.bincount(inverse, weights=of[:, j]) for j in range(size)], 1) + 1e-4 * weights[unique]
        seen[unique] += step * step
        weights[unique] -= 0.3 * step / np.sqrt(seen[unique])
        want = np.zeros((size, size))
        np.add.at(want, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), 1)
        step = (pair.sum((0, 1)) - want) / batch + 1e-3 * moves
        moves_seen += step * step
        moves -= 0.3 * step / np.sqrt(moves_seen)
    return LanguageModel(languages, weights.astype(np.float32), np.exp(moves - moves.max()), bits)


def fit_languages(docs: DataFrame, keep: Column, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, bits: int = BITS, train_bytes: int = TRAIN_BYTES) -> LanguageModel:
    """Fitted on an equal share of about ``rows`` texts (those whose ids hash lowest) of each language, one at least, for which ``keep`` holds, of ``train_bytes`` bytes together, language by language."""
    ids = docs.where(keep & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("label"))
    # the values of lang by frequency; from the last one on they are one class
    top = ids.groupBy("label").agg(F.count("*").alias("_c")).orderBy(F.desc("_c"), "label").limit(LANGUAGES).select("label").toArrow()["label"].to_pylist()
    n = len(top)
    if n == LANGUAGES:
        names = docs.sparkSession.createDataFrame([(x,) for x in top], "_own string")
        ids = ids.join(F.broadcast(names), F.col("label") == F.col("_own"), "left").select("doc_id", F.coalesce("_own", F.lit(top[-1])).alias("label"))
    share = -(-rows // max(1, n))
    w = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    first = ids.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= share)
    # ids first, so that the texts of only these rows are moved
    sample = first.groupBy("doc_id").agg(F.min_by("label", F.struct("_n", "label")).alias("label"), F.min("_n").alias("_n"))
    known = two_columns(docs, id_col, text_col).join(F.broadcast(sample), "doc_id")
    blank = F.max((F.trim(F.col("text")) == "").cast("int"))
    sizes = known.groupBy("doc_id", "label", "_n").agg(F.max(F.octet_length("text")).alias("size"), blank.alias("blank")).collect()  # as many as the sample has, at most
    fitting = docs.sparkSession.createDataFrame([(i,) for i in fair_share([tuple(r) for r in sizes], train_bytes)], "doc_id long")
    got = known.join(F.broadcast(fitting), "doc_id").groupBy("doc_id").agg(F.max(F.struct("text", "label")).alias("one")).select("doc_id", "one.label", "one.text").orderBy("doc_id").toArrow()
    return fit_crf(got["text"].to_pylist(), got["label"].to_pylist(), min(bits, max(8, WEIGHTS - max(1, n - 1).bit_length())))


def fair_share(sizes: list[tuple[int, str, int, int, int]], limit: int) -> list[int]:
    """Ids of texts (id, language, place in its language, bytes, 1 if it is blank) to learn from: of each language first its shortest text that is not blank, then the next of each in turn while all together have at most limit bytes."""
    by: dict[str, list[tuple]] = {}
    for r in sizes:
        by.setdefault(r[1], []).append(r)
    for own in by.values():
        own.sort(key=lambda r: (r[4], r[3], r[2], r[0]))
        own[1:] = sorted(own[1:], key=lambda r: (r[2], r[0]))
    out = [own[0][0] for own in by.values()]
    left = limit - sum(own[0][3] for own in by.values())
    for turn in range(1, max(map(len, by.values()), default=0)):
        for label in sorted(by):
            if turn < len(by[label]) and by[label][turn][3] <= left:
                left -= by[label][turn][3]
                out.append(by[label][turn][0])
    return out


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row; no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches):
            langs, score = held.value.predict(texts)
            yield pa.record_batch([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return two_columns(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")


def label_words(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, langs: the likeliest language of each word of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches):
            f = WordFeatures(texts, held.value.bits)
            names = np.array(held.value.languages, object)
            found = [names[p.argmax(1)] for *_, p in held.value.marginals(f)] if held.value.languages else [np.full(int(f.n.sum()), UNKNOWN, object)]
            every = np.concatenate(found) if found else names[:0]
            yield pa.record_batch([part.column("doc_id"), pa.array([list(x) for x in np.split(every, np.cumsum(f.n)[:-1])], pa.list_(pa.string()))], ["doc_id", "langs"])

    return two_columns(docs, id_col, text_col).mapInArrow(run, "doc_id long, langs array<string>")
