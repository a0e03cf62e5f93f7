"""SentencePiece encoding and decoding of merge-type (BPE) models, exact, by backtracking.

A sequence of pieces is the encoding of a text if each piece encodes to itself and each two neighbours stay two
pieces when their joined text is merged anew. So the search takes the longest piece at each position (all matches
come from one Aho-Corasick pass), asks whether it is compatible with the piece before, tries shorter ones if not, and
steps back when none is. A bitfield holds the positions that a valid beginning reached and that led nowhere: the encoding of a
beginning is unique, so such a position need never be tried again. Characters that no piece holds become byte pieces.

The new words of a block of texts are searched side by side: all places walk down a trie of the pieces together, then all words take,
shorten or take back a piece at a time, by the same rules. The last few that need many steps are searched one by one.

Where no piece has a space after another character, as in usual models, no merge crosses the start of a word; words
are then encoded one by one, and short ones are remembered in a bounded table.

Null texts are empty: their ids are the begin and end ids alone. Texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sigdiff.llm.common import blocks, two_columns

SPACE = "▁"
#: Words remembered by a process's encoder, those used last, and the longest of them.
WORDS, LONGEST = 200_000, 48
#: Places (of 8 bytes) for neighbours whose compatibility is remembered; of those that share a place the last one is.
PAIRS = 1 << 20
#: New words of a block from which on they are encoded side by side, and most of them at once.
MANY, MOST = 100, 10_000
#: Words left of them from which on the rest is searched one by one.
LEFT = 20
#: Codes of the piece types in the model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = raw[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message in protocol buffer form."""
    at = 0
    while at < len(raw):
        tag, at = _varint(raw, at)
        if tag & 7 == 0:
            value, at = _varint(raw, at)
        else:
            size, at = (8, at) if tag & 7 == 1 else (4, at) if tag & 7 == 5 else _varint(raw, at)
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value


class PieceModel:
    """The parts of a model file that encoding needs."""

    def __init__(self, raw: bytes):
        self.raw = raw
        self.pieces: list[str] = []
        scores: list[float] = []
        kinds: list[int] = []
        trainer, normalizer = {}, {}
        for number, value in fields(raw):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normalizer = dict(fields(value))
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0):
            raise ValueError("only merge-type models with byte fallback are read")
        if normalizer.get(2, b"") or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("only models that leave the text as it is are read")
        if USER in kinds or UNUSED in kinds:
            raise ValueError("models with pieces set by the user are not read")
        self.prefix = bool(normalizer.get(3, 1))
        self.begin, self.end = trainer.get(41, 1), trainer.get(42, 2)
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == NORMAL}
        self.score = {p: scores[i] for p, i in self.ids.items()}
        self.bytes = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == BYTE}
        self.surface = [bytes([int(p[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, kinds, strict=True)]
        self.words_apart = not any(SPACE in p.lstrip(SPACE) for p in self.ids)


class Recent(dict):
    """A dict of a bounded number of keys: when half of them are new since the last time, those unused meanwhile go."""

    def __init__(self, most: int):
        self.half, self.old = max(1, most // 2), {}

    def __missing__(self, key):
        """The value, or None; a key that was about to go is kept."""
        value = self.old.get(key)
        if value is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value


class Trie:
    """Pieces by their characters; many places of a text go down at once. Its edges lie in a hash table, those that share a place one after another."""

    def __init__(self, pieces: dict[str, int]):
        codes = {c: k for k, c in enumerate(sorted({c for p in pieces for c in p}), 1)}
        nodes = {"": 0}
        for piece in pieces:
            for k in range(1, len(piece) + 1):
                nodes.setdefault(piece[:k], len(nodes))
        self.codes = np.zeros(max(map(ord, codes), default=0) + 2, np.int32)
        for c, k in codes.items():
            self.codes[ord(c)] = k
        self.piece = np.full(len(nodes), -1, np.int64)
        for piece, i in pieces.items():
            self.piece[nodes[piece]] = i
        self.width, bits = len(codes) + 1, (4 * len(nodes)).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.child = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        below = {nodes[p[:-1]] * self.width + codes[p[-1]]: node for p, node in nodes.items() if p}
        for (key, node), place in zip(below.items(), self._places(np.array(list(below), np.int64)).tolist(), strict=True):
            while self.keys[place] >= 0:
                place = (place + 1) & self.mask
            self.keys[place], self.child[place] = key, node

    def _places(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def down(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The nodes' children, or -1."""
        keys = nodes * self.width + codes
        place, out, left = self._places(keys), np.full(len(keys), -1), np.arange(len(keys))
        while len(left):
            found = self.keys[place]
            hit = found == keys
            out[left[hit]] = self.child[place[hit]]
            on = np.flatnonzero(~hit & (found >= 0))
            left, keys, place = left[on], keys[on], (place[on] + 1) & self.mask
        return out

    def longest(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The longest piece at each place of the words, which lie one after another with one place between two, or -1; and where they end."""
        points = np.frombuffer(("\n".join(words) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        codes = self.codes[np.minimum(points, len(self.codes) - 1)].astype(np.int64)
        codes[ends] = 0  # no edge has this code
        out, at = np.full(len(codes), -1), np.arange(len(codes))
        to, nodes = at, np.zeros(len(codes), np.int64)
        while len(at):
            nodes = self.down(nodes, codes[to])
            on = np.flatnonzero(nodes >= 0)
            at, to, nodes = at[on], to[on] + 1, nodes[on]
            piece = self.piece[nodes]
            some = piece >= 0
            out[at[some]] = piece[some]
        return out, ends


class Encoder:
    def __init__(self, raw: bytes):
        self.model = m = PieceModel(raw)
        self.known = {c for p in m.ids for c in p}
        self.find = ahocorasick.Automaton()
        whole = {p: i for p, i in m.ids.items() if self.merged(p) == [p]}
        for piece, i in whole.items():
            self.find.add_word(piece, (len(piece), i))
        self.find.make_automaton()
        self.trie = Trie(whole)
        self.size, self.shorter = np.zeros(len(m.pieces), np.int64), np.full(len(m.pieces), -1)
        for piece, i in whole.items():
            self.size[i] = len(piece)
            self.shorter[i] = next((whole[piece[:k]] for k in range(len(piece) - 1, 0, -1) if piece[:k] in whole), -1)
        self.fits = array("q", [-1]) * PAIRS
        self.memory = Recent(WORDS)
        self.cut = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if m.words_apart else "(?s).+")

    def merged(self, text: str) -> list[str]:
        """Merges by score, the leftmost of equal ones first; for short texts."""
        parts, score = list(text), self.model.score
        while len(parts) > 1:
            best, at = -np.inf, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and s > best:
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        key, place = a << 32 | b << 1, (a * 40_503 + b) % PAIRS
        found = self.fits[place]
        if found | 1 != key | 1:
            x, y = self.model.pieces[a], self.model.pieces[b]
            found = self.fits[place] = key | (self.merged(x + y) == [x, y])
        return bool(found & 1)

    def search(self, text: str) -> list[int]:
        """Ids of a text of known characters, by backtracking."""
        n = len(text)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for last, (size, i) in self.find.iter(text):
            starts[last - size + 1].append((size, i))
        dead = bytearray(n // 8 + 1)
        ids: list[int] = []
        tries: list[int] = []
        ends: list[int] = []
        at, left = 0, len(starts[0])
        while at < n:
            options = starts[at]
            while left:
                left -= 1
                size, i = options[left]
                to = at + size
                if dead[to >> 3] >> (to & 7) & 1 or ids and not self.compatible(ids[-1], i):
                    continue
                ids.append(i)
                tries.append(left)
                ends.append(to)
                at, left = to, len(starts[to]) if to < n else 0
                break
            else:
                if not ids:
                    raise ValueError("no sequence of pieces covers the text")
                dead[at >> 3] |= 1 << (at & 7)
                ids.pop()
                ends.pop()
                at, left = ends[-1] if ends else 0, tries.pop()
        return ids

    def word(self, text: str) -> bytes:
        if self.known.issuperset(text):
            ids = self.search(text)
        else:
            ids = []
            at = 0
            for k, c in enumerate(text):
                if c not in self.known:
                    if k > at:
                        ids += self.search(text[at:k])
                    ids += [self.model.bytes[b] for b in c.encode("utf-8", "surrogatepass")]
                    at = k + 1
            if at < len(text):
                ids += self.search(text[at:])
        return np.array(ids, "<u4").tobytes()

    def all_compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """compatible() of many pairs."""
        keys, found = a << 32 | b << 1, np.frombuffer(self.fits, np.int64)[(a * 40_503 + b) % PAIRS]
        out = (found & 1).astype(bool)
        for k in np.flatnonzero(found | 1 != keys | 1).tolist():
            out[k] = self.compatible(int(a[k]), int(b[k]))
        return out

    def side_by_side(self, words: list[str]) -> list[bytes | None]:
        """word() of words of known characters, by the same search; None of the last few."""
        longest, ends = self.trie.longest(words)
        dead = np.zeros(len(longest), bool)
        stack, depth = np.zeros((len(words), max(map(len, words)) + 1), np.int64), np.zeros(len(words), np.int64)
        own, at = np.arange(len(words)), np.concatenate(([0], ends[:-1] + 1))
        last, piece = np.full(len(words), -1), longest[at]
        while len(own) > LEFT:
            # take the piece, if it leads to no dead end and fits the one before
            tried = np.flatnonzero(piece >= 0)
            to = at[tried] + self.size[piece[tried]]
            good = ~dead[to]
            pairs = np.flatnonzero(good & (last[tried] >= 0))
            good[pairs] = self.all_compatible(last[tried[pairs]], piece[tried[pairs]])
            taken, failed = tried[good], tried[~good]
            back = np.flatnonzero(piece < 0)
            stack[own[taken], depth[own[taken]]] = last[taken] = piece[taken]
            depth[own[taken]] += 1
            at[taken] = to[good]
            piece[taken] = longest[at[taken]]
            piece[failed] = self.shorter[piece[failed]]
            if len(back):  # nothing fits here
                if (last[back] < 0).any():
                    raise ValueError("no sequence of pieces covers the text")
                dead[at[back]] = True
                depth[own[back]] -= 1
                at[back] -= self.size[last[back]]
                piece[back] = self.shorter[last[back]]
                top = depth[own[back]]
                last[back] = np.where(top > 0, stack[own[back], top - 1], -1)
            on = np.flatnonzero(at < ends[own])
            own, at, last, piece = own[on], at[on], last[on], piece[on]
        undone = set(own.tolist())
        raw = stack[np.arange(stack.shape[1]) < depth[:, None]].astype("<u4").tobytes()
        cuts = (np.cumsum(depth) * 4).tolist()
        return [None if k in undone else raw[a:b] for k, (a, b) in enumerate(zip([0, *cuts[:-1]], cuts, strict=True))]

    def chunks(self, text: str) -> list[str]:
        spaced = text.replace(" ", SPACE)
        return self.cut.findall(SPACE + spaced if self.model.prefix and text else spaced)

    def learn(self, texts: list[str]) -> None:
        """Encodes the new words of the texts side by side, if they are many, and remembers them."""
        memory = self.memory
        new: dict[str, None] = {}
        for text in texts:
            new.update(dict.fromkeys([c for c in self.chunks(text) if c not in memory and c not in memory.old and len(c) <= LONGEST]))
        words = [c for c in islice(new, WORDS // 4) if self.known.issuperset(c)]
        for k in range(0, len(words), MOST):
            some = words[k : k + MOST]
            if len(some) >= MANY:
                for word, ids in zip(some, self.side_by_side(some), strict=True):
                    if ids is not None:
                        memory.put(word, ids)

    def encode(self, text: str) -> bytes:
        """The ids, with begin and end, as little-endian 32-bit integers."""
        memory, parts = self.memory, []
        for chunk in self.chunks(text):
            ids = memory[chunk]
            if ids is None:
                ids = self.word(chunk)
                if len(chunk) <= LONGEST:
                    memory.put(chunk, ids)
            parts.append(ids)
        m = self.model
        return m.begin.to_bytes(4, "little") + b"".join(parts) + m.end.to_bytes(4, "little")

    def decode(self, ids: bytes) -> str:
        surface = self.model.surface
        text = b"".join([surface[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")
        return text[1:] if self.model.prefix and text.startswith(" ") else text


_encoders: dict[str, Encoder] = {}


def encoder(raw: bytes) -> Encoder:
    """One encoder for each model in a process."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _encoders:
        _encoders[key] = Encoder(raw)
    return _encoders[key]


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; with_ids adds ids (array), with_text ids and decoded (text).

    The model file is read on the driver and sent to the tasks.
    """
    with open(model_path, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(held.value)
        for part, texts in blocks(batches):
            own.learn(texts)
            ids = [own.encode(t) for t in texts]
            decoded = [own.decode(i) for i in ids]
            columns = [part.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()), pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in decoded], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids or with_text:
                columns.append(pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i in ids], pa.list_(pa.int32())))
                names.append("ids")
            if with_text:
                columns.append(pa.array(decoded, pa.string()))
                names.append("decoded")
            yield pa.record_batch(columns, names)

    more = (", ids array<int>" if with_ids or with_text else "") + (", decoded string" if with_text else "")
    return two_columns(docs, id_col, text_col).mapInArrow(run, f"doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
