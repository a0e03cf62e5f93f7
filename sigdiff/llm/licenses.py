"""License scans: an exact set-similarity join of text blocks with license notices.

Blocks of a text are its windows of 2 n words that start at every n-th word, for each number n of words that a notice has, so whatever
stands within n + 1 words lies in one block. A block meets a notice if it holds at least CONTAINMENT of the notice's distinct words.

The distinct words of the notices are ordered by how often the whole table has them, rarest first. With a words of a notice
of m to be met, one of its first m - a + 1 is in the block (prefix filter), among the first b - a + 1 of the block's b words that
any notice has, and b is at least a (length filter); a common word at places i and j leaves at most min(m - i, b - j) further ones (positional
filter). What passes is counted in full, so the result is the same as without filters. Other words of the text are in no notice and never count.

Where overlapping blocks meet notices of one family (the Creative Commons ones differ in a word or two), the notice met by the greater share
counts, then the longer, then the first listed one.

Phrases are found apart from that, word by word. Words are runs of ASCII letters in any case, digits and whatever is not ASCII.
Null and empty texts have no words and no licenses. Repeated rows get equal results. Texts are read whole: long ones in parts
that end at white space; a worker keeps the places of the notices' words of one text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigdiff.llm.common import BLOCK_CHARS, Words, blocks, cut, two_columns

#: Share of a notice's distinct words that a block has to hold.
CONTAINMENT = 0.85

#: Phrases and their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: Label, family and words of well-known license notices.
NOTICES = [
    ("mit", "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl-3", "gnu", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2", "gnu", "this work is licensed under the gnu general public license version 2"),
    ("gpl-3", "gnu", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-2", "gnu", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license"),
    ("lgpl", "gnu", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl-3", "gnu", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license"),
    ("bsd", "bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "cc", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "cc", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "cc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc0", "cc", "the author has waived all copyright and related or neighboring rights to this work to the extent possible under law"),
    ("unlicense", "unlicense", "this is free and unencumbered software released into the public domain"),
    ("reserved", "reserved", "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form without prior written permission"),
]

_WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
_GAP = np.zeros(256, bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _GAP[_low : _high + 1] = True

PLACES = "doc_id long, n_words long, base array<struct<label:string,start:bigint>>, found array<struct<notice:int,label:string,start:bigint,share:double>>"


def words_of(text: str) -> list[str]:
    return _WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))


class Vocabulary:
    """The words of notices and phrases, in a given order."""

    def __init__(self, words: list[str]):
        self.words = words
        known = Words([" ".join(words)])
        self.order = np.argsort(known.hash)
        self.hash = known.hash[self.order]
        raw = [w.encode() for w in words]
        self.length = np.array([len(w) for w in raw])
        self.letters = np.zeros((len(raw), int(self.length.max(initial=0))), np.uint8)
        for k, w in enumerate(raw):
            self.letters[k, : len(w)] = list(w)

    def places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of words of each text; text, place and rank in this vocabulary of each word that is in it, by text and place."""
        n = np.zeros(len(texts), np.int64)
        found: list[tuple[np.ndarray, ...]] = []
        part: list[tuple[int, str]] = []
        size = 0

        def flush() -> None:
            owner = np.array([k for k, _ in part])
            w = Words([t for _, t in part], _GAP)
            # several parts of one text follow each other
            before = np.cumsum(np.concatenate(([0], w.n)))[:-1]
            own = owner[w.doc]
            head = np.searchsorted(owner, np.arange(len(texts)))
            place = n[own] + np.arange(len(w.doc)) - before[np.minimum(head[own], len(part) - 1)]
            np.add.at(n, owner, w.n)
            at = np.minimum(np.searchsorted(self.hash, w.hash), len(self.hash) - 1)
            hit = np.flatnonzero(self.hash[at] == w.hash) if len(self.hash) else at[:0]
            rank = self.order[at[hit]]
            # hashes are held against the letters
            start, same = w.start[hit], w.end[hit] - w.start[hit] == self.length[rank]
            for j in range(self.letters.shape[1]):
                c = w.raw[np.minimum(start + j, len(w.raw) - 1)] if len(w.raw) else start
                c = np.where((c >= 65) & (c <= 90), c + 32, c)
                same &= (j >= self.length[rank]) | (c == self.letters[rank, j])
            found.append((own[hit[same]], place[hit[same]], rank[same]))

        for k, text in enumerate(texts):
            for piece in cut(text, BLOCK_CHARS) if len(text) > BLOCK_CHARS else [text]:
                if part and size + len(piece) > BLOCK_CHARS:
                    flush()
                    part, size = [], 0
                part.append((k, piece))
                size += len(piece)
        if part:
            flush()
        empty = (np.zeros(0, np.int64),) * 3
        return n, *(np.concatenate(x) for x in zip(*(found or [empty]), strict=True))


@dataclass
class Index:
    """Notices by their number of words, and for each the words of their prefixes."""

    vocabulary: Vocabulary
    notices: list[tuple[str, str, list[int], int]] = field(default_factory=list)  # label, family, ascending ranks, number of words
    needed: list[int] = field(default_factory=list)
    prefixes: dict[int, dict[int, list[tuple[int, int]]]] = field(default_factory=dict)  # words of a notice -> rank -> (notice, place in it)

    @classmethod
    def of(cls, vocabulary: Vocabulary, notices: list[tuple[str, str, str]], containment: float) -> Index:
        rank = {w: k for k, w in enumerate(vocabulary.words)}
        out = cls(vocabulary)
        for k, (label, family, text) in enumerate(notices):
            words = words_of(text)
            ranks = sorted({rank[w] for w in words})
            need = max(1, math.ceil(containment * len(ranks) - 1e-9))
            out.notices.append((label, family, ranks, len(words)))
            out.needed.append(need)
            for place, r in enumerate(ranks[: len(ranks) - need + 1]):
                out.prefixes.setdefault(len(words), {}).setdefault(r, []).append((k, place))
        return out

    def join(self, doc: np.ndarray, place: np.ndarray, rank: np.ndarray, n_words: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(doc, notice, first word of the block, share) of every block that meets a notice."""
        out = []
        for n, prefix in self.prefixes.items():
            first = np.concatenate(([0], np.cumsum(n_words // n + 1)))
            own = first[doc] + place // n
            later = place >= n
            block, r = np.concatenate((own, own[later] - 1)), np.concatenate((rank, rank[later]))
            key = np.unique(block * len(self.vocabulary.words) + r)
            block, r = np.divmod(key, len(self.vocabulary.words))
            head = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(block) else np.zeros(0, np.int64)
            stop = np.append(head[1:], len(block))
            rare = np.zeros(len(self.vocabulary.words) + 1, bool)
            rare[list(prefix)] = True
            least = min(self.needed[k] for own_list in prefix.values() for k, _ in own_list)
            some = np.add.reduceat(rare[r], head) if len(head) else np.zeros(0, int)
            for h in np.flatnonzero((some > 0) & (stop - head >= least)).tolist():
                tokens = r[head[h] : stop[h]].tolist()
                for k in self._candidates(tokens, prefix):
                    ranks = self.notices[k][2]
                    common = len(set(ranks).intersection(tokens))
                    if common >= self.needed[k]:
                        d = int(np.searchsorted(first, block[head[h]], side="right")) - 1
                        out.append((d, k, int(block[head[h]] - first[d]) * n, common / len(ranks)))
        return out

    def _candidates(self, tokens: list[int], prefix: dict[int, list[tuple[int, int]]]) -> list[int]:
        seen: dict[int, int] = {}
        for j, token in enumerate(tokens):
            for k, i in prefix.get(token, ()):
                need, have = self.needed[k], seen.get(k, 0)
                if j <= len(tokens) - need and have >= 0 or have > 0:
                    rest = min(len(self.notices[k][2]) - i, len(tokens) - j)
                    seen[k] = have + 1 if have + rest >= need else -1
        return [k for k, have in seen.items() if have > 0]

    def best(self, found: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
        """Of a text's (notice, start, share), by start: those without a better one of the same family in an overlapping block."""
        size = lambda k: 2 * self.notices[k][3]
        reach = max((size(k) for k, _, _ in found), default=0)
        good = lambda x: (x[2], len(self.notices[x[0]][2]), -x[0])
        out = []
        for at, x in enumerate(found):
            near = []
            for step in (-1, 1):
                other = at + step
                while 0 <= other < len(found) and (x[1] - found[other][1] < reach if step < 0 else found[other][1] < x[1] + size(x[0])):
                    near.append(found[other])
                    other += step
            label, family = self.notices[x[0]][:2]
            if not any(self.notices[y[0]][1] == family and self.notices[y[0]][0] != label and y[1] < x[1] + size(x[0]) and x[1] < y[1] + size(y[0]) and good(y) > good(x) for y in near):
                out.append(x)
        return out


def word_counts(docs: DataFrame, words: list[str], id_col: str = "doc_id", text_col: str = "text") -> dict[str, int]:
    """How often the words occur in all texts. A row a word comes to the driver."""
    known = Vocabulary(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(words), np.int64)
        for _, texts in blocks(batches):
            total += np.bincount(known.places(texts)[3], minlength=len(words))
        yield pa.record_batch([pa.array(np.arange(len(words))), pa.array(total)], ["word", "n"])

    found = two_columns(docs, id_col, text_col).select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {words[r["word"]]: r["n"] for r in found}


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: list[tuple[str, str, str]] = NOTICES, phrases: list[tuple[str, str]] = PHRASES, containment: float = CONTAINMENT) -> DataFrame:
    """For each row of docs: doc_id, n_words, base (label and first word of each place of a phrase) and found (number of the notice, its label, the block's first word, the share of
    the notice in it), both by place. Words count from 0.

    notices and phrases are lists that the driver holds and each task gets; docs is read once for counts and once for the places, and not shuffled.
    """
    words = sorted({w for *_, text in notices for w in words_of(text)} | {w for text, _ in phrases for w in words_of(text)})
    counts = word_counts(docs, words, id_col, text_col) if words else {}
    index = Index.of(Vocabulary(sorted(words, key=lambda w: (counts.get(w, 0), w))), notices, containment)
    rank = {w: k for k, w in enumerate(index.vocabulary.words)}
    sequences = [([rank[w] for w in words_of(text)], label) for text, label in phrases]
    names = [c.split()[0] for c in ("doc_id", "n_words", "base", "found")]
    base_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
    found_type = pa.list_(pa.struct([("notice", pa.int32()), ("label", pa.string()), ("start", pa.int64()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches):
            n, doc, place, r = index.vocabulary.places(texts)
            base: list[list[tuple[int, int, str]]] = [[] for _ in texts]
            for number, (sequence, label) in enumerate(sequences):
                at = np.flatnonzero(r[: max(0, len(r) - len(sequence) + 1)] == sequence[0])
                for j, want in enumerate(sequence[1:], 1):
                    at = at[(r[at + j] == want) & (doc[at + j] == doc[at]) & (place[at + j] == place[at] + j)]
                for k in at.tolist():
                    base[doc[k]].append((int(place[k]), number, label))
            found: list[list[tuple[int, int, float]]] = [[] for _ in texts]
            for d, k, start, share in index.join(doc, place, r, n):
                found[d].append((k, start, share))
            rows = [index.best(sorted(own, key=lambda x: (x[1], x[0]))) for own in found]
            yield pa.record_batch(
                [
                    part.column("doc_id"),
                    pa.array(n),
                    pa.array([[{"label": label, "start": s} for s, _, label in sorted(own)] for own in base], base_type),
                    pa.array([[{"notice": k, "label": index.notices[k][0], "start": s, "share": share} for k, s, share in own] for own in rows], found_type),
                ],
                names,
            )

    return two_columns(docs, id_col, text_col).mapInArrow(run, PLACES)


def license_labels(base: bool) -> Column:
    """Distinct labels of the phrases, or of phrases and notices, sorted and joined by commas."""
    own = F.transform("base", lambda x: x["label"])
    every = own if base else F.concat(own, F.transform("found", lambda x: x["label"]))
    return F.array_join(F.array_sort(F.array_distinct(every)), ",")


def license_score() -> Column:
    """1 with a phrase, else the greatest share of a notice that was found, 0 without any."""
    return F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0)))
