import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sigdiff.llm.pieces import Encoder, encode_decode
from tests.llm.helpers import awkward, none

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
with open(PATH, "rb") as f:
    OURS = Encoder(f.read())

odd = st.sampled_from([" ", "  ", "▁", "\n", "\t", "\0", "the ", "tion", "<s>", "<0x41>", "x" * 40, "é", "é", "😀", "中文", "​", "⁇", "====", "----", "2024", "İ", "    "])
texts = st.one_of(st.text(max_size=60), st.lists(st.one_of(odd, st.text(alphabet="aeinorst .,'▁", max_size=12)), max_size=20).map("".join))


@settings(max_examples=1500, deadline=None)
@given(texts)
def test_same_as_library(text):
    ids = LIBRARY.encode(text, add_bos=True, add_eos=True)
    ours = OURS.encode(text)
    assert np.frombuffer(ours, "<u4").tolist() == ids
    assert OURS.decode(ours) == LIBRARY.decode(ids)


def test_backtracking_is_needed_and_right():
    # the longest match first is not the merge result for some of these
    for text in ("thaththth", "ingingly", "nderereronst", "aaaaaaaaaaaaaaaaaaaaaaa", "onononononon", "eaueauxeau"):
        assert OURS.search("▁" + text) == LIBRARY.encode(text)


def test_long_word():
    text = "thereonanderingtion" * 3000
    assert np.frombuffer(OURS.encode(text), "<u4").tolist() == LIBRARY.encode(text, add_bos=True, add_eos=True)


def test_operator(spark):
    got = encode_decode(awkward(spark), PATH, with_text=True).collect()
    assert len(got) == 10
    for row, text in zip(got, [r.text or "" for r in awkward(spark).collect()], strict=True):
        ids = LIBRARY.encode(text, add_bos=True, add_eos=True)
        assert (row.n_tokens, row.ids, row.decoded) == (len(ids), ids, LIBRARY.decode(ids))
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(row.decoded.encode()).hexdigest()
    assert encode_decode(none(spark), PATH).count() == 0


def test_remembered_words_and_pairs_stay_few_and_frequent_ones_stay(monkeypatch):
    monkeypatch.setattr("sigdiff.llm.pieces.WORDS", 20)
    monkeypatch.setattr("sigdiff.llm.pieces.PAIRS", 8)  # so that pairs share places
    with open(PATH, "rb") as f:
        small = Encoder(f.read())
    asked = []
    monkeypatch.setattr(small, "word", lambda text, word=small.word: asked.append(text) or word(text))
    for k in range(200):
        text = f"often rare{k}ingly"
        assert np.frombuffer(small.encode(text), "<u4").tolist() == LIBRARY.encode(text, add_bos=True, add_eos=True)
        assert len(small.memory) + len(small.memory.old) <= 20
    assert asked.count("▁often") == 1
    assert len(small.fits) == 8


def test_ids_without_text(spark):
    both, ids = encode_decode(awkward(spark), PATH, with_text=True), encode_decode(awkward(spark), PATH, with_ids=True)
    assert ids.columns == [c for c in both.columns if c != "decoded"]
    assert sorted(map(str, ids.collect())) == sorted(map(str, both.drop("decoded").collect()))


def made_words(n, seed=0):
    rng = np.random.default_rng(seed)
    parts = ["th", "er", "on", "ing", "ed", "ou", "x", "é", "ß", "ntth", "tion", "z", "ht", "*", "$", "20", "ieux", "\n", "中", "a", "ight"]
    return ["".join(rng.choice(parts, int(rng.integers(1, 12)))) for _ in range(n)]


def test_side_by_side_equals_library(monkeypatch):
    words = sorted({"▁" + w for w in made_words(3000)})
    words = [w for w in words if OURS.known.issuperset(w)]
    for left in (0, 20):
        monkeypatch.setattr("sigdiff.llm.pieces.LEFT", left)
        got = OURS.side_by_side(words)
        assert sum(x is None for x in got) <= left
        for word, ids in zip(words, got, strict=True):
            assert ids is None or np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode(word[1:])


def test_new_words_of_a_block_are_not_searched_one_by_one(monkeypatch):
    with open(PATH, "rb") as f:
        own = Encoder(f.read())
    asked = []
    monkeypatch.setattr(own, "word", lambda text, word=own.word: asked.append(text) or word(text))
    for seed in range(3):
        texts = [" ".join(made_words(50, 100 * seed + k)) + " 😀\u0600 " + "on" * 60 for k in range(40)] + ["", "a"]
        own.learn(texts)
        for text in texts:
            ids = LIBRARY.encode(text, add_bos=True, add_eos=True)
            assert np.frombuffer(own.encode(text), "<u4").tolist() == ids
    new = [w for w in asked if own.known.issuperset(w) and len(w) <= 48]
    assert len(new) <= 3 * 20  # of about 5,000
