from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from cases import DOCS, documents, ordered, plain
from hypothesis import given, settings
from hypothesis import strategies as st

from tablewright.llm import sentencepiece_bpe
from tablewright.llm.queries import tokenizer_path

VOCABULARY = sentencepiece_bpe.Vocabulary.load(tokenizer_path())
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())


def same(texts):
    ours = VOCABULARY.encode(texts)
    theirs = LIBRARY.encode(texts, add_bos=True, add_eos=True, num_threads=1)
    assert [ids.tolist() for ids in ours] == theirs
    assert [VOCABULARY.decode(ids) for ids in ours] == LIBRARY.decode(theirs)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aabehint \n\t▁é日😀\x00.,==--"), max_size=50), min_size=1, max_size=8))
def test_like_the_library(texts):
    same(texts)


def test_long_words_and_blanks():
    random.seed(0)
    same([" " * 700 + "x", "a" * 1500, "ab" * 900, "the" * 500 + " " * 40, "=-" * 700, "".join(random.choices("abcdeth", k=3000))])
    same(["-" * k + " " * k + "=" * k for k in range(60)])


def test_texts_without_blanks():
    random.seed(1)
    draw = lambda alphabet: "".join(random.choices(alphabet, k=20_000))
    same([draw("etaoinshrdlu"), draw("ABCDEFabcdef0123456789+/"), draw("日本語中文字的是不了人我在有他这"), draw("abcdefghijklmnopqrstuvwxyz")])
    same([draw("a="), "https://" + draw("abc/?&=%20-_."), draw("привет мирдело"), "\U00010348é" * 9000])


def test_kept_words_are_bounded(monkeypatch):
    monkeypatch.setattr(sentencepiece_bpe, "KEPT_BYTES", 4000)
    known = sentencepiece_bpe.Kept()
    for i in range(50):
        texts = [f"word{i} other{i} " + "long" * 100, "same words"]
        found = VOCABULARY.encode_bytes(texts, known)
        assert [np.frombuffer(ids, "<u4").tolist() for ids in found] == LIBRARY.encode(texts, add_bos=True, add_eos=True)
        assert known.size < 6000 and max(map(len, known)) <= sentencepiece_bpe.LONGEST_KEPT


def test_whole_table(spark):
    found = sentencepiece_bpe.digests(sentencepiece_bpe.encode_and_decode(documents(spark), tokenizer_path()))
    expected = []
    for doc_id, text, *_ in DOCS:
        ids = LIBRARY.encode(text or "", add_bos=True, add_eos=True)
        decoded = LIBRARY.decode(ids)
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        expected.append((doc_id, len(ids), digest, hashlib.sha256(decoded.encode()).hexdigest()))
    assert plain(found, *found.columns) == ordered(expected)


def test_empty_table(spark):
    assert sentencepiece_bpe.encode_and_decode(documents(spark, []), tokenizer_path()).count() == 0


def test_other_models_are_refused(monkeypatch):
    monkeypatch.setattr(sentencepiece_bpe.Vocabulary, "decode", lambda self, ids: "?")
    with pytest.raises(ValueError):
        sentencepiece_bpe.Vocabulary.load(tokenizer_path())
