"""Packing encodes the parts of words once, with the ids that the library gives whole texts."""

from __future__ import annotations

import json
import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from dumpsieve.llm import packing


@pytest.fixture
def vocabulary():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


def _same(texts, vocabulary, words=None):
    plain, words = Tokenizer.from_str(vocabulary), words or packing._words(vocabulary)
    ids, begin = packing.encode(pa.array(texts, pa.string()), words, 1)
    for text, a, b in zip(texts, begin[:-1], begin[1:]):
        assert ids[a:b].tolist() == [*plain.encode(text or "", add_special_tokens=False).ids, 1], repr(text)


def test_words_of_the_same_parts_are_encoded_once(vocabulary, monkeypatch):
    given = []

    class Counting:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        @classmethod
        def from_str(cls, text):
            return cls(Tokenizer.from_str(text))

        def no_truncation(self):
            self.tokenizer.no_truncation()

        def encode(self, strings, **options):
            given.extend(strings)
            return self.tokenizer.encode(strings, **options)

    stems = ["".join(random.Random(i).choice("abcdeéñ") for _ in range(8)) for i in range(100)]
    texts = [f"{s} {s.title()}, ({s}) {s.upper()}!! {s}'s" for s in stems]
    monkeypatch.setattr(packing, "Tokenizer", Counting)
    words = packing._words.__wrapped__(vocabulary)
    _same(texts, vocabulary, words)
    assert len(given) <= len(set(stems)) + 10


def test_every_character_that_is_taken_apart(vocabulary):
    found = [chr(i) for i in (*range(0x300), *range(0x300, 0x3000, 7), *range(0xFB00, 0xFB07), 0x212A, 0x1F600)]
    _same([t for c in found for t in (c, f"a{c}", f"{c}a", f"'{c}s!", f"A{c}E{c} {c}́")], vocabulary)


def test_parts_of_random_words(vocabulary):
    chance = random.Random(2)
    bits = ["'s", "'RE", "'ll", "don't", "''", "12", "½", "É", "ß", "ŉ", "Ÿ", "İ", "µ", "_", "x", "QU", "!", "<|", "|>", "endoftext", "<|ENDOFTEXT|>", "<|endoftext|>"]
    _same([None, ""] + [" ".join("".join(chance.choices(bits, k=chance.randrange(1, 6))) for _ in range(6)) for _ in range(3000)], vocabulary)


@pytest.mark.parametrize(
    "change",
    [
        {"normalizer": None}, {"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "WhitespaceSplit"}},
        {"added_tokens": [{"id": 49406, "content": "the", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}]},
        {"added_tokens": [{"id": 49406, "content": "The", "single_word": False, "lstrip": False, "rstrip": False, "normalized": True, "special": False}]},
    ],
    ids=["no normalizer", "another normalizer", "another split", "a word is a token", "a lower-cased word is a token"],
)
def test_other_vocabularies(vocabulary, change):
    steps = json.loads(vocabulary) | change
    texts = ["the other the, THE The breathe's 12", "Été ÀB a_b x's", "", "over the Theatre"]
    _same(texts, json.dumps(steps))


def test_forgets(vocabulary, monkeypatch):
    monkeypatch.setattr(packing, "_CACHED", 20)
    for k in range(5):
        _same([f"word{'abcdefgh'[i % 8]}{'klmnopqr'[k]} x中{i}" for i in range(40)], vocabulary)
