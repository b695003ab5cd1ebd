"""Encoding against the libraries, packing against its rules."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dumpsieve.llm import packing
from dumpsieve.llm.byte_bpe import encode_documents, read_ranks
from dumpsieve.llm.packing import Packing, fill, pack, pack_documents

ODD = [
    None, "", " ", "   a", "a   b", "a \n b", "x\n \ny", "it's we'll 123４ ½", "a" * 300 + " " + "thinanble" * 60,
    "é́ 😀😀 \x1c\x1d y\x85 z ", "\n\n  end  ", "<|endoftext|> x",
]


def _texts():
    chance = random.Random(1)
    return ODD + ["".join(chance.choice(" \n\t  a'sé1.!😀 bcthe") for _ in range(chance.randint(1, 60))) for _ in range(200)]


@pytest.mark.parametrize("native", [False, True])
def test_byte_bpe(docs, native):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = file.read()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(ranks), special_tokens={})
    rows = list(enumerate(_texts()))
    got = encode_documents(docs(rows), ranks, public_tokenizers.PATTERN, native=native).collect()
    assert {r.doc_id: (list(r.ids), bytes(r.decoded)) for r in got} == {
        i: (library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows
    }


def test_packing(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [(i, (t or "") * (40 if i % 3 else 1) if t is not None else None) for i, t in enumerate(_texts())]
    with open(path, encoding="utf-8") as file:
        got = pack_documents(docs(rows), file.read(), Packing(length=64, group=32, merge=4)).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), 64))
        assert [(r.length, r.ids_crc32) for r in own] == [
            (len(p), zlib.crc32(p.tobytes())) for p in (ids[s : s + 64] for s in range(0, len(ids), 64))
        ]
    for own in sequences.values():
        own = sorted(own, key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) <= 64
    assert len(sequences) <= 1.02 * sum(r.length for r in got) / 64 + 2
    assert pack_documents(docs([]), open(path, encoding="utf-8").read()).count() == 0


def test_fill_finds_full_sequences():
    sequence, _ = fill(np.array([7, 3, 6, 4, 5, 5, 10]), 10)
    assert sequence.max() + 1 == 4


@pytest.mark.parametrize("doc_id", ["id", "null"])
def test_teams_stay_bounded(spark, monkeypatch, doc_id):
    packer = packing._packer

    def bounded(*args):
        run = packer(*args)

        def checked(group):
            assert len(group) <= 160, len(group)
            return run(group)

        return checked

    monkeypatch.setattr(packing, "_packer", bounded)
    length = F.when(F.col("id") < 900, 2500).otherwise(1596).cast("long")
    rows = spark.range(0, 1200, 1, 4).select(
        F.expr(doc_id).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"),
        length.alias("length"), length.alias("ids_crc32"),
    )
    got = pack(rows, Packing(group=100)).collect()
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
    assert len(got) == 1200 and len(sequences) <= 910
    for own in sequences.values():
        assert [r.offset for r in sorted(own, key=lambda r: r.offset)] in ([0], [0, 1596], [0, 2500])
        assert sum(r.length for r in own) <= 4096


def test_many_sequences_in_a_team(spark):
    one = F.lit(1).cast("long")
    rows = spark.range(560_000).select(
        F.col("id").alias("doc_id"), F.lit(0).alias("piece"), (one - 1).alias("start"), one.alias("length"), F.col("id").alias("ids_crc32")
    )
    got = pack(rows, Packing(length=2, group=280_000)).groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert got.filter("n > 2").count() == 0 and got.count() == 280_000


def test_names_of_special_tokens_in_a_text():
    """As the plain library does without special tokens added: a name in a text is its one id, also inside a word."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        vocabulary = file.read()
    plain, words, rng = Tokenizer.from_str(vocabulary), packing._words(vocabulary), random.Random(1)
    bits = ["<|endoftext|>", "<|startoftext|>", "abc", "<|", "é", " ", "　x", "İ", "ﬁ", "'s", "12", "\n", "\x85", "<|EndOfText|>", "​", "中文", "\x1c", "ß"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 14))) for _ in range(2000)]
    ids, begin = packing.encode(pa.array(texts), words, 1)
    for text, a, b in zip(texts, begin[:-1], begin[1:]):
        assert ids[a:b].tolist() == [*plain.encode(text, add_special_tokens=False).ids, 1]
