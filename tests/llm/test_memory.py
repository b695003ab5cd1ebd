"""What a Python worker holds at once: numpy's part of it, which follows the texts that are taken together."""

from __future__ import annotations

import tracemalloc
from types import SimpleNamespace

import public_tokenizers
import pyarrow as pa
import pytest

from dumpsieve.llm.minhash import _set_maker, _sketcher
from dumpsieve.llm.packing import Packing, _cutter

ROWS = 4000


def _cutting():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return _cutter(SimpleNamespace(value=file.read()), Packing(), False)


@pytest.mark.parametrize(
    "make, most", [(lambda: _sketcher(5, 32), 40), (lambda: _set_maker(5), 40), (_cutting, 110)], ids=["sketches", "sets", "pieces"]
)
def test_worker_holds_few_texts_at_once(make, most):
    texts = [" ".join(f"w{(i * 31 + j * j) % 3000}" for j in range(300)) for i in range(ROWS)]
    numbers = pa.array(range(ROWS), pa.int64())
    names = ["doc_id", "row", "cid", "component", "set_key", "text"]
    batch = pa.RecordBatch.from_arrays([numbers] * 4 + [pa.array([b"x"] * ROWS), pa.array(texts)], names=names)
    assert batch.column("text").nbytes > 6e6
    run = make()
    for _ in run(iter([batch.slice(0, 1)])):  # what is kept between batches is there
        pass
    tracemalloc.start()
    try:
        for _ in run(iter([batch])):
            pass
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert peak < most
