"""Lists that are too long for one automaton."""

import random

import numpy as np
import pyarrow as pa
import pytest
from dumpsieve.operators import contained
from dumpsieve.functions.text import fold_table, lower_table
from dumpsieve.operators.contained import flag_contained
from pyspark.sql import functions as F


def flags(spark, texts, values):
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, x string")
    items = spark.createDataFrame([(v,) for v in values], "item string")
    got = flag_contained(rows, F.col("x"), items).collect()
    assert sorted(r.n for r in got) == list(range(len(texts)))
    return [bool(r.matched) for r in sorted(got)]


@pytest.mark.parametrize("window", [contained._WINDOW, 5])
def test_like_brute_force(spark, monkeypatch, window):
    monkeypatch.setattr(contained, "_WINDOW", window)
    draw = random.Random(3)
    text = lambda n: "".join(draw.choices("abcÄ𝒳 ", k=n))
    texts = [text(draw.randrange(60)) for _ in range(300)] + [None, "", "abc", "ABC"]
    values = [text(draw.randrange(1, 14)) for _ in range(60)] + ["a" * 30, "a" * 31]
    values = [v for v in values if len(v) > 2]
    want = [t is not None and any(v.lower() in t.lower() for v in values) for t in texts]
    assert 20 < sum(want) < len(texts) - 20 and min(map(len, values)) < contained.GRAM < max(map(len, values))
    assert flags(spark, texts, values) == want


def test_odd_lists(spark):
    assert flags(spark, ["x", "", None], []) == [False, False, False]
    assert flags(spark, ["x", "", None], ["", None]) == [False, False, False]
    assert flags(spark, ["xa", "b", "", None, "a"], ["A", "a", "A"]) == [True, False, False, False, True]
    # A value at the very end, one longer than the text, one across two texts, a long text.
    long = "word " * 300_000 + "at the end"
    assert flags(spark, ["12345678", "9abc", long], ["123456789", "89abc", "t the end"]) == [False, False, True]


def test_one_run_in_all_lines(spark):
    texts = [f"the same beginning of all lines {i % 7}" for i in range(2000)]
    values = [f"same beginning of all lines {i}" for i in (3, 5)]
    assert sum(flags(spark, texts, values)) == sum(i % 7 in (3, 5) for i in range(2000))


def test_lines_of_the_same_words_are_told_apart():
    # All counters are equal, as those of a very long list are nearly.
    class Full:
        value = np.ones(contained.COUNTERS, np.int64)

    draw = random.Random(3)
    words = [f"{i:07d}" for i in range(20)]
    lines = [" ".join(draw.choices(words, k=40)) for _ in range(200)]
    (filed,) = contained._filer(Full)([pa.RecordBatch.from_arrays([pa.array(lines)], names=["low"])])
    assert len(set(filed["gram"].to_pylist())) > 100


def test_a_task_counts_its_runs_once():
    # What is sent on is bounded by the counters, not by the number of batches.
    lines = [pa.RecordBatch.from_arrays([pa.array([f"the line of number {i}", "", "short"])], names=["low"]) for i in range(50)]
    (counted,) = contained._count_runs(iter(lines))
    counts = dict(zip(counted["counter"].to_pylist(), counted["n"].to_pylist()))
    assert len(counts) == counted.num_rows and max(counts.values()) == 50
    assert sum(counts.values()) == sum(len(f"the line of number {i}") - contained.GRAM + 1 for i in range(50)) + 50


def test_bits_are_set_once_for_all_rows_of_a_task():
    # What is sent on is bounded by the bitmap, not by the runs of the index.
    draw = np.random.default_rng(7)
    grams = draw.integers(-(1 << 62), 1 << 62, 40_000)
    batches = [pa.RecordBatch.from_arrays([pa.array(np.full(len(g), 16, np.int32)), pa.array(g)], names=["width", "gram"]) for g in np.split(grams, 8)]
    sent = list(contained._bit_setter({16: 1 << 20})(iter(batches)))
    assert sum(b.num_rows for b in sent) == 32
    whole = np.unpackbits(np.frombuffer(b"".join(p for b in sent for p in b["bits"].to_pylist()), np.uint8), bitorder="little")
    want = np.unique(np.concatenate([contained._places(grams, 1 << 20, which) for which in range(contained.PLACES)]))
    assert np.flatnonzero(whole).tolist() == want.tolist()


def test_folded_like_the_tables():
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x1F200)]))
    for folds in (fold_table(), lower_table()):
        assert contained._folded(["", text, "K"], contained._table(folds)) == ["", text.translate(folds), "k"]


def test_values_of_one_run_share_no_text(spark):
    # All values are filed under the same run; each text is compared with all of them and holds its own, or nearly.
    values = [f"{i:05d} the beginning of all the lines" for i in range(200)]
    texts = [v.upper() + "!" for v in values] + [v.replace("lines", "line") for v in values]
    assert flags(spark, texts, values * 2) == [True] * 200 + [False] * 200


def test_a_full_bitmap_lets_few_runs_pass(spark, monkeypatch):
    # Half of the list are short values, whose bits are no concern of the longer ones.
    monkeypatch.setattr(contained, "BITS", 1 << 17)
    draw = random.Random(4)
    text = lambda n: "".join(draw.choices("abcdefghijklmnop", k=n))
    values = [text(n) for n in (8, 16) for _ in range(6_000)]

    class Full:
        value = np.ones(contained.COUNTERS, np.int64)

    filed = contained._filer(Full)([pa.RecordBatch.from_arrays([pa.array(values)], names=["low"])])
    index = spark.createDataFrame(pa.Table.from_batches(filed))
    rows = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([text(200_000)])], names=["row", "low"])
    passed = sum(found.num_rows for found in contained._finder(contained._bitmap(index), [8, 16])([rows]))
    assert passed < 0.005 * 2 * 200_000
