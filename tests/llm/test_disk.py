"""What near-dedup moves and leaves: its own tables go when nothing reads them any more."""

from __future__ import annotations

import os
import random
import uuid

from pyspark.sql import functions as F

from dumpsieve.llm import minhash, shared
from dumpsieve.llm.minhash import MinHash, near_duplicates
from dumpsieve.sources import scan


def _rows(copies=1):
    """Texts of a group with common parts, so that there is something to prove in each search."""
    chance = random.Random(3)
    base = [f"w{chance.randrange(400)}" for _ in range(60)]
    rows = []
    for i in range(120):
        text = list(base)
        for _ in range(chance.randrange(0, 12)):
            text[chance.randrange(60)] = f"own{i}x{chance.randrange(9)}"
        rows += [(i, " ".join(text))] * copies
    return rows + [(500, None), (501, ""), (502, "one")]


def test_tables_go_when_nothing_reads_them(docs, tmp_path, monkeypatch):
    for module in (scan, shared):
        monkeypatch.setattr(module, "shared_folder", lambda spark, name: f"{tmp_path}/{name}-{uuid.uuid4().hex}")
    found = near_duplicates(docs(_rows()), MinHash(shingle=2)).collect()
    assert len(found) == 123 and sum(not r.kept for r in found) > 20
    left = {name.rsplit("-", 1)[0] for name in os.listdir(tmp_path)}
    assert "classes" in left
    assert not left & {"sketches", "index", "sets", "prefixes", "shared", "members", "lists", "hubs", "mixed", "run"}


def test_sets_move_again_only_if_some_come_twice(spark, docs, tmp_path):
    for copies, moved in ((1, False), (3, True)):
        texts = docs(_rows(copies)).select("doc_id", "text")
        drawn = minhash.sketches(texts, MinHash(shingle=2)).filter("n > 0")
        classes = drawn.groupBy("set_key").agg(F.min("doc_id").alias("doc")).withColumn("cid", F.monotonically_increasing_id())
        asked = minhash.stored(classes.withColumn("component", F.col("cid")), "asked")
        folder = str(tmp_path / f"c{copies}")
        sets = minhash._sets(asked, texts, MinHash(shingle=2), folder)
        assert sets.count() == sets.select("cid").distinct().count() == asked.count()
        assert os.path.exists(f"{folder}/sets_once") == moved
        first = sets.join(classes.select("set_key", "doc"), F.lit(False), "left").first()
        assert first.n == len(first.members) // 8 and len(first.sketch) == min(first.n, 32)
