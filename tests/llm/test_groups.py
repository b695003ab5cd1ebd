"""Sharding, the trie of conversations and the filter audit against brute force."""

import hashlib
import itertools
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dumpsieve.llm import audit, sharding, trie
from dumpsieve.llm.scan import MODULUS, grouped_scan, join_counted, powers

# ---------------------------------------------------------------- running values


def test_running_values_of_groups_that_fill_many_tasks(spark):
    rng = random.Random(3)
    rows = [(g, i, rng.randrange(MODULUS)) for i, g in enumerate([7] * 300 + [1] * 5 + [9] + [8] * 60 + [2] * 3)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "g long, o long, v long").withColumn("t", F.col("v")).repartition(5)
    got = grouped_scan(frame, "g", ["o"], sums=["v"], products={"t": 12345}).collect()
    assert len(got) == len(rows)
    state = defaultdict(lambda: (0, 0, 0))
    for r in sorted(got, key=lambda r: (r.g, r.o)):
        n, total, product = state[r.g]
        assert (r.idx, r.v_before, r.v_upto, r.t_before) == (n, total, total + r.v, product)
        product = (product + r.v * pow(12345, n, MODULUS)) % MODULUS
        assert r.t_upto == product
        state[r.g] = (n + 1, total + r.v, product)
    assert grouped_scan(frame.limit(0), "g", ["o"], sums=["v"]).isEmpty()


def test_powers():
    assert powers(3, np.array([0, 1, 5, 40, 10**9])).tolist() == [pow(3, e, MODULUS) for e in (0, 1, 5, 40, 10**9)]


def test_join_with_keys_that_hold_most_rows(spark):
    rows = spark.range(0, 6000, 1, 6).select((F.when(F.col("id") < 2000, 0).otherwise(F.col("id"))).alias("k"), "id")
    keyed = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least")).filter("k % 3 <> 1")
    got = join_counted(rows, keyed, ["k"], "n", 6000).select("k", "id", "least")
    want = rows.join(keyed, "k").select("k", "id", "least")
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
    assert join_counted(rows, keyed, ["k"], "n", 6000, "left").count() == 6000


# ---------------------------------------------------------------- sharding


def _texts(n):
    return [(i, ["", None, "é" * (i % 50), "x" * (i * 7 % 400)][i % 4]) for i in range(n)]


def _ring_by_hand(keys, shards, nodes, law):
    """Round by round, key by key: all keys that have gone as far, in the order of the ring, try their next place."""
    places, owner = sharding.ring(shards, nodes)
    total = sum(w for *_, w in keys)
    room = sharding.capacities(total, shards, law).tolist()
    waiting = [(*k, int(np.searchsorted(places, k[0]))) for k in sorted(keys)]
    out = {}
    while waiting:
        refused = []
        for place, row, weight, node in waiting:
            s = owner[node % len(owner)]
            if room[s] >= weight:
                room[s] -= weight
                out[row] = int(s)
            else:
                refused.append((place, row, weight, node + 1))
        waiting = refused
    return out


@pytest.mark.parametrize("nodes", [1, 40])
def test_rows_go_where_the_ring_sends_them(spark, docs, nodes):
    rows = _texts(200) + [(None, "n")] * 30 + [(5, "again")] * 90
    frame = docs(rows).coalesce(1)
    got = sharding.shard_documents(frame, 7, "rows", nodes).collect()
    keyed = frame.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "text", F.shiftrightunsigned(F.xxhash64("doc_id"), 1).alias("p")
    ).collect()
    want = _ring_by_hand([(r.p, r.row, 1) for r in keyed], 7, nodes, "rows")
    count = lambda rows: sorted(rows, key=repr)
    assert count((r.doc_id, r.size, r.text_crc32, r.shard) for r in got) == count(
        (r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode()), want[r.row]) for r in keyed
    )
    assert {r.law for r in got} == {"rows"} and all(r.grown_shard is None for r in got)
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    assert max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1


def test_shares_of_bytes_are_near_equal(spark, docs):
    rows = [(i, "x" * (i % 97)) for i in range(4000)]
    got = sharding.shard_documents(docs(rows), 8, "bytes", 64).groupBy("shard").agg(F.sum("size").alias("n"), F.count("*").alias("c"), F.max("slot").alias("m")).collect()
    assert len(got) == 8 and all(r.m == r.c - 1 for r in got)
    mean = sum(r.n for r in got) / 8
    assert max(abs(r.n - mean) for r in got) < 0.01 * mean


def test_by_key_a_new_shard_takes_rows_only_into_itself(spark, docs):
    small, large = (sharding.shard_documents(docs(_texts(n)), 6, "key", 32) for n in (100, 300))
    at = {r.doc_id: r.shard for r in large.collect()}
    assert all(at[r.doc_id] == r.shard for r in small.collect())  # the other rows do not matter
    assert all(r.grown_shard in (r.shard, 6) for r in large.collect())
    grown = {r.doc_id: r.shard for r in sharding.shard_documents(docs(_texts(300)), 7, "key", 32).collect()}
    assert all(grown[r.doc_id] == r.grown_shard for r in large.collect())


def test_one_more_shard_moves_few_rows(spark, docs):
    """Balance is exact in both; a remainder of the id would move 24 of 25 rows."""
    frame = docs([(i, "") for i in range(20_000)])
    a = sharding.shard_documents(frame, 24).select("doc_id", F.col("shard").alias("a"))
    b = sharding.shard_documents(frame, 25).select("doc_id", F.col("shard").alias("b"))
    assert a.join(b, "doc_id").filter("a <> b").count() < 0.12 * 20_000


def test_sharding_of_odd_tables(spark, docs):
    assert sharding.shard_documents(docs([]), 24).isEmpty()
    (one,) = sharding.shard_documents(docs([(None, None)]), 24).collect()
    assert (one.doc_id, one.size, one.text_crc32, one.slot) == (None, 8, 0, 0)
    (long,) = sharding.shard_documents(docs([(1, "ö" * 3_000_000)]), 2, "bytes").collect()
    assert (long.size, long.slot) == (6_000_008, 0)
    clash = docs(_texts(9)).withColumn("place", F.lit("p")).withColumn("row", F.lit(1)).withColumn("weight", F.lit(None))
    assert sharding.shard_documents(clash, 3).count() == 9
    for bad in (dict(law="x"), dict(shards=0)):
        with pytest.raises(ValueError):
            sharding.shard_documents(docs([]), **bad)


# ---------------------------------------------------------------- trie


def _trie_by_hand(rows):
    own = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        if conv is not None:
            own[conv].append((role or "", text or ""))
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))  # as in SQL, towards zero
        built[c] = own[c] if base == c else own.get(base, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    out = []
    for node, convs in members.items():
        below = [m for m in members if m[: len(node)] == node]
        leaves = [m for m in below if not any(len(k) == len(m) + 1 and k[: len(m)] == m for k in members)]
        saved = sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below if m)
        ends = ",".join(str(c) for c in convs if len(built[c]) == len(node))
        children = [m for m in below if len(m) == len(node) + 1]
        parent = members[node[:-1]][0] if node else None
        out.append((convs[0], len(node), parent, len(convs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def _found(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "c", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, n int")
    got = trie.trie_report(trie.prefix_trie(frame.repartition(3), **options))
    assert [f.dataType.simpleString() for f in got.schema.fields] == ["bigint"] * 7 + ["string"]
    return sorted(map(tuple, got.collect()), key=repr)


def _conversations():
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 40), 95, 101, 102, 103, -7, -5]:
        for t in range(rng.randrange(1, 14)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "é" * 3])))
    for c in range(200, 260):  # one common conversation
        rows += [(c, t, "user", f"same {t}") for t in range(10)]
    rows += [(300, t, "user", str(t % 2)) for t in range(150)]  # a long one, also as a base
    rows += [(301, t, "user", str(t)) for t in range(150)]
    rows += [(None, 1, "user", "nobody's"), (40, None, "user", "first"), (40, -1, "user", "second"), (41, 1, "x", "y")]
    rows += [(45, 1, "user", "twice"), (45, 1, "user", "twice"), (46, 1, "user", "twice")]
    return rows


def test_trie_equals_rebuilt_conversations(spark):
    rows = _conversations()
    assert _found(spark, rows) == _trie_by_hand(rows)


def test_fingerprints_that_collide_are_found_out(spark):
    rows = [(c, t, "user", f"{c * t % 11}") for c in range(30) for t in range(5)]
    assert _found(spark, rows, bits=2) == _trie_by_hand(rows)


@pytest.mark.parametrize("rows", [
    [], [(None, 0, "user", "x")], [(5, None, None, None)], [(6, 0, "user", "only")], [(6, t, "u", "t" * 100_000) for t in range(9)],
])
def test_trie_of_odd_tables(spark, rows):
    assert _found(spark, rows) == _trie_by_hand(rows) if any(r[0] is not None for r in rows) else _found(spark, rows) == []


def test_a_node_refers_to_its_last_turn(spark):
    rows = [(5, 0, "user", "a"), (5, 1, "user", "b"), (8, 0, "user", "z")]
    found = trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    met = found.nodes.join(found.turns, F.col("turn_ref") == F.col("row")).select("conv_id", "depth", "text")
    assert {(r.conv_id, r.depth): r.text for r in met.collect()}[(5, 2)] == "b"


# ---------------------------------------------------------------- filter audit

SORTED = st.lists(st.integers(0, 4000), max_size=900, unique=True).map(lambda x: np.array(sorted(x), np.int64))


@settings(max_examples=60, deadline=None)
@given(SORTED, SORTED, SORTED)
def test_posting_lists(a, b, c):
    assert audit.gallop(a, b).tolist() == np.searchsorted(b, a).tolist()
    assert audit.difference(a, b).tolist() == sorted(set(a.tolist()) - set(b.tolist()))
    assert audit.union([a, b, c]).tolist() == sorted({*a.tolist(), *b.tolist(), *c.tolist()})


def _audit_by_hand(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    docs = []
    for i, text, lang in rows:
        t = text or ""
        words = [w for w in "".join(" " if c in " \t\n\x0b\f\r" else c for c in t).split(" ") if w]
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        fails = "".join(f for f, x in zip("ABCDE", (
            len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * sum("A" <= x <= "Z" for x in t) > 10 * len(t),
            any(x in "#$%&*|" for x in t), copy)) if x)
        docs.append((lang or "", fails, i in good, i in toxic))
    out = []
    for part in {d[0] for d in docs}:
        own, shapley, lines = [d for d in docs if d[0] == part], defaultdict(int), []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                failing = [d for d in own if f in d[1]]
                shapley[f] += len(gone)
                lines.append((part, order, k + 1, len(left), len(gone), len(failing) - len(gone), sum(d[1] == f for d in own),
                              sum(d[2] for d in gone), sum(d[3] for d in gone), f))
        out += [(*x[:-1], shapley[x[-1]]) for x in lines]
    return sorted(out)


@pytest.mark.parametrize("many", [True, False])
def test_audit_equals_every_order_by_hand(spark, monkeypatch, many):
    monkeypatch.setattr(audit, "_RANGE_BITS", 3)  # many ranges
    rng, rows = random.Random(11), []
    for i in range(160 if many else 0):
        words = [rng.choice(["Word", "über", "X", "a", "b\x0bc", "1%", "z z"] + [f"w{k}" for k in range(300)]) for _ in range(rng.choice([5, 99, 100, 140]))]
        rows.append((i % 150, rng.choice([" ", "\n", "\t "]).join(words), rng.choice(["en", "de", None, ""])))
    rows += [(1, None, "fr"), (2, "", "fr"), (None, "", "fr"), (None, None, "fr"), (900, "same text", "de"), (901, "same text", "en"), (901, "same text", "en")]
    rows += [(1000 + i, "copy", "hot") for i in range(60)] + [(2000, "A b " * 40_000, "long"), (2001, " ".join(map(str, range(200))), "clean")]
    labels = [(i, i % 2, (i % 3 == 0) + 0) for i in range(0, 2001, 2)] + [(1, 1, None), (1, 0, 1), (None, 1, 1), (901, None, None)]
    docs = spark.createDataFrame([(*r, "m", True) for r in rows], "doc_id long, text string, lang string, mask string, same boolean")
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.audit_filters(docs, told)
    assert sorted(map(tuple, got.collect())) == _audit_by_hand(rows, labels)


def test_audit_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit_filters(docs, labels).isEmpty()
    one = spark.createDataFrame([(1, "x", "en")], docs.schema)
    assert audit.audit_filters(one, labels).count() == 600
