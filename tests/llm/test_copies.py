"""Exact, line and near duplicates, and components."""

from __future__ import annotations

import hashlib
import random

from dumpsieve.llm import minhash
from dumpsieve.llm.exact import drop_exact_copies, exact_groups
from dumpsieve.llm.graph import connected_components
from dumpsieve.llm.lines import drop_repeated_lines
from dumpsieve.llm.minhash import MinHash, drop_near_copies, near_duplicates


def test_exact_ties_nulls_and_repeats(docs):
    rows = [(5, "a b"), (3, "ab"), (4, "a  b"), (4, "a  b"), (9, None), (7, ""), (8, " \n"), (None, "solo"), (1, "x")]
    frame = docs(rows)
    got = exact_groups(frame).collect()
    assert len(got) == len(rows)
    by_text = {r.text_sha256: r for r in got}
    same = hashlib.sha256(b"ab").hexdigest()
    assert by_text[same].keep_id == 4 and by_text[same].group_size == 4
    assert sum(r.kept for r in got if r.text_sha256 == same) == 1
    empty = hashlib.sha256(b"").hexdigest()
    assert by_text[empty].keep_id == 8 and by_text[empty].group_size == 3
    kept = drop_exact_copies(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in kept.collect()) == [
        (False, 1, "x"), (False, 4, "a  b"), (False, 8, " \n"), (True, 0, "solo")
    ]
    assert exact_groups(frame.limit(0)).count() == 0


def test_lines(docs):
    rows = [(2, "Same line here\nown\n same LINE here\t"), (1, "x\nsame line here"), (3, None), (4, "short\nshort"), (5, "short")]
    got = {r.doc_id: (r.kept, r.n_lines, r.n_dropped) for r in drop_repeated_lines(docs(rows)).collect()}
    assert got == {
        2: ("own", 3, 2), 1: ("x\nsame line here", 2, 0), 3: ("", 1, 0), 4: ("short\nshort", 2, 0), 5: ("short", 1, 0)
    }
    assert drop_repeated_lines(docs([])).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (200, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}


def _brute(rows, n, percent=80):
    sets = {}
    for i, text in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
        sets[i] = {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), top(i)) for i, s in sets.items()}


def test_near_copies(docs):
    chance = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, ""), (2, " one"), (3, "ONE"), (4, "one two")]
    for group in range(12):
        base = [chance.choice(words) for _ in range(chance.choice([6, 30, 200]))]
        for _ in range(chance.randint(1, 12)):
            edited = list(base)
            for _ in range(chance.randint(0, max(1, len(base) // 20))):
                edited[chance.randrange(len(edited))] = chance.choice(words)
            rows.append((len(rows) + 100 * group, " ".join(edited)))
    for n in (2, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs(rows), MinHash(shingle=n)).collect()}
        assert got == _brute(rows, n)
    kept = drop_near_copies(docs(rows), MinHash(shingle=5))
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in _brute(rows, 5).items() if i == c}


def test_copies_of_one_text_meet_it_first(docs, monkeypatch):
    # Copies are like their text, not like each other: any other leader leaves all of them to the search of pairs.
    chance = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = [(1000, " ".join(base))]
    for i in range(60):
        edited = list(base)
        for k in range(9):
            edited[20 * k + chance.randrange(1, 19)] = f"own{i}x{k}"
        rows.append((i, " ".join(edited)))
    met, search = [], minhash._pairs_between

    def counted(*args):
        met.append(search(*args).count())
        return search(*args)

    monkeypatch.setattr(minhash, "_pairs_between", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs(rows), MinHash(shingle=2)).collect()}
    assert got == _brute(rows, 2) and {c for _, c in got.values()} == {0}
    assert met == [0]


def test_leaders_that_find_nothing_do_not_leave_all_pairs(docs, monkeypatch):
    # All copies are like each other; the first pass links none of them, as where its leaders are like no other copy.
    chance = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = [(1000, " ".join(base))]
    for i in range(60):
        edited = list(base)
        for k in range(3):
            edited[60 * k + chance.randrange(1, 59)] = f"own{i}x{k}"
        rows.append((i, " ".join(edited)))
    met, search, lead = [], minhash._pairs_between, minhash._leader_pairs

    def counted(*args):
        met.append(search(*args).count())
        return search(*args)

    monkeypatch.setattr(minhash, "_pairs_between", counted)
    monkeypatch.setattr(minhash, "_leader_pairs", lambda *args: lead(*args).limit(0))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs(rows), MinHash(shingle=2)).collect()}
    assert got == _brute(rows, 2) and {c for _, c in got.values()} == {0}
    assert met == [0]
