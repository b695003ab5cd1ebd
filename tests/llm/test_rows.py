"""Rows with null and repeated ids, and the pipeline against a brute-force version."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dumpsieve.llm.lines import drop_repeated_lines
from dumpsieve.llm.minhash import MinHash, drop_near_copies, near_duplicates
from dumpsieve.llm.quality import keep_good, score_quality
from dumpsieve.llm.secrets import find_secrets, redact_secrets

WORDS = [f"w{i}" for i in range(400)]


def _lines_by_hand(rows):
    """(text kept, dropped) per row; a null id is a document of its own behind all others, in the order of the table."""
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(set)
    doc = [(i is None, i if i is not None else n) for n, (i, _) in enumerate(rows)]
    for d, (_, text) in zip(doc, rows):
        for line in (text or "").split("\n"):
            holders[key(line)].add(d)
    out = []
    for d, (i, text) in zip(doc, rows):
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == d]
        out.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return out


def test_lines_of_rows_with_null_and_repeated_ids(spark, docs):
    top = 2**63 - 1
    rows = [
        (None, "a shared line of text\nown line of the first"), (None, "A SHARED line of text \nother"), (3, "x\n\ta line in three\nshort"),
        (3, "a line in three\nagain a line here\nagain a line here"), (top, "a line in three\nthe largest id of all"), (None, "the largest id of all"),
        (5, None), (6, ""), (7, "\n\n"), (2, "a line in three\r\nanother line é"), (9, "long line " * 200_000 + "\nANOTHER LINE é"), (2, "a line in three\r\nanother line é"),
    ]
    got = drop_repeated_lines(docs(rows).coalesce(1)).collect()
    same = lambda x: sorted(map(repr, x))
    assert same((r.doc_id, r.kept, r.n_lines, r.n_dropped) for r in got) == same(_lines_by_hand(rows))
    assert drop_repeated_lines(docs([])).isEmpty()
    three = drop_repeated_lines(docs([(i, "one line in all") for i in range(2)] + [(9, "q")]), min_docs=3)
    assert three.agg(F.sum("n_dropped")).first()[0] == 0


def _near_by_hand(rows, words):
    """Row numbers that stay: of linked rows the smallest id, null last, then the first row."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    best = {}
    for n, (i, _) in enumerate(rows):
        key = (i is None, i or 0, n)
        best[group[n]] = min(best.get(group[n], key), key)
    return [n for n, (i, _) in enumerate(rows) if not sets[n] or best[group[n]][2] == n]


def _near_rows():
    base = WORDS[:120]
    rows = [(1, "a a b"), (None, "a a b"), (None, "only here"), (7, "and only here too"), (7, "a a b"), (4, ""), (4, None)]
    for k in range(40):  # a chain of near copies, and texts too far from all of them
        changed = list(base)
        for j in range(k % 12):
            changed[(k * 7 + j * 11) % 120] = f"n{k}x{j}"
        rows.append((100 + k if k % 5 else None, " ".join(changed)))
    return rows


def test_near_copies_are_dropped_by_row(docs):
    rows = _near_rows()
    frame = docs(rows).coalesce(1).withColumn("n", F.monotonically_increasing_id())
    for words in (2, 5):
        got = sorted(r.n for r in drop_near_copies(frame, MinHash(shingle=words)).collect())
        assert got == _near_by_hand(rows, words)
    assert drop_near_copies(docs([])).isEmpty()
    assert near_duplicates(docs([(1, "x " * 500_000)] * 3)).filter("kept").count() == 3  # repeated rows are one document


def test_rejected_and_redacted_rows(spark, docs):
    good = [(i, " ".join(WORDS[i : i + 60]) + ".") for i in range(0, 300)]
    bad = [(1000 + i, "BUY $$$ now!!! " * (20 + i)) for i in range(300)]
    rows = good + bad + [(None, None), (None, good[0][1]), (3, good[3][1]), (5, "")]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(None, 0, 0)], "doc_id long, quality int, toxic int")
    frame = docs(rows).repartition(3)
    kept = keep_good(frame, labels)
    assert kept.columns == frame.columns
    scored = score_quality(frame, labels).filter("predicted = 1")
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in scored.collect())
    assert keep_good(docs([]), labels).isEmpty() and redact_secrets(docs([])).isEmpty()
    secret = docs([(None, "token = abcdef0123456789xyz"), (1, None), (1, "nothing")])
    assert [r.text for r in redact_secrets(secret).coalesce(1).collect()] == ["[secret]", None, "nothing"]


def test_pipeline_equals_its_steps_by_hand(spark, tmp_path):
    """The classifier's verdict is the operator's own (tested for its accuracy); all else is done by hand."""
    rows = _near_rows() + [(i, " ".join(WORDS[i : i + 150]) + f" password: hunter2hunter{i:03d}") for i in range(0, 200, 10)]
    rows += [(i, " ".join(WORDS[i : i + 150]) + f"  password:  hunter2hunter{i:03d}\n") for i in range(0, 60, 10)]
    rows += [(5000 + i, "BUY $$$ now!!! " * 40 + str(i)) for i in range(60)] + [(9, " ".join(WORDS) * 40)]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i < 5000), 0) for i, _ in rows if i is not None]
    spark.createDataFrame(sorted(set(labels)), "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, sf_dir = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)

    good = [(r.doc_id, r.text) for r in keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()]
    assert {i for i, _ in good if i is not None} and not any(i and i >= 5000 for i, _ in good)
    best = {}
    for n, (i, text) in enumerate(good):
        key = re.sub(r"[\x20\x09-\x0d]", "", text or "")
        best[key] = min(best.get(key, (1,)), (-len(text or ""), i is None, i or 0, n))
    exact = [good[b[3]] for b in best.values()]
    near = [exact[n] for n in _near_by_hand(exact, 5)]
    clean = []
    for i, text in near:
        out, at = "", 0
        for start, _, end in find_secrets(text)[0]:
            out, at = out + (text or "")[at:start] + "[secret]", end
        clean.append((i, out + (text or "")[at:] if text is not None else None))
    assert any("[secret]" in (t or "") for _, t in clean)

    with open(corpus_pipeline.public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(file.read())
    want = []
    for i, text in clean:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            want.append((i, piece, start, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
