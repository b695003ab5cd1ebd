import os

import pyarrow as pa
import pytest
from dump_files import frame, read_zst
from pyspark.sql import functions as F

from dumpsieve.operators import value_list as lists
from dumpsieve.operators.counters import error_rate_gate, per_file_stats
from dumpsieve.operators.manifest import (
    collect_superseded, compact_manifest, export_live, live_files, live_parts, read_manifest, read_output,
)
from dumpsieve.operators.predicates import tag_matches
from dumpsieve.plans import filter_run
from dumpsieve.plans.csv_run import csv_projection, read_csv_parts, run_csv, write_csv
from dumpsieve.plans.filter_run import ErrorRateExceeded, filter_dump, filter_files, run_filter, write_lines
from dumpsieve.sources.csv_sink import CsvPartsWriter, read_report
from dumpsieve.sources.listing import NoInputError
from dumpsieve.sources.scan import only_lines, scan_dump_lines
from dumpsieve.specs import CsvSpec, FilterSpec
from dumpsieve.streaming.incremental import stream_filter

SUBMISSIONS = b'{"author":"AB","n":1}\r\n\n{"author":"xaby"}\n{"author":"ab","title":"a,b"}\nbad\n{"author":"Ab"}\nnull\n'
FILES = {
    "RS_1.zst": frame(SUBMISSIONS),
    "sub/RS_1.zst": frame(b'{"author":"ab","from":"sub"}\n'),
    "RS_none.zst": frame(b'{"author":"zz"}\n'),
    "RC_1.zst": frame(b'{"author":"ab","body":"q\\"","score":2}\n'),
    "RS_cut.zst": frame(b'{"author":"ab"}\n') + frame(b'{"author":"ab"}\n' * 50, write_checksum=True)[:-2],
}
MATCHED = b'{"author":"AB","n":1}\n{"author":"ab","title":"a,b"}\n{"author":"Ab"}\n'
SPEC = FilterSpec("author", "ab")


def outputs(spark, root) -> dict[str, bytes]:
    """Live outputs by name; the parts of one output joined in order."""
    found = {}
    for r in sorted(live_parts(spark, str(root)).collect(), key=lambda r: r.part):
        found[r.out] = found.get(r.out, b"") + read_zst(r.path)
    return found


def plain(root) -> dict[str, bytes]:
    found = {}
    for folder, _, names in sorted(os.walk(root)):
        for name in sorted(names):
            path = os.path.relpath(os.path.join(folder, name), root)
            key = os.path.dirname(path) if os.path.dirname(path).endswith(".zst") else path
            found[key] = found.get(key, b"") + read_zst(os.path.join(folder, name))
    return found


def leftovers(root) -> list[str]:
    """Folders of runs without a row in the manifest, and hidden ones."""
    runs, done = f"{root}/_runs", {n.split(".")[0] for n in os.listdir(f"{root}/_manifest")} if os.path.isdir(f"{root}/_manifest") else set()
    unknown = [n for n in os.listdir(runs) if n not in done] if os.path.isdir(runs) else []
    return unknown + [n for n in os.listdir(root) if n.startswith("_tmp")]


@pytest.mark.parametrize("split_bytes", [1 << 27, 16, 1])  # 1: long splits, staged
def test_filter_run(spark, dump, tmp_path, split_bytes):
    out = str(tmp_path / "out")
    report = run_filter(spark, dump(FILES), out, SPEC, split_bytes)
    assert outputs(spark, out) == {
        "RS_1_ab.zst": MATCHED, "sub/RS_1_ab.zst": b'{"author":"ab","from":"sub"}\n',
        "RC_1_ab.zst": b'{"author":"ab","body":"q\\"","score":2}\n'}
    assert leftovers(out) == []
    rows = {r.file: r for r in report.files.collect()}
    assert (rows["RS_1.zst"].match_count, rows["RS_1.zst"].total_lines, rows["RS_1.zst"].bad_lines) == (3, 7, 1)
    assert (rows["RS_none.zst"].match_count, rows["RS_none.zst"].total_lines) == (0, 1)
    assert [f for f, r in rows.items() if r.failure] == ["RS_cut.zst"]
    assert report.new_files == 5 and report.skipped_files == 0
    assert report.errors == 2

    again = run_filter(spark, dump({}), out, SPEC, split_bytes)  # only the failed file is tried again
    assert (again.new_files, again.skipped_files) == (1, 4)
    other = run_filter(spark, dump({}), out, FilterSpec("author", "ab", partial=True), split_bytes)
    assert other.new_files == 5
    assert outputs(spark, out)["RS_1_ab.zst"] == MATCHED.replace(b"\n", b'\n{"author":"xaby"}\n', 1)


def test_run_with_nothing_new(spark, dump, tmp_path):
    out = str(tmp_path / "out")
    root = dump({"RS_1.zst": FILES["RS_1.zst"]})
    run_filter(spark, root, out, SPEC)
    report = run_filter(spark, root, out, SPEC)
    assert (report.new_files, report.skipped_files, report.processed) == (0, 1, 0)
    assert report.files.isEmpty()
    dump({"RS_2.zst": frame(b'{"author":"aB"}\n')})
    assert run_filter(spark, root, out, SPEC).new_files == 1
    assert set(outputs(spark, out)) == {"RS_1_ab.zst", "RS_2_ab.zst"}
    assert read_manifest(spark, out).count() == 2
    with pytest.raises(NoInputError):
        run_filter(spark, root, out, FilterSpec("author", "ab", file_filter="nothing"))


def test_parts_replace_a_single_file_and_back(spark, dump, tmp_path):
    out = str(tmp_path / "out")
    root = dump({"RS_1.zst": frame(b'{"author":"ab"}\n') + frame(b'{"author":"AB"}\n' * 2)})
    for i, (split_bytes, parts) in enumerate([(1 << 20, 1), (8, 2), (1 << 20, 1)]):
        # a new name filter makes it a new run
        run_filter(spark, root, out, FilterSpec("author", "ab", file_filter="RS" + ".*" * i), split_bytes)
        assert live_parts(spark, out).count() == parts
        assert outputs(spark, out) == {"RS_1_ab.zst": b'{"author":"ab"}\n{"author":"AB"}\n{"author":"AB"}\n'}


def test_error_rate(spark, dump, tmp_path):
    root = dump({"RS_1.zst": frame(b'bad\n{"author":"ab"}\n{"author":"ab"}\n{"author":"ab"}\n')})
    out = str(tmp_path / "out")
    with pytest.raises(ErrorRateExceeded):
        run_filter(spark, root, out, FilterSpec("author", "ab", error_rate=24))
    assert outputs(spark, out) == {} and leftovers(out) == [] and read_manifest(spark, out) is None
    assert run_filter(spark, root, out, FilterSpec("author", "ab", error_rate=25)).errors == 1
    tagged = tag_matches(only_lines(scan_dump_lines(spark, root)), SPEC)
    assert error_rate_gate(tagged, 24).first().passed is False
    assert tuple(error_rate_gate(tagged, 25).first()) == (4, 1, True)
    stats = per_file_stats(tagged).first()
    assert (stats.lines_processed, stats.bad_lines, stats.bytes_processed) == (4, 1, 4 + 16 * 3)


def test_split_by_letter(spark, dump, tmp_path):
    root = dump({"RS_1.zst": frame(b'{"title":"Ax"}\n{"title":"bx"}\n{"title":"ax2"}\n{"title":"/x"}\n{"title":"q"}\n')})
    out = str(tmp_path / "out")
    run_filter(spark, root, out, FilterSpec("title", "x", partial=True, split_by_letter=True))
    assert outputs(spark, out) == {
        "a/RS_1_x.zst": b'{"title":"Ax"}\n{"title":"ax2"}\n', "b/RS_1_x.zst": b'{"title":"bx"}\n', "_/RS_1_x.zst": b'{"title":"/x"}\n'}


@pytest.mark.parametrize("limit", [lists.BROADCAST_BYTES, 0])
def test_value_list(spark, dump, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(lists, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(lists, "AUTOMATON_BYTES", limit)
    path = tmp_path / "values.txt"
    path.write_bytes("AB\r\n\nXaBy\nab\nſ\n".encode())
    root = dump({"RS_1.zst": frame(SUBMISSIONS + b'{"author":"S"}\n') + frame(b'{"author":"aB"}\n{"author":"s"}\n')})
    out = str(tmp_path / "out")
    spec = FilterSpec("author", value_list=str(path))
    report = run_filter(spark, root, out, spec, split_bytes=8)
    (got,) = outputs(spark, out).values()
    want = MATCHED.replace(b"\n", b'\n{"author":"xaby"}\n', 1) + b'{"author":"S"}\n{"author":"aB"}\n{"author":"s"}\n'
    assert got == want and (report.matched, report.errors, report.processed) == (7, 1, 10)
    assert run_filter(spark, root, out, spec).new_files == 0
    path.write_bytes(b"zz\n")  # another list is another run
    assert run_filter(spark, root, out, spec).new_files == 1
    for text, flags, n in [("X\nzz\n", dict(partial=True), 1), ("^A.$\nxa+\n", dict(regex=True), 3)]:
        path.write_text(text)
        spec = FilterSpec("author", value_list=str(path), **flags)
        assert filter_dump(spark, root, spec).count() == n


def test_long_and_blank_lists_of_patterns(spark, tmp_path):
    table = spark.createDataFrame([('{"author":"xABCy"}',), ('{"author":"q"}',)], "value string")

    def matched(text, **flags):
        path = tmp_path / "values.txt"
        path.write_text(text)
        tagged = tag_matches(table, FilterSpec("author", value_list=str(path), **flags), lists.value_list_source(spark, str(path)))
        return [r.matched for r in tagged.collect()]

    long = "".join(f"value{i:06d}\n" for i in range(100_000))  # above 1 MiB
    assert matched(long + "abc\n", partial=True) == [True, False]
    assert matched("".join(f"v{i:05d}\n" for i in range(12_000)) + "A.C\n", regex=True) == [True, False]
    for flags in (dict(partial=True), dict(regex=True), {}):
        assert not any(matched("\n\n", **flags))


def test_the_latest_run_decides(spark, dump, tmp_path):
    root, output = dump({
        "RS_a.zst": frame(b'{"author":"ab"}\n{"author":"xaby"}\n'),
        "RS_b.zst": frame(b'{"author":"xaby"}\n'),  # only the middle run matches
        "RS_c.zst": frame(b'{"author":"ab"}\n'),  # fails in the last run
    }), str(tmp_path / "out")
    exact, partial = FilterSpec("author", "ab"), FilterSpec("author", "ab", partial=True)
    a, b = b'{"author":"ab"}\n', b'{"author":"xaby"}\n'
    both = {"RS_a_ab.zst": a + b, "RS_b_ab.zst": b, "RS_c_ab.zst": a}
    for spec, live in ((exact, {"RS_a_ab.zst": a, "RS_c_ab.zst": a}), (partial, both)):
        assert run_filter(spark, root, output, spec).new_files == 3
        assert outputs(spark, output) == live
    resolved = live_files(spark, output).collect()
    dump({"RS_c.zst": frame(b'{"author":"ab"}\n')[:-2]})
    assert run_filter(spark, root, output, exact).new_files == 3
    assert outputs(spark, output) == {"RS_a_ab.zst": a}
    assert live_parts(spark, output, partial.config_hash()).isEmpty()
    assert all(os.path.exists(f.path) for f in resolved)  # a reader that is still at the earlier run is not disturbed
    assert run_filter(spark, root, output, exact).new_files == 1  # the failed one
    # Another value has outputs of its own, which do not make the first ones old.
    other = FilterSpec("author", "xaby")
    run_filter(spark, root, output, other)
    assert outputs(spark, output) == {"RS_a_ab.zst": a, "RS_a_xaby.zst": b, "RS_b_xaby.zst": b}
    assert run_filter(spark, root, output, exact).new_files == 1
    dump({"RS_c.zst": frame(b'{"author":"ab"}\n')})
    assert run_filter(spark, root, output, FilterSpec("author", "ab", split_by_letter=True)).new_files == 3
    assert set(outputs(spark, output)) == {"a/RS_a_ab.zst", "a/RS_c_ab.zst", "RS_a_xaby.zst", "RS_b_xaby.zst"}
    for bad in ("/", "file:///", "//"):
        with pytest.raises(ValueError):
            run_filter(spark, root, bad, exact)


def test_superseded_runs_are_collected(spark, dump, tmp_path):
    root, output = dump({f"RS_{i}.zst": frame(b'{"author":"ab"}\n{"author":"xaby"}\n') for i in range(3)}), str(tmp_path / "out")
    assert collect_superseded(spark, output) == 0
    run_filter(spark, root, output, FilterSpec("author", "ab"))
    run_filter(spark, root, output, FilterSpec("author", "ab", partial=True, file_filter="RS_[01]"))
    run_filter(spark, root, output, FilterSpec("author", "ab", partial=True, file_filter="RS_[01].*"))
    os.makedirs(f"{output}/_runs/running/RS_9_ab.zst")  # another driver is at work
    (tmp_path / "out/_runs/running/RS_9_ab.zst/part").write_bytes(b"")
    (live,) = {r.run_id for r in live_parts(spark, output).where("file = 'RS_0.zst'").collect()}
    (tmp_path / f"out/_runs/{live}/RS_0_ab.zst/lost-attempt.zst").write_bytes(b"?")
    before = outputs(spark, output)
    lines = sorted(r.value for r in read_output(spark, output).collect())
    assert len(lines) == 5
    # Two parts of the first run, the second run whole, the part of a lost attempt.
    assert collect_superseded(spark, output) == 4
    assert outputs(spark, output) == before and sorted(r.value for r in read_output(spark, output).collect()) == lines
    assert len([n for n in os.listdir(f"{output}/_manifest") if n.endswith(".parquet")]) == 1
    assert sorted(os.listdir(f"{output}/_runs"))[-1] == "running" and len(os.listdir(f"{output}/_runs")) == 3
    assert collect_superseded(spark, output) == 0 and compact_manifest(spark, output) == 0
    assert run_filter(spark, root, output, FilterSpec("author", "ab", partial=True, file_filter="RS_[01].*")).new_files == 0
    # An older run loses to a later one also after its rows were put together.
    run_filter(spark, root, output, FilterSpec("author", "AB"))
    assert set(outputs(spark, output)) == {f"RS_{i}_{v}.zst" for i in range(3) for v in ("ab", "AB")}


def test_live_outputs_as_plain_files(spark, dump, tmp_path):
    root, output = dump({"sub/RS_1.zst": frame(b'{"author":"ab"}\n') + frame(b'{"author":"AB"}\n' * 2)}), str(tmp_path / "out")
    run_filter(spark, root, output, SPEC, split_bytes=8)
    (row,) = export_live(spark, output, str(tmp_path / "copy")).collect()
    assert (row.name, row.parts, row.bytes) == ("sub/RS_1_ab.zst", 2, os.path.getsize(tmp_path / "copy/sub/RS_1_ab.zst"))
    assert plain(tmp_path / "copy") == outputs(spark, output)
    assert export_live(spark, output, str(tmp_path / "parts"), whole=False).count() == 2
    assert plain(tmp_path / "parts") == outputs(spark, output)
    # Outputs can be filtered again.
    again = str(tmp_path / "again")
    filter_files(spark, live_files(spark, output), again, FilterSpec("author", "AB", partial=True))
    assert b"".join(outputs(spark, again).values()) == b'{"author":"ab"}\n{"author":"AB"}\n{"author":"AB"}\n'


def test_plain_dumps_are_not_replaced(spark, tmp_path):
    lines = spark.createDataFrame([("RS_1.zst", "a")], "out string, value string")
    write_lines(lines, str(tmp_path / "d"))
    with pytest.raises(Exception, match="there already"):
        write_lines(lines, str(tmp_path / "d"))
    assert plain(tmp_path / "d") == {"RS_1.zst": b"a\n"} and leftovers(tmp_path / "d") == []


def test_missing_and_empty_lists(spark, tmp_path):
    (tmp_path / "empty.txt").write_text("")
    for bad in ("empty.txt", "missing.txt"):
        with pytest.raises(ValueError):
            lists.value_list_source(spark, str(tmp_path / bad))


@pytest.mark.parametrize("options", [
    dict(field="score", value="1"), dict(field="author"), dict(field="author", value="(", regex=True),
    dict(field="author", value="a", regex=True, partial=True), dict(field="author", value="a", error_rate=101),
    dict(field="author", value="a", file_filter="("), dict(field="author", value="a", value_list="b"),
])
def test_options_are_checked(options):
    with pytest.raises(ValueError):
        FilterSpec(**options)
    with pytest.raises(ValueError):
        CsvSpec(number_style="e")


def test_filter_dump_leaves_out_failed_files(spark, dump):
    got = filter_dump(spark, dump(FILES), SPEC)
    assert sorted((r.file, r.value) for r in got.collect()) == sorted(
        [("RS_1.zst", x.decode()) for x in MATCHED.splitlines()]
        + [("sub/RS_1.zst", '{"author":"ab","from":"sub"}'), ("RC_1.zst", '{"author":"ab","body":"q\\"","score":2}')])


def whole(path) -> str:
    parts = sorted(n for n in os.listdir(path) if n.startswith("part-"))
    return "".join(open(os.path.join(path, n), newline="").read() for n in parts)


@pytest.mark.parametrize("split_bytes", [1 << 27, 16, 1])
def test_csv_run(spark, dump, tmp_path, split_bytes):
    root = dump({k: v for k, v in FILES.items() if k != "RC_1.zst"})
    (report,) = run_csv(spark, root, str(tmp_path), split_bytes=split_bytes)
    site = "https://www.reddit.com/r//comments//_//"
    empty = f",,,None,{site},,"
    text = whole(f"{tmp_path}/output.csv")
    header, *rows = text.splitlines()
    assert text.endswith("\n") and header == "author,title,score,created,link,text,url"
    # The checksum at the end of the cut file is what is missing: its lines are kept.
    assert sorted(rows) == sorted(
        [empty, "u/AB" + empty, "u/xaby" + empty, 'u/ab,"a,b",,None,' + site + ",,", "u/Ab" + empty, "u/ab" + empty, "u/zz" + empty]
        + ["u/ab" + empty] * 51)
    assert (report.kind, report.processed, report.bad_lines, report.errors) == ("submission", 58, 1, 2)


def test_csv_of_mixed_kinds(spark, dump, tmp_path):
    root = dump({k: FILES[k] for k in ("RC_1.zst", "RS_none.zst")})
    (report,) = run_csv(spark, root, str(tmp_path / "one"))
    link = "https://www.reddit.com/r//comments//_//"
    header, *rows = whole(f"{tmp_path}/one/output.csv").splitlines()
    assert report.kind == "comment" and header == "author,score,created,link,body"
    assert sorted(rows) == [f'u/ab,2,None,{link},"q"""', f"u/zz,,None,{link},"]
    both = run_csv(spark, root, str(tmp_path / "two"), CsvSpec(per_kind=True))
    assert [(r.kind, r.processed) for r in both] == [("comment", 1), ("submission", 1)]
    assert "u/zz,,,None" in whole(f"{tmp_path}/two/submission/output.csv")
    assert csv_projection(spark, root).count() == 2
    with pytest.raises(NoInputError):
        run_csv(spark, root, str(tmp_path / "three"), CsvSpec(file_filter="nothing"))


@pytest.mark.parametrize("split_bytes", [1 << 27, 64])
def test_csv_keeps_the_rows_in_front_of_a_failure_in_order(spark, dump, tmp_path, split_bytes):
    def lines(name, i):
        return b"".join(b'{"author":"%s%d"}\n' % (name, 10 * i + k) for k in range(10))

    bad = bytearray(frame(lines(b"b", 5), write_checksum=True))
    bad[-1] ^= 1
    root = dump({
        "RS_a.zst": frame(lines(b"a", 0)),
        "RS_b.zst": b"".join(frame(lines(b"b", i)) for i in range(5)) + bytes(bad) + b"".join(frame(lines(b"b", i)) for i in range(6, 9)),
        "RS_c.zst": frame(b"bad\n") + b"".join(frame(lines(b"c", i)) for i in range(4)),
    })
    out = str(tmp_path / "out")
    for _ in range(2):  # the second run replaces what the first has written
        (report,) = run_csv(spark, root, out, split_bytes=split_bytes)
        rows = [line.split(",")[0] for line in whole(report.path).splitlines()]
        assert rows == ["author", *[f"u/a{i}" for i in range(10)], *[f"u/b{i}" for i in range(60)], *[f"u/c{i}" for i in range(40)]]
        assert (report.processed, report.bad_lines, report.errors) == (110, 1, 2)
        assert sorted(os.listdir(out)) == ["output.csv"]
    table = read_csv_parts(spark, report.path)
    assert table.count() == 110 and table.columns[0] == "author"


def test_parts_of_lost_attempts_are_left_out(tmp_path):
    options = {"path": str(tmp_path / "t.csv"), "header": "a", "run_id": "r"}
    schema = pa.schema([("file", pa.string()), ("place", pa.int64()), ("piece", pa.string()), ("whole", pa.bool_()), ("line", pa.int64()),
                        ("value", pa.string()), ("is_bad", pa.bool_()), ("status", pa.string())])

    def rows(place, *values, status="end"):
        lines = [("f", place, "", False, i, v, v == "bad", None) for i, v in enumerate(values)]
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in [*lines, ("f", place, "", False, len(values), None, None, status)]], schema)

    def task(*batches):
        return CsvPartsWriter(options).write(iter(batches))

    first, lost, second = task(rows(0, "1", "2")), task(rows(10, "3")), task(rows(10, "3", "bad"), rows(20, "4", status="failed: x"))
    third = task(rows(30, "5"))
    CsvPartsWriter(options).commit([first, second, None, third])
    assert lost.parts and whole(tmp_path / "t.csv") == "a\n1\n2\n3\n4\n"
    assert read_report(str(tmp_path / "t.csv")) == {"processed": 4, "bad_lines": 1, "failed_files": ["f"]}
    CsvPartsWriter({**options, "run_id": "s"}).commit([])  # nothing to read: a table without rows
    assert whole(tmp_path / "t.csv") == "a\n" and os.listdir(tmp_path) == ["t.csv"]
    task(rows(0, "1"))
    CsvPartsWriter(options).abort([])
    assert os.listdir(tmp_path) == ["t.csv"]


def test_csv_with_a_header_in_each_part(spark, tmp_path):
    rows = [("a,b", ""), ('q"', "x\ny"), ("é", "z")]
    table = spark.createDataFrame(rows, "a string, b string").repartition(2)
    write_csv(table, str(tmp_path / "t"), exact=False)
    back = spark.read.csv(str(tmp_path / "t"), header=True, multiLine=True, escape='"').na.fill("")
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_stream_equals_batch(spark, dump, tmp_path):
    root = dump({k: v for k, v in FILES.items() if k != "RS_cut.zst"})
    spec, state = FilterSpec("author", "a", partial=True), str(tmp_path / "state")
    run_filter(spark, root, str(tmp_path / "batch"), spec)
    stream_filter(spark, root, str(tmp_path / "stream"), spec, state, max_files=1).awaitTermination()
    assert outputs(spark, tmp_path / "stream") == outputs(spark, tmp_path / "batch") != {}
    dump({"new/RS_9.zst": frame(b'{"author":"A"}\n')})
    stream_filter(spark, root, str(tmp_path / "stream"), spec, state).awaitTermination()
    assert outputs(spark, tmp_path / "stream")["new/RS_9_a.zst"] == b'{"author":"A"}\n'
    assert read_manifest(spark, str(tmp_path / "stream")).count() == 5


def test_stream_tries_failed_files_again(spark, dump, tmp_path):
    good = frame(b'{"author":"ab"}\n')
    root, state, out = dump({"RS_1.zst": good, "RS_2.zst": good[:-2]}), str(tmp_path / "state"), str(tmp_path / "out")
    stream_filter(spark, root, out, SPEC, state).awaitTermination()
    assert set(outputs(spark, out)) == {"RS_1_ab.zst"}
    times = os.stat(f"{root}/RS_2.zst")
    dump({"RS_2.zst": good, "RS_3.zst": good})
    os.utime(f"{root}/RS_2.zst", ns=(times.st_atime_ns, times.st_mtime_ns))  # the source has seen this one
    stream_filter(spark, root, out, SPEC, state).awaitTermination()
    assert set(outputs(spark, out)) == {"RS_1_ab.zst", "RS_2_ab.zst", "RS_3_ab.zst"}


def test_written_dump_reads_back(spark, tmp_path):
    table = spark.range(0, 1000, 1, 4).select(
        F.concat(F.lit("RS_"), (F.col("id") % 3).cast("string"), F.lit(".zst")).alias("out"),
        F.concat(F.lit("line "), F.col("id").cast("string")).alias("value"))
    write_lines(table, str(tmp_path / "d"))
    assert len(plain(tmp_path / "d")) == 3
    back = only_lines(scan_dump_lines(spark, str(tmp_path / "d"))).select("value")
    assert back.exceptAll(table.select("value")).isEmpty() and back.count() == 1000


def test_lines_of_a_filter_are_not_moved(spark, dump):
    scanned = scan_dump_lines(spark, dump(FILES))
    for spec in (SPEC, FilterSpec("author", "(?i)a.*b", regex=True)):
        plan = filter_run.sink_rows(scanned, spec)._jdf.queryExecution().executedPlan().toString()
        assert plan.index("read_splits") < plan.index("Exchange") and plan.count("from_json") == 1
