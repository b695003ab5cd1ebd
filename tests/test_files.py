import os

import pyarrow as pa
import pytest
from dump_files import frame, raw_frame, read_zst
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dumpsieve.sources import dump_sink, zst
from dumpsieve.sources.listing import DumpFile, NoInputError, collect_files, dump_kind, kind_of, list_input_files
from dumpsieve.sources.scan import (
    drop_failed_files, ingest, keep_until_failure, only_lines, plan_scan, read_staged, scan_dump_lines, scan_in_pieces,
    shared_folder, stage,
)


def lines_of(scanned, column="value"):
    return [r[column] for r in only_lines(scanned).orderBy("file", "split", "line").collect()]


def statuses(scanned):
    rows = scanned.where("status is not null").orderBy("file", "split").collect()
    return [(r.file, r.split, r.line, r.status) for r in rows]


def test_listing_walks_names_and_patterns(spark, dump):
    root = dump({
        "RS_2023-01.zst": b"", "RC_2023-01.zst": b"", "sub/RS_2023-02.zst": b"x", "sub/RS_2023-01.zst": b"",
        "notes.txt": b"", "RS_x.ZST": b"", "other.zst": b"", "_hidden/RS_9.zst": b"", ".RS_8.zst": b"",
    })
    files = collect_files(list_input_files(spark, root))
    assert [f.file for f in files] == [
        ".RS_8.zst", "RC_2023-01.zst", "RS_2023-01.zst", "_hidden/RS_9.zst", "other.zst",
        "sub/RS_2023-01.zst", "sub/RS_2023-02.zst"]
    assert [f.length for f in files][-1] == 1
    assert {f.file for f in collect_files(list_input_files(spark, root, "^RS_2023-0[1]"))} == {
        "RS_2023-01.zst", "sub/RS_2023-01.zst"}
    assert list_input_files(spark, root, "nothing").isEmpty()
    with pytest.raises(NoInputError):
        scan_dump_lines(spark, root, "nothing")
    with pytest.raises(ValueError):
        list_input_files(spark, root, "(")


def test_walk_order_goes_into_folders_in_place(spark, dump):
    root = dump({"b.zst": b"", "a/z.zst": b"", "a.zst": b"", "a-b/c.zst": b""})
    assert [f.file for f in collect_files(list_input_files(spark, root))] == ["a/z.zst", "a-b/c.zst", "a.zst", "b.zst"]


def test_single_file(spark, dump):
    root = dump({"RS_1.zst": frame(b"a\nb\n"), "x.zst": b"", "RS_1.txt": b""})
    assert lines_of(scan_dump_lines(spark, f"{root}/RS_1.zst")) == ["a", "b"]
    for bad in ("x.zst", "RS_1.txt", "missing.zst"):
        with pytest.raises(NoInputError):
            scan_dump_lines(spark, f"{root}/{bad}")


def test_kinds(spark):
    names = ["RS_1.zst", "RC_1.zst", "other.zst"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(dump_kind(F.col("n"))).collect()
    assert [r[0] for r in got] == [kind_of("a/RC_b/" + n) for n in names] == ["submission", "comment", "submission"]


def test_line_ends(spark, dump):
    root = dump({"RS_1.zst": frame(b"a\r\n\r\n\nb\rc\n d\r\r\nlast\r"), "RS_2.zst": frame(b""), "RS_3.zst": b""})
    scanned = scan_dump_lines(spark, root)
    assert lines_of(scanned) == ["a", "", "", "b\rc", " d\r", "last"]
    assert statuses(scanned) == [("RS_1.zst", 0, 6, "end"), ("RS_2.zst", 0, 0, "end"), ("RS_3.zst", 0, 0, "end")]


def test_bytes_are_untouched(spark, dump):
    root = dump({"RS_1.zst": frame(b"a\xff\xfe\n\xef\xbb\xbfb\n")})
    got = scan_dump_lines(spark, root).select("file", "split", "line", "status", F.col("value").cast("binary").alias("value"))
    assert [bytes(x) for x in lines_of(got)] == [b"a\xff\xfe", b"\xef\xbb\xbfb"]


@settings(max_examples=6, deadline=None)
@given(
    pieces=st.lists(st.binary(max_size=40).map(lambda b: b.replace(b"\0", b"\n")), min_size=1, max_size=12),
    text=st.lists(st.sampled_from([b"\n", b"ab", b"c\r\n", b"\n\n", b"long" * 20]), max_size=12),
    split_bytes=st.integers(1, 200),
)
def test_splits_give_the_lines_of_the_whole(spark, tmp_path_factory, pieces, text, split_bytes):
    root = tmp_path_factory.mktemp("splits")
    skippable = b"\x51\x2a\x4d\x18" + (3).to_bytes(4, "little") + b"xyz"
    frames = [frame(p, write_checksum=i % 2 == 0, write_content_size=i % 3 > 0) for i, p in enumerate(pieces + text)]
    (root / "RS_1.zst").write_bytes(skippable.join(frames))
    (root / "RS_2.zst").write_bytes(b"".join(frames))
    whole = b"".join(pieces + text)
    want = [line.removesuffix(b"\r") for line in whole.split(b"\n")]
    if whole.endswith(b"\n") or not whole:
        want.pop()
    scanned = scan_dump_lines(spark, str(root), split_bytes=split_bytes)
    rows = only_lines(scanned).withColumn("value", F.col("value").cast("binary")).orderBy("file", "split", "line").collect()
    for name in ("RS_1.zst", "RS_2.zst"):
        assert [bytes(r.value) for r in rows if r.file == name] == want
    ends = statuses(scanned)
    assert {s for *_, s in ends} == {"end"} and sum(n for _, _, n, _ in ends) == 2 * len(want)


def test_large_file_of_many_frames_gets_many_splits(spark, dump):
    lines = [b"%06d" % i + os.urandom(20).hex().encode() for i in range(2000)]
    data = b"".join(frame(b"\n".join(lines[i : i + 100]) + b"\n") for i in range(0, 2000, 100))
    root = dump({"RS_1.zst": data})
    scanned = scan_dump_lines(spark, root, split_bytes=len(data) // 8)
    assert lines_of(scanned) == [x.decode() for x in lines]
    assert 6 <= len(statuses(scanned)) <= 10
    tasks = scanned.where("status is null").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(tasks) >= 6 and max(t["count"] for t in tasks) < 700


def test_windows_up_to_two_gib(spark, dump):
    root = dump({
        "RS_1.zst": raw_frame(b"a\nb\n", 31) + frame(b"c\n"), "RS_2.zst": raw_frame(b"d\n", 28),
        "RS_3.zst": raw_frame(b"e\n", 33),
    })
    scanned = scan_dump_lines(spark, root)
    assert lines_of(scanned) == ["a", "b", "c", "d"]
    assert [s.startswith("failed") for *_, s in statuses(scanned)] == [False, False, True]


def test_damaged_files(spark, dump):
    good = b"".join(b"line %d\n" % i for i in range(5))
    # Two raw blocks, the second damaged: what stands in front of the damage is read.
    header = b"\x28\xb5\x2f\xfd" + bytes([0, 0])
    block = (len(good) << 3).to_bytes(3, "little") + good
    checksummed = bytearray(frame(good, write_checksum=True))
    checksummed[-1] ^= 1
    root = dump({
        "RS_garbage.zst": b"not zstd at all", "RS_tail.zst": frame(good) + b"garbage here",
        "RS_truncated.zst": header + block + (9 << 3 | 1).to_bytes(3, "little") + b"part", "RS_block.zst": header + block + b"\x07\0\0",
        "RS_sum.zst": bytes(checksummed), "RS_ok.zst": frame(good),
    })
    for split_bytes in (1 << 20, 1):
        scanned = scan_dump_lines(spark, root, split_bytes=split_bytes)
        failed = {f for f, _, _, s in statuses(scanned) if s != "end"}
        assert failed == {"RS_garbage.zst", "RS_tail.zst", "RS_truncated.zst", "RS_block.zst", "RS_sum.zst"}
        staged = stage(scanned, shared_folder(spark, "test"))
        assert {r.file for r in drop_failed_files(staged).collect()} == {"RS_ok.zst"}
        kept = {}
        for r in keep_until_failure(staged).orderBy("file", "split", "line").collect():
            kept.setdefault(r.file, []).append(r.value)
        want = good.decode().split("\n")[:-1]
        assert kept.pop("RS_truncated.zst") == want + ["part"]
        assert kept == {f: want for f in ("RS_tail.zst", "RS_block.zst", "RS_sum.zst", "RS_ok.zst")}


def test_rows_behind_a_failure_are_dropped_in_later_splits(spark, dump):
    bad = bytearray(frame(b"x" * 50 + b"\n", write_checksum=True))
    bad[-1] ^= 1
    root = dump({"RS_1.zst": frame(b"a\nb\n") + bytes(bad) + frame(b"c\nd\n")})
    staged = stage(scan_dump_lines(spark, root, split_bytes=1), shared_folder(spark, "test"))
    assert "d" in lines_of(staged)
    got = [r.value for r in keep_until_failure(staged).orderBy("split", "line").collect()]
    assert got == ["a", "b", "x" * 50]


def test_overlong_lines_stop_a_file(spark, dump):
    limit = zst.MAX_LINE_BYTES
    fits, too_long = b"f" * (limit - 1), b"g" * limit
    root = dump({
        "RS_fits.zst": frame(b"a\n" + fits + b"\nb\n"), "RS_long.zst": frame(b"a\n" + too_long + b"\nb\n"),
        "RS_cr.zst": frame(b"a\n" + fits + b"\r\nb\n"), "RS_end.zst": frame(b"a\n" + too_long),
        "RS_frames.zst": frame(b"a\n" + too_long[:100]) + frame(too_long) + frame(b"\nb\n"),
    })
    scanned = scan_dump_lines(spark, root, split_bytes=64)
    staged = stage(scanned, shared_folder(spark, "test"))
    short = F.when(F.length("value") < 5, F.col("value")).otherwise("long").alias("value")
    got = {}
    for r in keep_until_failure(staged).select("file", "split", "line", short).orderBy("file", "split", "line").collect():
        got.setdefault(r.file, []).append(r.value)
    assert got == {"RS_fits.zst": ["a", "long", "b"], "RS_long.zst": ["a"], "RS_cr.zst": ["a"], "RS_end.zst": ["a"], "RS_frames.zst": ["a"]}


def test_ingest(spark, dump, tmp_path):
    root = dump({"RS_1.zst": frame(b"a\nb\n"), "RC_1.zst": frame(b"c\n")})
    ingest(spark, root, str(tmp_path / "staged"), "^RS")
    assert lines_of(read_staged(spark, str(tmp_path / "staged"))) == ["a", "b"]


def test_shared_folder_is_the_one_the_session_names(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        assert shared_folder(spark, "x").startswith(root)
    assert shared_folder(spark, "x") != shared_folder(spark, "x")


def test_plan_moves_no_lines(spark, dump):
    root = dump({"RS_1.zst": frame(b"a\n")})
    plan = scan_dump_lines(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Exchange")  # the reader stands above the last exchange
    assert read_zst(f"{root}/RS_1.zst") == b"a\n"


# ---------------------------------------------------------------- splits without a look at the file


class _Counting:
    """A file system that counts the bytes read through it."""

    def __init__(self):
        self.bytes = 0

    def open_input_file(self, name):
        return _CountingFile(open(name, "rb"), self)


class _CountingFile:
    def __init__(self, file, owner):
        self.file, self.owner = file, owner

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def size(self):
        return os.fstat(self.file.fileno()).st_size

    def read_at(self, n, at):
        self.file.seek(at)
        data = self.file.read(n)
        self.owner.bytes += len(data)
        return data

    def seek(self, at):
        self.file.seek(at)

    def read(self, n):
        data = self.file.read(n)
        self.owner.bytes += len(data)
        return data


def read_by(monkeypatch, path, splits):
    """Values and statuses of the splits of a file as a task reads them, and the bytes that took."""
    counting = _Counting()
    monkeypatch.setattr(zst, "open_fs", lambda uri: (counting, uri))
    rows = [{"file": "f", "path": str(path), "first": a, "last": b, "bin": 0, "place": a} for a, b in splits]
    batches = list(zst.read_splits([pa.RecordBatch.from_pylist(rows)]))
    values = [v for b in batches for v, s in zip(b["value"].to_pylist(), b["status"].to_pylist()) if s is None]
    return values, [s for b in batches for s in b["status"].to_pylist() if s is not None], counting.bytes


def ranges(size, step):
    return [(a, min(a + step, size)) for a in range(0, size, step)]


def test_planning_reads_no_file(spark):
    files = [DumpFile("RS_1.zst", "/nowhere/RS_1.zst", 1000), DumpFile("RS_2.zst", "/nowhere/RS_2.zst", 250)]
    plan = plan_scan(spark, files, 300)
    got = [(r.file, r["first"], r["last"], r.place) for r in plan.splits.orderBy("place").collect()]
    assert got == [("RS_1.zst", a, b, a) for a, b in ranges(1000, 300)] + [("RS_2.zst", 0, 250, 1000)]
    assert plan.cut and plan.uneven is None


def test_short_splits_share_tasks(spark):
    files = [DumpFile("RS_1.zst", "/nowhere/RS_1.zst", 1 << 30), DumpFile("RS_2.zst", "/nowhere/RS_2.zst", 1 << 20)]
    plan = plan_scan(spark, files, 64 << 10)
    tasks = plan.splits.groupBy("bin").agg(F.count("*").alias("n"), F.sum(F.col("last") - F.col("first")).alias("size")).collect()
    assert sum(t.n for t in tasks) == (1 << 14) + 16 and len(tasks) <= plan.n_tasks <= 130
    assert max(t.size for t in tasks) <= 9 << 20 and max(t.bin for t in tasks) < plan.n_tasks


def test_splits_without_lines_are_sent_together(monkeypatch, tmp_path):
    path = tmp_path / "RS_1.zst"
    path.write_bytes(frame(b"".join(b"%d\n" % i for i in range(2000))))
    rows = [{"file": "f", "path": str(path), "first": a, "last": b, "bin": 0, "place": a} for a, b in ranges(path.stat().st_size, 16)]
    for read in (zst.read_splits, zst.read_placed_splits):
        (batch,) = read([pa.RecordBatch.from_pylist(rows)])
        assert [v for v in batch["value"].to_pylist() if v is not None] == [b"%d" % i for i in range(2000)]
        assert batch["status"].to_pylist().count("end") == len(rows) > 100
        assert batch["split"].to_pylist()[1999:] == [0, *(a for a, _ in ranges(path.stat().st_size, 16))]


def test_a_split_reads_little_besides_its_own_bytes(monkeypatch, tmp_path):
    monkeypatch.setattr(zst, "_HEADER_BYTES", 4 << 10)
    lines = [os.urandom(5000).hex().encode() for _ in range(200)]
    frames = [frame(b"\n".join(lines[i : i + 4]) + b"\n") for i in range(0, 200, 4)]
    path = tmp_path / "RS_1.zst"
    path.write_bytes(b"".join(frames))
    size, longest = path.stat().st_size, max(map(len, frames))
    step, got = size // 8, []
    for split in ranges(size, step):
        values, ends, read = read_by(monkeypatch, path, [split])
        got += values
        # Its own frames, the rest of one in front of them, the headers of two, the line behind.
        assert ends == ["end"] and read < step + 4 * longest + 3 * zst._READ_BYTES
    assert got == lines


def test_a_false_magic_in_a_frame(monkeypatch, tmp_path):
    false = b"\x28\xb5\x2f\xfd\x20\x05\x09\x00\x00" + b"x" * 40
    content = b"one\n" + false + b"\n" + b"\x28\xb5\x2f\xfd" + b"\ntwo\n"
    path = tmp_path / "RS_1.zst"
    path.write_bytes(frame(b"a\n") + raw_frame(content, 20) + frame(b"b\n"))
    want = [b"a", b"one", false, b"\x28\xb5\x2f\xfd", b"two", b"b"]
    for step in range(1, path.stat().st_size + 1):
        values, ends, _ = read_by(monkeypatch, path, ranges(path.stat().st_size, step))
        assert values == want and set(ends) == {"end"}


def test_whole_frames_stored_in_a_frame(monkeypatch, tmp_path):
    """Text cannot hold them. Inside content they are passed over; at its very end, where they look like frames of the file, that is reported."""
    inner = frame(b"inner\n") + frame(b"inner 2\n")
    path = tmp_path / "RS_1.zst"
    path.write_bytes(frame(b"a\n") + raw_frame(b"x\n" + inner + b"\ny\n", 20) + frame(b"b\n"))
    whole, _, _ = read_by(monkeypatch, path, [(0, path.stat().st_size)])
    for step in (1, 5, 30):
        values, ends, _ = read_by(monkeypatch, path, ranges(path.stat().st_size, step))
        assert values == whole or any("inside another" in e for e in ends)
    path.write_bytes(frame(b"a\n") + raw_frame(b"x\ny\n" + inner, 20) + frame(b"b\n"))
    _, ends, _ = read_by(monkeypatch, path, ranges(path.stat().st_size, 1))
    assert any("inside another" in e for e in ends)
    _, ends, _ = read_by(monkeypatch, path, [(0, path.stat().st_size)])
    assert ends == ["end"]


def test_the_seek_table_tells_where_frames_begin(monkeypatch, tmp_path):
    inner = frame(b"inner\n") + frame(b"inner 2\n")
    frames = [frame(b"a\n"), raw_frame(b"x\ny\n" + inner, 20), frame(b"b\nc\n"), frame(b"d\n")]
    entries = b"".join(len(f).to_bytes(4, "little") + bytes(4) for f in frames)
    table = entries + len(frames).to_bytes(4, "little") + b"\0" + b"\xb1\xea\x92\x8f"
    path = tmp_path / "RS_1.zst"
    path.write_bytes(b"".join(frames) + b"\x5e\x2a\x4d\x18" + len(table).to_bytes(4, "little") + table)
    starts = [sum(map(len, frames[:i])) for i in range(len(frames))]
    with _Counting().open_input_file(path) as file:
        assert zst.seek_table(zst._Headers(file)).tolist() == starts
        assert [zst.first_frame(file, s - 1, s + 1) for s in starts[1:]] == starts[1:]
        assert zst.first_frame(file, starts[1] + 1, starts[2]) is None
    whole, _, _ = read_by(monkeypatch, path, [(0, path.stat().st_size)])
    for step in (1, 7, 40):
        values, ends, _ = read_by(monkeypatch, path, ranges(path.stat().st_size, step))
        assert values == whole and set(ends) == {"end"}
    # A table that does not fit the file is not believed.
    path.write_bytes(b"".join(frames[1:]) + b"\x5e\x2a\x4d\x18" + len(table).to_bytes(4, "little") + table)
    with _Counting().open_input_file(path) as file:
        assert zst.seek_table(zst._Headers(file)) is None


def test_only_uneven_splits_are_staged(spark, dump, tmp_path):
    many = [b"%06d" % i + os.urandom(30).hex().encode() for i in range(3000)]
    one = [b"one %06d" % i + os.urandom(30).hex().encode() for i in range(3000)]
    root = dump({
        "RS_even.zst": b"".join(frame(b"\n".join(many[i : i + 50]) + b"\n") for i in range(0, 3000, 50)),
        "RS_one.zst": frame(b"\n".join(one) + b"\n"), "RS_small.zst": frame(b"s\n"),
        "RS_tail.zst": b"".join(frame(b"\n".join(many[i : i + 50]) + b"\n") for i in range(0, 3000, 50)) + frame(b"\n".join(one) + b"\n"),
    })
    folder = str(tmp_path / "staged")
    plan = plan_scan(spark, collect_files(list_input_files(spark, root)), 8 << 10, folder)
    uneven = {(r.file, r["first"] > 0) for r in plan.uneven.collect()}
    assert uneven == {("RS_one.zst", False), ("RS_tail.zst", True)}
    rows = scan_in_pieces(plan, folder).where("status IS NULL").orderBy("file", "split", "line").collect()
    for name, want in (("RS_even.zst", many), ("RS_one.zst", one), ("RS_small.zst", [b"s"]), ("RS_tail.zst", many + one)):
        assert [r.value.encode() for r in rows if r.file == name] == want
    staged = spark.read.parquet(folder + "/lines")
    assert {r.file for r in staged.select("file").distinct().collect()} == {"RS_one.zst", "RS_tail.zst"}
    assert staged.where("status IS NULL").count() < 2 * 3000 + 200
    written = sum(os.path.getsize(os.path.join(folder, "lines", n)) for n in os.listdir(folder + "/lines"))
    assert written < 1.3 * 2 * os.path.getsize(f"{root}/RS_one.zst")
    plain = scan_in_pieces(plan_scan(spark, collect_files(list_input_files(spark, root, "even|small")), 8 << 10, folder + "2"), folder + "2")
    assert plain.count() > 3000 and not os.path.exists(folder + "2/lines")


def test_lines_are_written_a_few_mib_at_a_time():
    class Stream:
        pieces = []

        def write(self, data):
            self.pieces.append(bytes(data))

    part = dump_sink.Part("out", "file", 0, 0)
    encoder = dump_sink._Encoder(None, "", part, "", None)
    encoder.stream = Stream()
    lines = [b"%07d" % i * 1000 for i in range(3000)] + [b"", b"x" * (6 << 20), b"end"]
    encoder.write(pa.array(lines)[1:])
    assert part.matched == len(lines) - 1
    assert b"".join(Stream.pieces) == b"".join(line + b"\n" for line in lines[1:])
    assert max(map(len, Stream.pieces)) < 12 << 20
