"""Sink ``dump_parts``: zstd NDJSON files written by tasks, live by what the manifest says.

Rows carry the output file they belong to.  Every task encodes the lines it is
given, so no line moves between tasks, and writes each part once, to the place where
it stays: ``_runs/<run>/<output>/<split>-<line>-<attempt>.zst``.  A run becomes visible
by one file: ``_manifest/<run>.parquet`` has a row per input file with the parts of the
attempts that succeeded.  Nothing is renamed, and nothing that readers may be using is
replaced or removed: what is live follows from the rows (``operators.manifest``), also
where a later run had no match in a file or failed to read it.  A run that does not
get as far leaves a folder that no row names.

An output's parts, in the order of their names, are together (``cat``) one valid file.

``versions=false`` writes plain dumps for others to read: parts go to a hidden folder,
and the commit moves them to ``<output>``, a file or, of several tasks, a folder of
numbered parts. There an output must not exist before.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import zstandard
from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from dumpsieve.sources.zst import END, EXTENSION, give_back, open_fs

FORMAT = "dump_parts"

# Kinds of row: a line to write, a bad line to count, the closing row of a split.
LINE, BAD, CLOSE = 0, 1, 2
# ``piece`` tells apart the runs of consecutive lines that one task may get of a split;
# ``line`` is the number of lines in a closing row.
SINK_SCHEMA = (
    "out string, file string, split bigint, piece string, line bigint, kind int, value binary, status string"
)

MANIFEST_DIR, RUNS_DIR = "_manifest", "_runs"
# ``label`` stands for the value in the names of outputs; ``outs`` has the paths of their parts.
MANIFEST_SCHEMA = (
    "file string, processed_at timestamp, match_count bigint, total_lines bigint, "
    "bad_lines bigint, failure string, hashed_config string, run_id string, label string, "
    "outs array<struct<out: string, parts: array<string>>>"
)
_MANIFEST_ARROW = pa.schema([
    ("file", pa.string()), ("processed_at", pa.timestamp("us", "UTC")), ("match_count", pa.int64()),
    ("total_lines", pa.int64()), ("bad_lines", pa.int64()), ("failure", pa.string()),
    ("hashed_config", pa.string()), ("run_id", pa.string()), ("label", pa.string()),
    ("outs", pa.list_(pa.struct([("out", pa.string()), ("parts", pa.list_(pa.string()))]))),
])
RATE_EXCEEDED = "error rate exceeded"
_PUBLISHERS = 32
_WRITE_BYTES = 4 << 20  # of lines that are joined at once

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class Part:
    """What one task wrote and saw of one run of lines of one file."""

    out: str
    file: str
    split: int
    first: int
    path: str | None = None  # below the target, once something is written
    matched: int = 0
    bad: int = 0
    lines: int = 0
    failure: str | None = None


@dataclass
class Written(WriterCommitMessage):
    parts: list[Part] = field(default_factory=list)


class _Encoder:
    """The one part a task has open."""

    def __init__(self, fs: pafs.FileSystem, target: str, part: Part, path: str, window_log: int | None):
        self.fs, self.target, self.part, self.path, self.window_log = fs, target, part, path, window_log
        self.raw = self.stream = None

    def write(self, values: pa.Array) -> None:
        if self.stream is None:
            name = f"{self.target}/{self.path}"
            self.fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
            self.part.path = self.path
            self.raw = self.fs.open_output_stream(name, compression=None)
            settings = {}
            if self.window_log:
                settings["compression_params"] = zstandard.ZstdCompressionParameters.from_level(
                    3, window_log=self.window_log, enable_ldm=True
                )
            self.stream = zstandard.ZstdCompressor(**settings).stream_writer(self.raw, closefd=False)
        step = max(1, len(values) * _WRITE_BYTES // max(1, values.nbytes))
        for first in range(0, len(values), step):
            some = values[first : first + step]
            one_list = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some)
            self.stream.write(pc.binary_join(one_list, b"\n")[0].as_buffer())
            self.stream.write(b"\n")
        self.part.matched += len(values)

    def close(self) -> Part:
        if self.stream is not None:
            self.stream.close()
            self.raw.close()
        return self.part


class DumpWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.target = options["path"].rstrip("/")
        self.run_id = options["run_id"]
        self.config_hash = options.get("config_hash", "")
        self.label = options.get("label", "")
        self.versions = options.get("versions", "true") == "true"
        rate = options.get("error_rate", "")
        self.error_rate = float(rate) if rate else None
        self.window_log = int(options.get("window_log", "0")) or None
        self.folder = f"{RUNS_DIR}/{self.run_id}" if self.versions else f"_tmp-{self.run_id}"

    # ------------------------------------------------------------ on executors

    def _path(self, part: Part) -> str:
        """A name of its own for every attempt, in the order of the file."""
        name = f"{part.split:015d}-{part.first:010d}-{uuid.uuid4().hex[:12]}{EXTENSION}"
        return f"{self.folder}/{part.out}/{name}" if self.versions else f"{self.folder}/{name}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, target = open_fs(self.target)
        message, encoder, open_key = Written(), None, None
        for batch in iterator:
            keys = pc.binary_join_element_wise(
                batch["out"], batch["file"], pc.cast(batch["split"], pa.string()), batch["piece"], "\n"
            )
            runs = pc.run_end_encode(keys)
            start = 0
            for end, key in zip(runs.run_ends.to_pylist(), runs.values.to_pylist()):
                rows = batch.slice(start, end - start)
                start = end
                if key != open_key:
                    if encoder is not None:
                        message.parts.append(encoder.close())
                    part = Part(*[rows[c][0].as_py() for c in ("out", "file", "split", "line")])
                    encoder, open_key = _Encoder(fs, target, part, self._path(part), self.window_log), key
                self._take(encoder, rows)
        if encoder is not None:
            message.parts.append(encoder.close())
        encoder = batch = rows = keys = runs = None
        give_back()
        return message

    @staticmethod
    def _take(encoder: _Encoder, rows: pa.RecordBatch) -> None:
        kinds = rows["kind"].to_numpy(zero_copy_only=False)
        is_line = kinds == LINE
        if is_line.any():
            encoder.write(rows["value"] if is_line.all() else rows["value"].filter(pa.array(is_line)))
        encoder.part.bad += int((kinds == BAD).sum())
        for at in np.flatnonzero(kinds == CLOSE):
            encoder.part.lines += rows["line"][at].as_py()
            status = rows["status"][at].as_py()
            if status != END:
                encoder.part.failure = status

    # ------------------------------------------------------------ on the driver

    def commit(self, messages: list[Written | None]) -> None:
        parts = [p for m in messages if m is not None for p in m.parts]
        by_file: dict[str, list[Part]] = {}
        for part in sorted(parts, key=lambda p: (p.file, p.split, p.first)):
            by_file.setdefault(part.file, []).append(part)
        rows = [self._summary(file, group) for file, group in by_file.items()]
        self._check_rate(rows)
        fs, target = open_fs(self.target)
        if not self.versions:
            self._publish(fs, target, by_file)
            self._drop(fs, target)
            return
        # The one step that publishes the run.
        folder = f"{target}/{MANIFEST_DIR}"
        for name in (folder, f"{target}/{self.folder}"):
            fs.create_dir(name, recursive=True)
        noted = f"{target}/{self.folder}/manifest"
        pq.write_table(pa.Table.from_pylist(rows, _MANIFEST_ARROW), noted, filesystem=fs)
        fs.move(noted, f"{folder}/{self.run_id}.parquet")

    def _summary(self, file: str, group: list[Part]) -> dict:
        """Counts of a file; as reading a failed file in order would have given them."""
        failure = next((p.failure for p in group if p.failure is not None), None)
        if failure is not None:
            stop = next(p.split for p in group if p.failure is not None)
            group = [p for p in group if p.split <= stop]
        outs: dict[str, list[str]] = {}
        for part in group:
            if failure is None and part.path is not None:
                outs.setdefault(part.out, []).append(part.path)
        return {
            "file": file,
            "processed_at": datetime.now(timezone.utc),
            "match_count": sum(p.matched for p in group),
            "total_lines": sum(p.lines for p in group),
            "bad_lines": sum(p.bad for p in group),
            "failure": failure,
            "hashed_config": self.config_hash,
            "run_id": self.run_id,
            "label": self.label,
            "outs": [{"out": out, "parts": paths} for out, paths in outs.items()],
        }

    def _check_rate(self, rows: list[dict]) -> None:
        if self.error_rate is None:
            return
        errors = sum(r["bad_lines"] + (r["failure"] is not None) for r in rows)
        lines = sum(r["total_lines"] for r in rows)
        if errors * 100 > self.error_rate * max(lines, 1):
            raise RuntimeError(f"{RATE_EXCEEDED}: {errors} errors in {lines} lines")

    @staticmethod
    def _publish(fs: pafs.FileSystem, target: str, by_file: dict[str, list[Part]]) -> None:
        by_out: dict[str, list[str]] = {}
        for group in by_file.values():
            for part in group:
                if part.path is not None:
                    by_out.setdefault(part.out, []).append(part.path)
        there = fs.get_file_info([f"{target}/{out}" for out in by_out])
        for info in there:
            if info.type != pafs.FileType.NotFound:
                raise FileExistsError(f"{info.path} is there already")

        def publish(out: str) -> None:
            final, group = f"{target}/{out}", by_out[out]
            if len(group) == 1:
                fs.create_dir(final.rsplit("/", 1)[0], recursive=True)
                fs.move(f"{target}/{group[0]}", final)
                return
            fs.create_dir(final, recursive=True)
            stem = final.rsplit("/", 1)[1][: -len(EXTENSION)]
            for i, path in enumerate(group):
                fs.move(f"{target}/{path}", f"{final}/{stem}.p{i:05d}{EXTENSION}")

        with ThreadPoolExecutor(_PUBLISHERS) as pool:  # renames wait on the file system
            list(pool.map(publish, by_out))

    def abort(self, messages: list[Written | None]) -> None:
        self._drop(*open_fs(self.target))

    def _drop(self, fs: pafs.FileSystem, target: str) -> None:
        folder = f"{target}/{self.folder}"
        if fs.get_file_info(folder).type == pafs.FileType.Directory:
            fs.delete_dir(folder)


class DumpSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> DumpWriter:
        return DumpWriter(dict(self.options))
