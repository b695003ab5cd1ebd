"""Sink ``csv_parts``: one CSV table in part files, in the order of the input, up to where a file failed.

Tasks write the records they have into parts of a folder that is not yet in place,
named by where their records stand in the whole input.  Whole files that one task reads
share a part; of a file that several tasks read, every run of lines is a part of its
own.  Where a file cannot be read on is known only when all tasks have ended: they
report it with their parts, and the commit leaves out the parts behind the first failure
of their file.  Then the folder takes the place of an earlier one.

``cat part-*`` is the table with its header, which is the first part (and the only one
that does not end in ``.csv``).  ``_report.json`` has the counts.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from dumpsieve.sources.zst import END, open_fs

FORMAT = "csv_parts"
ROW_SCHEMA = "file string, place bigint, piece string, whole boolean, line bigint, value string, is_bad boolean, status string"
REPORT = "_report.json"

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class CsvPart:
    """Records of one run of lines; ``file`` is empty where a part is of whole files."""

    file: str
    place: int
    first: int
    name: str | None = None
    rows: int = 0
    bad: int = 0


@dataclass
class CsvWritten(WriterCommitMessage):
    parts: list[CsvPart] = field(default_factory=list)
    failures: list[tuple[str, int]] = field(default_factory=list)  # file, place of the split


class CsvPartsWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.target = options["path"].rstrip("/")
        self.header = options["header"]
        self.hidden = f"_csv-{options['run_id']}"

    def _folder(self) -> tuple[pafs.FileSystem, str, str]:
        """File system, the folder in the making, and its place."""
        fs, target = open_fs(self.target)
        return fs, f"{target.rsplit('/', 1)[0]}/{self.hidden}", target

    # ------------------------------------------------------------ on executors

    def write(self, iterator: Iterator[pa.RecordBatch]) -> CsvWritten:
        fs, folder, _ = self._folder()
        fs.create_dir(folder, recursive=True)
        message, part, stream, open_key = CsvWritten(), None, None, None

        def close() -> None:
            if stream is not None:
                stream.close()
            if part is not None and (part.rows or part.bad):
                message.parts.append(part)

        for batch in iterator:
            place = pc.cast(batch["place"], pa.string())
            alone = pc.binary_join_element_wise(batch["file"], place, batch["piece"], "\n")
            runs = pc.run_end_encode(pc.if_else(batch["whole"], "", alone))
            start = 0
            for end, key in zip(runs.run_ends.to_pylist(), runs.values.to_pylist()):
                rows, start = batch.slice(start, end - start), end
                if key != open_key:
                    close()
                    file = rows["file"][0].as_py() if key else ""
                    part, stream = CsvPart(file, rows["place"][0].as_py(), rows["line"][0].as_py()), None
                    open_key = key
                bad = pc.fill_null(rows["is_bad"], False)
                lines = rows["value"].filter(pc.invert(pc.or_(bad, pc.is_null(rows["value"]))))
                part.bad += pc.sum(bad).as_py() or 0
                part.rows += len(lines)
                if len(lines):
                    if stream is None:
                        part.name = f"part-{part.place:018d}-{part.first:010d}-{uuid.uuid4().hex[:12]}.csv"
                        stream = fs.open_output_stream(f"{folder}/{part.name}", compression=None)
                    one_list = pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines)
                    stream.write(pc.binary_join(one_list, "\n")[0].as_buffer())
                    stream.write(b"\n")
                ends = rows["status"].to_pylist() if rows["status"].null_count < len(rows["status"]) else []
                for at in np.flatnonzero([s is not None and s != END for s in ends]):
                    message.failures.append((rows["file"][at].as_py(), rows["place"][at].as_py()))
        close()
        return message

    # ------------------------------------------------------------ on the driver

    def commit(self, messages: list[CsvWritten | None]) -> None:
        got = [m for m in messages if m is not None]
        failed: dict[str, int] = {}
        for file, place in (f for m in got for f in m.failures):
            failed[file] = min(place, failed.get(file, place))
        live = [p for m in got for p in m.parts if p.place <= failed.get(p.file, p.place)]
        fs, folder, target = self._folder()
        fs.create_dir(folder, recursive=True)
        # What stands behind a failure goes, and what attempts that did not count have left.
        names = {p.name for p in live}
        for info in fs.get_file_info(pafs.FileSelector(folder)):
            if info.base_name not in names:
                fs.delete_file(info.path)
        with fs.open_output_stream(f"{folder}/part-{0:018d}-{0:010d}-0-header", compression=None) as out:
            out.write(self.header.encode() + b"\n")
        report = {"processed": sum(p.rows for p in live), "bad_lines": sum(p.bad for p in live), "failed_files": sorted(failed)}
        with fs.open_output_stream(f"{folder}/{REPORT}", compression=None) as out:
            out.write(json.dumps(report).encode())
        earlier = f"{folder}-earlier"
        if fs.get_file_info(target).type != pafs.FileType.NotFound:
            fs.move(target, earlier)
        fs.move(folder, target)
        kind = fs.get_file_info(earlier).type
        if kind == pafs.FileType.Directory:
            fs.delete_dir(earlier)
        elif kind == pafs.FileType.File:
            fs.delete_file(earlier)

    def abort(self, messages: list[CsvWritten | None]) -> None:
        fs, folder, _ = self._folder()
        if fs.get_file_info(folder).type == pafs.FileType.Directory:
            fs.delete_dir(folder)


class CsvSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> CsvPartsWriter:
        return CsvPartsWriter(dict(self.options))


def read_report(path: str) -> dict:
    fs, name = open_fs(f"{path.rstrip('/')}/{REPORT}")
    with fs.open_input_stream(name, compression=None) as file:
        return json.loads(file.read())
