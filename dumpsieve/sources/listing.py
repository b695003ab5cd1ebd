"""Listing of dump files.

Only names, sizes and times pass through the driver, as in Spark's own file index.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dumpsieve.functions.regex import check_re2, re2_search
from dumpsieve.sources.zst import EXTENSION, open_fs

# Name prefixes of the two record kinds.
SUBMISSION_PREFIX, COMMENT_PREFIX = "RS_", "RC_"

FILE_SCHEMA = "file string, path string, file_name string, length bigint, modified timestamp"


class NoInputError(ValueError):
    """No file to read."""


class DumpFile(NamedTuple):
    file: str  # relative to the input directory
    path: str
    length: int


def walk_key(file: str) -> list[str]:
    """Sort key that orders relative paths as a directory walk visits them."""
    return file.split("/")


def _infos(uri: str) -> tuple[str, list[tuple[str, str, pafs.FileInfo]]]:
    fs, root = open_fs(uri.rstrip("/") or "/")
    scheme = uri[: len(uri.rstrip("/")) - len(root)] if "://" in uri else ""
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.NotFound:
        raise NoInputError(f"nothing to read at {uri}")
    if info.type == pafs.FileType.File:
        name = info.base_name
        if not name.endswith(EXTENSION):
            raise NoInputError(f"{uri} is a single file without the extension {EXTENSION}")
        if not name.startswith((SUBMISSION_PREFIX, COMMENT_PREFIX)):
            raise NoInputError(f"the name of a single file begins with {SUBMISSION_PREFIX} or {COMMENT_PREFIX}, unlike {uri}")
        return scheme, [(name, info.path, info)]
    found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
    return scheme, [
        (i.path[len(root):].lstrip("/"), i.path, i) for i in found if i.type == pafs.FileType.File
    ]


def list_input_files(spark: SparkSession, path: str, file_filter: str = ".*") -> DataFrame:
    """Dump files below ``path`` whose base name matches the pattern, as a DataFrame.

    ``path`` is a directory, walked to any depth, or one file, which must be named
    like a dump.
    """
    check_re2(file_filter)
    scheme, infos = _infos(path)
    rows = [
        (file, scheme + full, i.base_name, i.size, i.mtime)
        for file, full, i in infos
        if i.base_name.endswith(EXTENSION)
    ]
    return spark.createDataFrame(rows, FILE_SCHEMA).where(re2_search(F.col("file_name"), file_filter))


def collect_files(files: DataFrame) -> list[DumpFile]:
    """The listed files in walk order: metadata only, one short row per file."""
    rows = files.select("file", "path", "length").collect()
    return sorted((DumpFile(*r) for r in rows), key=lambda f: walk_key(f.file))


def dump_kind(file_name: Column) -> Column:
    """``comment`` or ``submission`` by prefix; unknown names count as submissions."""
    return F.when(F.startswith(file_name, F.lit(COMMENT_PREFIX)), "comment").otherwise("submission")


def kind_of(file: str) -> str:
    return "comment" if file.rsplit("/", 1)[-1].startswith(COMMENT_PREFIX) else "submission"

