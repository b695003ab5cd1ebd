"""What the operators share: written tables, Bloom bitmaps, words of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dumpsieve.sources.scan import scratch_folder, shared_folder  # noqa: F401 - for the operators
from dumpsieve.sources.zst import give_back  # noqa: F401 - for the operators

WHITE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CHUNK_CHARS = 4 << 20

MAX_BLOOM_BITS = 1 << 27
_WORD = 32768  # bits in one bitmap of Spark's bitmap functions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(frame: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """The rows as a table in the shared folder: cuts lineage and outlives executors.

    A table in a ``folder`` of :func:`scratch_folder` goes away with that; other names in the folder must differ.
    """
    path = f"{folder}/{name}" if folder else shared_folder(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def remainder(column: str, divisor: int) -> Column:
    """crc32 of the number as text, modulo; null where the number is null."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(divisor))


# ---------------------------------------------------------------- Bloom bitmaps


def bloom_bits(rows: int) -> int:
    """Bits for so many keys. Bounded: beyond, more keys pass the filter, and results stay the same."""
    return min(MAX_BLOOM_BITS, max(1 << 16, 1 << (16 * max(rows, 1) - 1).bit_length()))


def bloom_position(key: Column, seed: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(bits).cast("long")) + 1


def bitmap_of(positions: DataFrame) -> DataFrame:
    """Bitmaps (``bucket``, ``bitmap``) of the distinct values of ``position``: at most bits / 8 bytes."""
    return positions.groupBy(F.bitmap_bucket_number("position").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("position")).alias("bitmap")
    )


def passes_bloom(frame: DataFrame, key: Column, bitmap: DataFrame, seeds: tuple[int, ...], bits: int) -> DataFrame:
    """The frame with ``maybe``: whether all of the key's bits are set. The bitmaps are broadcast."""
    columns = frame.columns
    maybe = F.lit(True)
    for seed in seeds:
        position = bloom_position(key, seed, bits)
        bits_of = F.broadcast(bitmap.select(F.col("bucket").alias(f"_b{seed}"), F.col("bitmap").alias(f"_m{seed}")))
        frame = frame.join(bits_of, F.bitmap_bucket_number(position) == F.col(f"_b{seed}"), "left")
        at = F.bitmap_bit_position(position)
        byte = F.conv(F.hex(F.substring(F.col(f"_m{seed}"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10)
        bit = F.getbit(byte.cast("int"), F.pmod(at, F.lit(8)).cast("int"))
        maybe = maybe & F.coalesce(bit == 1, F.lit(False))
    return frame.select(*columns, maybe.alias("maybe"))


def member_bitmap(keys: DataFrame, key: Column, seeds: tuple[int, ...], bits: int) -> DataFrame:
    """Bitmaps of all the keys, for :func:`passes_bloom`."""
    each = F.explode(F.array(*[bloom_position(key, seed, bits) for seed in seeds]))
    return bitmap_of(keys.select(each.alias("position")))


# ---------------------------------------------------------------- texts in batches


def text_chunks(
    batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK_CHARS
) -> Iterator[pa.RecordBatch]:
    """The batches cut so that one chunk holds few texts or few MiB of text; a text is never cut."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        begin = 0
        while begin < batch.num_rows:
            ends = np.cumsum(sizes[begin:])
            rows = max(1, int(np.searchsorted(ends, size, "right")))
            yield batch.slice(begin, rows)
            begin += rows


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row of each word, number of each word in the dictionary, and the dictionary.

    Words are maximal runs of characters other than ASCII white space.
    """
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    rows, words = pc.list_parent_indices(split), pc.list_flatten(split)
    there = pc.not_equal(words, "")
    rows, words = rows.filter(there), words.filter(there)
    coded = pc.dictionary_encode(words)
    return rows.to_numpy().astype(np.int64), coded.indices.to_numpy().astype(np.int64), coded.dictionary


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """As :func:`coded_words`, with the dictionary as a list."""
    rows, codes, dictionary = coded_words(texts)
    return rows, codes, dictionary.to_numpy(zero_copy_only=False).tolist()


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of several ranges, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
