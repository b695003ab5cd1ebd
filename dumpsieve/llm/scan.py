"""Running values within groups of any size, and joins that a hot key does not hold up.

A window over a group puts the whole group into one task. Here rows are sorted by range
over all tasks, each task runs over its own rows, and what a group has gathered in the
tasks before is put in front of its rows by the law of the values: sums add, and
products of turns compose as polynomials do. The driver gets one short row per task.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dumpsieve.llm.shared import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MODULUS = (1 << 31) - 1  # so that a product of two values fits into 62 bits
HEAVY = 1000


def powers(base: int, exponents: np.ndarray) -> np.ndarray:
    """``base`` to each exponent, modulo ``MODULUS``."""
    out, factor, left = np.ones(len(exponents), np.int64), base % MODULUS, exponents.astype(np.int64)
    while left.any():
        out = np.where(left & 1, out * factor % MODULUS, out)
        factor, left = factor * factor % MODULUS, left >> 1
    return out


def _local(group: str, sums: Sequence[str], products: dict[str, int]):
    """Task function: rows sorted by group -> the same rows with what the task itself has seen of their group."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, current, opened = TaskContext.get().partitionId(), 0, None, True
        count, seen = 0, dict.fromkeys([*sums, *products], 0)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(group).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            goes_on = current is not None and keys[0] == current
            if current is not None and not goes_on:
                opened = False
            if not goes_on:
                count, seen = 0, dict.fromkeys(seen, 0)
            lengths = np.diff(np.append(first, n))
            idx = np.arange(n) - np.repeat(first, lengths)
            idx[: lengths[0]] += count
            open_rows = np.zeros(n, bool)
            open_rows[: lengths[0]] = opened
            out = {name: batch.column(name) for name in batch.schema.names}
            for name in (*sums, *products):
                values = batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)
                if name in products:
                    values = values % MODULUS * powers(products[name], idx) % MODULUS
                upto = np.cumsum(values)
                upto -= np.repeat(upto[first] - values[first], lengths)
                upto[: lengths[0]] += seen[name]
                before = upto - values
                if name in products:
                    upto, before = upto % MODULUS, before % MODULUS
                out[f"{name}_before"], out[f"{name}_upto"] = pa.array(before), pa.array(upto)
                seen[name] = int(upto[-1])
            count, current = int(idx[-1]) + 1, keys[-1]
            opened = opened and len(first) == 1
            out |= {
                "idx": pa.array(idx.astype(np.int64)), "part": pa.array(np.full(n, part, np.int32)),
                "at": pa.array(np.arange(at, at + n)), "open": pa.array(open_rows),
            }
            at += n
            yield pa.RecordBatch.from_pydict(out)

    return run


def grouped_scan(
    frame: DataFrame, group: str, order: Sequence[str | Column], sums: Sequence[str] = (), products: dict[str, int] | None = None
) -> DataFrame:
    """``frame`` with ``idx``, the place of a row in its group (from 0), and running values.

    ``sums``: columns with ``<name>_before`` and ``<name>_upto``, the sum without and with
    the row. ``products``: columns with a base; the same names hold the sum of value *
    base^idx modulo ``MODULUS``. ``group`` is a bigint without nulls; ``order`` must tell
    all rows of a group apart, or what it leaves equal must be equal. An empty table gives
    an empty result. The rows are written to the shared folder once.
    """
    products = products or {}
    spark, names = frame.sparkSession, [*sums, *products]
    kinds = [f for f in frame.schema.fields]
    kinds += [T.StructField(f"{n}_{w}", T.LongType()) for n in names for w in ("before", "upto")]
    kinds += [T.StructField("idx", T.LongType()), T.StructField("part", T.IntegerType())]
    kinds += [T.StructField("at", T.LongType()), T.StructField("open", T.BooleanType())]
    dealt = frame.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    local = stored(dealt.mapInArrow(_local(group, sums, products), T.StructType(kinds)), "scan")

    last = F.max_by(F.struct("at", F.col(group).alias("last"), "idx", "open", *[f"{n}_upto" for n in names]), "at")
    ends = local.groupBy("part").agg(F.min(group).alias("first"), last.alias("end")).orderBy("part").collect()
    carried, state = [], (None, 0, dict.fromkeys(names, 0))
    for part, first, end in ends:
        if state[0] != first:
            state = (first, 0, dict.fromkeys(names, 0))
        _, length, values = state
        if length:
            carried.append((part, length, *[values[n] for n in names], *[pow(products[n], length, MODULUS) for n in products]))
        here = {n: end[f"{n}_upto"] for n in names}
        if end["open"]:  # one group fills the task: it goes on
            here = {
                n: (values[n] + pow(products[n], length, MODULUS) * here[n]) % MODULUS if n in products else values[n] + here[n]
                for n in names
            }
            length += end["idx"] + 1
        else:
            length = end["idx"] + 1
        state = (end["last"], length, here)
    schema = ", ".join(["part int", "_n bigint", *[f"_c_{n} bigint" for n in names], *[f"_p_{n} bigint" for n in products]])
    carry = spark.createDataFrame(carried, schema)  # at most one row per task
    met = local.join(F.broadcast(carry), "part", "left")
    on = F.col("open") & F.col("_n").isNotNull()
    out = [F.col(f"`{c}`") for c in frame.columns]
    out.append((F.col("idx") + F.when(on, F.col("_n")).otherwise(0)).alias("idx"))
    for n in names:
        for which in ("before", "upto"):
            value = F.col(f"{n}_{which}")
            if n in products:
                moved = F.pmod(F.col(f"_c_{n}") + F.col(f"_p_{n}") * value, F.lit(MODULUS))
            else:
                moved = F.col(f"_c_{n}") + value
            out.append(F.when(on, moved).otherwise(value).alias(f"{n}_{which}"))
    return met.select(*out)


def join_counted(
    rows: DataFrame, keyed: DataFrame, on: Sequence[str], count: str, total: int, how: str = "inner"
) -> DataFrame:
    """``rows`` joined to ``keyed``, which has each key once and in ``count`` how many of ``rows`` have it.

    Keys of a thousandth of all rows or more, at most ``HEAVY`` since the counts add up to
    ``total``, are broadcast, so no task gets their rows; the rest are exchanged by key.
    ``rows`` should be a written table, as it is read twice.
    """
    heavy = F.col(count) * HEAVY >= F.lit(total)
    some = keyed.filter(heavy).withColumn("_heavy", F.lit(True))
    met = rows.join(F.broadcast(some), list(on), "left")
    rest = met.filter(F.col("_heavy").isNull()).select(*rows.columns).join(keyed.filter(~heavy), list(on), how)
    return met.filter("_heavy").drop("_heavy").unionByName(rest)
