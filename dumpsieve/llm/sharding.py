"""Shards by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dumpsieve.llm.scan import grouped_scan
from dumpsieve.llm.shared import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LAWS = ("rows", "bytes", "key")


def ring(shards: int, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all virtual nodes in rising order, and the shard of each."""
    each = [
        (int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big") >> 1, s)
        for s in range(shards) for v in range(nodes)
    ]
    each.sort()
    return np.array([p for p, _ in each], np.int64), np.array([s for _, s in each], np.int64)


def capacities(total: int, shards: int, law: str) -> np.ndarray:
    if law == "key":
        return np.full(shards, total, np.int64)
    if law == "rows":
        return total // shards + (np.arange(shards) < total % shards)
    return np.full(shards, -(-total // shards), np.int64)


def place(load: np.ndarray, owner: np.ndarray, room: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Pieces (arc, from, amount, shard) of the loads of all arcs.

    ``load[i]`` is what lies in front of node ``i``; the last entry is what lies behind the
    last node and goes to the first one. First every arc offers its load to the node it
    ends at, arcs in the order of the ring; what a full shard refuses goes on to the next
    node clockwise, and so on, until all is placed.
    """
    nodes, room = len(owner), room.copy()
    left, used, pieces, hop = load.copy(), np.zeros_like(load), [], 0
    while left.any():
        arcs = np.flatnonzero(left)
        shard = owner[(arcs + hop) % nodes]
        order = np.argsort(shard, kind="stable")
        arcs, shard = arcs[order], shard[order]
        want = left[arcs]
        before = np.cumsum(want) - want
        first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
        before -= np.repeat(before[first], np.diff(np.append(first, len(arcs))))
        got = np.clip(room[shard] - before, 0, want)
        there = np.flatnonzero(got)
        pieces += zip(arcs[there].tolist(), used[arcs[there]].tolist(), got[there].tolist(), shard[there].tolist())
        used[arcs] += got
        left[arcs] -= got
        np.subtract.at(room, shard, got)
        hop += 1
    return pieces


def shard_documents(
    docs: DataFrame, shards: int = 24, law: str = "rows", nodes: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A document's key is its id, hashed onto a ring on which every shard has ``nodes``
    places. It belongs to the first place clockwise; a shard that is full sends it on to
    the next place of a shard with room. ``law`` says what fills a shard: ``rows`` (all
    shards hold the same number of rows, or one less), ``bytes`` (an equal share of all
    bytes; a document belongs where its first byte lies, so a shard may exceed its share
    by the ends of documents) or ``key`` (nothing: the id and the number of shards decide
    alone, and ``grown_shard`` is the shard among one more). Of keys that meet a full
    shard, those later on the ring go on.

    ``size`` is the text's UTF-8 bytes and 8 more; ``slot`` numbers a shard's rows from 0
    in the order of the ring. Null text counts as empty. Null ids are one key, rows that
    repeat an id are told apart by their place in the table, so a key of any number of
    rows is dealt like the rest. Texts of any length are read once and never moved. An
    empty table gives an empty result; other columns are not read.

    Only ids, sizes and places on the ring are exchanged. The driver gets one row per arc,
    piece and task: bounded by the ring and the tasks, whatever the table holds.
    """
    if law not in LAWS:
        raise ValueError(f"law must be one of {', '.join(LAWS)}")
    if shards < 1 or nodes < 1:
        raise ValueError("a ring needs shards and nodes")
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.col(id_col).cast("long")
    rows = docs.select(
        key.alias("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("row"),
        F.shiftrightunsigned(F.xxhash64(key), 1).alias("place"), F.lit(0).cast("long").alias("all"),
    )
    weight = F.col("size") if law == "bytes" else F.lit(1).cast("long")
    rows = stored(rows.withColumn("weight", weight), "shard-keys")
    # Rank and bytes in front of each row, in the order of the ring.
    on_ring = stored(grouped_scan(rows, "all", ["place", "row"], sums=["weight"]), "ring")

    places, owner = ring(shards, nodes)

    @F.pandas_udf("long")
    def arc(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(places, place.to_numpy()))

    load = np.zeros(shards * nodes + 1, np.int64)
    for i, amount in on_ring.groupBy(arc("place").alias("arc")).agg(F.sum("weight")).collect():
        load[i] = amount
    base = np.cumsum(load) - load
    pieces = sorted((int(base[a]) + begin, s) for a, begin, _, s in place(load, owner, capacities(int(load.sum()), shards, law)))
    begins = np.array([b for b, _ in pieces], np.int64)
    piece_shard = np.array([s for _, s in pieces], np.int64)

    @F.pandas_udf("long")
    def piece(before: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(begins, before.to_numpy(), "right") - 1)

    # A piece is a run of rows; a shard's slots go through its pieces.
    first, held = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
    for i, start, n in on_ring.groupBy(piece("weight_before").alias("p")).agg(F.min("idx"), F.count("*")).collect():
        first[i], held[i] = start, n
    slot_of = np.zeros(len(pieces), np.int64)
    for s in range(shards):
        own = np.flatnonzero(piece_shard == s)
        slot_of[own] = np.cumsum(held[own]) - held[own] - first[own]

    more_places, more_owner = ring(shards + 1, nodes)

    @F.pandas_udf("shard int, slot long, grown int")
    def where(before: pd.Series, idx: pd.Series, place: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(begins, before.to_numpy(), "right") - 1
        grown = more_owner[np.searchsorted(more_places, place.to_numpy()) % len(more_places)]
        return pd.DataFrame({"shard": piece_shard[at], "slot": slot_of[at] + idx.to_numpy(), "grown": grown})

    grown = F.col("to.grown") if law == "key" else F.lit(None).cast("int")
    return on_ring.withColumn("to", where("weight_before", "idx", "place")).select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"),
        F.col("to.shard").alias("shard"), F.col("to.slot").alias("slot"), grown.alias("grown_shard"),
    )
