"""The trie of conversations that share their beginnings, from fingerprints that compose."""

from __future__ import annotations

import hashlib
import itertools
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dumpsieve.llm.scan import MODULUS, grouped_scan, join_counted
from dumpsieve.llm.shared import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Four polynomials modulo 2^31 - 1: the bases and their inverses.
_BASES = (1_103_515_245, 1_664_525 * 7, 69_069 * 11, 214_013 * 13)
_INVERSES = tuple(pow(b, -1, MODULUS) for b in _BASES)
_PARTS = tuple(f"t{j}" for j in range(4))
_KEY = ("depth", "a", "b")
_ID_CHARS = 1 << 18


@dataclass(frozen=True)
class Family:
    """Conversation c is rebuilt on the first ``head`` turns of conversation c - c % ``size``."""

    size: int = 5
    heads: int = 9

    def head(self, conv: Column) -> Column:
        """From 0 to ``heads`` - 1, by the id alone."""
        return (F.crc32(conv.cast("string").cast("binary")) % self.heads).cast("int")


@dataclass(frozen=True)
class Trie:
    """``nodes``: one row per node; ``ends``: (depth, a, b, conv), one row per conversation, at the node where
    it ends; ``turns``: what ``turn_ref`` of a node refers to (row, role, text)."""

    nodes: DataFrame
    ends: DataFrame
    turns: DataFrame


def _turn_hash(seed: int, bits: int) -> Column:
    hashed = F.xxhash64(F.lit(seed), "role", "text")
    return hashed.bitwiseAND((1 << bits) - 1) if bits < 62 else F.shiftrightunsigned(hashed, 2)


def _table(base: int, size: int, exponent: Column) -> Column:
    """base^exponent for a small exponent."""
    return F.element_at(F.array(*[F.lit(pow(base, i, MODULUS)).cast("long") for i in range(size)]), exponent + 1)


def _mod(x: Column) -> Column:
    return F.pmod(x, F.lit(MODULUS))


def _packed(values: list[Column]) -> tuple[Column, Column]:
    return F.shiftleft(values[0], 31) + values[1], F.shiftleft(values[2], 31) + values[3]


def _same_text(turns: DataFrame, total: int) -> bool:
    """Whether turns of equal hashes are equal: those that share theirs are compared with the first of them."""
    shared = turns.groupBy("h1", "h2").agg(F.min("row").alias("ref"), F.count("*").alias("n")).filter("n > 1")
    shared = stored(shared, "shared-turns")
    if shared.isEmpty():
        return True
    met = stored(join_counted(turns.select("row", "h1", "h2", "role", "text"), shared, ["h1", "h2"], "n", total), "same-turns")
    first = met.filter("row = ref").select("ref", F.col("role").alias("role_ref"), F.col("text").alias("text_ref"))
    # Not broadcast: texts may be long. A hot text's rows are split by Spark where the join is skewed.
    pairs = met.filter("row <> ref").join(first.hint("merge"), "ref")
    return pairs.filter((F.col("role") != F.col("role_ref")) | (F.col("text") != F.col("text_ref"))).isEmpty()


def prefix_trie(conversations: DataFrame, family: Family = Family(), bits: int = 62) -> Trie:
    """The trie of all rebuilt conversations; ``nodes`` has the columns conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, turn_ref and the node's key (a, b).

    A conversation's turns are ordered by ``turn`` (null first; equal numbers by role, then
    by a hash of the text), null role or text is empty. Conversation c is rebuilt as the
    first turns of its family's base (none if that is absent) and its own behind as many.
    Rows without conv_id belong to no conversation. A repeated row is a turn of its own.
    An empty table has no node; other columns are not read.

    No rebuilt text exists anywhere: a turn is a hash, a run of turns is a polynomial of
    hashes, and the fingerprint of a rebuilt beginning is that of the base's head composed
    with that of its own turns, the latter by dividing its head off. Nodes are the groups
    of equal fingerprints. Each is verified: all its members refer to turns of one hash,
    and stored turns of one hash are compared as texts, so by induction over the depth the
    whole beginnings are equal. If anything differs, all is done again under another seed
    with more ``bits`` of hash.

    Conversations of any length are numbered and multiplied out by many tasks
    (:func:`grouped_scan`); sums over a subtree are sums over members, since the nodes
    that a conversation is the smallest member of are the lower end of its path.
    """
    for attempt in itertools.count():
        trie = _build(conversations, family, attempt, min(62, bits << attempt))
        if trie is not None:
            return trie


def _build(conversations: DataFrame, family: Family, seed: int, bits: int) -> Trie | None:
    spark = conversations.sparkSession
    clean = conversations.select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    ).filter("conv IS NOT NULL")
    hashes = [_turn_hash(2 * seed + k, bits).alias(f"h{k + 1}") for k in range(2)]
    turns = stored(clean.select("*", *hashes, F.octet_length("text").cast("long").alias("bytes")), "turns")
    total = turns.count()
    if not _same_text(turns, total):
        return None

    halves = [F.col("h1"), F.shiftright("h1", 31), F.col("h2"), F.shiftright("h2", 31)]
    narrow = turns.select(
        "conv", "turn", "role", "row", "h1", "h2", "bytes",
        *[x.bitwiseAND(MODULUS).alias(t) for x, t in zip(halves, _PARTS)],
    )
    order = [F.col("turn").asc_nulls_first(), "role", "h1", "h2", "row"]
    products = dict(zip(_PARTS, _BASES))
    own = stored(grouped_scan(narrow, "conv", order, products=products).drop("turn", "role", *_PARTS), "own-turns")

    # Per conversation: how many turns, and what stands at its first few of them.
    heads = family.heads
    upto = [f"{t}_upto" for t in _PARTS]
    early = F.when(F.col("idx") < heads, F.struct("idx", "row", "h1", "h2", "bytes", *upto))
    convs = own.groupBy("conv").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(early)).alias("heads"))
    convs = stored(convs, "convs")
    mine = convs.withColumn("base", F.col("conv") - F.col("conv") % family.size)
    bases = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"), F.col("heads").alias("base_heads"))
    alone = F.col("base") == F.col("conv")
    params = mine.join(bases, "base", "left").select(
        "conv", "n", "heads", "base_heads",
        F.when(alone, 0).otherwise(F.least(family.head(F.col("conv")), F.coalesce("base_n", F.lit(0)))).cast("int").alias("k"),
        F.when(alone, 0).otherwise(family.head(F.col("conv"))).cast("int").alias("skip"),
    )
    zero = F.lit(0).cast("long")
    params = stored(params.select(
        "conv", "n", "k", "skip", (F.col("k") + F.greatest(F.col("n") - F.col("skip"), zero)).alias("length"),
        F.slice("base_heads", F.lit(1), F.col("k")).alias("head"),
        *[F.coalesce(F.get("base_heads", F.col("k") - 1)[u], zero).alias(f"k_{u}") for u in upto],
        *[F.coalesce(F.get("heads", F.col("skip") - 1)[u], zero).alias(f"s_{u}") for u in upto],
    ), "families")

    # The rebuilt conversations, one narrow row per turn: the head's from the base ...
    head = params.select("conv", "length", F.posexplode("head").alias("i", "at"), F.col("head"))
    here = [F.col("at")[u] for u in upto]
    above = [F.coalesce(F.get("head", F.col("i") - 1)[u], zero) for u in upto]
    head = head.select(
        "conv", "length", (F.col("i") + 1).cast("long").alias("depth"), *_named(here, above),
        F.col("at.h1").alias("h1"), F.col("at.h2").alias("h2"), F.col("at.row").alias("ref"), F.col("at.bytes").alias("bytes"),
    )
    # ... and its own turns behind: composed with the head, without what it leaves out.
    kept = params.filter("n > skip").drop("head")
    rest = join_counted(own, kept, ["conv"], "n", total).filter("idx >= skip")

    def composed(which: str) -> list[Column]:
        out = []
        for t, base, inverse in zip(_PARTS, _BASES, _INVERSES):
            suffix = _mod(F.col(f"{t}_{which}") - F.col(f"s_{t}_upto")) * _table(inverse, heads, F.col("skip"))
            out.append(_mod(F.col(f"k_{t}_upto") + _mod(suffix) * _table(base, heads, F.col("k"))))
        return out

    depth = (F.col("k") + F.col("idx") - F.col("skip") + 1).cast("long")
    rest = rest.select(
        "conv", "length", depth.alias("depth"), *_named(composed("upto"), composed("before")),
        "h1", "h2", F.col("row").alias("ref"), "bytes",
    )
    path = stored(head.unionByName(rest), "paths")
    n_path = path.count()

    groups = path.groupBy(*_KEY).agg(
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b"),
        (F.min("h1") == F.max("h1")).alias("same1"), (F.min("h2") == F.max("h2")).alias("same2"),
        F.min("ref").alias("turn_ref"), F.min("bytes").alias("bytes"),
    )
    groups = stored(groups, "prefixes")
    if not groups.filter("NOT (same1 AND same2)").isEmpty():
        return None
    below = groups.groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(
        F.count("*").alias("n_children")
    )
    nodes = groups.join(below, list(_KEY), "left").select(
        *_KEY, "conv_id", "n_convs", "up_a", "up_b", "turn_ref", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
    )
    # The nodes of which a conversation is the smallest member lie below each other.
    nodes = stored(grouped_scan(nodes, "conv_id", ["depth"], sums=["saved"]).drop("idx"), "nodes")
    chains = nodes.groupBy("conv_id").agg(F.sum("saved").alias("chain"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    chains = stored(params.select(F.col("conv"), "length").join(chains.withColumnRenamed("conv_id", "conv"), "conv"), "chains")
    members = join_counted(path.select("conv", *_KEY), chains, ["conv"], "length", n_path)
    members = members.groupBy(*_KEY).agg(F.sum("chain").alias("chains"), F.sum("leaf").alias("n_leaves"))

    n_nodes = nodes.count()
    parents = nodes.filter("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"),
        F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"),
    )
    deep = join_counted(nodes.filter("depth > 1"), parents, ["depth", "up_a", "up_b"], "n", n_nodes).drop("n")
    least, n_convs = params.agg(F.min("conv"), F.count("*")).first()
    n_top, n_leaves, saved = nodes.agg(
        F.count_if(F.col("depth") == 1), F.count_if(F.col("n_children") == 0), F.sum("saved")
    ).first()
    top = nodes.filter("depth = 1").withColumn("parent_conv_id", F.lit(least).cast("long"))
    # Ancestors have all of a member's chain below them but for what the owner's own chain has above the node.
    found = deep.unionByName(top).join(members, list(_KEY)).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("chains") - F.col("saved_before")).alias("saved_tokens"), "turn_ref", "a", "b",
    )
    root = [(least, 0, None, n_convs, n_top, n_leaves or 1, saved or 0, None, 0, 0)] if n_convs else []
    found = found.unionByName(spark.createDataFrame(root, found.schema))
    ends = path.filter("depth = length").select(*_KEY, "conv").unionByName(
        params.filter("length = 0").select(*[zero.alias(k) for k in _KEY], "conv")
    )
    return Trie(found, ends, turns.select("row", "role", "text"))


def _named(here: list[Column], above: list[Column]) -> list[Column]:
    return [c.alias(name) for c, name in zip((*_packed(here), *_packed(above)), ("a", "b", "up_a", "up_b"))]


def _id_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: ids sorted by node -> runs of them as text."""
    key, first, ids, size = None, 0, [], 0

    def run():
        return pa.RecordBatch.from_pylist([dict(zip((*_KEY, "first", "ids"), (*key, first, ",".join(ids))))], _RUN)

    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in (*_KEY, "conv")]):
            if row[:3] != key or size > _ID_CHARS:
                if key is not None:
                    yield run()
                key, first, ids, size = row[:3], row[3], [], 0
            ids.append(str(row[3]))
            size += len(ids[-1]) + 1
    if key is not None:
        yield run()


_RUN = pa.schema([(k, pa.int64()) for k in (*_KEY, "first")] + [("ids", pa.string())])
_DIGEST = pa.schema([(k, pa.int64()) for k in _KEY] + [("ends_sha256", pa.string())])


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: runs of ids sorted by node and first id -> the digest of each node's whole list."""
    key, digest, out = None, None, []
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in (*_KEY, "ids")]):
            if row[:3] != key:
                if key is not None:
                    out.append((*key, digest.hexdigest()))
                key, digest = row[:3], hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(row[3].encode())
        if len(out) > 10_000:
            yield pa.RecordBatch.from_pylist([dict(zip(_DIGEST.names, r)) for r in out], _DIGEST)
            out = []
    if key is not None:
        out.append((*key, digest.hexdigest()))
    yield pa.RecordBatch.from_pylist([dict(zip(_DIGEST.names, r)) for r in out], _DIGEST)


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256): SHA-256 of the ids that end at a node, in rising order, joined by commas.

    Many tasks turn ranges of a node's ids into text; the task of the node hashes these
    runs one after the other and never holds the list.
    """
    runs = ends.repartitionByRange(*_KEY, "conv").sortWithinPartitions(*_KEY, "conv").mapInArrow(
        _id_runs, "depth long, a long, b long, first long, ids string"
    )
    dealt = runs.repartition(*_KEY).sortWithinPartitions(*_KEY, "first")
    return dealt.mapInArrow(_digests, "depth long, a long, b long, ends_sha256 string")


def trie_report(trie: Trie) -> DataFrame:
    """The nodes with the digest of what ends there instead of keys and references."""
    nothing = hashlib.sha256().hexdigest()
    return trie.nodes.join(end_digests(trie.ends), list(_KEY), "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )
