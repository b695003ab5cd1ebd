"""Near duplicates among vectors by search in a robust-pruned graph.

Vectors go to shards around the nearest few of a bounded number of centres. In each shard a
graph is built; what a vector's neighbours are is the union over its shards. Each shard is
then searched with its own vectors: a beam walks from the medoid, and whatever it finds
close by is widened through the graph until nothing new is close. A sample of vectors
compared with all others tells the recall, and more shards are used where it is too low.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dumpsieve.llm.graph import connected_components
from dumpsieve.llm.shared import stored


@dataclass(frozen=True)
class GraphSearch:
    cosine: float = 0.98
    slack: float = 0.05  # cosines so far below still lead on
    degree: int = 24
    alpha: float = 1.2
    beam: int = 32
    shard: int = 256  # vectors nearest to one centre; with all that overlap, a shard stays one block
    block: int = 2048  # vectors in one graph at most; larger shards are searched block by block
    centres: int = 4096  # over all labels; bounds what is broadcast
    sample: int = 20_000  # vectors that the centres are fitted on
    probes: tuple[int, ...] = (2, 4, 8)
    audit: int = 200  # classes compared with all others, and links that they must have together
    audit_rounds: int = 3  # each with eight times as many classes, while they have fewer links
    recall: float = 0.95


# ---------------------------------------------------------------- centres


def _drawn(vectors: DataFrame, rows: int, share_of: int, seed: int) -> DataFrame:
    """About so many rows, drawn by a hash of their class before their vectors are looked at."""
    share = min(1.0, rows / max(share_of, 1))
    return vectors.filter(F.pmod(F.xxhash64("cid", F.lit(seed)), F.lit(1 << 32)) < int(share * (1 << 32)))


def _fit_centres(vectors: DataFrame, options: GraphSearch) -> dict[tuple[str, int], np.ndarray]:
    """Centres per label and dimension, by a few rounds of spherical k-means on a bounded sample."""
    totals = vectors.groupBy("label", "dim").count().collect()
    rows = sum(r["count"] for r in totals)
    drawn = _drawn(vectors, options.sample, rows, 0).select("cid", "label", "dim", "unit").toPandas().sort_values("cid")
    centres = {}
    for total in totals:
        key = total["label"], int(total["dim"])
        own = drawn[(drawn["label"] == key[0]) & (drawn["dim"] == key[1])]
        k = int(np.clip(total["count"] / options.shard, 1, max(1, options.centres * total["count"] // rows)))
        if len(own) == 0 or k == 1:
            centres[key] = np.zeros((1, key[1]))
            continue
        x = np.stack(own["unit"].to_numpy())
        random = np.random.default_rng(len(x))
        middle = x[random.choice(len(x), min(k, len(x)), replace=False)]
        for _ in range(8):
            near = (x @ middle.T).argmax(1)
            sums = np.zeros_like(middle)
            np.add.at(sums, near, x)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            middle = np.where(size > 0, sums / np.maximum(size, 1e-12), middle)
        centres[key] = middle
    return centres


def _assigner(shared, probes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (label, dim), rows in batch.groupby(["label", "dim"]):
                middle = shared.value[(label, int(dim))]
                n = min(probes, len(middle))
                near = np.argsort(-(np.stack(rows["unit"].to_numpy()) @ middle.T), axis=1, kind="stable")[:, :n]
                out = rows.loc[rows.index.repeat(n)].copy()
                out["shard"] = near.ravel()
                # All shards of a vector, so that a pair can be counted in the first shard that both have.
                out["shards"] = [s for row in np.sort(near, axis=1).tolist() for s in [row] * n]
                yield out

    return run


# ---------------------------------------------------------------- graph of one block


def _pruned(x: np.ndarray, options: GraphSearch) -> list[np.ndarray]:
    """Neighbours of each vector: closest first, without those that a chosen one is much closer to."""
    n = len(x)
    distance = np.maximum(2 - 2 * (x @ x.T), 0)
    np.fill_diagonal(distance, np.inf)
    wide = min(n - 1, 3 * options.degree)
    if wide <= 0:
        return [np.empty(0, np.int64)] * n
    near = np.argpartition(distance, wide - 1, axis=1)[:, :wide]
    near = np.take_along_axis(near, np.argsort(np.take_along_axis(distance, near, 1), axis=1, kind="stable"), 1)
    out = []
    for i in range(n):
        left, chosen = near[i], []
        while len(left) and len(chosen) < options.degree:
            best = left[0]
            chosen.append(best)
            left = left[1:]
            left = left[options.alpha**2 * distance[best, left] > distance[i, left]]
        out.append(np.array(chosen, np.int64))
    back: list[list[int]] = [[] for _ in range(n)]
    for i, found in enumerate(out):
        for j in found:
            back[j].append(i)
    return [np.unique(np.concatenate([a, np.array(b[: 2 * options.degree], np.int64)])) for a, b in zip(out, back)]


def _builder(options: GraphSearch):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("cid").reset_index(drop=True)
        ids = group["cid"].to_numpy()
        found = _pruned(np.stack(group["unit"].to_numpy()), options)
        return pd.DataFrame({"cid": ids, "neighbours": [ids[f].tolist() for f in found]})

    return run


def _walk(q: np.ndarray, x: np.ndarray, graph: np.ndarray, start: int, options: GraphSearch) -> np.ndarray:
    """Beams of all queries at once from one start: the nearest nodes that greedy steps reach."""
    n, width = len(q), min(options.beam, len(x))
    rows = np.arange(n)[:, None]
    beam = np.full((n, width), -1)
    beam[:, 0] = start
    score = np.full((n, width), -np.inf)
    score[:, 0] = q @ x[start]
    expanded = np.zeros((n, len(x)), bool)
    for _ in range(4 * width):
        waiting = np.where((beam >= 0) & ~expanded[rows, np.maximum(beam, 0)], score, -np.inf)
        best = waiting.argmax(1)
        live = waiting[rows[:, 0], best] > -np.inf
        if not live.any():
            break
        at = rows[live, 0]
        node = beam[at, best[live]]
        expanded[at, node] = True
        new = graph[node]
        known = (new < 0) | (new[:, :, None] == beam[at][:, None, :]).any(2)
        close = np.where(known, -np.inf, np.einsum("qrd,qd->qr", x[np.maximum(new, 0)], q[at]))
        nodes, scores = np.concatenate([beam[at], new], 1), np.concatenate([score[at], close], 1)
        order = np.argsort(-scores, axis=1, kind="stable")[:, :width]
        beam[at], score[at] = np.take_along_axis(nodes, order, 1), np.take_along_axis(scores, order, 1)
        beam[at] = np.where(np.isfinite(score[at]), beam[at], -1)
    return beam


def _search(q: np.ndarray, x: np.ndarray, graph: np.ndarray, own: np.ndarray, options: GraphSearch) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) of at least the cosine asked for. ``own`` is a query's place among the nodes, or -1."""
    medoid = int((x @ x.mean(0)).argmax())
    beam = _walk(q, x, graph, medoid, options)
    low = options.cosine - options.slack
    seen = np.zeros((len(q), len(x)), bool)
    a, b = np.nonzero(beam >= 0)
    a, b = a, beam[a, b]
    mine = own >= 0
    a, b = np.concatenate([a, np.flatnonzero(mine)]), np.concatenate([b, own[mine]])
    found_a, found_b = [], []
    while len(a):
        fresh = np.zeros_like(seen)
        fresh[a, b] = True
        fresh &= ~seen
        seen |= fresh
        a, b = np.nonzero(fresh)
        near_a, near_b = [], []
        for at in range(0, len(a), 1 << 16):  # double precision, a bounded number at a time
            i, j = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
            cosine = np.einsum("nd,nd->n", q[i], x[j])
            hit, near = cosine >= options.cosine, cosine >= low
            found_a.append(i[hit])
            found_b.append(j[hit])
            near_a.append(np.repeat(i[near], graph.shape[1]))
            near_b.append(graph[j[near]].ravel())
        a, b = np.concatenate([a[:0], *near_a]), np.concatenate([b[:0], *near_b])
        a, b = a[b >= 0], b[b >= 0]
    return np.concatenate(found_a), np.concatenate(found_b)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Links that hold together what all links hold together."""
    parent = np.arange(n)

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    kept = []
    for i, j in zip(a.tolist(), b.tolist()):
        x, y = top(i), top(j)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((i, j))
    return kept


def _compared(q: np.ndarray, x: np.ndarray, options: GraphSearch) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (query, node) of at least the cosine asked for."""
    a, b = np.nonzero(q @ x.T >= options.cosine - 1e-9)
    hit = [np.empty(0, bool)]
    for at in range(0, len(a), 1 << 16):
        i, j = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
        hit.append(np.einsum("nd,nd->n", q[i], x[j]) >= options.cosine)
    hit = np.concatenate(hit)
    return a[hit], b[hit]


def _searcher(options: GraphSearch, exact: bool):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        shard, query_block, node_block = key[2], key[3], key[4]
        group = group.sort_values("cid").reset_index(drop=True)
        nodes, queries = group[group["block"] == node_block], group[group["block"] == query_block]
        node_ids, query_ids = nodes["cid"].to_numpy(), queries["cid"].to_numpy()
        x, q = np.stack(nodes["unit"].to_numpy()), np.stack(queries["unit"].to_numpy())
        flat = np.concatenate([np.asarray(v, np.int64) for v in nodes["neighbours"]]) if len(nodes) else np.empty(0, np.int64)
        degrees = np.array([len(v) for v in nodes["neighbours"]])
        place = np.searchsorted(node_ids, flat)
        inside = (place < len(node_ids)) & (node_ids[np.minimum(place, len(node_ids) - 1)] == flat)
        owner = np.repeat(np.arange(len(nodes)), degrees)[inside]
        degrees = np.bincount(owner, minlength=len(nodes))
        graph = np.full((len(nodes), max(1, degrees.max(initial=0))), -1)
        graph[owner, np.arange(len(owner)) - (np.cumsum(degrees) - degrees)[owner]] = place[inside]
        own = np.arange(len(nodes)) if query_block == node_block else np.full(len(queries), -1)
        a, b = _compared(q, x, options) if exact else _search(q, x, graph, own, options)
        ia, ib = query_ids[a], node_ids[b]
        pairs = np.unique(np.stack([np.minimum(ia, ib), np.maximum(ia, ib)])[:, ia != ib], axis=1)
        # Place of both in the group; a pair counts in the first shard that both are in.
        ids = group["cid"].to_numpy()
        a, b = np.searchsorted(ids, pairs[0]), np.searchsorted(ids, pairs[1])
        width = max(map(len, group["shards"]))
        shards = np.stack([np.pad(np.asarray(s), (0, width - len(s)), constant_values=-1) for s in group["shards"]])
        shared = np.full(len(a), np.iinfo(np.int64).max)
        for k in range(width):
            mine = shards[a, k]
            both = (mine >= 0) & (shards[b] == mine[:, None]).any(1)
            shared = np.where(both, np.minimum(shared, mine), shared)
        counted = shared == shard
        a, b = a[counted], b[counted]
        weight = group["copies"].to_numpy()
        links = np.bincount(a, weights=weight[b], minlength=len(ids)) + np.bincount(b, weights=weight[a], minlength=len(ids))
        peers = np.bincount(a, minlength=len(ids)) + np.bincount(b, minlength=len(ids))
        some = np.flatnonzero(peers)
        kept = np.array(_forest(a, b, len(ids)), np.int64).reshape(-1, 2)
        return pd.DataFrame({
            "a": np.concatenate([ids[some], ids[kept[:, 0]]]),
            "b": np.concatenate([ids[some], ids[kept[:, 1]]]),
            "links": np.concatenate([links[some].astype(np.int64), np.zeros(len(kept), np.int64)]),
            "peers": np.concatenate([peers[some], np.zeros(len(kept), np.int64)]),
        })

    return run


# ---------------------------------------------------------------- the whole


def _unit(values: list | None) -> np.ndarray | None:
    """The vector at length one, or None where it has no direction."""
    x = np.array(values or [], np.float64)  # null components become NaN
    peak = np.abs(x).max(initial=0)
    if not np.isfinite(peak) or peak == 0:
        return None
    x = x / peak  # first, so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum()) + 0.0


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels = batch.column("label").to_pylist()
        units = [None if label is None else _unit(v) for label, v in zip(labels, batch.column("vector").to_pylist())]
        keys = [None if u is None else hashlib.md5(f"{label}:".encode() + u.tobytes()).digest() for label, u in zip(labels, units)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("label"), pa.array(units, pa.list_(pa.float64())), pa.array(keys, pa.binary())],
            names=["vec_id", "label", "unit", "key"],
        )


def _classes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """All rows with the key of their class, and one row per class of equal vectors with equal labels."""
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    ).mapInArrow(_units, "vec_id long, label string, unit array<double>, key binary")
    rows = stored(rows, "vectors")
    classes = rows.filter("unit IS NOT NULL").groupBy("key", "label").agg(
        F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("unit").alias("unit")
    )
    classes = classes.withColumn("dim", F.size("unit")).withColumn("cid", F.monotonically_increasing_id())
    return rows, stored(classes, "classes")


def _linked(classes: DataFrame, centres, probes: int, options: GraphSearch, exact: bool = False) -> DataFrame:
    """(a, b, links, peers): with a = b the links of a class, weighted by copies and not, else a link of the forest.

    If ``exact``, each block of a shard is compared with each other.
    """
    vectors = classes.select("cid", "label", "dim", "copies", "unit")
    kinds = "cid long, label string, dim int, copies long, unit array<double>"
    placed = stored(
        vectors.mapInPandas(_assigner(centres, probes), f"{kinds}, shard long, shards array<long>"), "placed"
    )
    # One row per shard: at most as many as there are centres.
    sizes = placed.groupBy("label", "dim", "shard").agg(F.ceil(F.count("*") / options.block).alias("blocks"))
    placed = placed.join(F.broadcast(sizes), ["label", "dim", "shard"])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    if exact:
        placed = placed.withColumn("neighbours", F.array().cast("array<long>"))
    else:
        built = placed.groupBy("label", "dim", "shard", "block").applyInPandas(_builder(options), "cid long, neighbours array<long>")
        union = built.groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours"))
        placed = placed.join(union, "cid")
    # A block of queries meets each block of nodes of its shard once.
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = placed.withColumn("other", other)
    dealt = dealt.withColumn("query_block", F.least("block", "other")).withColumn("node_block", F.greatest("block", "other"))
    dealt = dealt.drop("other", "blocks")
    found = dealt.groupBy("label", "dim", "shard", "query_block", "node_block").applyInPandas(
        _searcher(options, exact), "a long, b long, links long, peers long"
    )
    return stored(found, "found")


def _audit(classes: DataFrame, options: GraphSearch) -> dict[int, int]:
    """Links of a bounded sample of classes, compared with all others.

    More classes are drawn while those drawn have too few links to tell a recall by.
    """
    spark = classes.sparkSession
    rows, size = classes.count(), options.audit
    for _ in range(options.audit_rounds):
        asked = _drawn(classes, size, rows, 1).select("cid", "label", "dim", "unit").toPandas()
        shared = spark.sparkContext.broadcast(
            {k: (g["cid"].to_numpy(), np.stack(g["unit"].to_numpy())) for k, g in asked.groupby(["label", "dim"])}
        )

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for key, rows in batch.groupby(["label", "dim"]):
                    if key in shared.value:
                        ids, q = shared.value[key]
                        hit = np.stack(rows["unit"].to_numpy()) @ q.T >= options.cosine
                        hit &= rows["cid"].to_numpy()[:, None] != ids
                        yield pd.DataFrame({"cid": ids, "n": hit.sum(0)})

        vectors = classes.select("cid", "label", "dim", "unit")
        true = vectors.mapInPandas(run, "cid long, n long").groupBy("cid").agg(F.sum("n").alias("n")).toPandas()
        if true["n"].sum() >= options.audit or size >= rows:
            break
        size *= 8
    return dict(zip(true["cid"].tolist(), true["n"].tolist()))


def _recall(true: dict[int, int], found: DataFrame) -> float:
    """Share of the links of the audited classes that the search has found. A link of two classes counts
    once, whatever their copies; 1 if there is no link."""
    total = sum(true.values())
    mine = found.filter("a = b").join(
        F.broadcast(found.sparkSession.createDataFrame(list(true.items()), "a long, n long").select("a")), "a"
    )
    return float(mine.agg(F.sum("peers")).first()[0] or 0) / total if total else 1.0


def near_vectors(
    vectors: DataFrame, options: GraphSearch = GraphSearch(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors of equal labels (compared as text) and dimensions are linked if their cosine in double precision reaches
    ``cosine``. Null, empty and zero vectors, those with a null or non-finite component and those without
    a label are linked with nothing. Equal vectors are one class, and each of its rows links with
    the others. A null id is kept only where its component has no other id. An empty table gives an
    empty result; other columns are not read. Every pair counted is verified; the recall of a sample against all
    rows is measured, and shards overlap more until it reaches ``recall``; where the widest search does not,
    all vectors of equal labels and dimensions are compared, block by block.
    """
    rows, classes = _classes(vectors, id_col, vector_col, label_col)
    centres = vectors.sparkSession.sparkContext.broadcast(_fit_centres(classes, options))
    true = _audit(classes, options)
    for probes in options.probes:
        found = _linked(classes, centres, probes, options)
        if _recall(true, found) >= options.recall:
            break
    else:
        one = {key: np.zeros((1, key[1])) for key in centres.value}
        found = _linked(classes, vectors.sparkSession.sparkContext.broadcast(one), 1, options, exact=True)
    components = connected_components(found.filter("a != b").select("a", "b"))
    links = found.filter("a = b").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    named = classes.select("key", "cid", "vec_id", "copies").join(links, "cid", "left").join(
        components.select(F.col("node").alias("cid"), "component"), "cid", "left"
    ).withColumn("component", F.coalesce("component", "cid"))
    smallest = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    named = named.join(smallest, "component").select(
        "key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    out = rows.select("vec_id", F.when(F.col("unit").isNotNull(), F.col("key")).alias("key")).join(named, "key", "left")
    component = F.when(F.col("key").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
