"""Approximate nearest neighbours by a hierarchical navigable small-world graph for each shard (Malkov and Yashunin, 2016).

Equal vectors are one node that holds the smallest k + 1 of their ids, all that an answer can need, so
every row is indexed and a large group of copies costs one node. Nodes are dealt over shards of about
`shard_rows` by a hash. A shard's graph is stored as flat arrays: nodes stand by falling level, so that
layer l holds the first nodes and its neighbours are one matrix of node numbers. Building and searching
take batches of vectors in step: each beam expands its best open nodes until none is left.

A query goes to every shard of its width, in chunks of bounded size, and the shards' answers are merged
by distance. Graphs only choose candidates; distances come from the vectors as given, in double precision.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a
null id, take no part; vectors of different width never meet; queries that repeat id and vector are one,
repeats of the id with other vectors are queries of their own; a row is never found by its own query,
another row with its id may be; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duoscope.llm.common import checkpointed, to_each_task


def distances(x: np.ndarray, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of each row of q to its own row of node numbers."""
    near = x[ids]
    return np.einsum("bcd,bcd->bc", near, near) - 2 * np.einsum("bcd,bd->bc", near, q) + np.einsum("bd,bd->b", q, q)[:, None]


def beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, ef: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The ef nodes found nearest to each row of q, nearest first (-1 where there are fewer), and their squared distances.

    start: node numbers to begin with, -1 for none. Each step expands the best `width` open nodes of a beam.
    """
    b = np.arange(len(q))[:, None]
    seen = np.full((len(q), len(links) + 1), -1, np.int32)  # the last column takes what stands for none
    ids, dist = np.full((len(q), ef), -1, np.int32), np.full((len(q), ef), np.inf, x.dtype)
    open_ = np.zeros((len(q), ef), bool)
    new = start
    while True:
        at = np.broadcast_to(np.arange(new.shape[1], dtype=np.int32), new.shape)
        fresh = (new >= 0) & (seen[b, new] < 0)
        seen[b, np.where(fresh, new, -1)] = at
        fresh &= seen[b, new] == at  # of a node that comes twice, one
        d = np.where(fresh, distances(x, np.where(fresh, new, 0), q), np.inf).astype(x.dtype)
        all_d = np.concatenate([dist, d], axis=1)
        best = np.argsort(all_d, axis=1, kind="stable")[:, :ef]
        dist = np.take_along_axis(all_d, best, 1)
        ids = np.where(np.isfinite(dist), np.take_along_axis(np.concatenate([ids, new], axis=1), best, 1), -1)
        open_ = np.take_along_axis(np.concatenate([open_, fresh], axis=1), best, 1) & (ids >= 0)
        first = np.argsort(~open_, axis=1, kind="stable")[:, :width]
        expand = np.where(np.take_along_axis(open_, first, 1), np.take_along_axis(ids, first, 1), -1)
        if (expand < 0).all():
            return ids, dist
        np.put_along_axis(open_, first, False, 1)
        new = np.where(expand[:, :, None] >= 0, links[expand], -1).reshape(len(q), -1)


def spread(x: np.ndarray, ids: np.ndarray, dist: np.ndarray, m: int) -> np.ndarray:
    """Of candidates by rising distance, up to m: first those nearer to the base than to any one chosen, then the nearest others."""
    near = x[np.maximum(ids, 0)]
    square = np.einsum("bcd,bcd->bc", near, near)
    between = square[:, :, None] + square[:, None, :] - 2 * near @ near.transpose(0, 2, 1)
    chosen, left = np.zeros(ids.shape, bool), np.full(len(ids), m)
    nearest = np.full(ids.shape, np.inf, x.dtype)
    for c in range(ids.shape[1]):
        take = (ids[:, c] >= 0) & (left > 0) & (dist[:, c] < nearest[:, c])
        chosen[:, c], left = take, left - take
        nearest = np.where(take[:, None], np.minimum(nearest, between[:, :, c]), nearest)
    order = np.argsort(np.where(ids < 0, 2, ~chosen), axis=1, kind="stable")[:, :m]
    return np.take_along_axis(ids, order, 1)


def entries(x: np.ndarray, layers: list[np.ndarray], q: np.ndarray, below: int, ef: int = 8) -> np.ndarray:
    """Where a search of the layer under `layers` (the top one first) starts; nodes from `below` on aren't there yet."""
    found = np.zeros((len(q), 1), np.int32)
    for links in layers:
        found = beam(x, links, q, found, ef, 1)[0]
    found = np.where(found < below, found, -1)
    return np.concatenate([found, np.zeros((len(q), 1), np.int32)], axis=1)


def layer(x: np.ndarray, n: int, above: list[np.ndarray], m: int, ef: int, batch: int) -> np.ndarray:
    """The neighbours, up to m, of the first n nodes among each other. Nodes come in batches that find candidates in what is linked so far, and among themselves."""
    links = np.full((n, m), -1, np.int32)
    done = 0
    while done < n:
        new = np.arange(done, min(n, done + min(batch, max(32, done))))
        own = distances(x, np.broadcast_to(new, (len(new), len(new))), x[new]).astype(x.dtype)
        np.fill_diagonal(own, np.inf)
        near = np.argsort(own, axis=1, kind="stable")[:, : min(ef, len(new) - 1)]
        ids, dist = new[near].astype(np.int32), np.take_along_axis(own, near, 1)
        if done:
            old, far = beam(x, links[:done], x[new], entries(x, above, x[new], done), ef)
            ids, dist = np.concatenate([old, ids], axis=1), np.concatenate([far, dist], axis=1)
        best = np.argsort(dist, axis=1, kind="stable")[:, :ef]
        ids, dist = np.take_along_axis(ids, best, 1), np.take_along_axis(dist, best, 1)
        made = spread(x, ids, dist, m // 2)
        links[new, : made.shape[1]] = made
        back(x, links, new, made, m)
        done = int(new[-1]) + 1
    return links


def back(x: np.ndarray, links: np.ndarray, new: np.ndarray, made: np.ndarray, m: int) -> None:
    """Links in the other direction; a node that has no room chooses anew."""
    source, target = np.repeat(new, made.shape[1])[made.ravel() >= 0], made.ravel()[made.ravel() >= 0]
    far = distances(x, source[:, None], x[target])[:, 0]
    order = np.lexsort((far, target))
    source, target = source[order], target[order]
    start = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])[: len(target)]
    rank = np.arange(len(target)) - np.repeat(start, np.diff(np.r_[start, len(target)]))
    nodes, row = np.unique(target, return_inverse=True)
    added = np.full((len(nodes), m), -1, np.int32)
    added[row[rank < m], rank[rank < m]] = source[rank < m]
    for at in range(0, len(nodes), 512):
        node = nodes[at : at + 512]
        ids = np.concatenate([links[node], added[at : at + 512]], axis=1)
        ids = np.where((ids[:, :, None] == ids[:, None, :]).argmax(2) == np.arange(ids.shape[1]), ids, -1)
        dist = np.where(ids >= 0, distances(x, np.maximum(ids, 0), x[node]), np.inf).astype(x.dtype)
        order = np.argsort(dist, axis=1, kind="stable")
        ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
        full = ids[:, m] >= 0
        links[node[~full]] = ids[~full, :m]
        if full.any():
            links[node[full]] = spread(x, ids[full], dist[full], m)


def scale(x: np.ndarray, size: float | None = None) -> np.ndarray:
    """The vectors over the largest entry, or over `size`, for distances in single precision; far beyond it, direction is all that counts."""
    with np.errstate(over="ignore"):
        return np.clip(x / (np.abs(x).max(initial=0.0) if size is None else size), -1e15, 1e15).astype(np.float32)


def build(x: np.ndarray, m: int = 16, ef: int = 64, batch: int = 256) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of the rows in the graph, and the neighbours of each layer's nodes, the top layer first."""
    draw = np.random.default_rng(len(x)).random(len(x))
    level = np.floor(-np.log(np.maximum(draw, 1e-12)) / math.log(m)).astype(int)
    order = np.argsort(-level, kind="stable")
    nodes, layers = scale(x)[order], []
    for at in range(int(level.max(initial=0)), -1, -1):
        layers.append(layer(nodes, int((level >= at).sum()), list(layers), m if at else 2 * m, ef, batch))
    return order, layers


def search(x: np.ndarray, layers: list[np.ndarray], q: np.ndarray, ef: int, batch: int = 128) -> np.ndarray:
    """Node numbers of the ef found nearest to each query (-1 where there are fewer); x and q scaled alike."""
    parts = [beam(x, layers[-1], q[at : at + batch], entries(x, layers[:-1], q[at : at + batch], len(x)), ef)[0] for at in range(0, len(q), batch)]
    return np.concatenate(parts) if parts else np.zeros((0, ef), np.int32)


def usable(vector: Column) -> Column:
    """Whether a vector is neither null, empty nor zero and all of its components are finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def stacked(column: pa.ChunkedArray, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def nearest(vectors: DataFrame, queries: Column, k: int = 10, shard_rows: int = 16_384, m: int = 16, ef_build: int = 64, ef_search: int = 160, chunk_queries: int = 32_768) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows found nearest to each row for which `queries` holds, by Euclidean distance, ties to the smaller id."""
    single = vectors.schema["embedding"].dataType.elementType.typeName() == "float"
    kind, cast = (np.dtype("<f4"), "array<float>") if single else (np.dtype("<f8"), "array<double>")
    given = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(cast)).filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    held = given.withColumn("nth", F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))).filter(F.col("nth") <= k + 1)
    nodes = checkpointed(held.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("width", F.size("embedding")))
    asked = checkpointed(given.filter(queries).distinct().select(F.col("vec_id").alias("query_id"), "embedding", F.size("embedding").alias("width"), F.monotonically_increasing_id().alias("of")))
    sizes = checkpointed(nodes.groupBy("width").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards")).join(asked.groupBy("width").agg(F.ceil(F.count("*") / chunk_queries).cast("int").alias("chunks")), "width"))
    sizes = to_each_task(sizes)

    def graph(group: pa.Table) -> pa.Table:
        x = np.stack(group.column("embedding").to_numpy()).astype(kind)
        order, layers = build(x.astype(np.float64), m, ef_build)
        ids = [group.column("ids")[int(i)].as_py() for i in order]
        flat = {"ids": np.array([i for own in ids for i in own], "<i8").tobytes(), "counts": np.array([len(own) for own in ids], "<i4").tobytes(), "vectors": x[order].tobytes()}
        return pa.table({"width": group.column("width")[:1], "shard": group.column("shard")[:1], **{c: pa.array([v], pa.binary()) for c, v in flat.items()}, "layers": pa.array([[np.ascontiguousarray(x, "<i4").tobytes() for x in layers]], pa.list_(pa.binary()))})

    index = nodes.join(sizes, "width").withColumn("shard", F.pmod(F.xxhash64("embedding"), F.col("shards")).cast("int"))
    index = checkpointed(index.select("width", "shard", "embedding", "ids").groupBy("width", "shard").applyInArrow(graph, "width int, shard int, ids binary, counts binary, vectors binary, layers array<binary>"))

    def find(key: tuple, shard: pa.Table, wanted: pa.Table) -> pa.Table:
        out = []
        if shard.num_rows and wanted.num_rows:
            row = {c: shard.column(c)[0].as_py() for c in ("ids", "counts", "vectors", "layers")}
            x = np.frombuffer(row["vectors"], kind).reshape(-1, key[0].as_py()).astype(np.float64)
            ids, ends = np.frombuffer(row["ids"], "<i8"), np.r_[0, np.cumsum(np.frombuffer(row["counts"], "<i4"))]
            layers = [np.frombuffer(b, "<i4").reshape(-1, m if at < len(row["layers"]) - 1 else 2 * m) for at, b in enumerate(row["layers"])]
            q = np.stack(wanted.column("embedding").to_numpy()).astype(np.float64)
            hits = search(scale(x), layers, scale(q, np.abs(x).max()), min(max(ef_search, k + 1), len(x)))
            for of, name, v, hit in zip(wanted.column("of").to_pylist(), wanted.column("query_id").to_pylist(), q, hits, strict=True):
                hit = hit[hit >= 0]
                far = np.sqrt(((x[hit] - v) ** 2).sum(axis=1))
                best = np.argsort(far, kind="stable")
                best = best[far[best] <= far[best][: k + 1].max(initial=0.0)]
                rows = [(d, i) for d, node in zip(far[best].tolist(), hit[best], strict=True) for i in ids[ends[node] : ends[node + 1]].tolist()]
                if (own := (0.0, name)) in rows:
                    rows.remove(own)
                out += [(of, name, i, d) for d, i in sorted(rows)[:k]]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["of", "query_id", "vec_id", "score"])

    dealt = asked.join(sizes, "width").withColumn("chunk", F.pmod(F.xxhash64("of"), F.col("chunks")).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    sent = index.join(sizes, "width").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    key = ["width", "shard", "chunk"]
    parts = sent.select(*key, "ids", "counts", "vectors", "layers").groupBy(*key).cogroup(dealt.select(*key, "of", "query_id", "embedding").groupBy(*key))
    found = parts.applyInArrow(find, "of long, query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("of").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
