"""The rows nearest to each of a set of query vectors, exactly, by cosine.

Queries come in blocks and rows in tiles of bounded size, so a pair of them is a group that one task
holds. In a group each query keeps its best k so far; of a row, the leading dimensions are multiplied
first, and it is left out where these and the norms of what follows can't bring it among them. The
groups' best are merged by a window that keeps k rows of a query before they are sent.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Decimals of a score: equal vectors have equal ones, whatever the order of the sums.
DECIMALS = 12


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: not null, empty or zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def best_of(q: np.ndarray, x: np.ndarray, skip: np.ndarray, ids: np.ndarray, k: int, lead: int = 16, step: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, row number, score) of each query's k best rows, ties to the smaller id; unit vectors; skip: the id that each query leaves out."""
    lead = min(lead, x.shape[1])
    norm = lambda v: np.sqrt((v[:, lead:] ** 2).sum(axis=1))
    rest_q, rest_x = norm(q), norm(x)
    order = np.argsort(ids, kind="stable")
    score, row = np.full((len(q), k), -np.inf), np.full((len(q), k), -1)
    for start in range(0, len(x), step):
        at = order[start : start + step]
        near = q[:, :lead] @ x[at, :lead].T
        bound = near + np.outer(rest_q, rest_x[at]) + 1e-9
        i, j = np.nonzero((bound >= score[:, -1:]) & (skip[:, None] != ids[at]))
        full = np.full(near.shape, -np.inf)
        for part in range(0, len(i), 1 << 16):
            a, b = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
            full[a, b] = np.round(near[a, b] + np.einsum("ij,ij->i", q[a, lead:], x[at[b], lead:]), DECIMALS)
        both, rows = np.concatenate([score, full], axis=1), np.concatenate([row, np.broadcast_to(at, full.shape)], axis=1)
        keep = np.argsort(-both, axis=1, kind="stable")[:, :k]  # stable: rows come by rising id
        score, row = np.take_along_axis(both, keep, 1), np.take_along_axis(rows, keep, 1)
    i, n = np.nonzero(np.isfinite(score))
    return i, row[i, n], score[i, n]


def top_k(queries: DataFrame, rows: DataFrame, k: int = 10, same_id: bool = False, block_rows: int = 2_048, tile_rows: int = 16_384) -> DataFrame:
    """query_id, rank (from 1), id, score: of the rows (id, embedding), the k with the largest cosine to each query (id, embedding).

    Scores have twelve decimals, ties go to the smaller id. Vectors that are null, empty, zero or hold null or non-finite components take no
    part, nor do null ids; vectors of different width never meet. same_id: whether a row with a query's id counts
    too. A query with fewer rows gets what there are; queries that repeat an id are told apart by nothing, so give them ids of their own.
    """
    side = lambda df: df.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    q, x = side(queries), side(rows)
    blocks, tiles = (max(1, -(-df.count() // size)) for df, size in ((q, block_rows), (x, tile_rows)))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumns({"block": dealt(blocks), "width": F.size("v")}).withColumn("tile", every(tiles))
    x = x.withColumns({"tile": dealt(tiles), "width": F.size("v")}).withColumn("block", every(blocks))

    def best(asked: pa.Table, there: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if asked.num_rows and there.num_rows:
            unit = [np.stack(t.column("v").to_numpy()) for t in (asked, there)]
            unit = [v / np.abs(v).max(axis=1, keepdims=True) for v in unit]
            unit = [v / np.linalg.norm(v, axis=1, keepdims=True) for v in unit]
            name, ids = asked.column("id").to_numpy(), there.column("id").to_numpy()
            i, j, score = best_of(*unit, np.full(len(name), np.iinfo(np.int64).min) if same_id else name, ids, k)
            found = [name[i], ids[j], score]
        return pa.table(found, ["query_id", "id", "score"])

    key = ["width", "block", "tile"]
    parts = q.groupBy(*key).cogroup(x.groupBy(*key)).applyInArrow(best, "query_id long, id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return parts.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
