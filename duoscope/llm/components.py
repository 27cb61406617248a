"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

Each round is joins and grouped minima over the edge list, so no component is ever gathered in one
task or on the driver. Edges between a hub and its many neighbours are joined with a written table of
minima, a join that adaptive execution can split. Rounds are many and small, so their partitions follow
the number of edges, and edges that one task takes at once (`task_edges`) need no rounds: it solves them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duoscope.llm.common import checkpointed
from duoscope.llm.tiles import spanning_roots


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", task_edges: int = 50_000) -> DataFrame:
    """(node, component): each node that has an edge, and the smallest node reachable from it.

    Loops, repeated edges and nulls are ignored; no edges give no rows.
    """
    high, low = F.greatest(a, b), F.least(a, b)
    now = checkpointed(edges.filter(F.col(a) != F.col(b)).select(high.cast("long").alias("u"), low.cast("long").alias("v")))
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = min(parts, now.count() // task_edges + 1)

    def written(df: DataFrame) -> DataFrame:
        return checkpointed(df.coalesce(width))

    if width == 1:
        return checkpointed(now.coalesce(1).mapInArrow(_solved, "node long, component long"))
    now = written(now.coalesce(width).distinct())
    seen = _mark(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = written(both.join(smallest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(least.select("u", F.col("m").alias("v")).unionByName(moved).distinct())
        before, seen = seen, _mark(now)
        if before == seen:
            break
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of all edges (u, v) of the only task."""
    edges = [np.stack([x.to_numpy() for x in b.columns]) for b in batches if b.num_rows]
    node, at = np.unique(np.concatenate(edges, axis=1) if edges else np.zeros((2, 0), np.int64), return_inverse=True)
    i, j = at.reshape(2, -1)
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[spanning_roots(len(node), i, j)])], ["node", "component"])


def _mark(edges: DataFrame) -> tuple:
    """Count and two sums of hashes: equal when the edges are."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(h.cast("decimal(20,0)")), F.sum(F.hash("u", "v").cast("long"))).first())
