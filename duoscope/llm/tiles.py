"""Comparing all rows of a bucket in blocks of bounded size.

A bucket is cut into tiles of about `tile_rows` rows, and each pair of tiles becomes a group of its
own, so a bucket that holds a third of all rows is compared by many tasks. A row is sent out once for
each tile of its bucket, not once for each row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duoscope.llm.common import checkpointed


def tile_pairs(rows: DataFrame, bucket: list[str], row_id: str, tile_rows: int, counts: DataFrame | None = None, tile_size: int = 1) -> DataFrame:
    """Rows of buckets of two or more, with `tile` and each pair (`lo`, `hi`) of tiles that they take part in.

    counts: the buckets to take with in_bucket, their rows, and sizes, of which a tile should hold about tile_size at most.
    """
    if counts is None:
        counts = checkpointed(rows.groupBy(*bucket).agg(F.count("*").alias("in_bucket"), F.lit(0).alias("sizes")).filter("in_bucket > 1"))
    tiles = F.ceil(F.greatest(F.col("in_bucket") / tile_rows, F.col("sizes") / tile_size)).cast("int")
    return (
        rows.join(counts, bucket)
        .withColumn("tile", F.pmod(F.xxhash64(row_id), tiles).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
        .withColumns({"lo": F.least("tile", "other"), "hi": F.greatest("tile", "other")})
        .drop("in_bucket", "sizes", "other")
    )


def sides(tile: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of either side of a pair of tiles; all rows twice where one tile meets itself."""
    return (np.flatnonzero(tile == lo), np.flatnonzero(tile == hi)) if lo != hi else (np.arange(len(tile)),) * 2


def spanning_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of n rows with links between rows i and j: for each row the first row of its component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        for at in (i, j, root[i], root[j]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
