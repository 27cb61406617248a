"""Nearest neighbours against brute force: recall on the table and on spread-out vectors, exact scores, copies, malformed rows."""

import math

import numpy as np
from pyspark.sql import functions as F

from duoscope.llm import hnsw
from duoscope.llm.queries import op11_hnsw

VECTORS = "vec_id long, embedding array<double>"


def truth(rows, k=10, queries=lambda i: i % 100 == 0):
    """query id to its list of (id, distance), every row but its own."""
    rows = [(i, np.array(v)) for i, v in rows]
    out = {}
    for at, (i, v) in enumerate(rows):
        if queries(i):
            far = sorted((math.sqrt(((w - v) ** 2).sum()), j) for b, (j, w) in enumerate(rows) if b != at and len(w) == len(v))
            out[i] = [(j, d) for d, j in far[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    return sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))


def test_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got, want = found(op11_hnsw(spark, sf)), truth(rows)
    assert got.keys() == want.keys()
    assert recall(got, want) >= 0.99
    vectors = dict(rows)
    for q, near in got.items():
        for i, score in near:
            assert score == np.sqrt(((np.array(vectors[i]) - np.array(vectors[q])) ** 2).sum())


def test_shards_and_chunks(spark):
    x = np.random.default_rng(3).standard_normal((3000, 24)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = found(hnsw.nearest(df, F.col("vec_id") % 20 == 0, shard_rows=700, chunk_queries=40, ef_search=96))
    want = truth(rows, queries=lambda i: i % 20 == 0)
    assert got.keys() == want.keys()
    assert recall(got, want) >= 0.95


def test_copies_are_found_by_smallest_id(spark):
    copy, other = [0.5, 0.5, 0.1], [0.9, 0.1, 0.3]
    rows = [(i, copy) for i in range(1000, 0, -1)] + [(2000, other)]
    got = found(hnsw.nearest(spark.createDataFrame(rows, VECTORS), F.col("vec_id").isin(5, 500, 2000)))
    assert [i for i, _ in got[5]] == [1, 2, 3, 4, 6, 7, 8, 9, 10, 11]
    assert [i for i, _ in got[500]] == list(range(1, 11))
    assert [i for i, _ in got[2000]] == list(range(1, 11))
    assert {d for _, d in got[5]} == {0.0}


def test_few_and_malformed_rows(spark):
    rows = [
        (0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
        (100, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (200, []), (300, None), (0, [1.0, 0.0]), (400, [1e200, 1e-200]),
    ]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], VECTORS + ", rank string, score int")
    got = found(hnsw.nearest(df, F.col("vec_id") % 100 == 0))
    assert got[0] == [(0, 0.0), (1, math.sqrt(5)), (400, math.inf)]  # the row that repeats it is another row; squares over the range of doubles are infinite
    assert got.keys() == {0, 400}  # alone in its width, a vector has no neighbour
    assert hnsw.nearest(df.filter("vec_id < 0"), F.col("vec_id") % 100 == 0).collect() == []
    assert hnsw.nearest(df, F.lit(False)).collect() == []


def test_one_id_with_two_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (7, [0.0, 1.1])], VECTORS)
    rows = sorted((r.rank, r.vec_id) for r in hnsw.nearest(df, F.col("vec_id") == 0).collect())
    assert rows == [(1, 0), (1, 7), (2, 0), (2, 7)]


def test_graph_has_flat_layers():
    x = np.random.default_rng(0).standard_normal((600, 8))
    order, layers = hnsw.build(x, m=8, ef=32)
    assert sorted(order) == list(range(600))
    assert [len(a) for a in layers] == sorted(len(a) for a in layers) and layers[-1].shape == (600, 16)
    for links in layers:
        assert links.max(initial=-1) < len(links)
        for node, row in enumerate(links):
            own = row[row >= 0].tolist()
            assert len(own) == len(set(own)) and node not in own
