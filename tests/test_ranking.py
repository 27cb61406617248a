"""Exact ranking by cosine against all pairs."""

import numpy as np
from pyspark.sql import functions as F

from duoscope.operators.ranking import top_k

VECTORS = "id long, embedding array<double>"


def truth(queries, rows, k, same_id=False):
    out = {}
    for q, v in queries:
        scored = []
        for i, w in rows:
            if len(w) == len(v) and (same_id or i != q):
                scored.append((-round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 12), i))
        out[q] = [(i, round(-s, 9)) for s, i in sorted(scored)[:k]]
    return {q: v for q, v in out.items() if v}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.id, round(r.score, 9)))
        assert r.rank == len(out[r.query_id])
    return out


def test_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-2, 3, (900, 20)).astype(float)  # whole numbers: many ties, and copies
    x[0] = 1
    x[~x.any(axis=1)] = 2
    x[500:560] = x[7] * 3
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, VECTORS)
    asked = [r for r in rows if r[0] % 20 in (0, 7)]
    want = truth(asked, rows, 12)
    for sizes in ({}, {"block_rows": 16, "tile_rows": 100}):
        assert found(top_k(df.filter("id % 20 in (0, 7)"), df, 12, **sizes)) == want
    assert found(top_k(df.filter("id = 7"), df, 3, same_id=True)) == truth(asked[1:2], rows, 3, True)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [1e300, 1e300]), (8, [1.0, 1.0, 1.0]), (9, []), (None, [1.0, 0.0]), (10, [-1e-300, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], VECTORS + ", rank string")
    got = found(top_k(df, df, 5))
    assert got[1] == [(2, 1.0), (7, round(0.5**0.5, 9)), (10, -1.0)]
    assert got.keys() == {1, 2, 7, 10}
    assert top_k(df.filter("id > 90"), df).collect() == [] == top_k(df, df.filter("id > 90")).collect()


def test_the_plan_has_no_cross_join(spark):
    df = spark.range(50).select("id", F.array(F.col("id") + 1.0, F.lit(1.0)).alias("embedding"))
    plan = top_k(df.filter("id < 9"), df)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "WindowGroupLimit" in plan
