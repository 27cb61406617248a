from datetime import date, datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from duoscope.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.93):
    ok = [(i, np.array(e, np.float32).astype(float), l) for i, e, l in rows if l is not None and e is not None and None not in e and np.isfinite(e).all() and np.any(e)]
    links = {i: set() for i, _, _ in rows}
    for n, (i, e, l) in enumerate(ok):
        for j, f, m in ok[:n]:
            if l == m and len(e) == len(f) and e @ f / (np.linalg.norm(e) * np.linalg.norm(f)) >= threshold:
                links[i].add(j)
                links[j].add(i)
    component = {}
    for i in sorted(links):
        todo = [i]
        while todo:
            x = todo.pop()
            if component.setdefault(x, i) == i:
                todo += [y for y in links[x] if y not in component]
    return {i: (len(links[i]), component[i], component[i] == i) for i in links}


def check(spark, rows, **settings):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("x", F.lit("clash")).withColumn("node", F.lit(0))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df, **settings).collect()}
    assert got == brute(rows)


def test_clusters_copies_and_bad_vectors(spark):
    rnd = np.random.default_rng(5)
    rows = []
    for c in range(6):
        centre = rnd.normal(size=24)
        for _ in range(60):
            rows.append((len(rows) * 7 % 1009, (centre + rnd.normal(size=24) * rnd.choice([0.05, 0.27, 0.4])).tolist(), c % 3 or None))
    same = rows[0][1]
    rows += [(2000 + k, [x * s for x in same], rows[0][2]) for k, s in enumerate((1, 1, 2.5, 0.25))]
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * 24, 1), (3003, [math.nan] * 24, 1), (3004, [math.inf] * 24, 1), (3005, [1.0, None], 1), (3006, [1.0, 0.0], 1), (3007, [2.0, 0.1], 1), (3008, [-1.0, 0.0], 1)]
    for settings in ({}, {"tile_rows": 16, "grid_dims": 2, "sample_rows": 50}):
        check(spark, rows, **settings)


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    check(spark, rows)


def test_empty_table(spark):
    assert vectors.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize(("kind", "labels"), [("double", [0.0, -0.0, 2.5]), ("boolean", [True, True, False]), ("smallint", [1, 1, 2]), ("date", [date(2020, 1, 1), date(2020, 1, 1), date(2020, 1, 2)]), ("string", ["a", "a", "b"]), ("timestamp", [datetime(2020, 1, 1, 0, 0, 0, 1), datetime(2020, 1, 1, 0, 0, 0, 1), datetime(2020, 1, 1, 0, 0, 0, 2)]), ("array<int>", [[1], [1], [1, None]]), ("binary", [b"\xff", b"\xff", b"\xfe"])])
def test_labels_of_any_type(spark, kind, labels):
    rows = [(1, [1.0, 0.0], labels[0]), (2, [1.0, 0.01], labels[1]), (3, [1.0, 0.0], labels[2]), (4, [1.0, 0.0], None)]
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {kind}")).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0}


def test_rows_that_share_an_id(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0), (1, [1.0, 0.0], 0), (5, [-1.0, 0.0], 0), (5, [0.0, -1.0], 0)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 1, False), (5, 0, 5, True), (5, 0, 5, True)]


def test_small_blocks_and_tiles(spark):
    rnd = np.random.default_rng(8)
    rows = []
    for c in range(12):
        width = (8, 40, 72)[c % 3]
        centre = rnd.normal(size=width)
        for _ in range(30):
            rows.append((len(rows) * 11 % 1009, (centre + rnd.normal(size=width) * rnd.choice([0.05, 0.27, 2.0])).tolist(), c % 5))
    rows += [(2000 + k, rows[k % 7][1], rows[k % 7][2]) for k in range(20)]
    for settings in ({"tile_rows": 7, "block_bytes": 16_000}, {"tile_rows": 64, "block_bytes": 40_000}):
        check(spark, rows, **settings)


def test_shuffle_does_not_grow_with_what_a_row_meets(spark):
    def shuffled():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().executorList(False)
        return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))

    x = np.random.default_rng(9).normal(size=(1500, 64))
    df = spark.createDataFrame([(k, v, 0) for k, v in enumerate(x.tolist())], SCHEMA)
    before = shuffled()
    assert vectors.near_vectors(df, tile_rows=16).filter("n_links = 0 and kept").count() == 1500
    assert shuffled() - before < 6 * x.size * 4
