"""Whitening against exact sums and another solver; eigenvalues of hard spectra; malformed rows."""

import numpy as np
import pytest

from duoscope.llm import whitening
from duoscope.llm.queries import op12_whitening

VECTORS = "vec_id long, embedding array<double>"


def check(rows, vectors, components=8):
    """The rows of a whitened table against plain numpy."""
    x = [[int(np.floor(np.float64(c) * 1024)) + 100_000 for c in v] for _, v in vectors]
    n, sums = len(x), np.array(x, object).sum(axis=0)
    d = np.array([[float((n * c - s) / n) for c, s in zip(row, sums, strict=True)] for row in x])
    v = d.T @ d / n
    e, axes = np.linalg.eigh(v)
    by = {}
    for r in rows:
        by.setdefault((r.vec_id, r.component), []).append(r)
    assert len(rows) == n * min(components, v.shape[0])
    for at, (i, _) in enumerate(vectors):
        exact = sum((n * c - s) ** 2 for c, s in zip(x[at], sums, strict=True))
        assert {r.deviation for r in by[i, 1]} == {int(exact)} and {r.n for r in by[i, 1]} == {n}
    ids = [i for i, _ in vectors]
    for c in range(1, min(components, v.shape[0]) + 1):
        got = np.array([by[i, c][0].whitened for i in ids])
        want = d @ axes[:, -c] / np.sqrt(e[-c])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-8
        assert by[ids[0], c][0].explained == pytest.approx(e[-c] / np.trace(v), rel=1e-10)
    assert max(r.identity_error for r in rows) < 1e-9


def test_table(spark, sf):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(op12_whitening(spark, sf).collect(), vectors)


def test_malformed_rows_and_widths(spark):
    rng = np.random.default_rng(2)
    good = [(i, rng.standard_normal(5).tolist()) for i in range(40)]
    bad = [(100, None), (101, []), (102, [1.0, None, 0, 0, 0]), (103, [float("nan")] * 5), (104, [float("-inf"), 0, 0, 0, 0]), (105, [1e300, 0, 0, 0, 0]), (106, [1.0, 2.0])]
    bad = [(i, v and [None if c is None else float(c) for c in v]) for i, v in bad]
    df = spark.createDataFrame([(*r, "x") for r in good + bad], VECTORS + ", n string")
    check(whitening.whitened(df).collect(), good)


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (None, [1.0, 0.0]), (4, [0.25, 0.75])]
    got = whitening.whitened(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted((str(r.vec_id), r.component) for r in got) == sorted((str(i), c) for i, _ in rows for c in (1, 2))
    assert {r.n for r in got} == {4}
    assert all(r.whitened is None for r in got if r.component == 2)  # all on one line


def test_no_variance_and_no_rows(spark):
    got = whitening.whitened(spark.createDataFrame([(1, [0.5, 0.5, 0.5])], VECTORS)).collect()
    assert [(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(got, key=lambda r: r.component)] == [(c, 0, None, None, None) for c in (1, 2, 3)]
    assert whitening.whitened(spark.createDataFrame([(1, None)], VECTORS)).collect() == []


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(i) * 1e9, 1.0]) for i in range(5)]
    check(whitening.whitened(spark.createDataFrame(rows[:1] + [(9, [5e5, 7.0]), (8, [2e5, -1.0])], VECTORS)).collect(), [rows[0], (9, [5e5, 7.0]), (8, [2e5, -1.0])])
    assert {r.deviation for r in whitening.whitened(spark.createDataFrame(rows, VECTORS)).filter("vec_id <> 2").collect()} == {None}  # beyond a long


@pytest.mark.parametrize("kind", ["spread", "equal", "repeated", "graded", "cluster"])
def test_leading_eigenvalues(kind):
    rng = np.random.default_rng(5)
    for _ in range(12):
        n = int(rng.integers(1, 60))
        q = np.linalg.qr(rng.standard_normal((n, n)))[0]
        e = {"spread": rng.random(n), "equal": np.full(n, 0.7), "repeated": np.round(rng.random(n) * 3), "graded": 10.0 ** rng.uniform(-12, 6, n), "cluster": np.r_[1, 1, 1 + 1e-13, np.zeros(n)][:n]}[kind]
        v = (q * e) @ q.T
        v = (v + v.T) / 2
        w = np.linalg.eigvalsh(v)[::-1]
        values, vectors = whitening.leading(v, 8)
        size = max(abs(w).max(), 1e-300)
        assert np.abs(values - w[:8]).max() <= 1e-13 * n * size
        assert np.abs(v @ vectors - vectors * values).max() <= 1e-13 * n * size
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12


def test_inertia_counts_of_indefinite_matrices():
    rng = np.random.default_rng(6)
    for t in range(100):
        a = rng.standard_normal((n := int(rng.integers(1, 25)), n))
        a = a + a.T
        if t % 2:
            a[np.diag_indices(n)] = 0  # pivots of two rows
        assert whitening.above(a, 0.25) == (np.linalg.eigvalsh(a) > 0.25).sum()
