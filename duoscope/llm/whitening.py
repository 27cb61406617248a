"""Whitening of embeddings by spectrum slicing.

Entries become whole numbers x. Passes over the table sum them exactly, then add up the products of the
centred rows, each task one matrix, entries of which meet by their position. The covariance V is as
large as the width squared, whatever the rows, and its leading eigenvalues are found on the driver:

- The signs of D in V - s I = L D L' say how many eigenvalues lie over s (Sylvester's law of inertia).
- Bisection by these counts isolates eigenvalue k, or stops where a cluster is as narrow as rounding.
- Rayleigh quotient iteration from the slice converges cubically; a result outside of the slice narrows
  it further. Vectors are kept at right angles to those before, those of a cluster too.
- Counts on both sides of each result certify its number.

Defined cases: rows whose vector is null or empty, holds null or non-finite entries, or entries of which
1024 * c is beyond 2**53, are dropped; of vectors of several widths those of the commonest (of equally
common ones the smallest) are the table and others are dropped; components without variance have a null
`whitened`; a sum of squares beyond a long has a null `deviation`; rows that repeat each give their own;
a null vec_id stays; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
#: Entries are whole numbers that doubles hold.
LARGEST = 2.0**53 / SCALE - SHIFT
EPS = np.finfo(np.float64).eps


def above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix are over `shift`: positive signs in D of L D L' (Bunch and Kaufman's pivots)."""
    a = v - shift * np.eye(len(v))
    tiny = EPS * EPS * max(np.abs(a).max(), 1e-300)
    alpha, count, k, n = (1 + 17**0.5) / 8, 0, 0, len(a)
    while k < n:
        wide, own = 1, abs(a[k, k])
        if k + 1 < n:
            r = k + 1 + int(np.abs(a[k + 1 :, k]).argmax())
            column = abs(a[r, k])
            if own < alpha * column:
                other = np.abs(a[r, k:])
                other[r - k] = 0
                row = other.max()
                if own * row < alpha * column * column:
                    swap = k if abs(a[r, r]) >= alpha * row else k + 1
                    wide = 1 if swap == k else 2
                    if r != swap:
                        a[[swap, r]] = a[[r, swap]]
                        a[:, [swap, r]] = a[:, [r, swap]]
        if wide == 1:
            pivot = a[k, k] if abs(a[k, k]) > tiny else -tiny
            count += pivot > 0
            below = a[k + 1 :, k].copy()
            a[k + 1 :, k + 1 :] -= np.outer(below, below / pivot)
        else:
            block, below = a[k : k + 2, k : k + 2].copy(), a[k + 2 :, k : k + 2].copy()
            det = block[0, 0] * block[1, 1] - block[0, 1] * block[1, 0]
            count += 1 if det < 0 else 2 * (block[0, 0] + block[1, 1] > 0)
            a[k + 2 :, k + 2 :] -= below @ np.linalg.inv(block) @ below.T
        k += wide
    return int(count)


def rayleigh(v: np.ndarray, shift: float, start: np.ndarray, before: list[np.ndarray], steps: int = 12) -> tuple[float, np.ndarray, float]:
    """An eigenvalue near `shift`, its unit vector and the norm of the residual. before: vectors that it stands at right angles to."""

    def free(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            for b in before:
                x = x - (b @ x) * b
        return x / np.linalg.norm(x)

    size, x, value, best = np.abs(v).max(), free(start), shift, None
    for step in range(steps):
        for nudge in (0.0, EPS, -64 * EPS):
            try:
                y = np.linalg.solve(v - (value + nudge * size) * np.eye(len(v)), x)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(y).all():
                break
        else:
            break
        x = free(y / np.abs(y).max())
        rest = float(np.linalg.norm(v @ x - (x @ v @ x) * x))
        if best is not None and rest >= best[2]:
            break
        best = (float(x @ v @ x), x, rest)
        if step > 1:
            value = best[0]  # the first steps keep the shift, so that the start can turn to the slice's own vector
    return best


def leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and unit eigenvectors as columns; RuntimeError where the counts do not certify them."""
    n = len(v)
    size = float(np.abs(v).sum(axis=1).max())
    if size == 0:
        return np.zeros(min(k, n)), np.eye(n)[:, : min(k, n)]
    v, least = v / size, 4 * n * EPS
    counts: dict[float, int] = {-1 - least: n, 1 + least: 0}

    def count(s: float) -> int:
        if s not in counts:
            counts[s] = above(v, s)
        return counts[s]

    rng, values, found = np.random.default_rng(n), [], []
    for number in range(1, min(k, n) + 1):
        low = max(s for s, c in counts.items() if c >= number)
        high = min(s for s, c in counts.items() if c < number)
        while True:
            if high - low <= least or counts[low] == number and counts[high] == number - 1:
                value, x, rest = rayleigh(v, (low + high) / 2, rng.standard_normal(n), found)
                edge = 2 * (rest + least)
                if rest <= 64 * least and count(value - edge) >= number > count(value + edge):
                    break
            if high - low <= least / 8:
                raise RuntimeError(f"eigenvalue {number} is not certified by counts")
            middle = (low + high) / 2
            low, high = (middle, high) if count(middle) >= number else (low, middle)
        values.append(value)
        found.append(x)
    return np.array(values) * size, np.array(found).T


def partial_sums(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], entry: str) -> list:
    """The sum over all rows of a matrix that `of` gives for a block of them, each task's own first; entry: the SQL type of its entries. Rows of (at, total)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(whole(batch.column("embedding")))
                total = part if total is None else total + part
        if total is not None:
            flat = total.ravel()
            exact = pa.array([str(x) for x in flat.tolist()], pa.string()) if flat.dtype == object else pa.array(flat)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), exact], ["at", "part"])

    kind = "string" if entry.startswith("decimal") else entry
    parts = rows.select("embedding").mapInArrow(run, f"at int, part {kind}")
    return sorted(tuple(r) for r in parts.groupBy("at").agg(F.sum(F.col("part").cast(entry)).alias("total")).collect())


def whole(column: pa.Array) -> np.ndarray:
    """floor(1024 c) + 100000 of each entry, a row for each vector."""
    entries = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(entries * SCALE).astype(np.int64) + SHIFT).reshape(len(column), -1)


def whitened(vectors: DataFrame, components: int = 8) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each row and component."""
    given = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    held = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST))
    given = given.filter(F.coalesce((F.size("embedding") > 0) & held, F.lit(False)))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    widths = given.groupBy(F.size("embedding").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").limit(1).collect()
    if not widths:
        return vectors.sparkSession.createDataFrame([], schema)
    width, n = widths[0]
    rows = given.filter(F.size("embedding") == width)

    sums = np.array([int(t) for _, t in partial_sums(rows, lambda x: x.sum(axis=0, dtype=object), "decimal(38,0)")], object)
    mean = np.array([s // n for s in sums], np.int64)  # and rest / n beyond it
    rest = np.array([s - n * int(q) for s, q in zip(sums, mean, strict=True)], object)
    beyond = np.array([r / n for r in rest])

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - mean) - beyond

    def products(x: np.ndarray) -> np.ndarray:
        c = centred(x)
        return (c.T @ c)[np.triu_indices(width)]

    v = np.zeros((width, width))
    v[np.triu_indices(width)] = [t / n for _, t in partial_sums(rows, products, "double")]
    v = np.triu(v) + np.triu(v, 1).T
    values, vectors_ = leading(v, components)
    trace = float(np.trace(v))
    real = values > trace * width * EPS
    project = np.divide(vectors_, np.sqrt(np.where(real, values, 1.0)))[:, real]
    count = int(real.sum())

    def moments(x: np.ndarray) -> np.ndarray:
        w = np.c_[np.ones(len(x)), centred(x) @ project]
        return w.T @ w

    error = None
    if count:
        m = np.array([t for _, t in partial_sums(rows, moments, "double")]).reshape(count + 1, -1) / n
        error = float(np.abs(m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) - np.eye(count)).max())
    parts = len(values)
    share = [float(e) / trace if trace > 0 else None for e in values]

    def deviations(x: np.ndarray) -> list[int | None]:
        d = x - mean
        if (n * (int(np.abs(d).max(initial=0)) + 1)) ** 2 * width < 2**63:
            each = n * d - rest.astype(np.int64)
            return (each * each).sum(axis=1).tolist()
        each = n * d.astype(object) - rest
        exact = (each * each).sum(axis=1).tolist()
        return [e if e < 2**63 else None for e in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = whole(batch.column("embedding"))
            w = np.full((len(x), parts), np.nan)
            w[:, np.flatnonzero(real)] = centred(x) @ project
            repeat = np.repeat(np.arange(len(x)), parts)
            number = np.tile(np.arange(parts), len(x))
            columns = [
                batch.column("vec_id").take(pa.array(repeat)), pa.array((number + 1).astype(np.int32)), pa.array(np.full(len(number), n)),
                pa.array(deviations(x), pa.int64()).take(pa.array(repeat)), pa.array(w.ravel(), mask=np.isnan(w.ravel())),
                pa.array(share, pa.float64()).take(pa.array(number)), pa.array([error], pa.float64()).take(pa.array(np.zeros(len(number), np.int64))),
            ]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    return rows.mapInArrow(run, schema)
