"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = logistic(threshold_k - w x): one weight vector over hashed byte trigrams, shared by all
grades, and increasing thresholds. The expected grade is the sum of the tail probabilities
P(grade >= k), and a document is kept if the tail at `keep_grade` reaches `keep_at`.

The fit is by full-batch gradients (Adam), summed over the partitions of a bounded sample: at most
`train_rows` rated rows, those with the smallest hashes of their ids. Defined cases: null counts as
empty; texts under three bytes have no features and get the thresholds' probabilities; ratings that
are null are left out, and of several for one document the lowest counts; without ratings every grade
is as likely; rows with a null id are scored; repeated rows are scored as often as they occur; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duoscope.llm.common import checkpointed, remainder, slices, utf8

SCALE = 32.0


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # increasing, one less than there are grades

    def tails(self, texts: list[bytes]) -> np.ndarray:
        """P(grade >= k) for k from 1, one row per text."""
        return logistic(linear(texts, self.weights)[:, None] - self.thresholds[None, :])


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def hashed(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all trigrams: the text's number and the hash; trigrams never reach over the end of a text."""
    data = np.frombuffer(b"".join(texts).lower(), np.uint8).astype(np.uint32)
    size = np.array([len(t) for t in texts])
    text = np.repeat(np.arange(len(texts)), size)
    if len(data) < 3:
        return text[:0], data[:0].astype(np.int64)
    code = (data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]) * np.uint32(2654435761)
    inside = text[:-2] == text[2:]
    return text[:-2][inside], (code >> np.uint32(32 - bits))[inside].astype(np.int64)


def linear(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    text, code = hashed(texts, int(len(weights)).bit_length() - 1)
    n = np.bincount(text, minlength=len(texts))
    return SCALE * np.bincount(text, weights[code], len(texts)) / np.maximum(n, 1)


def rated_rows(docs: DataFrame, ratings: DataFrame, grades: int, train_rows: int, modulus: int | None) -> DataFrame:
    """(text, grade): at most train_rows rated documents; with a modulus, ids whose remainder is 0 are held out."""
    rated = ratings.filter(f"doc_id is not null and grade >= 0 and grade < {grades} and grade = floor(grade)")
    if modulus:
        rated = rated.filter(remainder("doc_id", modulus) != 0)
    chosen = rated.groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "grade")


def fit(docs: DataFrame, ratings: DataFrame, grades: int, train_rows: int = 20_000, modulus: int | None = 5, bits: int = 16, steps: int = 40, rate: float = 0.3, ridge: float = 1e-4) -> Model:
    """ratings: (doc_id, grade) with whole grades from 0 up to `grades` - 1; rows with others or null are no ratings."""

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            for raw, grade in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                code, n = np.unique(hashed([raw], bits)[1], return_counts=True)
                x = (SCALE * n / max(1, n.sum())).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([grade], pa.int32()), pa.array([code.astype(np.int32)]), pa.array([x])], ["grade", "i", "x"])

    rows = checkpointed(rated_rows(docs, ratings, grades, train_rows, modulus).mapInArrow(sparse, "grade int, i array<int>, x array<float>")).coalesce(4)
    counts = {r.grade: r.n for r in rows.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    above = np.array([(sum(n for g, n in counts.items() if g >= k) + 0.5 * (grades - k)) / (total + 0.5 * grades) for k in range(1, grades)])
    w, low, gaps = np.zeros(1 << bits), float(-np.log(above[0] / (1 - above[0]))), np.log(np.maximum(1e-3, np.diff(-np.log(above / (1 - above)))))
    params = np.concatenate([w, [low], gaps])
    m, s = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1 if total else 0):
        model = _model(params, bits)

        def gradient(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            dw, dt = np.zeros(1 << bits), np.zeros(grades - 1)
            for batch in batches:
                i, x = (batch.column(c).flatten().to_numpy() for c in (1, 2))
                size = np.diff(batch.column(1).offsets.to_numpy())
                row = np.repeat(np.arange(len(size)), size)
                score = np.bincount(row, model.weights[i] * x, len(size))
                ds, by_threshold = loss_gradient(score, batch.column(0).to_numpy(), model.thresholds)
                dw += np.bincount(i, ds[row] * x, 1 << bits)
                dt += by_threshold
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([dw, dt]).tobytes()], pa.binary())], ["g"])

        g = sum(np.frombuffer(x) for x in rows.mapInArrow(gradient, "g binary").toArrow().column(0).to_pylist()) / total
        dt = g[1 << bits :]
        steps_up = np.exp(params[(1 << bits) + 1 :])
        g = np.concatenate([g[: 1 << bits] + ridge * params[: 1 << bits], [dt.sum()], [dt[k + 1 :].sum() * up for k, up in enumerate(steps_up)]])
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        params = params - rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return _model(params, bits)


def _model(params: np.ndarray, bits: int) -> Model:
    """Thresholds are the first and the exponentials of what they rise by, so they stay in order."""
    low, gaps = params[1 << bits], params[(1 << bits) + 1 :]
    return Model(params[: 1 << bits], low + np.append(0, np.cumsum(np.exp(gaps))))


def loss_gradient(score: np.ndarray, grade: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of -log P(grade): by each row's score, and summed by threshold."""
    edges = np.concatenate([[-np.inf], thresholds, [np.inf]])
    with np.errstate(over="ignore"):
        upper, lower = (logistic(np.clip(edges[g] - score, -60, 60)) for g in (grade + 1, grade))
    upper, lower = np.where(grade + 1 == len(edges) - 1, 1.0, upper), np.where(grade == 0, 0.0, lower)
    p = np.maximum(upper - lower, 1e-12)
    up, down = upper * (1 - upper) / p, lower * (1 - lower) / p
    by_threshold = np.bincount(grade, -up, len(thresholds) + 1)[:-1] + np.bincount(grade, down, len(thresholds) + 1)[1:]
    return up - down, by_threshold


def score(docs: DataFrame, model: Model, keep_grade: int = 1, keep_at: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, tails (array, P(grade >= k) for k from 1), kept; one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            tails = model.tails(utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(axis=1)), pa.array(list(tails), pa.list_(pa.float64()))], ["doc_id", "expected_grade", "tails"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, expected_grade double, tails array<double>")
    return scored.withColumn("kept", F.element_at("tails", keep_grade) >= keep_at)
