import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from duoscope.llm import quality, queries


def test_gradient_is_that_of_the_loss():
    rnd = np.random.default_rng(1)
    score, grade, thresholds = rnd.normal(size=30), rnd.integers(0, 4, 30), np.array([-1.0, 0.2, 1.5])

    def loss(s, t):
        edges = np.concatenate([[-50.0], t, [50.0]])
        p = 1 / (1 + np.exp(-(edges[grade + 1] - s))) - 1 / (1 + np.exp(-(edges[grade] - s)))
        return -np.log(p).sum()

    ds, dt = quality.loss_gradient(score, grade, thresholds)
    for k in range(3):
        step = np.eye(3)[k] * 1e-6
        assert dt[k] == pytest.approx((loss(score, thresholds + step) - loss(score, thresholds - step)) / 2e-6, abs=1e-4)
    for k in range(30):
        step = np.eye(30)[k] * 1e-6
        assert ds[k] == pytest.approx((loss(score + step, thresholds) - loss(score - step, thresholds)) / 2e-6, abs=1e-4)


def test_trigrams_stay_inside_their_text():
    text, code = quality.hashed([b"abcd", b"", b"xy", b"abc"], 12)
    assert text.tolist() == [0, 0, 3] and code[0] == code[2]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op2_quality(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    held = [(got[r.doc_id].kept, r.quality == 1) for r in labels if got[r.doc_id].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.93
    assert all(abs(r.expected_grade - r.p_good - r.p_clean) < 1e-9 and r.p_good >= r.p_clean for r in got.values())


def test_the_table_against_plain_sums(spark, sf):
    """Every column of the query from the model's weights and thresholds, trigram by trigram in plain Python."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    ratings = spark.read.parquet(f"{sf}/labels.parquet").filter("quality is not null").select("doc_id", grade.alias("grade"))
    model = quality.fit(docs, ratings, grades=3)
    weights, low = model.weights.tolist(), model.thresholds.tolist()
    got = {r.doc_id: r for r in queries.op2_quality(spark, sf).collect()}
    for r in docs.collect():
        data = bytes(b + 32 if 65 <= b <= 90 else b for b in (r.text or "").encode())
        total = n = 0
        for a, b, c in zip(data, data[1:], data[2:]):
            total += weights[((a << 16 | b << 8 | c) * 2654435761 % 2**32) >> 16]
            n += 1
        score = 32.0 * total / max(n, 1)
        tails = [1 / (1 + math.exp(-min(60.0, max(-60.0, score - t)))) for t in low]
        x = got[r.doc_id]
        assert [x.p_good, x.p_clean, x.expected_grade] == pytest.approx([*tails, sum(tails)], abs=1e-9)
        assert x.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and x.kept == (x.p_good >= 0.5)
    assert len(got) == docs.count()


def test_edge_cases(spark):
    rows = [(i, "good clean prose here" if i % 3 else "### $$$ %%% &&&") for i in range(60)] + [(90, None), (91, ""), (92, "ab"), (93, "good clean prose " * 20_000), (93, "good clean prose " * 20_000), (None, "### $$$ %%%")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("grade", F.lit("clash"))
    ratings = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)] + [(1, None), (None, 1), (999, 0), (2, 1), (7, 5), (8, -1)], "doc_id long, grade int")
    model = quality.fit(docs, ratings, grades=2)
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id: r.kept for r in got}
    assert kept[1] and kept[93] and not kept[0] and not kept[None] and kept[90] == kept[91] == kept[92]
    none = quality.fit(docs, ratings.limit(0), grades=4)
    assert {tuple(round(x, 6) for x in r.tails) for r in quality.score(docs, none).collect()} == {(0.75, 0.5, 0.25)}
    assert quality.score(docs.limit(0), model).collect() == []
