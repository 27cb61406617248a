import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from duoscope.llm import toxicity


def brute_segments(scores):
    """Maximal segments by definition: the best segment, then the rest to its left and right."""
    if not scores:
        return []
    best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=None)
    s, _, _, i, j = best
    if s <= 0:
        return []
    return brute_segments(scores[:i]) + [(i, j, s)] + [(a + j, b + j, t) for a, b, t in brute_segments(scores[j:])]


def test_all_maximal_segments():
    rnd = random.Random(4)
    for _ in range(300):
        scores = [rnd.choice([-1.0, -1.0, -1.0, 0.75, 1.5, 2.25]) for _ in range(rnd.randint(0, 14))]
        got = toxicity.maximal_segments([(i, s) for i, s in enumerate(scores) if s > 0], -1.0)
        assert [(i, j, round(s, 6)) for i, j, s in got] == [(i, j, round(s, 6)) for i, j, s in brute_segments(scores)]


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in toxicity.score(docs.withColumn("toxic", F.lit("x")), toxicity.fit(docs, labels)).collect()}
    assert len(got) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(got[r.doc_id].predicted, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(p == t for p, t in held) / len(held) > 0.95


def test_labels_of_held_out_rows_and_other_columns_change_nothing(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = toxicity.fit(docs, labels)
    assert a == toxicity.fit(docs.withColumn("lang", F.lit("q")).withColumn("source", F.lit("s")), other)


def test_edge_cases(spark):
    rows = [(i, ("you idiot moron " if i % 4 == 0 else "fine words here ") + f"w{i} v{i * 7}") for i in range(80)]
    rows += [(100, None), (101, ""), (102, "idiot " * 30_000), (103, "plain " * 30_000), (104, "IDIOT!"), (104, "IDIOT!")]
    docs = spark.createDataFrame([*rows, (None, "idiot")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(80)] + [(0, 1, 0), (3, 1, None), (None, 0, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    assert [got[i] for i in (100, 101, 102, 103, 104, 0, 1)] == [0, 0, 1, 0, 1, 1, 0]
    assert toxicity.score(docs, model).count() == len(rows) + 1
    assert {r.doc_id for r in toxicity.passages(docs, model).collect()} >= {102}
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs.limit(0), model).collect() == []
    assert {r.predicted for r in toxicity.score(docs, none).collect()} == {0}


def test_labelled_documents_with_a_common_header_all_count(spark):
    header = "Licensed under the terms of a page header, v1.00"
    assert len(header) == 48
    rows = [(i, f"{header} " + ("you grobnik there " if i % 4 == 0 else "fine words here ") + f"w{i} v{i * 7}") for i in range(80)]
    rows += [(1000 + i, f"{header.upper()}  you grobnik   there W0 v0") for i in range(40)]  # of one text, and one vote
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0 or i >= 1000)) for i, _ in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    assert model.token("grobnik") > 0
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    assert all(got[i] == int(i % 4 == 0 or i >= 1000) for i, _ in rows)
    used = toxicity.training_rows(docs, labels, 5, 20_000).collect()
    assert len([r for r in used if "w0 " in r.text.lower()]) == 1


def test_lambda_and_k_are_those_of_the_maxima():
    rng = np.random.default_rng(2)
    n = rng.integers(20, 3000, 20_000)
    for rate, k in ((1.0, 0.01), (1.7, 0.02), (0.6, 0.001)):
        best = np.log(k * n / -np.log(rng.random(len(n)))) / rate
        best = np.where(best > 2, best, 0.0)  # no segment below the least score of a term
        got = toxicity.extreme_value(best, n)
        assert abs(got[0] / rate - 1) < 0.08 and abs(np.log(got[1] / k)) < 0.3
        model = toxicity.Model(rate=got[0], k=got[1])
        p = np.array([model.p_value(s, m) for s, m in zip(best, n, strict=True) if s > 0])
        for alpha in (0.01, 0.05, 0.1):  # p-values of clean rows are uniform where they are known
            assert abs((p <= alpha).sum() / len(n) - alpha) < 0.015


def test_scores_by_brute_force(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    short = docs.filter("length(text) < 1500")
    got = {r.doc_id: r.score for r in toxicity.score(short, model).collect()}
    hits = 0
    for r in short.collect():
        tokens = re.findall(r"[^\W_]+", r.text.lower())
        scores = []
        for t in tokens:
            known = [model.weights[x] for x in (t[:4] + "*" if len(t) > 4 else t, t[:5] + "*" if len(t) > 5 else t, t[:6] + "*" if len(t) > 6 else t, t) if x in model.weights]
            scores.append(known[-1] if known else model.drift)
        p = [-math.expm1(-model.k * len(tokens) * math.exp(-model.rate * s)) for _, _, s in brute_segments(scores)]
        hits += len(p)
        z = model.a + model.b * math.log1p(sum(-math.log(x) for x in p if x < 0.5))
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-z))) < 1e-6
    assert hits > 20
