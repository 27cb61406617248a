"""Toxicity by maximum-scoring segments over token log-odds.

A token is a run of letters and digits. Its score is the log-odds of toxic against clean documents,
estimated with Dirichlet priors that lead from the base rate over the token's first 4, 5 and 6
characters to the whole token, so that a rare form of a known stem is scored like its stem. Terms with
a clear positive score make up the model; other tokens have a small negative score. The scan of
Ruzzo and Tompa (1999) finds all maximal segments of a document in linear time.

Segment scores become p-values by extreme-value statistics (Karlin and Altschul, 1990): a document of
n tokens without toxicity has about K n exp(-lambda s) segments of score s or more. lambda and K are
fitted to the largest segments of clean rows. The document's evidence is the sum of -log p over its
significant segments, and two logistic coefficients turn it into a score from 0 to 1. The maxima are
measured for each half of the training rows with the term weights of the other half, so that they are
those of rows not learnt from; weights and coefficients are those of all rows.

Fitting uses at most `train_rows` labelled rows, those with the smallest hashes of their ids, one for
each text but for case and white space, since a text copied a hundred times should not vote a hundred
times. Defined cases: null counts as empty; empty texts have no evidence; rows with a null id are
scored as training rows; labels that are null or contradict each other count as toxic if any is 1;
without labels of both kinds every score is the share of toxic rows, or 0; repeated rows and further
columns change nothing; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duoscope.llm.common import checkpointed, remainder, slices

TOKEN = re.compile(r"[^\W_]+")
STEMS = (4, 5, 6)


def terms(token: str) -> list[str]:
    """The token after its stems, shortest first; stems end in a star."""
    return [*(token[:k] + "*" for k in STEMS if len(token) > k), token]


@dataclass
class Model:
    """weights: score of a term, in nats; drift: of any other token; a, b: of the logistic; rate, k: lambda and K."""

    weights: dict[str, float] = field(default_factory=dict)
    drift: float = -0.05
    rate: float = 1.0
    k: float = 1.0
    a: float = 0.0
    b: float = 0.0
    seen: dict[str, float] = field(default_factory=dict, compare=False, repr=False)  # scores of tokens met, up to a bound

    def token(self, token: str) -> float:
        found = self.drift
        for term in terms(token):
            found = self.weights.get(term, found)
        return found

    def segments(self, text: str) -> tuple[list[tuple[int, int, float]], int]:
        """Maximal segments as (first token, token after the last, score), and the number of tokens."""
        tokens = TOKEN.findall(text.lower())
        if len(self.seen) > 400_000:
            self.seen.clear()
        for t in set(tokens).difference(self.seen):
            self.seen[t] = self.token(t)
        hits = [(i, s) for i, s in enumerate(map(self.seen.__getitem__, tokens)) if s > 0]
        return maximal_segments(hits, self.drift), len(tokens)

    def p_value(self, score: float, n: int) -> float:
        """Of a segment: how probable one of that score or more is in n tokens without toxicity."""
        return -math.expm1(-min(50.0, self.k * n * math.exp(-self.rate * score)))

    def significance(self, scores: list[float], n: int) -> float:
        """The sum of -log p over the segments with a p-value below a half."""
        return -sum(math.log(max(p, 1e-300)) for p in (self.p_value(s, n) for s in scores) if p < 0.5)

    def evidence(self, text: str) -> float:
        found, n = self.segments(text)
        return self.significance([s for _, _, s in found], n)

    def score(self, text: str) -> float:
        z = self.a + self.b * math.log1p(self.evidence(text))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def maximal_segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments; hits: positions and scores of tokens over zero, the others score `drift`."""
    stack: list[tuple[int, int, float, float]] = []  # first, end, sum before it, sum up to its end
    total, last = 0.0, 0
    for at, s in hits:
        total += drift * (at - last)
        last = at + 1
        first, before, after = at, total, total + s
        total = after
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= before:
                j -= 1
            if j < 0 or stack[j][3] >= after:
                stack.append((first, at + 1, before, after))
                break
            first, before = stack[j][0], stack[j][2]
            del stack[j:]
    return [(first, end, after - before) for first, end, before, after in stack]


def training_rows(docs: DataFrame, labels: DataFrame, modulus: int, train_rows: int) -> DataFrame:
    """(text, toxic 0 or 1, half 0 or 1): at most train_rows labelled documents whose id isn't held out."""
    labelled = labels.filter(remainder("doc_id", modulus) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter("toxic is not null")
    chosen = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id")
    whole = F.sha2(F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))), 256)
    once = found.groupBy(whole.alias("whole"), "toxic").agg(F.min_by("text", "doc_id").alias("text"))
    return checkpointed(once.select("text", (F.col("toxic") == 1).cast("int").alias("toxic"), F.pmod(F.xxhash64("whole"), F.lit(2)).cast("int").alias("half")))


COUNTS = ("clean0", "toxic0", "clean1", "toxic1")


def term_counts(rows: DataFrame) -> DataFrame:
    """A term, and in how many training rows of either kind and half it occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = [Counter() for _ in COUNTS]
        for batch in slices(batches, 0):
            for text, toxic, half in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by[toxic + 2 * half].update({x for t in set(TOKEN.findall(text.lower())) for x in terms(t)})
        names = list(set().union(*by))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[x] for x in names], pa.int64()) for c in by)], ["term", *COUNTS])

    counted = rows.select("text", "toxic", "half").mapInArrow(count, "term string, " + ", ".join(f"{c} long" for c in COUNTS))
    return counted.groupBy("term").agg(*[F.sum(c).alias(c) for c in COUNTS])


def weights(found: dict[str, tuple[int, int]], toxic: int, clean: int, drift: float, prior: float, least_docs: int, least_odds: float, least_z: float) -> dict[str, float]:
    """Scores of the terms that enter the model, from their counts in toxic and clean rows."""
    out: dict[str, float] = {}
    if not toxic or not clean:
        return out
    share = toxic / (toxic + clean)
    for term in sorted(found, key=lambda x: (len(x) - x.endswith("*"), not x.endswith("*"), x)):
        t, c = found[term]
        if t < least_docs or t * clean <= c * toxic:
            continue
        expected = share
        for shorter in terms(term.rstrip("*"))[:-1]:
            if shorter != term and shorter in found:
                st, sc = found[shorter]
                expected = (st + prior * share) / (st + sc + prior)
        posterior_t, posterior_c = t + prior * expected, c + prior * (1 - expected)
        odds = math.log(posterior_t / toxic) - math.log(posterior_c / clean)
        z = odds / math.sqrt(1 / posterior_t + 1 / posterior_c)
        if odds >= least_odds and z >= least_z:
            out[term] = odds
        elif any(s in out for s in terms(term.rstrip("*"))[:-1]) and odds < least_odds and c >= least_docs:
            out[term] = drift  # a known form of a toxic stem that isn't toxic itself
    return out


def extreme_value(best: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """lambda and K of rows of n tokens whose largest segments score `best` (0: none).

    The likelihood of P(max < s) = exp(-K n exp(-lambda s)); rows without a segment are known to be below
    the least score that was seen. A normal prior of 0.5 on log lambda around 0, the value for pure
    log-odds, and half a row more than were seen hold where few clean rows have a segment.
    """
    hit, n = best > 0, np.maximum(n, 1)
    least = best[hit].min() if hit.any() else 2.0
    s = np.where(hit, best, least)

    def fitted(rate: float) -> tuple[float, float]:
        mass = (n * np.exp(-rate * s)).sum() + 1e-9
        k = (hit.sum() + 0.5) / mass
        return hit.sum() * math.log(rate * k) - rate * s[hit].sum() - k * mass - math.log(rate) ** 2 / 0.5, k

    rate = max(np.geomspace(0.05, 8, 200), key=lambda r: fitted(r)[0])
    return float(rate), float(fitted(rate)[1])


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, train_rows: int = 20_000, prior: float = 2.0, least_docs: int = 3, least_odds: float = 2.0, least_z: float = 2.5) -> Model:
    """prior: documents that a term's prior counts for; least_*: what a term must show to enter the model."""
    rows = training_rows(docs, labels, modulus, train_rows)
    n = {(r.half, r.toxic): r.n for r in rows.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = (sum(v for (_, kind), v in n.items() if kind == k) for k in (1, 0))
    model = Model()
    if not toxic or not clean:
        model.a = math.log((toxic + 1e-6) / (clean + 1e-6)) if toxic else -50.0
        return model
    seen = term_counts(rows).filter(f"toxic0 + toxic1 >= {least_docs} and (toxic0 + toxic1) * {clean} > (clean0 + clean1) * {toxic}").collect()
    rule = (model.drift, prior, least_docs, least_odds, least_z)
    model.weights = weights({r.term: (r.toxic0 + r.toxic1, r.clean0 + r.clean1) for r in seen}, toxic, clean, *rule)
    of_half = [weights({r.term: (r[f"toxic{h}"], r[f"clean{h}"]) for r in seen}, n.get((h, 1), 0), n.get((h, 0), 0), *rule) for h in (0, 1)]
    others = [Model(weights=of_half[1 - h] or model.weights, drift=model.drift) for h in (0, 1)]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            given = [others[h].segments(x) for x, h in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            best = [max((s for _, _, s in x), default=0.0) for x, _ in given]
            scores = [[s for _, _, s in model.segments(x)[0]] for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(best, pa.float64()), pa.array(scores, pa.list_(pa.float64())), pa.array([size for _, size in given], pa.int64())], ["toxic", "best", "scores", "n"])

    parts = rows.select("text", "toxic", "half").mapInArrow(measured, "toxic int, best double, scores array<double>, n long").toArrow()
    y, best, size = (parts.column(c).to_numpy() for c in ("toxic", "best", "n"))
    model.rate, model.k = extreme_value(best[y == 0], size[y == 0])
    evidence = np.array([model.significance(x, k) for x, k in zip(parts.column("scores").to_pylist(), size, strict=True)])
    model.a, model.b = logistic(np.log1p(evidence), y == 1)
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 50) -> tuple[float, float]:
    """Intercept and slope (not below zero) by Newton's method with a small penalty."""
    w, z = np.zeros(2), np.stack([np.ones_like(x), x], axis=1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(2), z.T @ (y - p) - ridge * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(0.0, w[1]))


def score(docs: DataFrame, model: Model, modulus: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted, one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            scores = [model.score(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(remainder("doc_id", modulus) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, most: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score is below `most`."""

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        parts = slices([pa.RecordBatch.from_arrays([text], ["text"])], 0)
        return pa.array([model.score(x or "") for part in parts for x in part.column(0).to_pylist()], pa.float64())

    return docs.filter(scored(F.col("text").cast("string")) < most)


def passages(docs: DataFrame, model: Model, p_most: float = 0.01) -> DataFrame:
    """doc_id, first, end (token numbers), passage_score, p_value of every significant toxic passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, n = model.segments(text or "")
                for first, end, s in found:
                    p = model.p_value(s, n)
                    if p <= p_most:
                        rows.append((i, first, end, s, p))
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "first", "end", "passage_score", "p_value"), r, strict=True)) for r in rows], schema=out)

    out = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("end", pa.int64()), ("passage_score", pa.float64()), ("p_value", pa.float64())])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, first long, end long, passage_score double, p_value double")
