"""Mixing sources to target weights with soft memberships.

A classifier learnt from a labelled table gives each document a posterior over the domains; document
rates r >= 0 are then fitted by projected gradients so that the expected tokens of each domain,
sum of r * tokens * posterior, match target weights of a total: least squares, weighted by 1 / target.

The classifier is naive Bayes over hashed words, learnt from at most about `train_docs` labelled rows and
calibrated on others of them: the mean log-likelihood ratio of a text's words is scaled by what makes
their records most probable, by little where words say little of the domain. A document whose domain
is recorded has the share `trust` of its posterior there and the rest as classified; one without a
record is classified alone. Documents of one record, one most probable domain and one step of its
odds against its share of all tokens form a cell and have one rate; a cell's posterior is the mean over its tokens, so expected
tokens are those of the documents. The steps are aggregations over the cells, of which sums by domain
and by pair of domains come to the driver. Everything is column expressions. There are at most
`most_domains` domains, those with most tokens; records of others count as one domain more, named OTHER.
A domain that is given a target is always one of its own; more than MOST_TARGETS of them are refused.

Defined cases: null counts as empty, with one token so that it can be drawn, and is classified by the
shares of the domains alone; labels that are null count as no record; domains without documents can't be
reached; documents of a domain whose target is zero or missing have rate 0; a table without labels gives
every document rate 1; rows that repeat id and text get the same rate; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import json
import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duoscope.llm.common import checkpointed

OTHER = "other domains"
MOST_TARGETS = 1024
BUCKETS = 4096  # of hashed words
SHARED = 2000.0  # tokens that the words of all domains count for in each
SCALES = (0.3, 1.0, 3.0, 10.0, 30.0, 100.0, 300.0)
STEPS = 8  # by which cells differ, of how far the most probable domain is from its share
RIDGE = 1e-6  # of rates that are not 1, against the targets


def text_digest(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")))


def features(docs: DataFrame, domain: Column) -> DataFrame:
    """doc_id, digest (MD5 of the text), tokens, recorded (domain or null) and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tokens = F.greatest(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(1)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("digest"), tokens.alias("tokens"), domain.cast("string").alias("recorded"), text.alias("text"))


def hashed_words(rows: DataFrame, *keep: str) -> DataFrame:
    """The columns to keep and bucket, a row for each word."""
    word = F.explode(F.split(F.lower("text"), r"[\x20\x09-\x0D]+")).alias("word")
    return rows.select(*keep, word).filter("word != ''").select(*keep, F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int").alias("bucket"))


def word_scores(rows: DataFrame, weights: DataFrame, d: int, *keep: str) -> DataFrame:
    """The columns to keep and s0 up to s(d-1), the mean score of the words for each domain; weights: bucket, w0 up to w(d-1), at most BUCKETS rows."""
    scored = hashed_words(rows, *keep).join(F.broadcast(weights), "bucket")
    return scored.groupBy(*keep).agg(*[F.avg(f"w{k}").alias(f"s{k}") for k in range(d)])


def softmax(d: int, scale: float, prior: list[float]) -> Column:
    """Posterior over the domains from s0 up to s(d-1), as an array."""
    z = [F.lit(scale) * F.coalesce(F.col(f"s{k}"), F.lit(0.0)) + F.lit(math.log(prior[k])) for k in range(d)]
    top = F.greatest(*z) if d > 1 else z[0]
    return F.transform(F.array(*z), lambda x: F.exp(x - top)) if d == 1 else normalised(F.transform(F.array(*[x - top for x in z]), F.exp))


def normalised(e: Column) -> Column:
    return F.get(F.transform(F.array(e), lambda v: F.transform(v, lambda x: x / F.aggregate(v, F.lit(0.0), lambda a, y: a + y))), F.lit(0))


def classified(docs: DataFrame, domains: list[str], prior: list[float], train_docs: int) -> DataFrame:
    """digest and soft, the posterior of each text that has words."""
    d = len(domains)
    place = F.array_position(F.array(*[F.lit(x) for x in domains]), F.col("recorded")) - 1
    labelled = docs.filter("recorded is not null").withColumn("k", place.cast("int")).withColumn("h", F.xxhash64("digest", F.lit("train")))
    count = labelled.count()
    if count > train_docs:
        labelled = labelled.filter(F.pmod("h", F.lit(1_000_000)) < math.floor(1e6 * train_docs / count))
    labelled = checkpointed(labelled.select("digest", "k", "text", (F.pmod(F.shiftright("h", 20), F.lit(4)) > 0).alias("learnt")))
    counts = hashed_words(labelled.filter("learnt"), "k").groupBy("bucket").pivot("k", list(range(d))).agg(F.count(F.lit(1)))
    counts = checkpointed(counts.na.fill(0).select("bucket", *[F.col(str(k)).alias(f"c{k}") for k in range(d)]))
    n = counts.agg(*[F.coalesce(F.sum(f"c{k}"), F.lit(0)) for k in range(d)]).first()
    total = max(1, sum(n))
    every = sum((F.col(f"c{k}") for k in range(1, d)), F.col("c0"))
    ratio = lambda k: F.log((F.col(f"c{k}") * total / every + SHARED) / (n[k] + SHARED))  # noqa: E731  of a word's frequency in the domain, smoothed by that in all, over the latter
    weights = checkpointed(counts.select("bucket", *[ratio(k).alias(f"w{k}") for k in range(d)]))
    tested = checkpointed(word_scores(labelled.filter("not learnt"), weights, d, "digest", "k"))
    chance = lambda s: F.avg(F.log(F.greatest(F.get(softmax(d, s, prior), F.col("k")), F.lit(1e-12))))
    likely = tested.agg(*[chance(s) for s in SCALES]).first()
    scale = max(zip((x if x is not None else 0.0 for x in likely), SCALES, strict=True), key=lambda x: (x[0], -x[1]))[1]
    return word_scores(docs, weights, d, "digest").select("digest", softmax(d, scale, prior).alias("soft"))


def tempered(mass: dict[str, float], power: float = 0.7) -> dict[str, float]:
    """Target tokens by domain in proportion to mass ** power, of the same total: small domains are repeated, large ones thinned."""
    shares = {d: m**power if m > 0 else 0.0 for d, m in mass.items()}
    scale = sum(m for m in mass.values() if m > 0) / (sum(shares.values()) or 1.0)
    return {d: scale * x for d, x in shares.items()}


def mixed(docs: DataFrame, domain: str = "source", targets: dict[str, float] | None = None, power: float = 0.7, trust: float = 0.5, steps: int = 40, tolerance: float = 1e-3, train_docs: int = 8_000, most_domains: int = 64) -> DataFrame:
    """doc_id, digest, tokens, domain (recorded), rate, copies; one row per document.

    targets: tokens by domain; by default the tempered token totals. copies: rate rounded up or down
    by a hash of id and text, so that its expectation is the rate.
    """
    given = features(docs, F.col(domain))
    small = checkpointed(given.drop("text"))
    wanted = [x for x, goal in (targets or {}).items() if goal > 0]
    if len(wanted) > MOST_TARGETS:
        raise ValueError(f"{len(wanted)} domains have a target, of {MOST_TARGETS} at most")
    by_tokens = checkpointed(small.filter("recorded is not null").groupBy("recorded").agg(F.sum("tokens").alias("mass")))
    own = by_tokens.filter(F.col("recorded").isin(wanted)).collect() if wanted else []
    others = by_tokens.filter(~F.col("recorded").isin(wanted)) if wanted else by_tokens
    top = own + others.orderBy(F.desc("mass"), "recorded").limit(max(0, most_domains - len(own))).collect()
    domains = sorted(r.recorded for r in top)
    chance = F.pmod(F.xxhash64("doc_id", "digest", F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    copies = (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")).cast("int").alias("copies")
    if not domains:
        return small.withColumn("rate", F.lit(1.0)).select("doc_id", "digest", "tokens", F.col("recorded").alias("domain"), "rate", copies)
    masses, labelled = {r.recorded: r.mass for r in top}, small.filter("recorded is not null").agg(F.sum("tokens")).first()[0]
    if labelled > sum(masses.values()):
        domains.append(OTHER)
        masses[OTHER] = masses.get(OTHER, 0) + labelled - sum(masses.values())
        domains = list(dict.fromkeys(domains))
    prior = [masses[x] / labelled for x in domains]
    pooled = F.when(F.col("recorded").isin(domains) | F.col("recorded").isNull(), F.col("recorded")).otherwise(OTHER)
    soft = checkpointed(classified(given.withColumn("recorded", pooled), domains, prior, train_docs))
    whole = small.join(soft, "digest", "left").withColumn("soft", F.coalesce("soft", F.array(*[F.lit(p) for p in prior])))
    best = F.array_max("soft")
    share = F.get(F.array(*[F.lit(p) for p in prior]), F.array_position("soft", best).cast("int") - 1)
    step = F.floor(STEPS * F.asinh(64 * F.log(best / share))).cast("int")  # fine around the share, coarse far from it
    whole = checkpointed(whole.select("doc_id", "digest", "tokens", "recorded", pooled.alias("pooled"), "soft", F.array_position("soft", best).cast("int").alias("top"), step.alias("step")))

    key = ["pooled", "top", "step"]
    sums = [F.sum(F.get("soft", F.lit(k)) * F.col("tokens")).alias(f"t{k}") for k in range(len(domains))]
    cells = whole.groupBy(*key).agg(F.sum("tokens").alias("mass"), *sums)
    shares = [(1 - F.lit(trust) * F.col("pooled").isNotNull().cast("int")) * F.col(f"t{k}") / F.col("mass") + trust * F.coalesce(F.col("pooled") == x, F.lit(False)).cast("double") for k, x in enumerate(domains)]
    cells = checkpointed(cells.select(*key, "mass", F.array(*shares).alias("p")))
    rate = fitted(cells, domains, targets, power, steps, tolerance)
    rated = checkpointed(cells.select(*[F.col(k).alias(f"of_{k}") for k in key], rate.alias("rate")))  # at most the domains squared, times some hundred steps
    same = F.col("pooled").eqNullSafe(F.col("of_pooled")) & (F.col("top") == F.col("of_top")) & (F.col("step") == F.col("of_step"))
    return whole.join(rated, same, "left").select("doc_id", "digest", "tokens", F.col("recorded").alias("domain"), "rate", copies)


def expected(cells: DataFrame, rate: Column) -> dict[int, float]:
    """Expected tokens under the rates, by the number of the domain."""
    rows = cells.withColumn("rate", rate).select(F.posexplode(F.transform("p", lambda x: x * F.col("mass") * F.col("rate"))).alias("d", "x"))
    return {r.d: r.x for r in rows.groupBy("d").agg(F.sum("x").alias("x")).collect()}


def fitted(cells: DataFrame, domains: list[str], targets: dict[str, float] | None, power: float, steps: int, tolerance: float) -> Column:
    """The rate of a cell, as a column over its posterior: max(0, 1 - posterior . push), by domain one push.

    The pushes are found by projected gradients, of the least squares of expected tokens to the targets,
    each over its target, and RIDGE times the squares of rate - 1, which of their many solutions picks the rates
    nearest to 1. A step moves each domain's push by how far its expected tokens are off, over the
    domain's own curvature (diagonal scaling) and the largest eigenvalue that is left, with momentum that
    starts again where it leads uphill (Nesterov; O'Donoghue and Candes); the rates that follow are projected to zero
    or more. The gradient by domain, over its target, must come below half the tolerance. Targets out of
    reach of any rates have no such pushes near; where gradients no longer gain, steps by Newton's
    method, halved until they descend, end the fit, or ValueError is raised; those that least squares leave further off than the
    tolerance are warned of. Domains with no target or zero are no part of this: cells whose most probable
    domain is one of them have rate 0.
    """
    of = expected(cells, F.lit(1.0))
    goal = targets if targets is not None else tempered({d: of.get(i, 0.0) for i, d in enumerate(domains)}, power)
    target = np.array([max(0.0, float(goal.get(d, 0.0))) for d in domains])
    used = np.flatnonzero(target > 0)
    push = np.zeros(len(domains))
    if not len(used):
        return F.lit(0.0)
    zero = np.flatnonzero(target == 0).tolist()
    t = target[used]
    slope = moments(cells, push, zero, used)[2]
    own = np.diag(slope) + RIDGE * t  # all cells have a rate here, so that no curvature is larger later on
    largest = 1.01 * np.linalg.eigvalsh(slope / np.sqrt(np.outer(own, own))).max()
    before, speed, least, since = push[used], 1.0, np.inf, 0
    ended = False
    for _ in range(5 * steps):
        gradient = t - expected_of(cells, push, zero, used) + RIDGE * t * push[used]
        worst = np.abs(gradient / t).max()
        if worst < tolerance / 2:
            ended = True
            break
        least, since = (worst, 0) if worst < 0.7 * least else (least, since + 1)
        if since == 25:
            break
        now = push[used] - gradient / own / max(largest, 1e-12)
        if gradient @ (now - before) > 0:
            speed, push[used] = 1.0, now
        else:
            after = (1 + math.sqrt(1 + 4 * speed * speed)) / 2
            speed, push[used] = after, now + (speed - 1) / after * (now - before)
        before = now
    if not ended:
        push = by_newton(cells, push, zero, used, t, steps, tolerance)
    tokens = expected_of(cells, push, zero, used)
    off = {domains[d]: float(tokens[k] / t[k] - 1) for k, d in enumerate(used) if abs(tokens[k] / t[k] - 1) >= tolerance}
    if off:
        warnings.warn(f"targets out of reach, expected / target - 1: {off}", stacklevel=2)
    return pushed(push, zero)


def expected_of(cells: DataFrame, push: np.ndarray, zero: list[int], used: np.ndarray) -> np.ndarray:
    """Expected tokens of the used domains under the rates of a push."""
    of = expected(cells, pushed(push, zero))
    return np.array([of.get(int(d), 0.0) for d in used])


def by_newton(cells: DataFrame, push: np.ndarray, zero: list[int], used: np.ndarray, t: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """The pushes by Newton steps on the same problem, for targets that no rates meet."""
    push = push.copy()
    dual = lambda squares, y: squares + t @ y + RIDGE / 2 * (t * y) @ y
    squares, tokens, slope = moments(cells, push, zero, used)
    for left in range(steps, -1, -1):
        y = push[used]
        gradient = t - tokens + RIDGE * t * y
        if np.abs(gradient / t).max() < tolerance / 2:
            return push
        if not left:
            break
        # scaled by the targets; the small term is for directions that no cell with a rate has
        step = -np.linalg.solve(slope / np.sqrt(np.outer(t, t)) + RIDGE * np.eye(len(t)), gradient / np.sqrt(t)) / np.sqrt(t)
        length, now = 1.0, dual(squares, y)
        while True:
            push[used] = y + length * step
            squares, tokens, slope = moments(cells, push, zero, used)
            if dual(squares, push[used]) <= now + 1e-4 * length * (gradient @ step) + 1e-12 * abs(now):
                break
            length /= 2
            if length < 1e-9:
                raise ValueError("the fit of the rates found no descent")
    raise ValueError(f"the fit of the rates did not end within {steps} steps")


def pushed(push: np.ndarray, zero: list[int]) -> Column:
    """max(0, 1 - posterior . push), and 0 where the most probable domain is one of `zero`."""
    given = F.from_json(F.lit(json.dumps(push.tolist())), "array<double>")
    rate = F.greatest(F.lit(0.0), 1.0 - F.aggregate(F.zip_with("p", given, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x))
    top = F.array_position("p", F.array_max("p")) - 1
    return F.when(top.isin(zero), 0.0).otherwise(rate) if zero else rate


def moments(cells: DataFrame, push: np.ndarray, zero: list[int], used: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Half the sum of tokens * rate ** 2, expected tokens, and their slopes by push (with the sign turned), over the used domains."""
    held = cells.withColumn("rate", pushed(push, zero)).filter("rate > 0")
    k = F.array(*[F.col("p")[int(d)] for d in used])
    held = held.select(F.col("mass").cast("double").alias("mass"), "rate", k.alias("q"))
    first = F.array(F.col("mass") * F.col("rate") * F.col("rate") / 2)
    second = F.transform("q", lambda x: x * F.col("mass") * F.col("rate"))
    third = F.flatten(F.transform("q", lambda x: F.transform("q", lambda y: x * y * F.col("mass"))))
    rows = held.select(F.posexplode(F.concat(first, second, third)).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    n = len(used)
    found = np.zeros(1 + n + n * n)
    for r in rows:
        found[r.i] = r.x
    return float(found[0]), found[1 : n + 1], found[n + 1 :].reshape(n, n)
