import hashlib
import math
import random
import warnings
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from duoscope.llm import mixing


SCHEMA = "doc_id long, text string, lang string, source string"


def brute_posteriors(texts, train_docs=None):
    """Naive Bayes by counts: learnt from three quarters of the recorded texts, scaled on the others. texts: (text, domain or None), no text twice."""
    words = lambda t: [xxhash.xxh64_intdigest(w.lower(), 42) for w in (t or "").split()]
    bucket = lambda h: (h - (1 << 64) if h >= 1 << 63 else h) % mixing.BUCKETS
    held = [([bucket(h) for h in words(t)], d, hashlib.md5((t or "").encode()).hexdigest()) for t, d in texts]
    domains = sorted({d for _, d, _ in held if d})
    mass = Counter()
    for w, d, _ in held:
        mass[d] += max(1, len(w))
    prior = [mass[d] / sum(mass[x] for x in domains) for d in domains]
    learnt = lambda digest: (_signed(xxhash.xxh64_intdigest("train", xxhash.xxh64_intdigest(digest, 42))) >> 20) % 4 > 0
    counts = {d: Counter(b for w, x, g in held if x == d and learnt(g) for b in w) for d in domains}
    n = {d: sum(counts[d].values()) for d in domains}
    every = sum(counts.values(), Counter())
    total = max(1, sum(n.values()))
    score = lambda w: [sum(math.log((counts[d][b] * total / every[b] + mixing.SHARED) / (n[d] + mixing.SHARED)) for b in w if every[b]) / max(1, sum(every[b] > 0 for b in w)) for d in domains]

    def soft(w, scale):
        z = [scale * s + math.log(p) for s, p in zip(score(w), prior)]
        e = [math.exp(x - max(z)) for x in z]
        return [x / sum(e) for x in e]

    tests = [(w, domains.index(d)) for w, d, g in held if d and not learnt(g) and any(every[b] for b in w)]
    scale = max(mixing.SCALES, key=lambda s: (sum(math.log(max(soft(w, s)[k], 1e-12)) for w, k in tests), -s))
    return domains, prior, {g: soft(w, scale) for w, _, g in held}, scale


def _signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def spoken(n=300):
    """Texts of three domains with words of their own among common ones; every seventh without a record."""
    rnd = random.Random(4)
    own = {"a": "apple orange pear plum", "b": "bolt screw nail hammer", "c": "Ünï cödé wörds ÉTÉ"}
    out = []
    for i in range(n):
        source = "aabc"[i % 4]
        text = " ".join(rnd.choice(own[source].split() if rnd.random() < 0.3 else ["the", "of", "and", f"n{rnd.randint(0, 50)}"]) for _ in range(rnd.randint(5, 60)))
        out.append((i, text, "en", source if i % 7 else None))
    return out


def test_posteriors_against_brute_force(spark):
    rows = spoken()
    domains, prior, want, scale = brute_posteriors([(t, d) for _, t, _, d in rows])
    docs = mixing.features(spark.createDataFrame(rows, SCHEMA), F.col("source"))
    got = {r.digest: r.soft for r in mixing.classified(docs, domains, prior, 8_000).collect()}
    assert scale > 0 and set(got) == set(want)
    for g, p in got.items():
        assert p == pytest.approx(want[g], abs=1e-9) and sum(p) == pytest.approx(1)
    right = [domains[max(range(3), key=got[hashlib.md5(t.encode()).hexdigest()].__getitem__)] == "aabc"[i % 4] for i, t, _, d in rows if d is None]
    assert sum(right) / len(right) > 0.9


@pytest.mark.filterwarnings("ignore:targets out of reach")
def test_expected_totals_match_the_targets(spark):
    rows = spoken()
    domains, prior, soft, _ = brute_posteriors([(t, d) for _, t, _, d in rows])
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("tokens", F.lit("clash")).withColumn("rate", F.lit(0)).withColumn("top", F.lit(0)).withColumn("digest", F.lit(1))
    full = {k: sum(len(t.split()) for i, t, _, _ in rows if "aabc"[i % 4] == k) for k in "abc"}
    targets = {"a": 0.4 * full["a"], "b": 1.5 * full["b"], "c": 1.0 * full["c"]}
    got = {r.doc_id: r for r in mixing.mixed(docs, targets=targets).collect()}
    assert len(got) == len(rows) and all(r.rate >= 0 and abs(r.copies - r.rate) < 1 for r in got.values())
    of = [0.0] * 3
    for i, t, _, d in rows:  # expected tokens document by document
        p = soft[hashlib.md5(t.encode()).hexdigest()]
        p = [0.5 * x + 0.5 * (k == d) for x, k in zip(p, domains)] if d else p
        of = [o + got[i].rate * len(t.split()) * x for o, x in zip(of, p)]
    assert of == pytest.approx([targets[d] for d in domains], rel=3e-3)


def test_sources_of_the_whole_table(spark):
    """Words say little of the source there, so half of each posterior is the record and half the shares of the sources; targets are met all the same."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        got = mixing.mixed(docs).collect()
    assert len(got) == 1000
    total = sum(r.tokens for r in got)
    assert sum(r.tokens * r.rate for r in got) == pytest.approx(total, rel=2e-3)


def test_rates_follow_the_texts_inside_a_source(spark):
    got = mixing.mixed(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    by_source = {}
    for r in got:
        by_source.setdefault(r.domain, set()).add(r.rate)
    assert all(len(rates) > 1 for source, rates in by_source.items() if source is not None), {k: len(v) for k, v in by_source.items()}


def test_every_domain_with_a_target_meets_it(spark):
    rows = [(i, f"word{i % 7} and more", "en", f"host{i % 80}") for i in range(800)]
    docs = spark.createDataFrame(rows, SCHEMA)
    targets = {f"host{k}": 20.0 + k for k in range(80)}
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        got = mixing.mixed(docs, targets=targets, trust=0.9).collect()
    assert len(got) == 800 and min(r.rate for r in got) > 0
    assert sum(r.tokens * r.rate for r in got) == pytest.approx(sum(targets.values()), rel=0.01)
    with pytest.raises(ValueError, match="have a target"):
        mixing.mixed(docs, targets={str(k): 1.0 for k in range(mixing.MOST_TARGETS + 1)})


def test_gradients_end_where_newton_steps_do(spark):
    held = [("a", 7e6, [0.8, 0.15, 0.05]), ("b", 1e6, [0.2, 0.7, 0.1]), ("c", 4e5, [0.2, 0.2, 0.6]), ("c", 1e5, [0.3, 0.2, 0.5])]
    cells, t = cells_of(spark, held), mixing.np.array([4e6, 2e6, 8e5])
    rate = mixing.fitted(cells, list("abc"), dict(zip("abc", t)), 0.7, 40, 1e-6)
    push = mixing.by_newton(cells, mixing.np.zeros(3), [], mixing.np.arange(3), t, 40, 1e-9)
    a, b = ([r.rate for r in cells.withColumn("rate", x).collect()] for x in (rate, mixing.pushed(push, [])))
    assert a == pytest.approx(b, rel=1e-4)


def test_many_domains_are_pooled(spark):
    rows = [(i, f"word{i % 3} and more", "en", f"host{i % 40}") for i in range(400)]
    got = mixing.mixed(spark.createDataFrame(rows, SCHEMA), most_domains=5).collect()
    assert len(got) == 400 and {r.domain for r in got} == {f"host{i}" for i in range(40)}
    assert sum(r.tokens * r.rate for r in got) == pytest.approx(1200, rel=0.01)


def test_edge_cases(spark):
    odd = [(1, None, None, None), (2, "", "en", "a"), (3, "w " * 60_000, "en", "a"), (None, "x y", "en", "b"), (4, "x y", "en", "b"), (4, "x y", "en", "b")]
    got = mixing.mixed(spark.createDataFrame(odd, SCHEMA)).collect()
    assert len(got) == 6 and all(r.rate >= 0 and r.copies >= 0 for r in got)
    assert {r.rate for r in mixing.mixed(spark.createDataFrame([(1, "x", "en", None)], SCHEMA)).collect()} == {1.0}
    assert mixing.mixed(spark.createDataFrame([], SCHEMA)).collect() == []


def test_only_column_expressions(spark, sf):
    plan = mixing.mixed(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_tiny_source_leaves_the_total_as_it_is(spark):
    mass = {"a": 3e8, "b": 6e7, "tiny": 1e3}
    goal = mixing.tempered(mass)
    assert sum(goal.values()) == pytest.approx(sum(mass.values()))
    assert goal["tiny"] / goal["a"] == pytest.approx((1e3 / 3e8) ** 0.7)
    docs = spark.createDataFrame([(i, "plain words in a row " * 40, "en", "ab"[i % 2]) for i in range(300)] + [(999, "12 34", "en", "tiny")], SCHEMA)
    got = mixing.mixed(docs).collect()
    total = sum(r.tokens for r in got)
    assert sum(r.tokens * r.rate for r in got) == pytest.approx(total, rel=0.05)
    assert sum(r.tokens * r.copies for r in got) > 0.9 * total


def cells_of(spark, held):
    return mixing.checkpointed(spark.createDataFrame(held, "recorded string, mass double, p array<double>"))


@pytest.mark.parametrize("sharp", [1.0, 0.999])
def test_targets_far_from_the_sources_are_met(spark, sharp):
    for mass, targets in (
        ([3e8, 1e8, 1e7], {"a": 1e8, "b": 5e7, "c": 0.0}),
        ([3e8, 1e8, 1e7], {"a": 1e8, "b": 5e7}),
        ([3e8, 1e8, 1e7], {"a": 1e8, "b": 5e7, "c": 1e6}),
        ([3e8, 1e7, 1e5, 1e3], None),
    ):
        domains, k = "abcd"[: len(mass)], len(mass)
        cells = cells_of(spark, [(d, m, [sharp if i == j else (1 - sharp) / (k - 1) for j in range(k)]) for i, (d, m) in enumerate(zip(domains, mass))])
        if targets is None and sharp < 1:
            continue  # what the large domains lend to the smallest is more than its target
        rate = mixing.fitted(cells, list(domains), targets, 0.7, 40, 1e-3)
        of = mixing.expected(cells, rate)
        goal = targets or mixing.tempered(dict(zip(domains, (mixing.expected(cells, F.lit(1.0))[i] for i in range(k)))))
        for i, d in enumerate(domains):
            if goal.get(d):
                assert of[i] == pytest.approx(goal[d], rel=2e-3), (mass, targets, d)
        zero = [d for d in domains if not goal.get(d)]
        assert {r.rate for r in cells.withColumn("rate", rate).collect() if r.recorded in zero} <= {0.0}


def test_targets_out_of_reach_are_reported_and_a_fit_that_does_not_end_raises(spark):
    held = [("a", 3e8, [0.9, 0.08, 0.02]), ("b", 1e8, [0.1, 0.88, 0.02]), ("c", 1e7, [0.05, 0.05, 0.9])]
    cells, targets = cells_of(spark, held), {"a": 1e8, "b": 5e7, "c": 1e4}
    with pytest.warns(UserWarning, match="out of reach"):
        rate = mixing.fitted(cells, list("abc"), targets, 0.7, 40, 1e-3)
    got = [r.rate for r in cells.withColumn("rate", rate).collect()]
    residual = [sum(r * m * p[k] for r, (_, m, p) in zip(got, held)) / t - 1 for k, t in enumerate(targets.values())]
    for r, (_, _, p) in zip(got, held):  # the projected gradient of least squares is next to nothing
        slope = sum(x * y for x, y in zip(p, residual))
        assert abs(slope) < 1e-2 if r > 0 else slope > -1e-2
    with pytest.raises(ValueError, match="did not end"):
        mixing.fitted(cells, list("abc"), targets, 0.7, 0, 1e-3)
