"""Secret scans: three fixed patterns, and a likelihood ratio of two character Markov models.

All of it is column expressions. Positions come from the stretches between the matches of a pattern,
whose lengths add up. The models are bigram counts over the characters from `+` to
`z`, smoothed by their frequencies: one of random strings, learnt from the values that the fixed patterns find, the other of
ordinary identifiers, learnt from words that no pattern touches. A run of at least `least_run` such
characters is a secret if its log-likelihood ratio reaches `least_ratio` nats and `least_mean` nats a
character. Fitting uses at most about `train_docs` documents, chosen by a hash of their ids; 80 x 80
counts for each model come to the driver.

Defined cases: a null or empty text has no spans; spans of one pattern never overlap; the model adds
no span over a fixed one; without labelled strings the ratio is that of the smoothed counts; repeated
rows are scanned as often as they occur; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import functools
import json
import math
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns, the least length of what counts, and the group that is measured.
KINDS = {
    "assign": (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
MARKS = {"assign": (":", "="), "access": ("AKIA",)}  # of which a text with such a match holds one
SPAN = "array<struct<start:int,kind:int,end:int,run:string>>"
BLOCK = 256
LOW, WIDTH = 43, 80  # of the characters that the models know, from + to z
PRIOR = 20.0  # transitions that the frequencies of characters count for


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, zero: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each value of an array all those before it, combined by an associative op.

    Block by block, since an array that grows by one is copied each time: a text with 40,000 matches
    costs 40,000 copies of half a block instead of half of 40,000 arrays.
    """

    def along(start: Column, block: Column) -> Column:
        grown = F.aggregate(block, F.array(start), lambda a, x: F.concat(a, F.array(op(F.element_at(a, -1), x))))
        return F.slice(grown, F.lit(1), F.size(block))

    def in_blocks(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda i: F.slice(v, i * BLOCK + 1, F.lit(BLOCK)))
        return let(blocks, lambda bs: F.flatten(F.zip_with(along(zero, F.transform(bs, lambda block: F.aggregate(block, zero, op))), bs, along)))

    return let(values, lambda v: F.when(F.size(v) > 0, in_blocks(v)).otherwise(F.slice(v, 1, 0)))


def located(text: Column, pattern: str, kind: int, group: int = 0, least: int = 1, keep: bool = False) -> Column:
    """Spans of the leftmost non-overlapping matches whose group has at least `least` characters, in code points.

    keep: with the match as `run`, since to take it from a long text by position would read all before it.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    between = F.split(text, pattern, -1)
    matches = F.zip_with(F.zip_with(between, whole, lambda b, w: F.struct(F.length(b).alias("b"), F.length(w).alias("w"), (w if keep else F.lit(None).cast("string")).alias("run"))), part, lambda x, p: F.struct(x["b"].alias("b"), x["w"].alias("w"), x["run"].alias("run"), F.length(p).alias("p")))

    def spans(m: Column) -> Column:
        before = running(F.transform(m, lambda x: x["b"] + F.coalesce(x["w"], F.lit(0))), F.lit(0), lambda a, b: a + b)
        placed = F.zip_with(m, before, lambda x, at: F.struct((at + x["b"]).alias("start"), F.lit(kind).alias("kind"), (at + x["b"] + x["w"]).alias("end"), x["run"].alias("run"), x["p"].alias("p")))
        return F.transform(F.filter(placed, lambda x: F.coalesce(x["p"] >= least, F.lit(False))), lambda x: F.struct(*[x[c].alias(c) for c in ("start", "kind", "end", "run")]))

    return F.when(text.rlike(pattern), let(matches, spans)).otherwise(F.array()).cast(SPAN)


def apart(runs: Column, base: Column) -> Column:
    """The runs that overlap none of the base spans, by one sweep over all of them in order."""
    is_run = lambda x: x["kind"] >= len(KINDS)
    beyond = F.lit((1 << 31) - 1)

    def swept(every: Column) -> Column:
        ended = running(F.transform(every, lambda x: F.when(is_run(x), 0).otherwise(x["end"])), F.lit(0), lambda a, b: F.greatest(a, b))
        begins = F.reverse(running(F.transform(F.reverse(every), lambda x: F.when(is_run(x), beyond).otherwise(x["start"])), beyond, lambda a, b: F.least(a, b)))
        met = F.zip_with(F.zip_with(every, ended, lambda x, e: F.struct(x.alias("x"), e.alias("ended"))), begins, lambda x, b: F.struct(x["x"].alias("x"), x["ended"].alias("ended"), b.alias("begins")))
        free = F.filter(met, lambda m: is_run(m["x"]) & (m["ended"] <= m["x"]["start"]) & (m["begins"] >= m["x"]["end"]))
        return F.transform(free, lambda m: m["x"])

    return F.when(F.size(runs) > 0, let(F.array_sort(F.concat(base, runs)), swept)).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> dict[str, Column]:
    """Spans by kind. Runs that the least length leaves out are left out by the pattern where that can't change other matches."""
    out = {}
    for i, (kind, (pattern, group, least)) in enumerate(KINDS.items()):
        if not group:  # one class of characters up to the end of the match: a match too short has nothing long enough inside
            head, _, rest = pattern.partition("[")
            pattern = f"{head}[{rest[:-1]}{{{least - len(head)},}}+"
            pattern = pattern if head else f"(?<![{rest[:-2]}]){pattern}"
        found = located(text, pattern, i, group, least)
        marks = [text.contains(x) for x in MARKS.get(kind, ())]
        out[kind] = F.when(functools.reduce(operator.or_, marks), found).otherwise(F.array().cast(SPAN)) if marks else found
    return out


def run_pattern(least_run: int) -> str:
    return rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{least_run},}}+"


def training_strings(docs: DataFrame, train_docs: int) -> DataFrame:
    """(string, random): distinct strings from at most about train_docs documents, labelled by the fixed patterns."""
    count = docs.count()
    chosen = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if count > train_docs:
        chosen = chosen.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < math.floor(1e6 * train_docs / count))
    long = lambda pattern, group, least: F.filter(F.regexp_extract_all("text", F.lit(pattern), F.lit(group)), lambda x: F.length(x) >= least)
    random = F.concat(*[long(*x) for x in KINDS.values()])
    bare = F.regexp_replace("text", "|".join(p for p, _, _ in (KINDS["assign"], KINDS["access"])) + "|[0-9a-f]{16,}", " ")
    ordinary = F.regexp_extract_all(bare, F.lit(r"[A-Za-z_][A-Za-z0-9_-]{5,}"), F.lit(0))
    labelled = F.concat(F.transform(random, lambda x: F.struct(x.alias("string"), F.lit(1).alias("random"))), F.transform(ordinary, lambda x: F.struct(x.alias("string"), F.lit(0).alias("random"))))
    return chosen.select(F.inline(labelled)).distinct()


def code(char: Column) -> Column:
    """The number of a character, -1 for those that the models don't know (only the dot, slash and below are few enough to matter)."""
    at = F.ascii(char) - LOW
    return F.when((at >= 0) & (at < WIDTH), at).otherwise(-1)


def fit(docs: DataFrame, train_docs: int = 8_000) -> list[float]:
    """Log-likelihood ratios of 80 x 80 pairs of characters, random over ordinary."""
    n = F.length("string") - 1
    pairs = F.zip_with(F.slice("chars", F.lit(1), n), F.slice("chars", F.lit(2), n), lambda a, b: F.concat(a, b))
    rows = training_strings(docs, train_docs).filter(F.length("string") > 1).withColumn("chars", F.split("string", "")).select("random", F.explode(pairs).alias("pair")).groupBy("random", "pair").agg(F.count("*").alias("n"))
    first, second = code(F.substring("pair", 1, 1)), code(F.substring("pair", 2, 1))
    counted = rows.select("random", first.alias("a"), second.alias("b"), "n").filter("a >= 0 and b >= 0").groupBy("random", "a", "b").agg(F.sum("n").alias("n")).collect()
    n = [[0] * (WIDTH * WIDTH) for _ in range(2)]
    for r in counted:
        n[r.random][r.a * WIDTH + r.b] = r.n
    logs = []
    for table in n:  # smoothed towards how often the second character occurs at all
        total = sum(table)
        often = [(sum(table[b::WIDTH]) + 0.5) / (total + 0.5 * WIDTH) for b in range(WIDTH)]
        rows_of = [sum(table[a * WIDTH : (a + 1) * WIDTH]) for a in range(WIDTH)]
        logs.append([math.log((c + PRIOR * often[i % WIDTH]) / (rows_of[i // WIDTH] + PRIOR)) for i, c in enumerate(table)])
    ordinary, random = logs
    return [r - o for r, o in zip(random, ordinary, strict=True)]


def codes(string: Column) -> Column:
    return F.transform(F.split(string, ""), code)


def ratio(codes: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of the transitions of a string, given the numbers of its characters; pairs with an unknown one add nothing."""
    table = F.from_json(F.lit(json.dumps([round(x, 5) for x in model])), "array<double>")
    last = F.struct(F.lit(-1).alias("code"), F.lit(0.0).alias("total"))

    def add(state: Column, b: Column) -> Column:
        a = state["code"]
        step = F.when((a >= 0) & (b >= 0), F.get(table, a * WIDTH + b)).otherwise(0.0)
        return F.struct(b.alias("code"), (state["total"] + step).alias("total"))

    return F.aggregate(codes, last, add, lambda s: s["total"])


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, "markov")])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, model: list[float], least_run: int = 12, least_ratio: float = 12.0, least_mean: float = 0.5) -> DataFrame:
    """doc_id, base (array of spans of the fixed patterns), added (spans of the model), text; one row per document."""
    spans = base_spans(F.col("text"))
    found = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = found.select("doc_id", "text", *[s.alias(k) for k, s in spans.items()], located(F.col("text"), run_pattern(least_run), len(KINDS), keep=True).alias("runs"))
    base = F.concat(*[F.col(k) for k in KINDS])
    spelt = F.transform(apart(F.col("runs"), base), lambda r: F.struct(r.alias("span"), codes(r["run"]).alias("codes")))
    random = F.filter(spelt, lambda x: ratio(x["codes"], model) >= F.greatest(F.lit(least_ratio), least_mean * F.size(x["codes"])))
    return found.select("doc_id", *KINDS, base.alias("base"), F.transform(random, lambda x: x["span"]).alias("added"), "text")


def digests(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of what scan() returns."""
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return scanned.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"))
