import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from duoscope.llm import pst

ROWS = [(0, None), (1, ""), (2, "The cat the dog"), (3, "a cat É é"), (4, " \n\t"), (5, "x" * 30_000), (6, "the the THE"), (6, "the the THE"), (7, "unseen wörter"), (14, "dog")]


def brute(rows):
    tokens = {k: [*(t or "").encode().lower().split(), b""] for k, (_, t) in enumerate(rows)}
    out = {k: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for k, (i, _) in enumerate(rows)}
    c = Counter(w for k, ws in tokens.items() if not out[k] for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted((rows[k][0], out[k], len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for k, ws in tokens.items())


@pytest.mark.parametrize("block_bytes", [8 << 20, 40])
def test_base_against_brute_force(spark, block_bytes):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("c", F.lit(1))
    got = pst.score(docs, block_bytes=block_bytes).collect()
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == brute(ROWS)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_whole_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = pst.score(docs).collect()
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize(("size", "known"), [("sf0.01", 0.95), ("sf0.1", 0)])
def test_beats_the_base_on_held_out_documents(spark, size, known):
    """The base gives every unseen word 1 / (N + V + 1), whatever their number, so with few training tokens only texts of known words compare."""
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    held = pst.score(docs).filter(f"held_out and n_known >= {known} * n_tokens").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


@pytest.mark.parametrize(("size", "most"), [("sf0.01", 0.16), ("sf0.1", -0.15)])
def test_all_held_out_documents(spark, size, most):
    """What a token costs more than in the base, in log10: at sf0.01 a sixth of the tokens are unseen words, many of them ids and secrets, each of which the base gives 1 / (N + V + 1) without ever summing to one."""
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    score, base, tokens = pst.score(docs).filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (base - score) / tokens < most


def test_distributions_sum_to_one():
    rnd = np.random.default_rng(2)
    text = rnd.choice(list(b"aabbbcd "), 4000, p=[0.3, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1]).astype(np.int64)
    keys = []
    for d in range(4):
        key = text[3:].copy()
        for j in range(1, d + 1):
            key |= text[3 - j : -j] << (8 * j)
        keys.append(key + (d << 56))
    keys, c = np.unique(np.concatenate(keys), return_counts=True)
    tree = pst.Tree(keys, c, 3, 0.01)
    assert all(len(level[2]) for level in tree.levels[:2])
    symbols = np.arange(257)  # the one beyond all bytes never occurs, but has its share
    for context in (b"", b"a", b"ab", b"bba", b"zzz", b"q a"):
        ctx = np.full(257, int.from_bytes(context, "big"))
        assert (10 ** tree.symbol(ctx, symbols, np.full(257, len(context)))).sum() == pytest.approx(1)


def test_openings():
    text, key = pst.openings([[b"the", b"a", b"of", b"", b""][:3] + [b""], [b""], [b"xy", b""]])
    tail = lambda k: (int(k) >> 24).to_bytes(3, "big")
    opening = lambda k: (int(k) & 0xFFFFFF).to_bytes(3, "big")
    assert text.tolist() == [0, 0, 0, 0, 1, 2, 2]
    assert [opening(k) for k in key] == [b"the", b"a \0", b"of ", b"\n\0\0", b"\n\0\0", b"xy ", b"\n\0\0"]
    assert [tail(k) for k in key] == [b"\0\0\0", b"the", b"e a", b" of", b"\0\0\0", b"\0\0\0", b"\0xy"]


def test_empty_table(spark):
    assert pst.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def direct(spark, train, text):
    """The score of a text from the two trees and plain counts, token by token."""
    c = Counter(w for t in train for w in [*t.encode().lower().split(), b""])
    start = lambda w: (w + b" ")[:3] if w else b"\n"
    speller = pst.fit(pst.gram_counts(spark.createDataFrame(list(c.items()), "word binary, c long"), 6), 6, 1e-5, 0.005, pst.BYTES)
    keys = Counter(pst.openings([[*t.encode().lower().split(), b""] for t in train])[1].tolist())
    opener = pst.fit(pst.opening_counts(spark.createDataFrame(list(keys.items()), "key long, c long")), pst.TAIL, 1e-5, 0.005, pst.OPENINGS)
    tokens = [*text.encode().lower().split(), b""]
    _, key = pst.openings([tokens])
    total = float(opener.symbol(key >> 24, key & (1 << 24) - 1, np.full(len(key), pst.TAIL)).sum())
    for w in tokens:
        rest = float(np.subtract(*(x[0] for x in speller.words([w]))))
        of_opening, types = (sum(n if total else 1 for v, n in c.items() if start(v) == start(w)) for total in (True, False))
        if c[w]:
            total += math.log10((c[w] + types * 10**rest) / (of_opening + types))
        else:
            total += rest + (math.log10(types / (of_opening + types)) if types else 0)
    return total


def test_scores_against_a_direct_sum(spark):
    ids = [i for i in range(300) if zlib.crc32(str(i).encode()) % 7 == 2]
    used = [i for i in range(100) if i not in ids]
    long = "".join(chr(97 + i * i % 23) for i in range(3000))
    train = [f"the cat {'ab'[i % 2]}cd the dog then {'thin' if i % 3 else 'thesis'} a" for i in used]
    texts = [long, "the", "", "thermal cat", "a THE \té dog zebra", f"x{long} the cat"]
    docs = spark.createDataFrame([*zip(used, train, strict=True), *zip(ids, texts, strict=False)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in pst.score(docs).collect()}
    for i, text in zip(ids, texts, strict=False):
        assert got[i] == pytest.approx(direct(spark, train, text), rel=1e-9)
    assert got[ids[0]] < -1000 and got[ids[5]] < got[ids[0]]
