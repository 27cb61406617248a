import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from duoscope.llm import pst, queries, suffix_tree
from tests.llm.test_pst import ROWS, brute

HELD = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 == 2]
USED = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 != 2]


def spelt(text):
    return b" ".join([*(text or "").encode().lower().split(), b""]) + b"\n"


def direct(train, text, depth, p_min, divergence):
    """The score of a text: states found by the method's steps, then every symbol by the longest state that the bytes before it end in."""
    after = defaultdict(Counter)
    for t in train:
        s = b"\n" * depth + spelt(t)
        for i in range(depth, len(s)):
            for d in range(depth + 1):
                after[s[i - d : i]][s[i]] += 1
    least = max(1, p_min * sum(after[b""].values()))
    after = {s: n for s, n in after.items() if sum(n.values()) >= least}

    def p(s, x):  # smoothed from the shortest suffix up
        n = after[s]
        lower = p(s[1:], x) if s else 1 / 257
        return (n[x] + len(n) * lower) / (sum(n.values()) + len(n))

    states = {b""}
    for s, n in after.items():
        total = sum(n.values())
        gain = s and sum(c / total * math.log(p(s, x) / p(s[1:], x)) for x, c in n.items())
        if s and gain >= divergence and total * gain >= len(n) / 2 * math.log(total + 1):
            states.update(s[i:] for i in range(len(s)))

    s, logp, used = b"\n" * depth + spelt(text), 0, set()
    for i in range(depth, len(s)):
        state = next(s[i - d : i] for d in range(depth, -1, -1) if s[i - d : i] in states)
        used.add(state)
        logp += math.log10(p(state, s[i]))
    return logp, used


def test_contexts_reach_over_words(spark, tmp_path):
    """Both words follow as often and open alike; which one comes was settled by the word before, more than three bytes back."""
    texts = [*[(i, "ab wxyz1" if k % 2 else "cd wxyz2") for k, i in enumerate(USED[:200])], *zip(HELD, ["ab wxyz1", "ab wxyz2", "cd wxyz1", "cd wxyz2"], strict=False)]
    pq.write_table(pa.table({"doc_id": [i for i, _ in texts], "text": [t for _, t in texts]}), f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.score for r in queries.op5_suffix_tree(spark, str(tmp_path)).collect()}
    a1, a2, c1, c2 = (got[i] for i in HELD[:4])
    assert a1 > a2 + 1 and c2 > c1 + 1


@pytest.mark.parametrize("block_bytes", [8 << 20, 4000])
@pytest.mark.parametrize(("depth", "p_min", "divergence", "longest"), [(6, 1e-6, 0.005, 6), (6, 2e-3, 0.05, 4), (3, 1e-6, 0.005, 3), (0, 1e-6, 0.005, 0)])
def test_scores_by_the_longest_state(spark, depth, p_min, divergence, longest, block_bytes):
    rnd = np.random.default_rng(5)
    word = lambda: "".join(rnd.choice(["th", "e", "an", "d", "É", "r"], rnd.integers(1, 5)))
    train = [None if i % 50 == 0 else " ".join(word() for _ in range(int(rnd.integers(0, 9)))) for i in range(150)]
    texts = ["".join(chr(97 + i * i % 23) for i in range(3000)), "", None, "the and  THE\tander\n", "é zebra \x00 \U0001f600", "thed " * 50]
    docs = spark.createDataFrame([*zip(USED, train, strict=False), *zip(HELD, texts, strict=False)], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.score for r in suffix_tree.score(docs, depth=depth, p_min=p_min, divergence=divergence, block_bytes=block_bytes, bucket_bytes=block_bytes).collect()}
    used = set()
    for i, t in [*zip(HELD, texts, strict=False), *zip(USED[:9], train, strict=False)]:
        want, states = direct(train, t, depth, p_min, divergence)
        used |= states
        assert got[i] == pytest.approx(want, rel=1e-9)
    assert max(map(len, used)) == longest and (longest < 6 or any(b" " in s.strip() for s in used))


@pytest.mark.parametrize("block_bytes", [8 << 20, 40])
def test_base_against_brute_force(spark, block_bytes):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("c", F.lit(1))
    got = suffix_tree.score(docs, block_bytes=block_bytes).collect()
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == brute(ROWS)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_whole_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = suffix_tree.score(docs).collect()
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize(("size", "most"), [("sf0.01", 0.14), ("sf0.1", -0.2)])
def test_all_held_out_documents(spark, size, most):
    """What a token costs more than in the base, in log10."""
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    score, base, tokens = suffix_tree.score(docs).filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    print(size, score / tokens, base / tokens)
    assert (base - score) / tokens < most


def test_symbols_in_windows():
    texts = [[b"ab", b"c", b""], [b""], [b"x" * 50, b""]]
    whole = [np.concatenate(x) for x in zip(*suffix_tree.symbols(texts, 2), strict=True)]
    assert [int(k).to_bytes(3, "big") for k in whole[1][:7]] == [b"\n\na", b"\nab", b"ab ", b"b c", b" c ", b"c \n", b"\n\n\n"]
    assert np.bincount(whole[0]).tolist() == [6, 1, 52]
    for window in (1, 2, 7):
        assert all((np.concatenate(x) == y).all() for x, y in zip(zip(*suffix_tree.symbols(texts, 2, window), strict=True), whole, strict=True))
    assert list(suffix_tree.symbols([], 2)) == []


def test_states_as_in_the_tree():
    rnd = np.random.default_rng(3)
    texts = [[bytes(rnd.choice(list(b"aab\xff\x80"), 5)) for _ in range(9)] + [b""] for _ in range(300)]
    keys, n = suffix_tree.merged([np.unique(k, return_counts=True) for _, k in suffix_tree.symbols(texts, 6)])
    every = [suffix_tree.merged([((keys & (1 << 8 * d + 8) - 1) + (d << 56), n)]) for d in range(7)]
    tree = pst.Tree(*(np.concatenate(x) for x in zip(*every, strict=True)), 6, 0.005)
    assert all(len(level[2]) for level in tree.levels)
    other = [*texts[::3], [b""], [b"zaab", b"\xff" * 9, b"q\x00", b""]] * 3
    text, key = (np.concatenate(x) for x in zip(*suffix_tree.symbols(other, 6), strict=True))
    want = np.bincount(text, tree.symbol(key >> 8, key & 255, np.full(len(key), 6)))
    assert suffix_tree.scores(suffix_tree.States(tree), other, 6) == pytest.approx(want, rel=1e-12)


def test_merged_counts():
    assert [x.tolist() for x in suffix_tree.merged([(np.array([3, 5]), np.array([1, 2])), (np.array([0, 5]), np.array([4, 8]))])] == [[0, 3, 5], [4, 1, 10]]
    assert [len(x) for x in suffix_tree.merged([])] == [0, 0]


def test_packed_counts():
    keys, n = np.array([0, 7, 1 << 40, (1 << 56) - 1]), np.array([1, 300, 1 << 33, 2])
    for size in (0, 1, 4):
        assert [x.tolist() for x in suffix_tree.unpacked(suffix_tree.packed(keys[:size], n[:size]), size)] == [keys[:size].tolist(), n[:size].tolist()]


@pytest.mark.parametrize(("depth", "buckets", "most"), [(6, 1, 1 << 20), (6, 7, 50), (3, 3, 1), (2, 3, 50), (0, 1, 50)])
def test_suffix_counts_whatever_the_buckets(spark, sf, depth, buckets, most):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(20)
    want, total = Counter(), Counter()
    for r in docs.collect():
        s = b"\n" * depth + spelt(r.text)
        for i in range(depth, len(s)):
            for d in range(depth + 1):
                want[d, s[i - d : i], s[i]] += 1
                total[s[i - d : i]] += 1
    want = {(d << 56) + (int.from_bytes(s, "big") << 8) + x: c for (d, s, x), c in want.items() if d <= 2 or total[s] >= 9}
    assert {r.key: r.c for r in suffix_tree.suffixes(docs, depth, 9, buckets, most).collect()} == want


def test_without_training_or_rows(spark):
    rows = [(HELD[0], "ab"), (HELD[1], None)]
    got = {r.doc_id: r.score for r in suffix_tree.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == pytest.approx({HELD[0]: -4 * math.log10(257), HELD[1]: -math.log10(257)})
    assert suffix_tree.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError, match="depth"):
        suffix_tree.score(spark.createDataFrame([], "doc_id long, text string"), depth=7)
