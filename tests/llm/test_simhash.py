import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from duoscope.llm import simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    fps = {i: brute_fingerprint(t) for i, t in rows}
    parent = {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (f"{fps[i]:016x}", find(i)) for i in fps}


def test_masks_cover_every_pair_within_the_radius():
    masks = simhash.covering_masks(3)
    assert len(masks) == 15
    rnd = random.Random(1)
    for bits in [*itertools.combinations(range(64), 2), *(rnd.sample(range(64), 3) for _ in range(20_000))]:
        assert any(not any(m >> b & 1 for b in bits) for m in masks)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("fp", F.lit(1))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [(5, None), (3, ""), (9, " \n"), (7, "one two"), (8, "ONE\ttwo"), (2, "É a b c"), (1, "é a b c"), (4, long), (6, long + " end"), (6, long + " end")]
    got = [tuple(r) for r in simhash.near_duplicates(spark.createDataFrame([*rows, (None, "one two")], "doc_id long, text string")).collect()]
    want = brute(dict(rows).items())
    assert sorted(x for x in got if x[0] is not None) == sorted((i, *want[i]) for i, _ in rows)
    assert [x for x in got if x[0] is None] == [(None, want[7][0], None)]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_large_bucket_is_cut_into_tiles_and_chains_are_followed(spark):
    rnd = np.random.default_rng(3)
    rows, fp = [], int(rnd.integers(0, 1 << 63))
    for i in range(600):  # a chain: each differs from the one before in 3 bits
        rows.append((i, fp - (1 << 64) if fp >= 1 << 63 else fp))
        for b in rnd.choice(64, 3, replace=False):
            fp ^= 1 << int(b)
    nodes = spark.createDataFrame(rows, "node long, fp long")
    from duoscope.llm.components import connected_components

    for tile_rows in (4, 1000):
        found = connected_components(simhash.near_edges(nodes, 3, tile_rows)).collect()
        assert {r.component for r in found} == {0} and len(found) == 600


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def similar(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) >= 0.8 * len(x | y)


def groups(rows):
    """For each (id, text), by position, the smallest id of its component over all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, hashlib.md5(fold(rows[i][1])).digest()))
    rank = {i: r for r, i in enumerate(order)}
    for a, b in itertools.combinations(range(len(rows)), 2):
        if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)), key=rank.__getitem__)
            parent[y] = x
    return [find(i) for i in range(len(rows))]


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()


def check(spark, rows, **settings):
    """Against all pairs: of each component one row stays, the first by id; copies counts rows that repeat id and text."""
    first = groups(rows)
    key = lambda i: (rows[i][0], hashlib.md5(fold(rows[i][1])).digest())
    copies = Counter(map(key, range(len(rows))))
    want = {key(i): (key(first[i]) == key(i), copies[key(i)]) for i in range(len(rows))}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("component", F.lit("x"))
    got = simhash.similar_documents(docs, **settings).collect()
    assert {(r.doc_id, bytes(r.digest)): (r.kept, r.copies) for r in got} == want and len(got) == len(want)
    return want


def test_similar_documents_of_the_table_and_of_one_set_of_words(spark, sf):
    """Many texts have the same words in other orders, so that most candidates fail and few link."""
    rnd = random.Random(5)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    words = [f"word{i}" for i in range(60)]
    for _ in range(12):
        own = rnd.sample(words, 60)
        rows += [(rnd.randrange(10**6, 10**7), " ".join(own if not k else [*own[:20], *(["a"] if k == 1 else ["b", "c"]), *own[20:]])) for k in range(3)]
    rows += [(10**8 + i, " ".join([*words[:55], f"extra{i}", f"other{i}"])) for i in range(40)]
    rows += [(None, rows[0][1]), (10**9, None), (10**9 + 1, " "), (rows[3][0], "another text under an id that is taken"), rows[5], rows[5]]
    assert sum(not kept for kept, _ in check(spark, rows, tile_rows=16).values()) > 50
    assert simhash.similar_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def edited_pairs(rnd, words, long, edits, n=150):
    """Pairs of a text and a copy with some of its long words (of any words where none is long) changed, at a similarity of 0.8 or more."""
    letters = lambda k: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    out = []
    while len(out) < n:
        text = [letters(9) if i < long * words else letters(rnd.randint(2, 4)) for i in range(words)]
        rnd.shuffle(text)
        copy, at = list(text), [i for i, w in enumerate(text) if len(w) > 4] or list(range(words))
        for i in rnd.sample(at, edits):
            copy[i] = letters(len(copy[i]))
        pair = " ".join(text), " ".join(copy)
        if similar(*pair):
            out.append(pair)
    return out


def test_all_pairs_are_found_whatever_the_words(spark):
    rnd = random.Random(9)
    shapes = [(50, 0.5, 1), (100, 0.5, 2), (100, 0.1, 1), (200, 0.1, 3), (1000, 0.1, 16), (100, 0.0, 2)]
    rows, of = [], {}
    for shape in shapes:
        for a, b in edited_pairs(rnd, *shape):
            of[len(rows) + 1] = shape
            rows += [(len(rows), a), (len(rows) + 1, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {r.doc_id for r in simhash.similar_documents(docs, tile_rows=64, sample_docs=300).filter("not kept").collect()}
    assert Counter(of[i] for i in gone) == dict.fromkeys(shapes, 150) and len(gone) == len(of)


@pytest.mark.parametrize(("settings"), [{"tile_rows": 8, "sample_docs": 20, "few": 2, "tile_shingles": 300}, {}])
def test_groups_around_a_common_passage(spark, settings):
    """Groups larger than `few` and than a tile, some of which only the comparison in tiles can join."""
    rnd = random.Random(10)
    passage = [f"of{i % 7} to{i}" for i in range(30)]
    rows = []
    for i in range(40):
        own = [rnd.choice("abcdefgh") + str(rnd.randint(0, 99)) for _ in range(rnd.choice([6, 40, 90]))]
        for _ in range(4):
            text = list(own)
            for _ in range(rnd.randint(0, 3)):
                text[rnd.randrange(len(text))] = str(rnd.randint(0, 999))
            rows.append((len(rows), " ".join([*passage, *text] if i % 2 else text)))
    chain = [f"c{i}" for i in range(60)]
    for i in range(50):  # each is like its neighbours and not like those further off
        rows.append((len(rows), " ".join(chain)))
        chain[rnd.randrange(60)] = f"d{i}"
    rows += [(len(rows) + k, x) for k, x in enumerate(["", " ", None, "a b", "A  b", "a b c"])]
    check(spark, rows, **settings)


def test_the_steps_find_what_the_first_ones_leave(spark):
    """With no SimHash edge and stars only, tiles still join all that is alike."""
    rnd = random.Random(13)
    base = [f"w{rnd.randint(0, 9)}x{i}" for i in range(120)]
    rows = []
    for i in range(60):
        text = list(base)
        for at in rnd.sample(range(120), 1):
            text[at] = f"z{i}"
        rows.append((i, " ".join(text)))
    hashes = {i: simhash.shingle_hashes(simhash.word_hashes(t.encode())[0], 5) for i, t in rows}
    bits = lambda x: np.packbits((np.bincount((x & np.uint64(simhash.PARITIES - 1)).astype(np.int64), minlength=simhash.PARITIES) & 1).astype(bool)).view(np.int64).tolist()
    given = [(7, i, i, len(x), bits(x), x.view(np.int64).tolist()) for i, x in hashes.items()]
    df = spark.createDataFrame(given, "bucket long, node long, component long, n long, bits array<long>, hashes array<long>")
    from duoscope.llm.components import connected_components

    near = simhash.promising(df.drop("hashes"), 0.8, 16, 64_000)
    assert near.count() == 60
    links = simhash.linked_in_tiles(df, 0.8, 16, 4000).collect()
    assert all(similar(rows[r.a][1], rows[r.b][1]) for r in links)
    got = connected_components(spark.createDataFrame([tuple(r) for r in links], "a long, b long")).collect()
    first = groups(rows)
    assert {r.node: r.component for r in got} == {i: f for i, f in enumerate(first) if first.count(f) > 1}


def test_parities_in_more_places_lose_no_pair(spark):
    """Of sizes around a power of two, alike or not; whatever is alike passes in SQL and in a tile, and long unlike sets do not."""
    rng = np.random.default_rng(4)
    sets = []
    for n in (1, 100, 1000, 1024, 1025, 5000, 8192, 9000):
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n).astype(np.uint64)
        sets += [np.unique(base), np.unique(np.concatenate([base[n // 9 :], base[:1]])), np.unique(np.concatenate([base[n // 2 :], rng.integers(0, 1 << 63, n // 2, dtype=np.uint64)]))]
    bits = [simhash.parities(x, simhash.wide_places(len(x))) for x in sets]
    pairs = list(itertools.combinations(range(len(sets)), 2))
    rows = [(a, b, len(sets[a]), len(sets[b]), bits[a].tolist(), bits[b].tolist()) for a, b in pairs]
    df = spark.createDataFrame(rows, "a int, b int, a_n long, b_n long, a_bits array<long>, b_bits array<long>")
    in_sql = {(r.a, r.b) for r in df.filter(simhash.may_be_alike(0.8)).collect()}
    columns = {"n": pa.array([len(x) for x in sets]), "component": pa.array(range(len(sets))), "tile": pa.array([0] * len(sets)), "bits": pa.array([x.tolist() for x in bits], pa.list_(pa.int64())), "lo": pa.array([0] * len(sets)), "hi": pa.array([0] * len(sets))}
    in_tile = {(min(p), max(p)) for i, j in simhash.near_in_tile(pa.table(columns), 0.8) for p in zip(i.tolist(), j.tolist(), strict=True)}
    want = {(a, b) for a, b in pairs if simhash.alike(sets[a], sets[b], 0.8)}
    assert want and want <= in_sql and in_sql == in_tile
    assert all((a, b) in want for a, b in in_sql if min(len(sets[a]), len(sets[b])) > 4000)
