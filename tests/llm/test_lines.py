import random
from collections import defaultdict

from pyspark.sql import functions as F

from duoscope.llm import lines

STRIP = " \t\n\x0b\x0c\r"


def key(line):
    return line.strip(STRIP).encode().lower()


def brute(rows, least_docs=3, least_chars=20):
    holders = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n") if len(x.strip(STRIP)) >= least_chars}:
            holders[k].append(i)
    out = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        keep = [x for x in all_lines if not (len(h := holders.get(key(x), ())) >= least_docs and i != max((j for j in h if j is not None), default=None))]
        out.append((i, len(all_lines), len(all_lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


def some_rows(seed, n=60):
    rnd = random.Random(seed)
    pool = [f"A repeated line of text no {k}" for k in range(12)] + ["short", "", "É" * 20, "é" * 20, "É" * 19, "\x0b padded line of some length\t"]
    return [(i * 3 % 101, "\n".join(rnd.choice([*pool, f"unique line of its own {i} {rnd.random()}"]).swapcase() if rnd.random() < 0.2 else rnd.choice(pool) for _ in range(rnd.randint(1, 9)))) for i in range(n)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_against_brute_force(spark, sf):
    rows = [*some_rows(1), (500, None), (501, ""), (502, "y" * 100_000 + "\n" + "A repeated line of text no 1"), (503, "A repeated line of text no 1\r\nx"), (503, "A repeated line of text no 1\r\nx"), (None, "A repeated line of text no 1\nown"), (None, "A repeated line of text no 2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("drop", F.lit(1))
    assert rows_of(lines.line_dedup(docs)) == brute(rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert rows_of(lines.line_dedup(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert lines.line_dedup(docs.limit(0)).collect() == []


def test_insertions_and_deletions_are_reversible(spark):
    a, b = some_rows(2), [(i + 1000, t) for i, t in some_rows(3)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    tables = lambda s: [sorted(map(str, t.collect())) for t in (s.refs.select("key", "doc_id"), s.counts.select("key", "n_docs", "keep_id"))]
    first = lines.LineStore.empty(spark, shards=4).insert(frame(a))
    both = first.insert(frame(b))
    assert rows_of(both.apply(frame(a + b))) == brute(a + b)
    back = both.delete(frame(b))
    assert tables(back) == tables(first)
    assert rows_of(back.apply(frame(a))) == brute(a)
    held = {r.shard: lines.CuckooFilter.load(bytes(r.filter)) for r in back.filters.collect()}
    for r in back.counts.collect():
        assert held[r.shard].contains([bytes(r.key)]).all()
    assert tables(back.insert(frame(b))) == tables(both)


def test_cuckoo_filter():
    rnd = random.Random(5)
    keys = [rnd.randbytes(16) for _ in range(20_000)]
    f = lines.CuckooFilter.sized(len(keys))
    assert f.insert(keys[:12_000]) and f.insert(keys[12_000:])
    assert f.contains(keys).all()
    assert f.contains([rnd.randbytes(16) for _ in range(20_000)]).mean() < 0.002
    f.delete(keys[:5_000])
    assert f.contains(keys[5_000:]).all() and f.contains(keys[:5_000]).mean() < 0.01
    f = lines.CuckooFilter.load(f.dump())
    f.delete(keys[5_000:])
    assert not f.table.any()
    small = lines.CuckooFilter(4)
    assert not small.insert(keys[:40])


def test_keys_that_collide_in_a_filter_keep_marks_of_their_own(spark):
    """Two lines with the same bucket and mark: taking one out must leave the mark of the other."""
    place = lambda k: (k[0] % 4, max(1, int.from_bytes(k[8:10], "little")))
    seen, pairs = {}, []
    for i in range(200_000):
        line = f"a line to collide, number {i}"
        other = seen.setdefault(place(lines.key_of(line.encode(), 20)), line)
        if other is not line:
            pairs.append((other, line))
        if len(pairs) == 2:
            break
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    tables = lambda s: [sorted(map(str, t.collect())) for t in (s.refs.select("key", "doc_id"), s.counts.select("key", "n_docs", "keep_id"))]
    (x, y), (z, u) = pairs
    first = lines.LineStore.empty(spark, shards=1).insert(frame([(1, f"{x}\n{z}")]))
    assert lines.CuckooFilter.load(bytes(first.filters.first().filter)).buckets == 4
    both = first.insert(frame([(2, f"{y}\n{u}")]))
    held = both.filters.first()
    assert held["keys"] == 4 == (lines.CuckooFilter.load(bytes(held.filter)).table > 0).sum()
    back = both.delete(frame([(2, "")]))
    assert tables(back) == tables(first)
    more = back.insert(frame([(3, f"{x}\n{z}")])).insert(frame([(4, x)]))
    assert {r.n_docs for r in more.counts.collect()} == {2, 3} and more.counts.count() == 2
    rows = [(1, f"{x}\n{z}"), (3, f"{x}\n{z}"), (4, x)]
    assert rows_of(more.apply(frame(rows))) == brute(rows)
