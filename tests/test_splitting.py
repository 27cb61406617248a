"""Cuts by size as columns against those of one text at a time; table functions against the operator; Markdown in both ways."""

import random

from pyspark.sql import functions as F

from duoscope.functions import pieces, splitting, tables
from duoscope.functions.text import suffix
from duoscope.operators import chunking


def texts():
    rnd = random.Random(3)
    yield from ["", " ", "x" * 20_000, "\n" * 5000, "a b", "é😀" * 3000, " \x1c\n" * 900 + "end", None, "y " * 4000]
    for _ in range(80):
        yield "".join(rnd.choice(["word", " ", "\n", "\n\n", "\n\n\n", "x" * rnd.randint(1, 900), "ü😀 ", "\t", "\x1f"]) for _ in range(rnd.randint(1, rnd.choice([20, 80, 2000]))))


def test_columns_cut_as_python_does(spark):
    given = list(texts())
    df = spark.createDataFrame(list(enumerate(given)), "i int, t string")
    got = {r.i: [tuple(p) for p in r.p or []] for r in df.select("i", splitting.size_pieces(F.col("t")).alias("p")).collect()}
    assert all(got[i] == pieces.by_size(t or "") for i, t in enumerate(given))


def test_the_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "A", "a.txt", "x")], "pair_id long, side string, name string, text string")
    plan = chunking.size_pieces(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def artifacts(spark):
    rnd = random.Random(9)
    line = lambda: rnd.choice(["", "# head", "## a  b ", "```", "~~~ x", "#no", " # no", "text " * rnd.choice([1, 9, 200])])
    rows = [(i % 7 or None, rnd.choice(["A", "B", None]), f"f{i}.{rnd.choice(['md', 'py', 'txt'])}", i % 3, "\n".join(line() for _ in range(rnd.randint(0, 25)))) for i in range(90)]
    return spark.createDataFrame(rows, "pair_id long, side string, name string, artifact_pos int, text string")


def test_table_function_numbers_as_the_operator(spark):
    df = artifacts(spark)
    tables.register(spark)
    got = spark.sql("SELECT * FROM side_chunks(TABLE(SELECT * FROM {df}) PARTITION BY (pair_id, side) ORDER BY (artifact_pos, name))", df=df).collect()
    want = chunking.chunks(df).withColumn("chunk_id", F.concat_ws("-", "side", (F.col("pos") - 1).cast("string"))).collect()
    pick = lambda rows: sorted(((r.pair_id, r.side, r.chunk_id, r.artifact_id, r.chunk_index, r.start_line, r.end_line, r.label, r.header, r.text) for r in rows), key=repr)
    assert pick(got) == pick(want) and len(want) > 100
    assert any(r.pair_id is None for r in got) and any(r.side is None for r in got)
    lateral = spark.sql("SELECT name, c.* FROM {df} LATERAL VIEW inline(artifact_chunks(name, text)) c", df=df).collect()
    assert sorted((r.name, r.chunk_index, r.header, r.text) for r in lateral) == sorted((r.artifact_id, r.chunk_index, r.header, r.text) for r in want)


def test_markdown_by_windows_and_by_lines(spark):
    df = artifacts(spark).filter("pair_id is not null and side is not null and name like '%md'")
    want = {}
    for r in df.collect():
        want[r.pair_id, r.side, r.name] = pieces.by_heading(r.text)
    got = {}
    for r in chunking.markdown_pieces(df).collect():
        got.setdefault((r.pair_id, r.side, r.name), []).append((r.text, r.start_line, r.end_line, r.label))
    assert {k: sorted(v, key=lambda p: p[1]) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_one_rule_for_suffixes(spark):
    names = ["a.py", "a..py", "..py", "a..", ".py", "a.PY", "x/.md", "x/y.MD", "a.b/c", "", "a."]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", suffix(F.col("n")).alias("s")).collect()
    assert [(r.n, r.s) for r in got] == [(n, tables.suffix(n)) for n in names]
    assert [tables.suffix(n) for n in names] == [".py", ".py", ".py", "", "", ".py", "", ".md", "", "", ""]
