"""The line index against resolving each citation alone."""

import random

from duoscope.operators.citations import line_index, resolve, resolve_by_index


def test_same_rows_as_resolve(spark):
    rnd = random.Random(11)
    words = ["a_b", "x", "the cat", "the cat sat", "y = (1 + 2)", "| a | b |", "  the cat ", "", " \t ", "é ü"]
    text = lambda: "\n".join(" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 3))) for _ in range(rnd.randint(1, 8)))
    chunks = [(p, f"{s}-{i}", f"{s}{i}.md", rnd.randint(1, 50), text()) for p in range(6) for s in "AB" for i in range(3)]
    cites = []
    for n in range(900):
        p, c, _, _, body = rnd.choice(chunks)
        lines = body.split("\n")
        at = rnd.randrange(len(lines))
        quote = rnd.choice([
            lines[at], f" {lines[at]}\t", lines[at][1:6], "\n ".join(lines[at : at + 2]), lines[at].replace("_", "\\_").replace("|", "\\|"), lines[at][:4] + "\\_", "the cat", "nowhere", "", None, "x " + lines[at],
        ])
        cites.append((p, n, rnd.choice([c, c, c, "A-9"]), quote))
    chunks = spark.createDataFrame(chunks, "pair_id long, chunk_id string, source string, start_line int, text string")
    cites = spark.createDataFrame(cites, "pair_id long, n int, chunk_id string, quote string")
    want = sorted(map(tuple, resolve(cites, chunks).collect()), key=lambda r: r[1])
    for index in (None, line_index(chunks)):
        got = sorted(map(tuple, resolve_by_index(cites, chunks, index).collect()), key=lambda r: r[1])
        assert got == want
    found = [r for r in want if r[5] is not None]
    assert len(found) > 300 and {r[7] for r in found} == {True, False} and len(want) == 900


def test_exact_quotes_meet_by_an_equi_join(spark):
    chunks = spark.createDataFrame([(1, "A-0", "a.md", 1, "one\ntwo")], "pair_id long, chunk_id string, source string, start_line int, text string")
    cites = spark.createDataFrame([(1, n, "A-0", ("two", " one ")[n % 2]) for n in range(10_000)], "pair_id long, n int, chunk_id string, quote string")
    got = resolve_by_index(cites, chunks)
    assert sorted((r.line, r["count"]) for r in got.groupBy("line").count().collect()) == [(1, 5000), (2, 5000)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
