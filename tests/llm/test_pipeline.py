import itertools

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline as pipeline  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    assert all(x.columns == stages[0].columns for x in stages[1:-1])


def test_toxic_documents_go(spark, stages):
    left = texts(stages[1])
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert sum(r.doc_id in left for r in labels if r.toxic) <= 0.15 * sum(r.toxic for r in labels)
    assert sum(r.doc_id in left for r in labels if not r.toxic) >= 0.97 * sum(1 - r.toxic for r in labels)


def test_one_of_each_group_of_copies_stays(stages):
    best = {}
    for i, t in texts(stages[1]).items():
        key = t.encode().lower()
        best[key] = max(best.get(key, -1), i)
    assert set(texts(stages[2])) == set(best.values())


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_copies_go_and_others_stay(stages):
    """Against all pairs that share a shingle: of each component one document stays, and no link is left."""
    before, after = texts(stages[2]), texts(stages[3])
    sets = {i: shingles(t) for i, t in before.items()}
    holders = {}
    for i, x in sets.items():
        for s in x:
            holders.setdefault(s, []).append(i)
    met = {q for v in holders.values() for q in itertools.combinations(sorted(v), 2)}
    links = [(a, b) for a, b in met if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    parent = {i: i for i in before}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert set(after) == {find(i) for i in before} and len(links) >= 5


SCHEMA = "doc_id long, text string, lang string, source string, row string, digest int"


def stage(spark, name, rows):
    out = dict(pipeline.STAGES)[name](spark, spark.createDataFrame(rows, SCHEMA), SF)
    assert out.columns == ["doc_id", "text", "lang", "source", "row", "digest"]
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty " * 3


def test_rows_go_by_id_and_text(spark):
    """Ids that several texts share, rows that repeat id and text, null ids and texts, other columns of any name."""
    own = [(1, "a"), (1, "unique b"), (2, "A"), (None, "x y"), (None, "x y"), (3, None), (4, ""), (5, "same"), (5, "same"), (5, "SAME"), (6, LONG), (6, "short text under the same id"), (7, LONG + "end"), (8, LONG * 2000)]
    rows = [(i, t, "en", "s", "r", 0) for i, t in own]
    exact = stage(spark, "exact dedup", rows)
    assert len(exact) == len({(t or "").lower() for _, t in own})
    assert {x for x in exact if x[1] not in ("same", "SAME")} == {(1, "unique b"), (2, "A"), (None, "x y"), (4, ""), (6, LONG), (6, "short text under the same id"), (7, LONG + "end"), (8, LONG * 2000)}
    near = stage(spark, "SimHash near-dedup", rows)
    assert (1, "unique b") in near and (6, "short text under the same id") in near
    assert len([t for _, t in near if t and t.startswith(LONG)]) == 1 and len([t for _, t in near if (t or "").lower() == "same"]) == 1
    assert len([x for x in near if x[1] in (None, "")]) == 1 and len([x for x in near if x[1] == "x y"]) == 1
    mixed = stage(spark, "mixing", [r for r in rows if r[1] != LONG * 2000])
    assert {x for x in mixed} <= set(own) and len(mixed) >= 8
    assert len(stage(spark, "toxicity", rows)) == len(rows)


def test_empty_tables(spark):
    for name, f in pipeline.STAGES:
        assert f(spark, spark.createDataFrame([], SCHEMA), SF).collect() == [], name


def test_run_writes_and_deletes_its_folders(spark):
    out = pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 20


def test_mixture_and_encoding(stages):
    before, after = texts(stages[3]), texts(stages[4])
    assert set(after) <= set(before) and len(after) > 0.8 * len(before)
    assert {r.doc_id for r in stages[5].collect()} == set(after) and stages[5].count() == stages[4].count()
