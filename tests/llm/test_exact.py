import hashlib
from collections import defaultdict

import pytest

from duoscope.llm import exact

SCHEMA = "doc_id long, text string, h int"
ROWS = [(1, "Abc", 0), (2, "aBC", 0), (5, "abc", 0), (3, None, 0), (4, "", 0), (6, "École", 0), (7, "école", 0), (8, "x" * 200_000, 0), (9, "X" * 200_000, 0), (None, "abc", 0), (10, "solo", 0), (10, "solo", 0)]


def lower(text):
    return (text or "").encode().lower()


@pytest.mark.parametrize("keep", ["max", "min"])
@pytest.mark.parametrize("hash_bytes", [16, 0])
def test_groups_are_those_of_equal_bytes(spark, keep, hash_bytes):
    """With no hash at all every pair collides, and the groups are the same."""
    groups = defaultdict(list)
    for i, t, _ in ROWS:
        groups[lower(t)].append(i)
    want = []
    for i, t, _ in ROWS:
        g = groups[lower(t)]
        best = (max if keep == "max" else min)(x for x in g if x is not None)
        want.append((i, best, len(g), i == best, hashlib.sha256(lower(t)).hexdigest()))
    got = [tuple(r) for r in exact.exact_duplicates(spark.createDataFrame(ROWS, SCHEMA), keep, hash_bytes).drop("digest").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_table(spark):
    assert exact.exact_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
