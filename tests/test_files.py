"""Guards by size from the listing, before contents are read."""

from duoscope.sources.files import read_pairs


def test_pairs_are_refused_from_the_listing(spark, tmp_path):
    def put(pair, side, name, content):
        folder = tmp_path / f"pair_id={pair}" / f"side={side}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(content)

    put(1, "A", "a.md", b"# x\r\ny")
    put(1, "B", "b..py", b"x = 1")
    put(2, "A", "a.md", b"x" * 1001)
    put(2, "B", "plain", b"x")
    put(2, "B", "bad.py", b"\x89PNG\xff")
    for i in range(70):
        put(3, "A", f"f{i}.md", b"y" * 999)
    put(3, "B", "b.py", b"z")
    for listed in (10, 0):
        artifacts, errors = read_pairs(spark, str(tmp_path), max_bytes=1000, listed=listed)
        assert sorted((r.pair_id, r.side, r.name, r.text) for r in artifacts.collect()) == [(1, "A", "a.md", "# x\r\ny"), (1, "B", "b..py", "x = 1")]
        bad = sorted((r.pair_id, r.name, r.error_code, r.status) for r in errors.collect())
        assert bad[:3] == [(2, "a.md", "upload_too_large", 413), (2, "bad.py", "unreadable_upload", 422), (2, "plain", "unnamed_upload", 422)]
        assert len(bad) == 3 + 71 and {b[2] for b in bad[3:]} == {"request_too_large"}
    artifacts, _ = read_pairs(spark, str(tmp_path), max_bytes=1000)
    plan = artifacts._jdf.queryExecution().executedPlan().toString()
    pruned = plan[plan.index("PartitionFilters") :]
    assert "pair_id" in pruned[: pruned.index("PushedFilters")] and "LessThanOrEqual(length,1000)" in plan
