"""Pairs whose sides arrive in different batches."""

import json
import os

from duoscope.operators import chunking, selection
from duoscope.streaming.pairing import start_paired_intake

SCHEMA = "pair_id long, side string, name string, text string, arrived timestamp"


def test_sides_in_different_batches(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    batches = [
        [(1, "A", "a.md", "# one", "00:00"), (2, "A", "a.md", "both", "00:01"), (2, "B", "b.py", "x = 1", "00:01"), (3, "A", "lone.md", "never", "00:02"), (None, "A", "x", "y", "00:02"), (4, "C", "x", "y", "00:02")],
        [(1, "A", "a2.md", "more", "00:30"), (1, "A", "a.md", "# one again", "00:30")],
        [(1, "B", "b.py", "y = 2", "01:15"), (5, "B", "late.py", "z", "01:16")],
        [(6, "A", "a.md", "ahead", "23:00")],
    ]
    for i, rows in enumerate(batches):
        keys = ("pair_id", "side", "name", "text", "arrived")
        (source / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(keys, (*r[:4], f"2024-01-01T{r[4]}:00")))) for r in rows))
        os.utime(source / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # the order of the batches
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
    folders = [str(tmp_path / x) for x in ("out", "errors", "check")]
    start_paired_intake(stream, *folders, patience_seconds=3600).awaitTermination()
    got = spark.read.parquet(folders[0]).collect()
    assert {(r.pair_id, r.side, r.artifact_id, r.chunk_id, r.text) for r in got} == {
        (1, "A", "a.md", "A-0", "# one again"), (1, "A", "a2.md", "A-1", "more"), (1, "B", "b.py", "B-0", "y = 2"),
        (2, "A", "a.md", "A-0", "both"), (2, "B", "b.py", "B-0", "x = 1"),
    }
    assert len({r.batch for r in got if r.pair_id == 1}) == 1  # whole, in the batch of its last side
    whole = spark.createDataFrame([(1, "A", "a.md", "# one again"), (1, "A", "a2.md", "more"), (1, "B", "b.py", "y = 2")], "pair_id long, side string, name string, text string")
    want = selection.select_within(selection.assign_ids(chunking.chunks(whole))).collect()
    assert sorted((r.chunk_id, r.cost, r.included) for r in got if r.pair_id == 1) == sorted((r.chunk_id, r.cost, r.included) for r in want)
    bad = {(r.pair_id, r.error_code, r.status_code, r.error_message) for r in spark.read.parquet(folders[1]).collect()}
    assert bad == {(3, "empty_artifact", 422, "A lone.md"), (5, "empty_artifact", 422, "B late.py"), (None, "invalid_request", 422, "A x"), (4, "invalid_request", 422, "C x")}
