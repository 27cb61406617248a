"""Functions for SQL, registered by name in a session: one of a table, one of a row.

    SELECT * FROM side_chunks(TABLE(artifacts) PARTITION BY (pair_id, side) ORDER BY (artifact_pos, name))
    SELECT id, c.* FROM documents LATERAL VIEW inline(artifact_chunks(name, text)) c
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from duoscope.functions.pieces import JOINT
from duoscope.operators.chunking import cut_artifact

CHUNK = pa.schema([("chunk_index", pa.int32()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("label", pa.string()), ("header", pa.string()), ("text", pa.string())])
CHUNK_DDL = "chunk_index int, start_line int, end_line int, label string, header string, text string"
SIDE_DDL = f"pair_id bigint, side string, chunk_id string, artifact_id string, {CHUNK_DDL}"
SIDE = pa.schema([("pair_id", pa.int64()), ("side", pa.string()), ("chunk_id", pa.string()), ("artifact_id", pa.string()), *CHUNK])


def suffix(name: str | None) -> str:
    """functions.text.suffix of one name."""
    whole = (name or "").rpartition("/")[2]
    at = whole.rfind(".")
    return whole[at:].lower() if 0 < at < len(whole) - 1 else ""


def chunk_rows(name: str | None, text: str | None) -> list[tuple]:
    """The chunks of one artifact as rows of CHUNK; none of a null or blank text."""
    if not text or not text.strip():
        return []
    source = (name or "").rpartition("/")[2]
    rows = cut_artifact(suffix(name), text)
    return [(i, first, last, label, f"[{JOINT.join(filter(None, (source, label, f'lines {first}-{last}')))}]", body) for i, (body, first, last, label) in enumerate(rows)]


def as_table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


class SideChunks:
    """side_chunks(TABLE(pair_id, side, name, text) PARTITION BY (pair_id, side) ORDER BY ...): the chunks of a side with ids that run on over its artifacts, in their order.

    It holds one batch of artifacts at a time; columns are found by name, others are ignored.
    """

    def __init__(self) -> None:
        self.at = 0

    def eval(self, artifacts: pa.RecordBatch) -> Iterator[pa.Table]:
        columns = [artifacts.column(artifacts.schema.get_field_index(c)).to_pylist() for c in ("pair_id", "side", "name", "text")]
        for pair, side, name, text in zip(*columns, strict=True):
            rows = [(pair, side, "-".join(filter(None, (side, str(self.at + i)))), name, *r) for i, r in enumerate(chunk_rows(name, text))]
            self.at += len(rows)
            yield as_table(rows, SIDE)


def register(spark: SparkSession) -> None:
    """Both functions, for this session's SQL."""

    @F.arrow_udf(f"array<struct<{CHUNK_DDL.replace(' ', ':').replace(',:', ',')}>>")
    def artifact_chunks(name: pa.Array, text: pa.Array) -> pa.Array:
        rows = [[dict(zip(CHUNK.names, r, strict=True)) for r in chunk_rows(one, body)] for one, body in zip(name.to_pylist(), text.to_pylist(), strict=True)]
        return pa.array(rows, pa.list_(pa.struct(list(CHUNK))))

    spark.udf.register("artifact_chunks", artifact_chunks)
    spark.udtf.register("side_chunks", F.arrow_udtf(SideChunks, returnType=SIDE_DDL))
