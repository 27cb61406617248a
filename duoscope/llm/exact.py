"""Exact dedup: groups by a 128-bit content hash, bytes compared inside the groups.

Texts are equal when identical after lower-casing A-Z. Only hashes, ids and counts are grouped; the
texts of documents in groups of two or more are then compared with the text of the row that stays,
and any group in which a text differs is regrouped by the texts themselves.

Defined cases: a null text counts as empty; a null id never wins over another; rows that repeat both
id and text are all reported, and all of them carry the id that stays; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duoscope.llm.common import checkpointed, fold_case, utf8


def content_hashes(docs: DataFrame, hash_bytes: int = 16, with_text: bool = False) -> DataFrame:
    """doc_id, h (the leading bytes of the MD5 of the normalised text), and its SHA-256 or the text as it is."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(pc.ascii_lower(batch.column(1)))
            h = pa.array([hashlib.md5(x).digest()[:hash_bytes] for x in texts], pa.binary())
            last = pc.fill_null(batch.column(1), "") if with_text else pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), h, last], ["doc_id", "h", name])

    name = "text" if with_text else "text_sha256"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(hashed, f"doc_id long, h binary, {name} string")


def exact_duplicates(docs: DataFrame, keep: str = "max", hash_bytes: int = 16) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, digest (the content hash).

    keep: "max" or "min", which id of a group stays. hash_bytes: 16 but in tests of collisions.
    """
    best = {"max": F.max, "min": F.min}[keep]
    ids = checkpointed(content_hashes(docs, hash_bytes))
    groups = checkpointed(ids.groupBy("h").agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1"))
    found = ids.join(groups, "h", "left")

    texts = content_hashes(docs, hash_bytes, with_text=True).join(groups.select("h", "keep_id").hint("shuffle_hash"), "h")
    texts = checkpointed(texts)
    stays = texts.filter("doc_id <=> keep_id").select("h", F.col("text").alias("stays"))
    others = texts.filter("not (doc_id <=> keep_id)").join(stays, "h")
    differs = checkpointed(others.filter((F.col("text") != F.col("stays")) & (fold_case(F.col("text")) != fold_case(F.col("stays")))).select("h"))  # no distinct here: it would tie all rows of a hash to one task
    if not differs.isEmpty():
        differs = differs.distinct()
        exact = texts.join(differs, "h", "left_semi").select("doc_id", "h", F.sha2(fold_case(F.col("text")), 256).alias("text_sha256"), fold_case(F.col("text")).alias("text"))
        regrouped = exact.groupBy("h", "text").agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        again = exact.join(regrouped, ["h", "text"])
        columns = ["doc_id", "keep_id", "group_size", "text_sha256", "h"]
        found = found.join(differs, "h", "left_anti").select(columns).unionByName(again.select(columns))
    return found.select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(F.coalesce("keep_id", "doc_id")).alias("kept"),
        "text_sha256",
        F.col("h").alias("digest"),
    )
