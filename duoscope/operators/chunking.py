"""Artifacts cut into line-addressed chunks.

Definitions and the merging of small pieces need a parser or look-ahead, so whole chunks are made of one
artifact at a time in Arrow batches. Cuts by size are also column expressions (`size_pieces`), Markdown
sections also windows over lines (`markdown_pieces`), for those who want these alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duoscope.functions import pieces as cut
from duoscope.functions import splitting
from duoscope.functions.batches import slices
from duoscope.functions.text import chunk_header, split_lines, strip, suffix

HEADING = "(?U)^(#{1,6})\\s+(\\S.*)$"
FENCE = "(?U)^\\s*(```|~~~)"
ARTIFACT = ["pair_id", "side", "name"]
PIECE = "array<struct<text:string,start_line:int,end_line:int,label:string>>"
FIELDS = ("text", "start_line", "end_line", "label")
ARROW_PIECE = pa.list_(pa.struct([("text", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("label", pa.string())]))


#: How to cut an artifact, by the suffix of its name; what isn't listed is cut by size.
SPLITTERS: dict[str, Callable[[str], list[cut.Piece]]] = {".md": cut.by_heading, ".markdown": cut.by_heading, ".py": cut.by_definition}


def markdown_lines(artifacts: DataFrame) -> DataFrame:
    """Each line with is_heading and section: a fence hides headings until the next fence."""
    lines = artifacts.select(*ARTIFACT, F.posexplode(split_lines(F.col("text"))).alias("at", "line")).withColumn("line_no", F.col("at") + 1)
    order = W.partitionBy(*ARTIFACT).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    fence = F.col("line").rlike(FENCE)
    open_ = F.sum(fence.cast("int")).over(order) % 2 == 1
    heading = ~fence & ~open_ & F.col("line").rlike(HEADING)
    return lines.withColumn("is_heading", heading).withColumn("section", F.sum(F.col("is_heading").cast("int")).over(order)).drop("at")


def markdown_pieces(artifacts: DataFrame) -> DataFrame:
    """(pair_id, side, name, text, start_line, end_line, label) of the sections, without blank lines at their ends."""
    lines = markdown_lines(artifacts)
    section = W.partitionBy(*ARTIFACT, "section")
    filled = F.when(strip(F.col("line")) != "", F.col("line_no"))
    inside = lines.withColumn("start_line", F.min(filled).over(section)).withColumn("end_line", F.max(filled).over(section)).filter("line_no between start_line and end_line")
    label = F.coalesce(F.max(F.when(F.col("is_heading"), strip(F.regexp_extract("line", HEADING, 2)))), F.lit(""))
    return inside.groupBy(*ARTIFACT, "section", "start_line", "end_line").agg(
        F.expr("listagg(line, '\n') within group (order by line_no)").alias("text"), label.alias("label")
    ).select(*ARTIFACT, "text", "start_line", "end_line", "label")


def size_pieces(artifacts: DataFrame) -> DataFrame:
    """(pair_id, side, name, at, text, start_line, end_line) of artifacts cut by size alone, before caps and merges: column expressions without a shuffle."""
    return artifacts.select(*ARTIFACT, F.posexplode(splitting.size_pieces(F.col("text"))).alias("at", "p")).select(*ARTIFACT, "at", "p.text", "p.start_line", "p.end_line")


def cut_artifact(name_suffix: str, text: str, splitters: dict[str, Callable[[str], list[cut.Piece]]] = SPLITTERS) -> list[cut.Piece]:
    """The final pieces of one artifact: cut by its suffix, capped, and small ones merged."""
    return cut.merged(cut.capped(splitters.get(name_suffix, cut.by_size)(text)), text)


def chunks(artifacts: DataFrame, splitters: dict[str, Callable[[str], list[cut.Piece]]] = SPLITTERS) -> DataFrame:
    """The chunks of (pair_id, side, name, text): pos in the side, chunk_index in the artifact, source, lines, label, header.

    An artifact is cut where it lies, so only its chunks are shuffled, for their positions in a side.
    Artifacts of one side follow each other by a column `artifact_pos`, where there is one, then by name;
    two of one side need different positions or names. Null and blank texts have no chunks; null keys are
    keys like others. splitters: other suffixes, or other cuts.
    """
    at = F.col("artifact_pos") if "artifact_pos" in artifacts.columns else F.lit(0)
    key = [*ARTIFACT, "artifact_pos"]
    given = artifacts.filter(strip(F.col("text")) != "").select(*ARTIFACT, at.cast("long").alias("artifact_pos"), "text", suffix(F.col("name")).alias("suffix"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4):
            texts, endings = (batch.column(i).to_pylist() for i in (4, 5))
            out = [[dict(zip(FIELDS, p, strict=True)) for p in cut_artifact(ending, text, splitters)] for text, ending in zip(texts, endings, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, ARROW_PIECE)], [*key, "pieces"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.select(*key).schema)
    flat = given.mapInArrow(run, f"{schema}, pieces {PIECE}").select(*key, F.posexplode("pieces").alias("chunk_index", "p")).select(*key, "chunk_index", "p.*")
    source = F.regexp_extract("name", "([^/]*)$", 1)
    pos = F.row_number().over(W.partitionBy("pair_id", "side").orderBy("artifact_pos", "name", "chunk_index"))
    return flat.select(
        "pair_id", "side", F.col("name").alias("artifact_id"), source.alias("source"), "chunk_index", pos.alias("pos"), "text", "start_line", "end_line", "label",
        chunk_header(source, F.col("label"), F.col("start_line"), F.col("end_line")).alias("header"),
    )
