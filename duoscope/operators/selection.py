"""Ids, costs and the budget: windows over (pair, side) in the order of `pos`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from duoscope.functions.text import embed_text, tokens


DEFAULT_BUDGET = 20_000


def in_order() -> WindowSpec:
    """The chunks of a side, in order."""
    return W.partitionBy("pair_id", "side").orderBy("pos")


def assign_ids(chunks: DataFrame) -> DataFrame:
    """With chunk_id: the side and a number from 0 that runs on over the files of a side."""
    return chunks.withColumn("chunk_id", F.concat_ws("-", "side", (F.row_number().over(in_order()) - 1).cast("string")))


def select_within(chunks: DataFrame, budget: int | str = DEFAULT_BUDGET) -> DataFrame:
    """With cost and included: each side's longest prefix whose costs fit into half of the budget, which may be a column."""
    half = F.floor((F.lit(budget) if isinstance(budget, int) else F.col(budget)) / 2)
    costed = chunks.withColumn("cost", tokens(embed_text(F.col("header"), F.col("text"))))
    return costed.withColumn("included", F.sum("cost").over(in_order().rowsBetween(W.unboundedPreceding, 0)) <= half)


def side_counts(selected: DataFrame) -> DataFrame:
    """pair_id, side, total, sent; both sides of each pair, also where one has no chunks."""
    counted = selected.groupBy("pair_id").agg(*[F.struct(F.count_if(F.col("side") == s).alias("total"), F.count_if((F.col("side") == s) & F.col("included")).alias("sent")).alias(s) for s in "AB"])
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}.total").alias("total"), F.col(f"{s}.sent").alias("sent")) for s in "AB"])
    return counted.select("pair_id", F.inline(sides))


def unknown_selected(selected: DataFrame, chunks: DataFrame) -> DataFrame:
    """Selected ids that no chunk of the pair has."""
    return selected.join(chunks, ["pair_id", "chunk_id"], "left_anti").select("pair_id", "chunk_id")


def empty_sides(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(pair_id, side, error_code) of the sides without any chunk."""
    wanted = pairs.select("pair_id").distinct().withColumn("side", F.explode(F.array(F.lit("A"), F.lit("B"))))
    return wanted.join(chunks, ["pair_id", "side"], "left_anti").withColumn("error_code", F.lit("empty_artifact"))
