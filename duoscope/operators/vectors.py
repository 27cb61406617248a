"""Checks and unit length of embedding vectors, and the texts that may be embedded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duoscope.functions.text import strip, tokens
from duoscope.operators.providers import BATCH


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector.cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))


def unit(vector: Column) -> Column:
    """The vector at length 1; null for a zero vector."""
    size = norm(vector)
    return F.when(size > 0, F.transform(vector.cast("array<double>"), lambda x: x / size))


def validated(vectors: DataFrame, dim: int) -> DataFrame:
    """With error: null, missing, width or zero."""
    v = F.col("embedding")
    return vectors.withColumn("error", F.when(v.isNull(), "missing").when(F.size(v) != dim, "width").when(norm(v) == 0, "zero"))


def text_errors(texts: DataFrame, max_input_tokens: int | None = None) -> DataFrame:
    """With error: blank, too_long or null."""
    over = tokens(F.col("text")) > max_input_tokens if max_input_tokens else F.lit(False)
    return texts.withColumn("error", F.when(F.coalesce(strip(F.col("text")), F.lit("")) == "", "blank").when(over, "too_long"))


def batches(texts: DataFrame, by: str, order: str, size: int = BATCH) -> DataFrame:
    """With batch: texts of one `by` in their order, at most `size` to a batch."""
    from pyspark.sql import Window

    return texts.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1) / size).cast("int"))


def first_errors(checked: DataFrame, by: str, order: str, k: int = 3) -> DataFrame:
    """(by, error, n, first) of texts with error: how many of a batch have it, and the first k by order."""
    found = checked.filter("error is not null").groupBy(by, "error")
    return found.agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list(order)), 1, k).alias("first"))  # a batch has at most BATCH texts
