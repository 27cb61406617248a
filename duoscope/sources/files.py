"""Artifacts read from files, and the checks that uploads go through."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duoscope.functions.errors import status_code
from duoscope.functions.text import normalise_newlines, suffix

MAX_BYTES = 1_000_000
BODY_SLACK = 65_536


def read_uploads(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """name, text, error_code, status of the files under `path`; the text is as it is, and null where there is an error.

    Contents of files over the limit are never read: their rows come from the listing alone.
    """
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", "([^/]*)$", 1)
    large = files.filter(F.col("length") > max_bytes).select(name.alias("name"), F.lit(None).cast("string").alias("text"), F.lit("upload_too_large").alias("error_code"))
    small = files.filter(F.col("length") <= max_bytes).select(name.alias("name"), F.col("content"))
    error = F.when(suffix(F.col("name")) == "", "unnamed_upload").when(~F.is_valid_utf8(F.col("content").cast("string")), "unreadable_upload")
    small = small.withColumn("error_code", error).select("name", F.when(F.col("error_code").isNull(), F.col("content").cast("string")).alias("text"), "error_code")
    status = F.when(F.col("error_code") == "upload_too_large", 413).when(F.col("error_code").isNotNull(), 422)
    return small.unionByName(large).withColumn("status", status)


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """name and text of the files under `path`, line ends as line feeds."""
    return read_uploads(spark, path, max_bytes=2**31 - 1).select("name", normalise_newlines(F.col("text")).alias("text"))


def oversized_pairs(artifacts: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(pair_id, error_code) of pairs whose texts together are larger than a request may be."""
    total = F.sum(F.octet_length("text"))
    return artifacts.groupBy("pair_id").agg(total.alias("bytes")).filter(F.col("bytes") > 2 * max_bytes + BODY_SLACK).select("pair_id", F.lit("request_too_large").alias("error_code"))


def read_pairs(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, listed: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Artifacts (pair_id, side, name, text) and errors (pair_id, side, name, error_code, status) of files laid out as pair_id=<id>/side=<A or B>/<name>.

    Sizes come from the listing alone, before any content: a pair over the limit of a request is refused
    as a whole, a file over its own limit alone. Up to `listed` refused pairs are left out as partitions of the scan, so
    that none of their files is opened; more of them by a join.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path).withColumn("name", F.regexp_extract("path", "([^/]*)$", 1))
    sizes = files.select("pair_id", "side", "name", "length")
    refused = sizes.groupBy("pair_id").agg(F.sum("length").alias("bytes")).filter(F.col("bytes") > 2 * max_bytes + BODY_SLACK).select("pair_id")
    few = [r.pair_id for r in refused.limit(listed + 1).collect()]
    scanned = files.filter(F.col("length") <= max_bytes)
    scanned = scanned.filter(~F.col("pair_id").isin(few)) if len(few) <= listed else scanned.join(refused, "pair_id", "left_anti")
    content = F.col("content").cast("string")
    code = F.when(suffix(F.col("name")) == "", "unnamed_upload").when(~F.is_valid_utf8(content), "unreadable_upload")
    read = scanned.select("pair_id", "side", "name", code.alias("error_code"), content.alias("text"))
    too_large = F.lit("upload_too_large")
    over = sizes.join(refused.withColumn("code", F.lit("request_too_large")), "pair_id", "left").withColumn("error_code", F.coalesce("code", F.when(F.col("length") > max_bytes, too_large)))
    bad = over.select("pair_id", "side", "name", "error_code").unionByName(read.select("pair_id", "side", "name", "error_code")).filter("error_code is not null")
    return read.filter("error_code is null").drop("error_code"), bad.withColumn("status", status_code(F.col("error_code")))
