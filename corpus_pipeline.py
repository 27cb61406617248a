"""Five operators in a row over the documents: toxic ones go, then copies, then near copies, then what
the mixture has no room for; what stays is encoded.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before has kept. All but the
last return the columns of documents. Those that read texts in Python set the session's Arrow batches to 1,000 rows at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duoscope.llm import bpe, exact, mixing, simhash, toxicity
from duoscope.llm.common import bounded_batches, checkpointed, digest, shared_folder, table, to_each_task
from duoscope.llm.queries import TOKENIZER


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier scores 0.5 or more."""
    bounded_batches(spark)
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def staying(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of docs that a table (doc_id, digest, kept, copies) keeps; of rows that repeat both, one.

    A row is found by its id and its text, so that rows of one id and different texts have their own fate.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text").cast("string")).alias("digest"))

    def met(other: DataFrame, how: str) -> DataFrame:
        other = to_each_task(other.select(F.col("doc_id").alias("id"), F.col("digest").alias("d")))
        return rows.join(other, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d")), how)

    again = decided.filter("kept and copies > 1")
    left = met(decided.filter("not kept or copies > 1"), "left_anti").select("row.*")
    if again.isEmpty():
        return left
    return left.unionByName(met(again, "left_semi").groupBy("doc_id", "digest").agg(F.first("row").alias("row")).select("row.*"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the row with the largest id; null texts are empty ones, a null id is the last choice."""
    bounded_batches(spark)
    found = exact.exact_duplicates(docs)
    decided = found.filter("group_size > 1").groupBy("doc_id", "digest").agg(F.max("kept").alias("kept"), F.count("*").alias("copies"))
    return staying(docs, checkpointed(decided))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts with a similarity of 0.8 or more by five-word shingles, the one with the smallest id."""
    bounded_batches(spark)
    return staying(docs, checkpointed(simhash.similar_documents(docs).filter("not kept or copies > 1")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their rates say, with sources tempered by a power of 0.7 to the same token total."""
    drawn = mixing.mixed(docs).groupBy("doc_id", "digest").agg(F.max("copies").alias("copies")).filter("copies > 0")  # rows that repeat both have one rate
    drawn = drawn.select(F.col("doc_id").alias("id"), F.col("digest").alias("d"), "copies").hint("shuffle_hash")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), mixing.text_digest(F.col("text")).alias("digest"))
    kept = rows.join(drawn, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d")))
    return kept.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the texts that are left."""
    import public_tokenizers

    bounded_batches(spark)
    return bpe.digests(bpe.encode(docs, public_tokenizers.path(TOKENIZER)))


STAGES = [("toxicity", toxic), ("exact dedup", exact_copies), ("SimHash near-dedup", near_copies), ("mixing", mixture), ("BPE", encoded)]

#: Learnt models and SimHash components are beyond SQL; the tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet to the shared folder and read again; folders that are read up are deleted."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = folder
    return docs
