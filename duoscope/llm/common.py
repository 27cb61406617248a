"""What the operators share: reading, checkpoints, and Arrow batches in slices of bounded size."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Text that one step of a Python worker holds at a time.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on one machine, where it may be unset, a temporary folder."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", "")
    if not folder:
        if sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder; later jobs survive the loss of executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def to_each_task(df: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """A written table of short rows for the right side of a join: sent to each task where it has at most `most_rows`, else met by a shuffle."""
    return F.broadcast(df) if df.count() <= most_rows else df.hint("shuffle_hash")


def fold_case(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.translate(text, UPPER, UPPER.lower())


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def bounded_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Rows of an Arrow batch, for jobs that read whole texts: buffers of both the JVM and the Python workers stay as large as the largest batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= rows:
        spark.conf.set(name, rows)


def slices(batches: Iterator[pa.RecordBatch], text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of a slice take about `limit` bytes (one document at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start = held = 0
        for row, length in enumerate(lengths):
            if held and held + length > limit:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += length
        yield batch.slice(start)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8; null counts as empty."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def digests(texts: pa.Array) -> pa.Array:
    """MD5 of each text with A-Z in lower case; null counts as empty."""
    parts = slices([pa.RecordBatch.from_arrays([texts], ["text"])], 0)
    return pa.array([hashlib.md5(x).digest() for part in parts for x in utf8(pc.ascii_lower(part.column(0)))], pa.binary())


def digest(text: Column) -> Column:
    """digests() as a column."""

    @F.arrow_udf("binary")
    def of(texts: pa.Array) -> pa.Array:
        return digests(texts)

    return of(text)
