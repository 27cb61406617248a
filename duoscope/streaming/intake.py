"""A stream of artifacts, cut batch by batch. The windows need whole pairs, so a pair must arrive in one batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from duoscope.operators.chunking import chunks
from duoscope.operators.selection import assign_ids, select_within


def start_intake(artifacts: DataFrame, output: str, checkpoint: str, budget: int = 20_000) -> StreamingQuery:
    """Writes the chunks of (pair_id, side, name, text) with ids and `included` as Parquet, a folder for each batch; a batch done again replaces its folder."""

    def write(batch: DataFrame, number: int) -> None:
        select_within(assign_ids(chunks(batch)), budget).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return artifacts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
