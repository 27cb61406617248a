"""A stream of artifacts whose two sides may arrive in different batches.

Artifacts of a pair are held in keyed state until both sides are there; then all of them go on together,
so that windows over a pair see it whole. A pair that is still open when the watermark has passed its
last arrival by `patience` goes to the errors, and its state is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from duoscope.functions.errors import errors_table
from duoscope.operators.chunking import chunks
from duoscope.operators.selection import assign_ids, select_within

OUT = "pair_id long, side string, name string, text string, error_code string"
HELD = "side array<string>, name array<string>, text array<string>"
COLUMNS = ["side", "name", "text"]


def paired(artifacts: DataFrame, patience_seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """pair_id, side, name, text, error_code of a stream (pair_id, side, name, text, arrived): whole pairs, with error_code null, and those that stayed open.

    An artifact that comes again with the same side and name replaces the one that is held. Artifacts that
    come after their pair has gone on open it anew, and need both sides again. Rows with a null pair_id, or
    a side other than A and B, are errors at once (invalid_request).
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            held = dict(zip(COLUMNS, state.get, strict=True))
            state.remove()
            yield pd.DataFrame({"pair_id": key[0], **held, "error_code": "empty_artifact"})
            return
        held = list(zip(*state.get, strict=True)) if state.exists else []
        last = 0
        for part in parts:
            held += part[COLUMNS].itertuples(index=False, name=None)
            last = max(last, int(part["at_ms"].max()))
        held = list({(side, name): (side, name, text) for side, name, text in held}.values())
        columns = [list(c) for c in zip(*held, strict=True)]
        if {"A", "B"} <= set(columns[0]):
            if state.exists:
                state.remove()
            yield pd.DataFrame({"pair_id": key[0], **dict(zip(COLUMNS, columns, strict=True)), "error_code": None})
            return
        state.update(tuple(columns))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 1000 * patience_seconds)

    given = artifacts.withWatermark("arrived", late)
    good = F.col("pair_id").isNotNull() & F.coalesce(F.col("side").isin("A", "B"), F.lit(False))
    rows = given.filter(good).select(F.col("pair_id").cast("long").alias("pair_id"), *COLUMNS, (F.col("arrived").cast("double") * 1000).cast("long").alias("at_ms"), "arrived")
    open_ = rows.groupBy("pair_id").applyInPandasWithState(step, OUT, HELD, "append", GroupStateTimeout.EventTimeTimeout)
    bad = artifacts.filter(~good).select(F.col("pair_id").cast("long").alias("pair_id"), *COLUMNS, F.lit("invalid_request").alias("error_code"))
    return open_.unionByName(bad)


def start_paired_intake(artifacts: DataFrame, output: str, errors: str, checkpoint: str, budget: int = 20_000, patience_seconds: int = 3600, late: str = "10 minutes") -> StreamingQuery:
    """Writes the chunks of whole pairs with ids and `included`, and the errors of others (one row for each artifact), a folder of either for each batch; a batch done again replaces its folders."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # the state's output is read twice
        select_within(assign_ids(chunks(batch.filter("error_code is null"))), budget).write.mode("overwrite").parquet(f"{output}/batch={number}")
        errors_table(batch, "pair_id", message=F.concat_ws(" ", "side", "name")).write.mode("overwrite").parquet(f"{errors}/batch={number}")
        batch.unpersist()

    stream = paired(artifacts, patience_seconds, late)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
