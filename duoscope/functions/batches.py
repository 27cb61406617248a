"""Arrow batches in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Text that one step of a Python worker holds at a time.
SLICE_BYTES = 2 << 20


def slices(batches: Iterator[pa.RecordBatch], text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of a slice take about `limit` bytes (one row at least); text: the number of their column."""
    for batch in batches:
        start = held = 0
        for row, length in enumerate(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()):
            if held and held + length > limit:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += length
        if start < batch.num_rows:
            yield batch.slice(start)
