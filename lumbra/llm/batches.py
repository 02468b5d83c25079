"""Slices of Arrow batches by the size of their texts, so that a task's memory doesn't follow the number of rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a slice; one longer text makes a slice of its own.
SLICE_BYTES = 2 << 20


def slices(batches: Iterable[pa.RecordBatch], column: int | str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in slices whose texts in ``column`` have ``size`` bytes at most, or one row."""
    for batch in batches:
        through = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, before = 0, 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(through, before + size, "right")))
            yield batch.slice(at, end - at)
            at, before = end, int(through[end - 1])
