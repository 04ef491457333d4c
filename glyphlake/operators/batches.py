"""Arrow batches of texts in slices, so that what Python holds at a time does not grow with the batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MOST_ROWS, MOST_BYTES = 500, 1 << 20


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, rows: int = MOST_ROWS, size: int = MOST_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in order, without a copy: at most ``rows`` at a time, with at most ``size`` bytes of text or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = min(max(int(np.searchsorted(ends, before + size, side="right")), at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
