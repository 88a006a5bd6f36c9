"""Arrow batches in pieces: a batch has so many rows however long their arrays are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Values of a piece, which may become Python objects of some 32 bytes each.
PIECE_VALUES = 1 << 17


def pieces(batch: pa.RecordBatch, column: int, most: int = PIECE_VALUES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` values in a list column; a longer list is a piece by itself."""
    sizes = pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        stop = max(int(np.searchsorted(ends, before + most, "right")), start + 1)
        yield batch.slice(start, stop - start)
        start = stop
