"""Arrow batches cut into slices of bounded text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MOST = 1 << 22  # bytes of text worked on at a time


def slices(batch: pa.RecordBatch, column: str = "text", most: int = MOST) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` text bytes (one text at least), no row left out."""
    if not batch.num_rows:
        return
    group = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()) // most
    cuts = np.flatnonzero(np.diff(group, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(group)], strict=True):
        yield batch.slice(a, b - a)
