"""Cutting Arrow batches and lists of texts into parts of bounded bytes."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TEXT_BYTES = 4 << 20  # of text handled at a time inside a task


def slices(batch: pa.RecordBatch, column: str, most: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch, each with at most ``most`` bytes in a column, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at, before = 0, 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, end - at)
        at, before = end, int(ends[end - 1])


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A text column as strings; a missing text is an empty one."""
    return [t or "" for t in batch[column].to_pylist()]


def of_bytes(parts: list[str], most: int) -> Iterator[list[str]]:
    """Lists of texts of about equal bytes, longest texts together, so that no call holds much more than ``most``."""
    held, size = [], 0
    for part in parts:
        if held and size + len(part) > most:
            yield held
            held, size = [], 0
        held.append(part)
        size += len(part)
    if held:
        yield held
