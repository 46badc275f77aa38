"""Parts of an Arrow batch. Spark hands a function up to ten thousand rows or
64 MB at once; NumPy work on them takes several times their size, so functions
over texts and token lists go through a batch in runs of rows of a bounded size
and what a task holds does not grow with its rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of text, or tokens, of the rows that are worked on at once.
PART_SIZE = 1 << 19


def row_parts(sizes: np.ndarray, most: int = PART_SIZE) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of rows whose ``sizes`` sum to at most ``most``; a
    larger row is a run of its own."""
    ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield start, stop
        start = stop


def list_sizes(arr: pa.Array) -> np.ndarray:
    """The number of values of each list of an Arrow array."""
    return np.diff(np.asarray(arr.offsets, dtype=np.int64))


def batch_parts(batch: pa.RecordBatch, lists: str, most: int = PART_SIZE) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows by the sizes of its list column ``lists``."""
    for start, stop in row_parts(list_sizes(batch.column(lists)), most):
        yield batch.slice(start, stop - start)
