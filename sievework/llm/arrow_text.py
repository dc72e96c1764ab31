"""Text columns of Arrow batches as bytes and offsets, in slices of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their bytes, their n + 1 offsets) with about ``limit`` bytes each; a longer text stands alone.

    Null text counts as empty.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        data, ends = utf8(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1)
            yield batch.slice(start, stop - start), data[ends[start] : ends[stop]], ends[start : stop + 1] - ends[start]
            start = stop


def emptied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches``, after which freed memory goes back to the system: workers stay and wait for other tasks.

    By then the frame that made them is gone, with all it held.
    """
    yield from batches
    del batches
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string array's bytes and offsets, without a copy where there are no nulls."""
    if array.null_count:
        array = pc.fill_null(array, "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    ends = np.frombuffer(array.buffers()[1], np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    if array.buffers()[2] is None:
        return np.zeros(0, np.uint8), ends - ends[0]
    return np.frombuffer(array.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends - ends[0]
