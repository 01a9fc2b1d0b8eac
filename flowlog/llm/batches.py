"""Arrow batches in tasks: slices of bounded text size, so that a batch of long texts fits a worker."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20


#: Where tasks keep what the next task of the same kind in this worker process can use again.
WORKER_STATE = "flowlog-worker"


def slices(
    batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES, keep: bool = False
) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in their order, as slices with ``limit`` bytes of text or a single row.

    Unless a task asks to ``keep`` it, what other tasks left in this worker is dropped, so that stages do not add up.
    """
    if not keep:
        sys.modules.pop(WORKER_STATE, None)
    pa.default_memory_pool().release_unused()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start)


def texts(batch: pa.RecordBatch, text: str) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    column = batch.column(text).cast(pa.large_binary())
    return [value or b"" for value in column.to_pylist()]
