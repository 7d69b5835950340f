"""Runs of whole documents that a task works on at a time, out of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext


def dealt(
    batches: Iterator[pa.RecordBatch], column: str, most: int
) -> Iterator[tuple[int, pa.Table]]:
    """Numbered tables of rows whose texts together have ``most`` bytes, or of one longer text.

    The number holds the task in its upper half, so that it is unique in the job.
    """
    number = TaskContext.get().partitionId() << 32
    held, size = [], 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch[column]), 0).to_pylist()
        first = 0
        for row, length in enumerate(lengths):
            if size and size + length > most:
                held.append(batch.slice(first, row - first))
                yield number, pa.Table.from_batches(held)
                number, held, size, first = number + 1, [], 0, row
            size += length
        held.append(batch.slice(first))
    if held:
        yield number, pa.Table.from_batches(held)
