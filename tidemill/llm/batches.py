"""Reading Arrow batches a few rows at a time, so that a task holds few texts as Python objects."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

STEP = 200


def lists(arrays: Iterable[pa.Array], step: int = STEP) -> Iterator[list]:
    """Values of arrays as lists of at most ``step``."""
    for array in arrays:
        for a in range(0, len(array), step):
            yield array.slice(a, step).to_pylist()
        pa.default_memory_pool().release_unused()


def rows(batches: Iterable[pa.RecordBatch], names: list[str], step: int = STEP) -> Iterator[tuple]:
    """Rows of record batches as tuples."""
    for batch in batches:
        for a in range(0, batch.num_rows, step):
            part = batch.slice(a, step)
            yield from zip(*(part.column(n).to_pylist() for n in names))
        pa.default_memory_pool().release_unused()


def batch(schema: pa.Schema, found: list[tuple]) -> pa.RecordBatch:
    columns = zip(*found) if found else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
