"""Vectorised helpers on Arrow arrays, shared by the operators that run inside Arrow partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def as_array(column) -> pa.Array:
    """One contiguous array of a possibly chunked column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column


def flat_strings(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The elements of a list column and, for each, the row it came from; null lists have none."""
    lists = as_array(lists)
    return pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def map_distinct(values: pa.Array, fn: Callable[[str], str | None]) -> pa.Array:
    """Apply a Python function once for each distinct string; nulls stay null."""
    coded = as_array(values).dictionary_encode()
    words = coded.dictionary.to_pylist()
    mapped = pa.array([None if w is None else fn(w) for w in words], pa.string())
    return mapped.take(coded.indices)


def lists_from(values: pa.Array, rows: np.ndarray, n_rows: int) -> pa.ListArray:
    """A list column from elements ordered by row."""
    ends = np.searchsorted(rows, np.arange(n_rows + 1), side="left").astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def map_batches(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None and out.num_rows:
                yield out

    return run


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a text column stays under a size in each, or holds one text; no row is lost."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(as_array(batch.column(column))), 0).to_numpy(zero_copy_only=False)
        start, size = 0, 0
        for row, n in enumerate(sizes.tolist()):
            if size and size + n > most:
                yield batch.slice(start, row - start)
                start, size = row, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)
