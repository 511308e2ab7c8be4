"""Sorted Arrow batches cut at the borders of groups, without a call a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups and the borders of the groups in them. Rows of a group must come one after the other."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        k = table[key].to_numpy()
        change = np.flatnonzero(k[1:] != k[:-1]) + 1
        if len(change):
            yield table.slice(0, change[-1]), np.concatenate([[0], change])
            rest = table.slice(change[-1])
        else:
            rest = table
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])


def binary_matrix(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    """Rows of equally long binary values as a matrix."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype).reshape(len(values), -1) if values else np.zeros((0, 0), dtype)
