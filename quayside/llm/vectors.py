"""What the operators on embeddings share: rows with whole vectors, and their components as exact integers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows a task works on at a time.
ROWS = 4096
SCALE = 1024
#: Scaled components stay below this, so that sums of a batch fit a long.
MOST = 2**50


def whole_vectors(df: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is there and has neither null nor non-finite entries."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col(column).isNotNull() & ~bad)


def dimension(df: DataFrame, column: str) -> int | None:
    """Length of the vectors, by the first one; None for an empty table."""
    first = df.select(F.size(column).alias("n")).first()
    return None if first is None else int(first["n"])


def integers(vectors: pa.Array, dim: int) -> np.ndarray:
    """floor(1024 * x) of every component, one row per vector. All vectors must have ``dim`` components."""
    lengths = np.diff(vectors.offsets.to_numpy())
    if (lengths != dim).any():
        raise ValueError(f"vectors of {sorted(set(lengths.tolist()))} components in one table")
    scaled = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if scaled.size and np.abs(scaled).max() >= MOST:
        raise ValueError(f"a component of {np.abs(scaled).max() / SCALE:g} is too large for exact sums")
    return scaled.astype(np.int64).reshape(-1, dim)


def as_lists(rows: np.ndarray) -> pa.ListArray:
    """One list per row of a matrix."""
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.array(rows.ravel()))


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
