"""Dense vectors of Arrow batches as exact integers, shared by the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components that are worked on together in a task, about.
GROUP = 1 << 19


def usable(vector: Column) -> Column:
    """Whether a vector has components and all of them are finite numbers; false for null."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def floored(column: pa.Array, dims: int, factor: int, limit: int) -> np.ndarray:
    """``floor(factor * c)`` of each component of a batch's usable vectors, rows x ``dims``.

    A vector of another length, or a result beyond ``limit``, where the exact
    sums that follow would leave 64 bits, is an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths != dims).any():
        raise ValueError(f"vectors of {dims} and {int(lengths[lengths != dims][0])} components in one table")
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * factor)
    if len(x) and np.abs(x).max() > limit:
        raise ValueError(f"a component of {np.abs(x).max() / factor:g}; exact sums need {limit / factor:g} at most")
    return x.astype(np.int64).reshape(-1, dims)


def slices(batch: pa.RecordBatch, dims: int) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows of about GROUP components together."""
    step = max(1, GROUP // max(dims, 1))
    for s in range(0, batch.num_rows, step):
        yield batch.slice(s, step)
