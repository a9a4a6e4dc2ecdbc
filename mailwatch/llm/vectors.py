"""Vectors in DataFrames and as matrices of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers that one matrix of rows may hold.
NUMBERS = 1 << 20


def usable(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(F.col(vector).isNotNull() & finite, F.lit(False))


def matrix(column: pa.Array, kind: str, width: int = 0) -> np.ndarray:
    """The rows of a list column; shorter ones are filled with zeros up to width, or to the longest."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(np.asarray(column.offsets))
    values = np.asarray(column.flatten()).astype(kind)
    width = max(width, int(sizes.max(initial=0)))
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), kind)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def widened(rows: np.ndarray, width: int) -> np.ndarray:
    """The rows with zeros behind them up to width."""
    return rows if rows.shape[1] >= width else np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


def slices(part: pa.RecordBatch, column: str, most: int = 2048) -> Iterator[pa.RecordBatch]:
    """The rows of part in pieces of at most ``most`` rows and about NUMBERS components."""
    offsets = np.asarray(part.column(column).offsets)
    start = 0
    while start < part.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + NUMBERS, side="right")) - 1
        stop = min(max(start + 1, stop), start + most, part.num_rows)
        yield part.slice(start, stop - start)
        start = stop


def first_of_groups(groups: np.ndarray, scores: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the n first entries of each group, higher scores and then smaller ids first, and their places from 0."""
    order = np.lexsort((ids, -scores if scores.dtype.kind == "f" else ~scores, groups))
    at = groups[order]
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.empty(0, np.int64)
    place = np.arange(len(at)) - np.repeat(new, np.diff(np.concatenate([new, [len(at)]])))
    return order[place < n], place[place < n]
