"""Arrow batches of a size that a Python worker can hold several copies of."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def few_rows(spark: SparkSession, rows: int = 1000) -> None:
    """Lets the session send at most so many rows at once; whole texts are rows of any size."""
    if not 0 < int(spark.conf.get(_ROWS)) <= rows:
        spark.conf.set(_ROWS, str(rows))


def small(parts: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of parts in batches with about limit bytes of text in column; a longer text is a batch of its own."""
    for part in parts:
        sizes = np.asarray(pc.fill_null(pc.binary_length(part.column(column)), 0))
        ends = np.cumsum(sizes)
        start = 0
        while start < part.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield part.slice(start, stop - start)
            start = stop
