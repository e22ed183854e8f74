"""Bounds on what a Python worker holds at once, whatever the size of the input.

Spark fills an Arrow batch up to a number of rows (10,000), so its bytes grow with the rows of a partition and with their
width.  ``bounded`` sets the limit in bytes that Spark has for it, and ``parts`` cuts a batch further, so that Python objects are made
of a part at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BATCH_BYTES = 4_000_000
PART_BYTES, PART_ROWS = 1_000_000, 1_000
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches hold ``BATCH_BYTES`` at most (one row at least); a smaller limit that is set stays."""
    conf = df.sparkSession.conf
    if not 0 < _bytes(conf.get(_LIMIT, None)) <= BATCH_BYTES:
        conf.set(_LIMIT, str(BATCH_BYTES))
    return df


def _bytes(text: str | None) -> int:
    digits = (text or "").lower().removesuffix("b")
    unit = {"k": 10, "m": 20, "g": 30, "t": 40}.get(digits[-1:], 0)
    digits = digits[:-1] if unit else digits
    return int(digits) << unit if digits.isdigit() else 0


def parts(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = PART_BYTES, most_rows: int = PART_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches cut to ``most_rows`` rows and ``most_bytes`` of a text or binary column (one row at least); nothing is left out."""
    for batch in batches:
        sizes = batch.column(column).cast(pa.large_binary())
        edge = np.cumsum(np.diff(np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset : sizes.offset + len(sizes) + 1])) if len(sizes) else np.zeros(0, np.int64)
        at = 0
        while at < len(batch):
            before = edge[at - 1] if at else 0
            stop = min(max(int(np.searchsorted(edge, before + most_bytes, side="right")), at + 1), at + most_rows)
            yield batch.slice(at, stop - at)
            at = stop
    pa.default_memory_pool().release_unused()  # workers are kept for later tasks
