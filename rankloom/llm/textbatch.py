"""Arrow batches and slices of bounded text size, for the Python side of operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

BATCH = 8_000_000


def groups_of(batch: pa.RecordBatch, text_at: int, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about so many bytes, a row at least."""
    sizes = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(text_at)).to_numpy(zero_copy_only=False).astype(float)))
    at = 0
    while at < batch.num_rows:
        base = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, base + size, "right")))
        yield batch.slice(at, to - at)
        at = to


def _given_back(run: Callable) -> Callable:
    """run, and at its end the memory that allocators hold back goes to the system: Python workers live on after a task."""

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(given)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return batches


def map_arrow(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """df.mapInArrow() in batches of about BATCH bytes, a row at least. run gets columns by their place: names may be any."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(_given_back(run), schema)
