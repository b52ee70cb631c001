"""Slices of Arrow batches for numpy kernels, bounded by bytes of text."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

SLICE_BYTES = 2 << 20
#: What Spark sends to a Python worker at once.
BATCH_BYTES = 2 << 20
_libc = ctypes.CDLL(None)
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes, unless it sets a bound of its own: 10,000 rows of text may be any size."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def release() -> None:
    """Give freed memory back to the system: workers stay alive beside those of later stages."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of batches with at most ``limit`` bytes in ``column``, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        end = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            done = end[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(end, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
    release()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column laid end to end, and len + 1 offsets; nulls are empty."""
    column = pa.concat_arrays([pc.fill_null(column, "")]).cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def plus(schema: StructType, **fields: str) -> StructType:
    """A copy of ``schema`` with further fields (name=type); ``add`` would change a frame's own schema."""
    out = StructType(list(schema.fields))
    for name, kind in fields.items():
        out.add(name, kind)
    return out


def unused(names: list[str], name: str) -> str:
    """``name``, or with underscores until no other column has it."""
    taken = {n.lower() for n in names}
    while name.lower() in taken:
        name += "_"
    return name
