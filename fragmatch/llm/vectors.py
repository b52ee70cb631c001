"""What the vector operators share: which rows take part, and vectors as bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vec) -> F.Column:
    """Whether a vector is not null, not empty or zero, and without null or non-finite components."""
    inf = F.lit(float("inf"))
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & fine & F.exists(vec, lambda x: x != 0), F.lit(False))


def common_size(rows: DataFrame, vec: str) -> int:
    """The number of components that most vectors have; ties: the larger."""
    top = rows.groupBy(F.size(vec).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return top["d"] if top else 0


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a float64 matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def stacked(column: pa.Array, size: int) -> np.ndarray:
    """A binary column of float64 vectors as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, size)


def packed(rows: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(rows, np.float64)
    return pa.array([r.tobytes() for r in raw], pa.binary())
