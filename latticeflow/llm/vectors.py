"""Vector columns: which rows take part, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, vector, dim)`` of rows with an id and a finite, non-zero vector without null components."""
    kept = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    fine = F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    return kept.where(F.col("id").isNotNull() & fine & F.exists("vector", lambda x: x != 0)).withColumn("dim", F.size("vector"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of one length as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def unit(m: np.ndarray) -> np.ndarray:
    """Rows over their lengths, scaled first so that squares neither overflow nor vanish."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the same row of ``b``, from the vectors as given.

    Products are added up in the order of the components, so that equal pairs have equal
    cosines wherever and whenever they are computed.
    """

    def dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for k in range(x.shape[1]):
            total += x[:, k] * y[:, k]
        return total

    with np.errstate(all="ignore"):
        out = dot(a, b) / np.sqrt(dot(a, a)) / np.sqrt(dot(b, b))
    odd = ~np.isfinite(out)
    if odd.any():  # squares out of range
        out[odd] = (unit(a[odd]) * unit(b[odd])).sum(1)
    return out


def lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], pa.int32()), pa.array(m.reshape(-1), pa.float64()))
