"""What the vector operators share: which vectors take part, and their rows as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: str) -> Column:
    """True for vectors that are neither null nor zero and hold only finite components."""
    x = F.col(column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


def vectors(df: DataFrame, id_col: str, vector_col: str, *more: Column) -> DataFrame:
    """(vec_id, x array<double>, ...) of the rows with an id and a usable vector."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"), *more)
    return rows.where(F.col("vec_id").isNotNull() & usable("x"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A row for each vector of one length."""
    rows = len(column)
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.float64).reshape(rows, -1) if rows else np.empty((0, 0))


def units(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(1, keepdims=True) if len(x) else x  # so that squares neither vanish nor overflow
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True) if len(x) else x
