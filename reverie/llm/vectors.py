"""Whole-number vectors: what the vector operators read, and how they put rows into blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Squared length up to which differences and products of two vectors are exact in 64 bits.
LENGTH_LIMIT = 2.0**60


def whole(vector: Column, factor: int) -> Column:
    """floor(factor * x) of each component x; null for a null vector, a null or non-finite component, or a squared length over LENGTH_LIMIT."""
    double = F.transform(vector, lambda x: x.cast("double") * factor)
    finite = F.forall(double, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    square = F.aggregate(double, F.lit(0.0), lambda a, x: a + x * x)
    return F.when(finite & (square <= LENGTH_LIMIT), F.transform(double, lambda x: F.floor(x).cast("int")))


def matrix(vectors: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of lists of int32 as a matrix, short ones filled up with 0."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    size = np.diff(vectors.offsets.to_numpy())
    if (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width), np.int32)
    out[np.arange(width)[None, :] < size[:, None]] = flat
    return out


def blocks(batches, rows: int):
    """The rows of Arrow batches as tables of that many rows, the last one of what is left."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        while n >= rows:
            table = pa.Table.from_batches(held)
            yield table.slice(0, rows)
            held, n = table.slice(rows).to_batches(), n - rows
    if n:
        yield pa.Table.from_batches(held)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of whole numbers; floating where all sums fit 53 bits."""
    most = lambda x: float(np.einsum("ij,ij->i", x, x, dtype=np.float64).max(initial=0))
    if most(a) * most(b) < 2.0**104:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def row_count(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]
