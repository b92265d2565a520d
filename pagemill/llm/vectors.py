"""Vector columns as matrices."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .textops import NULL_ID


def vector_rows(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, embedding as array<double>) of all rows; a null id becomes the smallest one."""
    return rows.select(F.coalesce(F.col(vec_id).cast("long"), F.lit(NULL_ID)).alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))


def is_whole(embedding: str) -> Column:
    """Neither null nor with null or non-finite components."""
    return F.col(embedding).isNotNull() & (F.size(F.filter(embedding, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))) == 0)


def matrix(column, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """A float64 matrix, shorter vectors filled up with zeros, and which rows are whole and finite."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    values = pc.fill_null(column.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    out = np.zeros((n, dim))
    row = np.repeat(np.arange(n), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = values
    ok = pc.is_valid(column).to_numpy(zero_copy_only=False) & np.isfinite(out).all(1)
    return out, ok


def put(**arrays: np.ndarray) -> bytes:
    sink = io.BytesIO()
    np.savez(sink, **arrays)
    return sink.getvalue()


def get(blob) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(bytes(blob))) as found:
        return {k: found[k] for k in found.files}
