"""Functions of whole arrays that NumPy computes in Arrow batches; each array stays with its row."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql.functions import arrow_udf

from cohortspark.plans.shared import ship


def stacks(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """The arrays of a column by length: (rows, values of these rows as a matrix). Null arrays are left out."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    length = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), -1)
    out = []
    for n in np.unique(length[length >= 0]):
        rows = np.flatnonzero(length == n)
        whole = len(rows) == len(length)
        own = values[offsets[0] : offsets[-1]] if whole else values[(offsets[rows][:, None] + np.arange(n)).ravel()]
        out.append((rows, own.reshape(len(rows), n)))
    return out


def lists(n_rows: int, parts: list[tuple[np.ndarray, np.ndarray]], kind: pa.DataType) -> pa.Array:
    """A column of arrays from matrices by rows; rows that no part has are null."""
    if len(parts) == 1 and len(parts[0][0]) == n_rows:
        size = parts[0][1].shape[1]
        return pa.ListArray.from_arrays(pa.array(np.arange(n_rows + 1, dtype=np.int32) * size), pa.array(parts[0][1].ravel(), kind))
    rows: list = [None] * n_rows
    for at, values in parts:
        for i, v in zip(at.tolist(), values):
            rows[i] = v
    return pa.array(rows, pa.list_(kind))


def mapped(data: Column, function: Callable[[np.ndarray], np.ndarray]) -> Column:
    """`function` of the arrays, a matrix of arrays of one length at a time; null for null, empty for empty."""
    ship(SparkSession.active())

    def run(column: pa.Array) -> pa.Array:
        parts = [(rows, function(v.astype(float)) if v.shape[1] else v.astype(float)) for rows, v in stacks(column)]
        return lists(len(column), parts, pa.float64())

    return arrow_udf(run, "array<double>")(data)


def counted(function: Callable[..., np.ndarray], *columns: Column) -> Column:
    """Whole numbers that `function` gives for the arrays of each row; null where any of these is null."""
    ship(SparkSession.active())

    def run(*arrays: pa.Array) -> pa.Array:
        n = len(arrays[0])
        by_row: list[dict[int, np.ndarray]] = [{i: v for rows, m in stacks(a) for i, v in zip(rows.tolist(), m)} for a in arrays]
        whole = [i for i in range(n) if all(i in d for d in by_row)]
        rows: list = [None] * n
        for i in whole:
            rows[i] = function(*[d[i] for d in by_row])
        return pa.array(rows, pa.list_(pa.int64()))

    return arrow_udf(run, "array<bigint>")(*columns)
