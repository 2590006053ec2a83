"""Moving feature vectors between Arrow batches and NumPy inside tasks."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_matrix(values: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Equal-length list column to a (rows, width) float64 matrix without a row loop."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=np.float64).reshape(-1, width)


def to_lists(matrix: np.ndarray) -> pa.ListArray:
    rows, width = matrix.shape
    offsets = np.arange(0, (rows + 1) * width, max(width, 1), dtype=np.int32)[: rows + 1]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(matrix.ravel()))


def _filled(parts: tuple[pd.Series, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Feature matrix of a batch, and which rows have all cells; a null cell arrives as NaN."""
    matrix = np.column_stack([p.to_numpy(dtype=np.float64) for p in parts])
    return matrix, ~np.isnan(matrix).any(axis=1)


def row_function(kernel: Callable[[np.ndarray], np.ndarray], cols: list[Column]) -> Column:
    """Column with ``kernel`` of the feature matrix, batch by batch; null if a cell is null."""

    @F.pandas_udf("double")
    def apply(*parts: pd.Series) -> pd.Series:
        matrix, filled = _filled(parts)
        # Spark stores the NaN of a row with a missing cell as null.
        return pd.Series(np.where(filled, kernel(matrix), np.nan))

    return apply(*cols)


def row_array_function(kernel: Callable[[np.ndarray], np.ndarray], cols: list[Column]) -> Column:
    """Like :func:`row_function` for a kernel that gives one vector per row."""

    @F.pandas_udf("array<double>")
    def apply(*parts: pd.Series) -> pd.Series:
        matrix, filled = _filled(parts)
        rows = zip(kernel(matrix), filled)
        return pd.Series([list(row) if whole else None for row, whole in rows], dtype=object)

    return apply(*cols)


# Up to this many vectors, and bytes of them, are added on the driver.
FEW_VECTORS = 64
FEW_BYTES = 16 << 20
# Bytes of the vectors that one task adds up.
GROUP_BYTES = 64 << 20


def sum_vectors(partials: DataFrame, count: int, length: int) -> np.ndarray:
    """Sum of the vectors ``v`` of ``(unit, v)``, added in the order of the units.

    Units are numbers below ``count``, each at most once. Groups of units with
    neighbouring numbers are added up in tasks, then the groups in the same way, until
    few vectors are left for the driver. The order of the additions follows from
    ``count`` and ``length`` alone, so the sum has the same bits for every partitioning,
    and whole vectors move, never their single numbers.
    """
    most = max(4, min(FEW_VECTORS, FEW_BYTES // (8 * max(length, 1))))
    while count > most:
        size = max(2, min(math.ceil(math.sqrt(count)), GROUP_BYTES // (8 * max(length, 1))))

        def add(key: tuple, table: pa.Table) -> pa.Table:
            total = _in_order(table, length)
            return pa.table([pa.array([key[0].as_py()], pa.int64()), to_lists(total[None, :])], names=["unit", "v"])

        group = F.floor(F.col("unit") / size).cast("long").alias("group")
        partials = partials.groupBy(group).applyInArrow(add, "unit long, v array<double>")
        count = math.ceil(count / size)
    return _in_order(partials.select("unit", "v").toArrow(), length)


def _in_order(table: pa.Table, length: int) -> np.ndarray:
    """The vectors of a table added one after another by unit."""
    total = np.zeros(length)
    if table.num_rows:
        for row in to_matrix(table.sort_by("unit")["v"], length):
            total += row
    return total
