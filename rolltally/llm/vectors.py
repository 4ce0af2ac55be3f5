"""Vector columns: which rows take part, copies folded, and numpy views of Arrow lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """No null, no null or non-finite component, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def sizes(vectors: DataFrame) -> list[int]:
    """The lengths that occur among ``vector``: one number per length comes to the driver."""
    return sorted(r["size"] for r in vectors.select(F.size("vector").alias("size")).distinct().collect())


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Lists of equal length as rows of a double matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size)


def lists(rows: np.ndarray) -> pa.ListArray:
    ends = np.arange(0, rows.size + 1, rows.shape[1] or 1, dtype=np.int32)[: len(rows) + 1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(rows).reshape(-1)))
