"""Vectors as whole numbers, for the operators that must be exact.

A component x becomes ``floor(1024 * x)`` in double precision. Rows whose vector is null, or holds a null, NaN or infinite
component, are dropped; a number beyond ``limit`` leaves the row without numbers (``q`` is null), as squared distances of such
vectors do not fit a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 1024
#: Sums of products of up to EXACT_WIDTH numbers of at most this size are exact in doubles.
EXACT = 2**22
EXACT_WIDTH = 512


def _unfit(x: Column) -> Column:
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def limit(length: Column) -> Column:
    """The largest number whose vectors' squared distances stay below 2 ** 62: 2 ** 27 for 64 components."""
    return F.lit(float(2**30)) / F.sqrt(F.greatest(length, F.lit(1)))


def quantised(df: DataFrame, id_col: str, vec_col: str, **more: str) -> DataFrame:
    """``vec_id`` (long), the columns ``more`` (new name: column) and ``q`` (null beyond the limit) of the rows that stay."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), *[F.col(c).alias(n) for n, c in more.items()], F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("v").isNotNull()).where(~F.exists("v", _unfit))
    rows = rows.withColumn("most", limit(F.size("v")))
    scaled = F.transform("v", lambda x: F.floor(x * SCALE))
    held = ~F.exists("v", lambda x: F.abs(x) * SCALE > F.col("most"))
    return rows.select("vec_id", *more, F.when(held, scaled.cast("array<int>")).alias("q"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column without nulls, of equal lengths, as rows of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def lists(rows: np.ndarray) -> pa.Array:
    """Rows of longs as a list column."""
    ends = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.reshape(-1), pa.int64()))
