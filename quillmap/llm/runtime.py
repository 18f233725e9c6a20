"""What the operators of this folder share: patterns, id handling and worker settings."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.session import workers_see_package

#: White space and words of all text operators here: ASCII white space parts words, nothing else does.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in an Arrow batch; with whole texts the usual 10,000 would be too many for a worker.
BATCH_ROWS = "500"


def prepare(spark: SparkSession) -> None:
    """Settings for Python operators over whole texts. A batch size that the session has set itself stays."""
    workers_see_package(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":  # Spark's own
        spark.conf.set(name, BATCH_ROWS)


def narrow(df: DataFrame, id_col: str, *cols: str) -> DataFrame:
    """Only the id, as a long, and ``cols``; clashing extra columns of the input go no further."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), *[F.col(c) for c in cols])


def packed(df: DataFrame, id_col: str) -> DataFrame:
    """``__own`` (the id, as a long) and ``__row`` with all columns, whose names can't clash with those of a join then."""
    return df.select(F.col(id_col).cast("long").alias("__own"), F.struct("*").alias("__row"))


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("__row.*")


def free_name(name: str, df: DataFrame) -> str:
    """``name``, with underscores behind it as long as ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id as text; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def release() -> None:
    """Give a worker's freed memory back to the system, at the end of a task; workers live on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
