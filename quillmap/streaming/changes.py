"""The latest state of a change stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_values(stream: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """The newest value of each key, as a running aggregate; use output mode ``update`` or ``complete``."""
    return stream.groupBy(key).agg(F.max_by(value, seq).alias(value), F.max(seq).alias(seq))


def windowed_counts(stream: DataFrame, ts: str, kind: str, width: str, late: str) -> DataFrame:
    """Counts by kind in tumbling windows; rows later than ``late`` behind the newest are left out.

    Times without a zone are those of the session's zone, as watermarks need an instant.
    """
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, width), kind).agg(F.count(F.lit(1)).alias("n"))
