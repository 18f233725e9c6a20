"""State as a fold of change logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def changes(log: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """Rows of a log whose value differs from the one before, nulls counting as values; the first of a key is a change."""
    w = W.partitionBy(key).orderBy(seq)
    out = log.withColumn("previous", F.lag(value).over(w)).withColumn("__n", F.row_number().over(w))
    return out.where((F.col("__n") == 1) | ~F.col(value).eqNullSafe(F.col("previous"))).drop("__n")


def latest(log: DataFrame, scope: str, key: str, seq: str, op: str, cols: list[str]) -> DataFrame:
    """The list that a log of ``add``, ``edit``, ``remove`` and ``clear`` leaves: one row per living key of each scope.

    A clear ends everything before it in its scope, a remove its key. Sums per key are made map-side.
    """
    cleared = log.where(F.col(op) == "clear").groupBy(F.col(scope).alias("__scope")).agg(F.max(seq).alias("__clear"))
    rows = log.where(F.col(op) != "clear").join(cleared, F.col(scope) == F.col("__scope"), "left").where(F.col("__clear").isNull() | (F.col(seq) > F.col("__clear")))
    last = rows.groupBy(scope, key).agg(F.max(F.struct(seq, op, *cols)).alias("m"))
    return last.where(F.col(f"m.{op}") != "remove").select(scope, key, *[F.col(f"m.{c}").alias(c) for c in [seq, *cols]])


def state_at_end(log: DataFrame, session: str, seq: str, field: str, value: str, fields: list[str]) -> DataFrame:
    """The last value set for each field of a session; a field may be set to null, which is not the same as unset."""
    put = [F.max(F.when(F.col(field) == f, F.struct(F.col(seq).alias("s"), F.col(value).alias("v")))).alias(f) for f in fields]
    out = log.groupBy(session).agg(*put)
    return out.select(session, *[F.col(f"{f}.v").alias(f) for f in fields], *[F.col(f).isNotNull().alias(f"{f}_set") for f in fields])
