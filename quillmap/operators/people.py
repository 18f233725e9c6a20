"""Order-aware merging and correcting of name lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap.functions.text import same_person


def merge_names(primary: Column, secondary: Column) -> Column:
    """``primary`` as it is, then each name of ``secondary`` that is no person already listed."""
    none = F.array().cast("array<string>")
    return F.reduce(F.coalesce(secondary, none), F.coalesce(primary, none), lambda have, n: F.when(F.exists(have, lambda h: same_person(h, n)), have).otherwise(F.concat(have, F.array(n))))


def corrected(lists: DataFrame, fixes: DataFrame, key: str, names: str) -> DataFrame:
    """``lists`` after ``fixes`` (``key, vacant, remove``): vacant keys go, named persons go, and so do lists left empty.

    A list that no fix touches stays, even if it is empty.
    """
    f = fixes.select(F.col(key).alias("__key"), "vacant", "remove")
    out = lists.join(f, F.col(key) == F.col("__key"), "left").where(~F.coalesce("vacant", F.lit(False)))
    removes = F.size(F.coalesce("remove", F.array().cast("array<string>"))) > 0
    left = F.filter(F.col(names), lambda p: ~F.exists(F.col("remove"), lambda r: same_person(p, r)))
    return out.withColumn("__left", F.when(removes, left).otherwise(F.col(names))).where(~removes | (F.size("__left") > 0)).withColumn(names, F.col("__left")).drop("__key", "vacant", "remove", "__left")
