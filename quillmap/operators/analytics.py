"""Aggregates beyond the built-in ones; all keep map-side partial sums except where a group's list is needed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmap.operators.grid import numbered
from quillmap.plans.storage import keep


def upper_median(v: str) -> Column:
    """The same as an aggregate: it holds a count for each different value of a group, so groups must have few of them."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {v} DESC)")


def medians(df: DataFrame, group: str, value: str) -> DataFrame:
    """``group, upper, middle`` of the values that are not null: the element at ``n div 2`` of the sorted group, so the upper
    of two middle values, and the mean of those two. Ranks come from range-sorted tasks, so no task holds a group.
    """
    rows = df.where(F.col(value).isNotNull()).select(group, F.col(value).alias("__value"))
    ranked = keep(numbered(rows, group, "__value", name="__n"), "ranked")
    sizes = ranked.groupBy(F.col(group).alias("__group")).agg(F.max("__n").alias("__size"))
    at = ranked.join(sizes, F.col(group).eqNullSafe(F.col("__group"))).where("__n between (__size + 1) div 2 and __size div 2 + 1")
    upper = F.max("__value").alias("upper")
    return at.groupBy(group).agg(upper, F.avg("__value").alias("middle")) if dict(rows.dtypes)["__value"] in ("double", "float", "int", "bigint", "smallint", "tinyint") else at.groupBy(group).agg(upper)


def reached(v: Column, limits: tuple[float, ...], name: str) -> list[Column]:
    """Counts of values at or above each limit."""
    return [F.count_if(v >= x).alias(f"{name}_{str(x).replace('.', '_')}") for x in limits]


def mean_direction(angle: Column, weight: Column, fold: int = 4) -> Column:
    """Weighted mean of angles (radians) that repeat every ``2 pi / fold``."""
    return F.atan2(F.sum(weight * F.sin(angle * fold)), F.sum(weight * F.cos(angle * fold))) / fold


def circle_fit(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """``cx, cy, r`` of the least-squares circle of each group, from sums of powers; null where the points are on a line.

    The sums are taken about the group's mean, so that large coordinates lose no digits.
    """
    mean = df.groupBy(group).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"))
    u, v = F.col(x) - F.col("mx"), F.col(y) - F.col("my")
    s = df.join(mean, group).select(group, "mx", "my", u.alias("u"), v.alias("v")).groupBy(group).agg(
        F.first("mx").alias("mx"), F.first("my").alias("my"), F.count(F.lit(1)).alias("n"), F.sum(F.expr("u*u")).alias("uu"), F.sum(F.expr("v*v")).alias("vv"), F.sum(F.expr("u*v")).alias("uv"),
        F.sum(F.expr("u*u*u + u*v*v")).alias("p"), F.sum(F.expr("v*v*v + v*u*u")).alias("q"),
    )
    det = F.expr("uu*vv - uv*uv")
    a, b = F.expr("(p*vv - q*uv) / 2") / det, F.expr("(q*uu - p*uv) / 2") / det
    good = F.abs(det) > 1e-12
    r = F.sqrt(a * a + b * b + (F.col("uu") + F.col("vv")) / F.col("n"))
    return s.select(group, F.when(good, a + F.col("mx")).alias("cx"), F.when(good, b + F.col("my")).alias("cy"), F.when(good, r).alias("r"))


def runs(df: DataFrame, group: str, order: str, gap: Column, into: str = "run") -> DataFrame:
    """``df`` with a run number per group; ``gap`` (on ``prev`` and the row) starts a new run."""
    w = W.partitionBy(group).orderBy(order)
    out = df.withColumn("prev", F.lag(order).over(w))
    return out.withColumn(into, F.sum(F.coalesce(gap, F.lit(False)).cast("int")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("prev")


def degrees(a: Column) -> Column:
    return a * (180 / math.pi)


def least_gap(df: DataFrame, group: str, value: str) -> DataFrame:
    """``group, pitch``: the smallest gap between neighbouring different values; null for a group of one value.

    Values are numbered over tasks and each meets its successor, so that no task sorts a whole group. Null values count for nothing.
    """
    rows = keep(numbered(df.select(group, value).where(F.col(value).isNotNull()).distinct(), group, value, name="__n"), "values")
    after = rows.select(F.col(group).alias("__group"), (F.col("__n") - 1).alias("__at"), F.col(value).alias("__value"))
    steps = rows.join(after, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__n") == F.col("__at")), "left")
    return steps.groupBy(group).agg(F.min(F.col("__value") - F.col(value)).alias("pitch"))


def frame(df: DataFrame, group: str, by: float = 20.0) -> DataFrame:
    """``group, x, y, width, height``: the box of all points ``x, y`` of a group, grown by ``by``."""
    b = df.groupBy(group).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    return b.select(group, (F.col("x0") - by).alias("x"), (F.col("y0") - by).alias("y"), (F.col("x1") - F.col("x0") + 2 * by).alias("width"), (F.col("y1") - F.col("y0") + 2 * by).alias("height"))


def mean_line(df: DataFrame, group: str, angle: str, offset: str, weight: str) -> DataFrame:
    """``group, nx, ny, offset``: the weighted mean of the normals (length 1) and offsets of a group's lines."""
    w = F.col(weight)
    s = df.groupBy(group).agg(F.sum(w * F.cos(angle)).alias("c"), F.sum(w * F.sin(angle)).alias("s"), F.sum(w * F.col(offset)).alias("o"), F.sum(w).alias("w"))
    n = F.hypot("c", "s")
    return s.select(group, (F.col("c") / n).alias("nx"), (F.col("s") / n).alias("ny"), (F.col("o") / F.col("w")).alias("offset"))


def parity(df: DataFrame, group: str, iou: str) -> DataFrame:
    """Per group the rows, those missing (null), those at or above 0.95, 0.9 and 0.8, and the upper median."""
    v = F.col(iou)
    df = keep(df.select(group, iou), "scores")
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(v.isNull()).alias("missing"), *reached(v, (0.95, 0.9, 0.8), "iou"))
    middle = medians(df, group, iou).select(F.col(group).alias("__group"), F.col("upper").alias("middle"))
    return counts.join(middle, F.col(group).eqNullSafe(F.col("__group")), "left").drop("__group")


def worst(df: DataFrame, iou: str, order: str, below: float = 0.8) -> DataFrame:
    """Rows without a score, then those below the limit from the lowest. Scores are worked out once."""
    df = keep(df, "scores")
    return df.where(F.col(iou).isNull() | (F.col(iou) < below)).orderBy(F.asc_nulls_first(iou), order)


def circle_residual(df: DataFrame, fit: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """``group, residual``: how far the point farthest from its group's circle (``cx, cy, r``) lies off it."""
    off = F.abs(F.hypot(F.col(x) - F.col("cx"), F.col(y) - F.col("cy")) - F.col("r"))
    return df.select(group, x, y).join(fit.select(group, "cx", "cy", "r"), group).groupBy(group).agg(F.max(off).alias("residual"))


def median_direction(df: DataFrame, group: str, angle: str, fold: float = 90.0) -> DataFrame:
    """``group, direction``: the median of angles in degrees that repeat every ``fold``, from -``fold``/2 on; groups of one have none."""
    turned = df.where(F.col(angle).isNotNull()).select(group, (F.pmod(F.col(angle) + fold / 2, F.lit(fold)) - fold / 2).alias("__angle"))
    turned = keep(turned, "angles")
    several = turned.groupBy(F.col(group).alias("__g")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    found = medians(turned, group, "__angle")
    return found.join(several, F.col(group).eqNullSafe(F.col("__g")), "left_semi").select(group, F.col("middle").alias("direction"))


def circular_runs(df: DataFrame, group: str, angle: str, order: str, gap: float = 25.0) -> DataFrame:
    """``df`` with ``run`` per group: angles in degrees from 0 to 360, a new run after a gap of more than ``gap``; the last run
    joins the first where the circle closes within the gap. ``order`` tells equal angles apart.
    """
    at = df.withColumn("__at", F.struct(angle, order))
    found = runs(at, group, "__at", F.col(f"__at.{angle}") - F.col(f"prev.{angle}") > gap)
    ends = found.groupBy(F.col(group).alias("__g")).agg(F.min(angle).alias("__low"), F.max(angle).alias("__high"), F.max("run").alias("__last"))
    out = found.join(ends, F.col(group) == F.col("__g"))
    wraps = (F.col("__last") > 0) & (F.col("run") == F.col("__last")) & (F.col("__low") + 360 - F.col("__high") <= gap)
    return out.withColumn("run", F.when(wraps, 0).otherwise(F.col("run"))).drop("__at", "__g", "__low", "__high", "__last")
