"""Outlines set straight by the points that were traced along them.

Each point counts for the side that it lies nearest to; a side's line is the one of least squared distances to its points, from
sums that tasks make before they shuffle. Corners move to where the lines of their two sides meet.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap.functions import geometry as G


def _nearest_side(poly: Column, x: Column, y: Column) -> Column:
    """``STRUCT<far, side, ox, oy>``: the squared distance to the nearest side, the side's number and where it starts."""

    def away(e: Column, i: Column) -> Column:
        dx, dy = e.b.x - e.a.x, e.b.y - e.a.y
        square = dx * dx + dy * dy
        along = F.when(square > 0, F.least(F.greatest(((x - e.a.x) * dx + (y - e.a.y) * dy) / square, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        rest_x, rest_y = x - e.a.x - along * dx, y - e.a.y - along * dy
        return F.struct((rest_x * rest_x + rest_y * rest_y).alias("far"), i.alias("side"), e.a.x.alias("ox"), e.a.y.alias("oy"))

    return F.array_min(F.transform(G.edges(poly), away))


def side_lines(points: DataFrame, outlines: DataFrame, key: str, poly: str = "poly", least: int = 6) -> DataFrame:
    """``key, side, n, x, y, angle``: the line through the points ``x, y`` of each side, by a point on it and its angle in [-pi/2, pi/2].

    Sides are numbered from 0, each from its corner to the next; of equally near sides the first counts. Sides with fewer than
    ``least`` points, or with all points in one place, have no row. Rows with a null and points without an outline count for nothing.
    """
    rows = points.select(F.col(key).alias("__key"), F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py")).where("__key is not null and px is not null and py is not null")
    # Outlines may be made from a file of few bytes, by which Spark would broadcast millions of them.
    shapes = outlines.select(F.col(key).alias("__own"), F.col(poly).alias("__poly")).where(F.size("__poly") > 0).hint("merge")
    rows = rows.join(shapes, F.col("__key") == F.col("__own"))
    near = rows.select("__key", "px", "py", _nearest_side(F.col("__poly"), F.col("px"), F.col("py")).alias("s"))
    dx, dy = F.col("px") - F.col("s.ox"), F.col("py") - F.col("s.oy")  # from the side's start, so that sums of squares stay exact
    sums = near.groupBy("__key", F.col("s.side").alias("side"), F.col("s.ox").alias("ox"), F.col("s.oy").alias("oy")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(dx).alias("mx"), F.avg(dy).alias("my"), F.avg(dx * dx).alias("xx"), F.avg(dx * dy).alias("xy"), F.avg(dy * dy).alias("yy")
    )
    xx, xy, yy = F.col("xx") - F.col("mx") * F.col("mx"), F.col("xy") - F.col("mx") * F.col("my"), F.col("yy") - F.col("my") * F.col("my")
    spread = xx + yy > 1e-12 * (F.col("xx") + F.col("yy"))
    out = sums.where((F.col("n") >= least) & spread)
    return out.select(F.col("__key").alias(key), "side", "n", (F.col("ox") + F.col("mx")).alias("x"), (F.col("oy") + F.col("my")).alias("y"), (F.atan2(2 * xy, xx - yy) / 2).alias("angle"))


def _meet(a: Column, b: Column, least_angle: float) -> Column:
    """Where two lines meet; null if either is null or they turn by less than ``least_angle`` degrees."""
    cross = F.sin(b.angle - a.angle)
    along = ((b.x - a.x) * F.sin(b.angle) - (b.y - a.y) * F.cos(b.angle)) / cross
    return F.when(F.abs(cross) >= math.sin(math.radians(least_angle)), G.point(a.x + along * F.cos(a.angle), a.y + along * F.sin(a.angle)))


def _onto(p: Column, a: Column) -> Column:
    """The point of a line that lies nearest to ``p``; null without a line."""
    along = (p.x - a.x) * F.cos(a.angle) + (p.y - a.y) * F.sin(a.angle)
    return F.when(a.isNotNull(), G.point(a.x + along * F.cos(a.angle), a.y + along * F.sin(a.angle)))


def straightened(points: DataFrame, outlines: DataFrame, key: str, poly: str = "poly", least: int = 6, least_angle: float = 20.0) -> DataFrame:
    """``outlines`` with each corner moved to the meet of its sides' lines.

    A corner between a line and a side without one goes to the nearest place on that line; so does one between two lines that
    hardly turn, onto the line of the side that starts there. Without lines a corner stays. Bulges are dropped. Outlines keep
    their other columns; null keys and empty outlines stay as they are, and outlines with equal keys are fitted to all points of the key.
    """
    lines = side_lines(points, outlines.select(key, poly), key, poly, least)
    # One line for each side of an outline, so a list is no longer than its outline.
    own = lines.groupBy(F.col(key).alias("__key")).agg(F.map_from_entries(F.collect_list(F.struct("side", F.struct("x", "y", "angle")))).alias("__lines"))
    rows = outlines.join(own.hint("merge"), F.col(key) == F.col("__key"), "left")
    p, n = F.col(poly), F.size(poly)

    def moved(q: Column, i: Column) -> Column:
        ends = F.struct(F.try_element_at("__lines", F.pmod(i - 1, n)).alias("before"), F.try_element_at("__lines", i).alias("after"))
        return G.named(ends, lambda e: F.coalesce(_meet(e.before, e.after, least_angle), _onto(q, e.after), _onto(q, e.before), G.point(q.x, q.y)))

    fitted = F.when(F.col("__lines").isNull(), F.transform(p, lambda q: G.point(q.x, q.y))).otherwise(F.transform(p, moved))
    return rows.select(*[fitted.alias(poly) if c == poly else F.col(c) for c in outlines.columns])
