"""Voronoi cells by rings of grid cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap.functions import geometry as G
from quillmap.operators.spatial import fine
from quillmap.plans.storage import apart, keep


def _nearer(poly: Column, x: Column, y: Column, other: Column) -> Column:
    """The part of a convex ``poly`` that is not nearer to ``other`` than to (x, y)."""
    dx, dy = other.x - x, other.y - y
    middle = (other.x * other.x + other.y * other.y - x * x - y * y) / 2

    def piece(e: Column) -> Column:
        t = e.d / (e.d - e.n)
        meet = G.point(e.a.x + (e.b.x - e.a.x) * t, e.a.y + (e.b.y - e.a.y) * t)
        return F.array_compact(F.array(F.when(e.d <= 0, e.a), F.when((e.d < 0) & (e.n > 0) | (e.d > 0) & (e.n < 0), meet)))

    def beyond(p: Column) -> Column:
        return p.x * dx + p.y * dy - middle

    sides = F.transform(G.edges(poly), lambda e: F.struct(e.a.alias("a"), e.b.alias("b"), beyond(e.a).alias("d"), beyond(e.b).alias("n")))
    return F.flatten(F.transform(sides, piece))


def voronoi(points: DataFrame, point_id: str, box: tuple[float, float, float, float], size: float) -> DataFrame:
    """``id, x, y, poly``: the part of ``box`` (x0, y0, x1, y1) that is nearer to each point (``x, y``) than to any other.

    Points lie in grid cells of ``size`` at most, halved until there are as many grid cells as points. A round cuts a point's polygon by the points of the grid cells up to r cells away;
    points beyond those are more than r sizes away, so a polygon whose corners all lie within half of that is final. r doubles
    for the others, and a written table goes from round to round.

    Points with a null, and those outside the box, have no polygon; of points in one place the least id has it.
    """
    x0, y0, x1, y1 = box
    known = points.select(F.col(point_id).alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(f"id is not null and x between {x0} and {x1} and y between {y0} and {y1}")
    known = known.groupBy("x", "y").agg(F.min("id").alias("id"))
    known = keep(known, "seeds")
    size = fine(known, (x1 - x0) * (y1 - y0), size)
    known = apart(known).select("id", "x", "y", F.floor((F.col("x") - x0) / size).alias("i"), F.floor((F.col("y") - y0) / size).alias("j"))
    whole = F.array(*[G.point(F.lit(float(a)), F.lit(float(b))) for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])
    rest, done, r, seen = known.withColumn("poly", whole), [], 1, -1
    widest = max(x1 - x0, y1 - y0) / size + 1
    others = known.select(F.col("i").alias("ci"), F.col("j").alias("cj"), F.col("id").alias("oid"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    while True:
        near = rest.select("id", "x", "y", "i", "j", F.explode(F.sequence(F.col("i") - r, F.col("i") + r)).alias("ci"))
        near = near.select("*", F.explode(F.sequence(F.col("j") - r, F.col("j") + r)).alias("cj")).where(F.greatest(F.abs(F.col("ci") - F.col("i")), F.abs(F.col("cj") - F.col("j"))) > seen)
        met = near.join(others, ["ci", "cj"]).where("id <> oid")
        far = (F.col("ox") - F.col("x")) * (F.col("ox") - F.col("x")) + (F.col("oy") - F.col("y")) * (F.col("oy") - F.col("y"))
        lists = met.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(far.alias("d"), F.col("ox").alias("x"), F.col("oy").alias("y")))).alias("near"))
        cut = F.reduce("near", F.col("poly"), lambda p, o: F.when(F.size(p) > 0, _nearer(p, F.col("x"), F.col("y"), o)).otherwise(p))
        found = rest.join(lists, "id", "left").withColumn("poly", F.when(F.col("near").isNull(), F.col("poly")).otherwise(cut)).drop("near")
        reach = F.array_max(F.transform("poly", lambda p: F.hypot(p.x - F.col("x"), p.y - F.col("y"))))
        found = keep(found.withColumn("final", (reach <= r * size / 2) | F.lit(r >= widest)), "voronoi")
        done.append(found.where("final").drop("final"))
        rest = found.where("not final").drop("final")
        if r >= widest or rest.limit(1).count() == 0:
            return reduce(DataFrame.unionByName, done).select(F.col("id").alias(point_id), "x", "y", "poly")
        seen, r = r, 2 * r
