"""Outlines and lines as rows of vertices: arcs in place of point runs, fewest straight pieces, simplification.

A vertex is a row ``(shape, place, x, y)``. Fits come from sums of powers of the coordinates, so a run of vertices is judged
by one aggregation. What splits does so in rounds: every round judges all open stretches of all shapes at once and is written
to the shared folder. Vertices with a null in any of the four are left out; shapes of one or two vertices stay as they are;
repeated rows are vertices of equal place, in no set order; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmap.plans.storage import apart, keep


def _vertices(points: DataFrame, shape: str) -> DataFrame:
    """``s, i, n, x, y``: vertices numbered from 0 in each shape, with their number."""
    rows = points.select(F.col(shape).alias("s"), "place", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("s is not null and place is not null and x is not null and y is not null")
    ring = W.partitionBy("s").orderBy("place")
    return rows.select("s", (F.row_number().over(ring) - 1).alias("i"), F.count(F.lit(1)).over(W.partitionBy("s")).alias("n"), "x", "y")


def _cyclic(name: str, step: int, ring, whole) -> Column:
    return F.coalesce(F.lead(name).over(ring), F.first(name).over(whole)) if step > 0 else F.coalesce(F.lag(name).over(ring), F.last(name).over(whole))


def curve_runs(points: DataFrame, shape: str, short: float, gentle: float, least: int = 3) -> DataFrame:
    """``s, r, n, x, y, to_x, to_y, run``: the edges of closed outlines, numbered from the first that starts a run; ``run`` is null for straight ones.

    An edge is part of a curve if it is at most ``short`` and bends into a neighbour by at most ``gentle`` degrees. A run goes
    on until a straight edge or a sharper bend; runs of less than ``least`` edges are straight. An outline that is a curve all
    round is cut in two.
    """
    ring, whole = W.partitionBy("s").orderBy("i"), W.partitionBy("s").orderBy("i").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    v = _vertices(points, shape)
    v = v.withColumn("to_x", _cyclic("x", 1, ring, whole)).withColumn("to_y", _cyclic("y", 1, ring, whole))
    dx, dy = F.col("to_x") - F.col("x"), F.col("to_y") - F.col("y")
    v = v.withColumn("long", F.hypot(dx, dy)).withColumn("way", F.degrees(F.atan2(dy, dx)))
    v = v.withColumn("bend", F.abs(F.pmod(F.col("way") - _cyclic("way", -1, ring, whole) + 180, F.lit(360.0)) - 180))
    after = _cyclic("bend", 1, ring, whole)
    curve = (F.col("long") <= short) & ((F.col("bend") <= gentle) | (after <= gentle)) & (F.col("bend") + after <= 2 * gentle + 90) & (F.col("n") > 3)
    v = v.withColumn("curve", curve)
    v = v.withColumn("starts", ~F.col("curve") | ~_cyclic("curve", -1, ring, whole) | (F.col("bend") > gentle))
    first = F.min(F.when(F.col("starts"), F.col("i"))).over(W.partitionBy("s"))
    v = v.withColumn("starts", F.when(first.isNull(), (F.col("i") == 0) | (F.col("i") == F.floor(F.col("n") / 2))).otherwise(F.col("starts")))
    v = v.withColumn("r", F.pmod(F.col("i") - F.coalesce(first, F.lit(0)), F.col("n")))
    v = v.withColumn("run", F.max(F.when(F.col("starts"), F.col("r"))).over(W.partitionBy("s").orderBy("r")))
    enough = F.count(F.lit(1)).over(W.partitionBy("s", "run")) >= least
    return v.select("s", "r", "n", "x", "y", "to_x", "to_y", F.when(F.col("curve") & enough, F.col("run")).alias("run"))


def _circles(edges: DataFrame, widest: float, least_radius: float) -> DataFrame:
    """``s, run, edges, cx, cy, radius, bulge``: the circle of least squares through the points of each run, null without one."""
    own = W.partitionBy("s", "run")
    rows = edges.withColumn("ox", F.avg("x").over(own)).withColumn("oy", F.avg("y").over(own))
    last = F.max(F.struct("r", "to_x", "to_y"))
    u, v = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    z = u * u + v * v
    powers = {"u": u, "v": v, "uu": u * u, "uv": u * v, "vv": v * v, "z": z, "uz": u * z, "vz": v * z}
    sums = rows.groupBy("s", "run").agg(F.count(F.lit(1)).alias("edges"), last.alias("e"), F.min(F.struct("r", "x", "y")).alias("a"), F.first("ox").alias("ox"), F.first("oy").alias("oy"), *[F.sum(p).alias(n) for n, p in powers.items()])
    # the end of the last edge is a point of the run too
    eu, ev = F.col("e.to_x") - F.col("ox"), F.col("e.to_y") - F.col("oy")
    ez = eu * eu + ev * ev
    more = {"u": eu, "v": ev, "uu": eu * eu, "uv": eu * ev, "vv": ev * ev, "z": ez, "uz": eu * ez, "vz": ev * ez}
    sums = sums.withColumns({n: F.col(n) + p for n, p in more.items()}).withColumn("m", F.col("edges") + 1.0)
    # centred moments: the normal equations of u² + v² = 2 a u + 2 b v + c without c
    c = {n: F.col(n) - F.col(n[0]) * F.col(n[1]) / F.col("m") for n in ("uu", "uv", "vv", "uz", "vz")}
    sums = sums.select("s", "run", "edges", "ox", "oy", "a", "e", "u", "v", "z", "m", *[k.alias("c" + n) for n, k in c.items()])
    det = F.col("cuu") * F.col("cvv") - F.col("cuv") * F.col("cuv")
    a, b = (F.col("cuz") * F.col("cvv") - F.col("cvz") * F.col("cuv")) / (2 * det), (F.col("cvz") * F.col("cuu") - F.col("cuz") * F.col("cuv")) / (2 * det)
    sums = sums.withColumn("fu", F.when(det > 0, a)).withColumn("fv", F.when(det > 0, b))
    square = (F.col("z") - 2 * F.col("fu") * F.col("u") - 2 * F.col("fv") * F.col("v")) / F.col("m") + F.col("fu") * F.col("fu") + F.col("fv") * F.col("fv")
    sums = sums.withColumn("radius", F.sqrt(square)).withColumn("cx", F.col("ox") + F.col("fu")).withColumn("cy", F.col("oy") + F.col("fv"))
    dx, dy = F.col("e.to_x") - F.col("a.x"), F.col("e.to_y") - F.col("a.y")
    chord = F.hypot(dx, dy)
    sweep = 2 * F.asin(F.least(chord / (2 * F.col("radius")), F.lit(1.0)))
    # the run's points lie on the side of the chord away from the circle's middle, as it sweeps less than half a turn
    side = F.signum((F.col("cx") - F.col("a.x")) * dy - (F.col("cy") - F.col("a.y")) * dx)
    fits = (F.col("radius") >= F.greatest(chord / 2 * (1 - 1e-9), F.lit(least_radius))) & (sweep <= math.radians(widest)) & (chord > 0)
    return sums.select("s", "run", "edges", "cx", "cy", "radius", F.when(fits, side * F.tan(sweep / 4)).alias("bulge"))


def arcs(points: DataFrame, shape: str, off: float, short: float, gentle: float = 40.0, loose: float | None = None, widest: float = 100.0, least_radius: float = 0.0, least: int = 3) -> DataFrame:
    """``shape, place, x, y, bulge``: closed outlines with each run of gently turning edges as arcs, places numbered anew.

    A run becomes one arc if every point of it lies within ``off`` of its circle (a whole run: within ``loose``), the arc turns by
    at most ``widest`` degrees and its radius is at least ``least_radius``; else it is halved and each half is tried, down to
    single edges.
    """
    edges = keep(curve_runs(points, shape, short, gentle, least), "outline-edges")
    rest, taken, bound = edges.where("run is not null").select("s", "r", "x", "y", "to_x", "to_y", "run"), [], max(off, loose or off)
    dropped = []
    while True:
        rest = keep(rest, "arc-runs")
        if rest.limit(1).count() == 0:
            break
        circles = _circles(rest, widest, least_radius)

        def away(x: str, y: str) -> Column:
            return F.abs(F.hypot(F.col(x) - F.col("cx"), F.col(y) - F.col("cy")) - F.col("radius"))

        judged = rest.join(circles, ["s", "run"])
        far = F.max(F.greatest(away("x", "y"), away("to_x", "to_y"))).over(W.partitionBy("s", "run"))
        judged = keep(judged.select("s", "r", "x", "y", "to_x", "to_y", "run", "edges", F.when(far <= bound, F.col("bulge")).alias("bulge")), "arc-fits")
        taken.append(judged.where("bulge is not null and r = run").select("s", "r", "bulge"))
        dropped.append(judged.where("bulge is not null and r > run").select("s", "r"))
        middle = F.col("run") + F.floor(F.col("edges") / 2)
        rest = judged.where("bulge is null and edges > 2").select("s", "r", "x", "y", "to_x", "to_y", F.when(F.col("r") < middle, F.col("run")).otherwise(middle).cast("int").alias("run"))
        bound = off
    out = edges.select("s", "r", "x", "y").withColumn("bulge", F.lit(None).cast("double"))
    if taken:
        marks, gone = taken[0], dropped[0]
        for t, d in zip(taken[1:], dropped[1:], strict=True):
            marks, gone = marks.unionByName(t), gone.unionByName(d)
        out = out.drop("bulge").join(gone, ["s", "r"], "left_anti").join(marks, ["s", "r"], "left")
    return out.select(F.col("s").alias(shape), (F.row_number().over(W.partitionBy("s").orderBy("r")) - 1).alias("place"), "x", "y", "bulge")


def straight_pieces(points: DataFrame, shape: str, pieces: int) -> DataFrame:
    """``shape, error, places``: the line of each shape as ``pieces`` chords between vertices of it, with the least squared distances.

    A chord costs the squared distances of the vertices it skips, from running sums of x, y, xx, xy and yy. Round by round the best
    line of one chord more to each vertex comes from the best ones before; of equal ones the vertices first in order win.
    Coordinates should be whole numbers, for exact sums; a shape with fewer edges than ``pieces`` keeps all its vertices. A
    shape of n vertices takes n² / 2 rows.
    """
    v = _vertices(points, shape)
    upto = W.partitionBy("s").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    x, y = F.col("x"), F.col("y")
    v = keep(v.select("s", "i", "n", "x", "y", *[F.sum(p).over(upto).alias(n) for n, p in (("sx", x), ("sy", y), ("sxx", x * x), ("sxy", x * y), ("syy", y * y))]), "line-sums")
    to = v.select("s", *[F.col(c).alias("q" + c) for c in v.columns if c != "s"])
    dx, dy = F.col("qx") - x, F.col("qy") - y
    m = F.col("qi") - F.col("i")  # vertices after the first one, the last included
    sums = {n: F.col("q" + n) - F.col(n) for n in ("sx", "sy", "sxx", "sxy", "syy")}
    xx = sums["sxx"] - 2 * x * sums["sx"] + m * x * x
    xy = sums["sxy"] - x * sums["sy"] - y * sums["sx"] + m * x * y
    yy = sums["syy"] - 2 * y * sums["sy"] + m * y * y
    length = dx * dx + dy * dy
    cost = F.when(length > 0, (dx * dx * yy - 2 * dx * dy * xy + dy * dy * xx) / length).otherwise(xx + yy)
    chords = keep(v.join(to, "s").where("qi > i").select("s", "i", F.col("qi").alias("j"), cost.alias("cost")), "chords")
    best = v.where("i = 0").select("s", F.lit(0).alias("i"), F.struct(F.lit(0.0).alias("error"), F.array(F.lit(0)).alias("places")).alias("b"))
    ends = v.groupBy("s").agg(F.max("i").alias("last"))
    for k in range(pieces):
        line = F.struct((F.col("b.error") + F.col("cost")).alias("error"), F.concat("b.places", F.array("j")).alias("places"))
        longer = best.join(chords, ["s", "i"]).groupBy("s", F.col("j").alias("i")).agg(F.min(line).alias("b"))
        done = best.join(ends, "s").where(F.col("i") == F.col("last")).where(F.col("last") <= k).select("s", "i", "b")  # no edge is left for another chord
        best = keep(longer.join(done.select("s", "i"), ["s", "i"], "left_anti").unionByName(done) if k else longer, "lines")
    single = v.where("n = 1").select("s", "i", F.struct(F.lit(0.0).alias("error"), F.array(F.lit(0)).alias("places")).alias("b"))
    found = best.join(ends, "s").where("i = last").select("s", "b").unionByName(single.select("s", "b"))
    return found.select(F.col("s").alias(shape), "b.error", "b.places")


def simplified(points: DataFrame, shape: str, off: float) -> DataFrame:
    """``shape, place, x, y`` of the vertices that stay, so that every dropped one lies within ``off`` of the line that skips it.

    A stretch is split at its vertex farthest from the chord (the first of equals) as long as that is farther than ``off``. The
    number of rounds is the depth of splits.
    """
    v = apart(keep(_vertices(points, shape), "line-vertices"))
    ends = v.where("i = 0 or i = n - 1").select("s", "i")
    stay = [ends]
    rest = v.where("i < n - 1 or n = 1").select("s", "i", "x", "y", F.lit(0).alias("lo"), (F.col("n") - 1).cast("int").alias("hi"))
    corner = v.select(F.col("s").alias("cs"), F.col("i").alias("ci"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    while True:
        a, b = corner.select(*[F.col(c).alias("a" + c) for c in corner.columns]), corner.select(*[F.col(c).alias("b" + c) for c in corner.columns])
        rows = rest.where("i > lo and i < hi").join(a, (F.col("s") == F.col("acs")) & (F.col("lo") == F.col("aci"))).join(b, (F.col("s") == F.col("bcs")) & (F.col("hi") == F.col("bci")))
        dx, dy = F.col("bcx") - F.col("acx"), F.col("bcy") - F.col("acy")
        length = F.hypot(dx, dy)
        far = F.when(length > 0, F.abs(dx * (F.col("y") - F.col("acy")) - dy * (F.col("x") - F.col("acx"))) / length).otherwise(F.hypot(F.col("x") - F.col("acx"), F.col("y") - F.col("acy")))
        worst = rows.select("s", "lo", "hi", "i", far.alias("far")).groupBy("s", "lo", "hi").agg(F.max(F.struct("far", (-F.col("i")).alias("i"))).alias("w"))
        split = apart(keep(worst.where(F.col("w.far") > off).select("s", "lo", "hi", (-F.col("w.i")).cast("int").alias("at")), "splits"))
        if split.limit(1).count() == 0:
            break
        stay.append(split.select("s", F.col("at").alias("i")))
        new = rest.join(split, ["s", "lo", "hi"]).where("i <> at")
        left = F.col("i") < F.col("at")
        rest = keep(new.select("s", "i", "x", "y", F.when(left, F.col("lo")).otherwise(F.col("at")).alias("lo"), F.when(left, F.col("at")).otherwise(F.col("hi")).alias("hi")), "stretches")
    kept = stay[0]
    for more in stay[1:]:
        kept = kept.unionByName(more)
    return v.join(kept.distinct(), ["s", "i"]).select(F.col("s").alias(shape), F.col("i").alias("place"), "x", "y")


def without_facets(points: DataFrame, shape: str, flat: float = 6.0, curve: float = 12.0, least: int = 3, still: float = 0.3) -> DataFrame:
    """``shape, place, x, y`` of the vertices of closed outlines that stay when facets of one flat wall are merged.

    A vertex that turns by less than ``flat`` degrees goes, unless it is of a curve: ``least`` or more vertices in a row that
    turn the same way, each by more than ``still`` and less than ``curve``. Turns are those of the outline as given. Outlines
    of less than five vertices, and those of which less than three would stay, keep all. Places count from 0.
    """
    ring, whole = W.partitionBy("s").orderBy("i"), W.partitionBy("s").orderBy("i").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    v = _vertices(points, shape)
    ax, ay = F.col("x") - _cyclic("x", -1, ring, whole), F.col("y") - _cyclic("y", -1, ring, whole)
    bx, by = _cyclic("x", 1, ring, whole) - F.col("x"), _cyclic("y", 1, ring, whole) - F.col("y")
    v = v.select("s", "i", "n", "x", "y", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"))
    sharp = F.degrees(F.atan2(F.col("ax") * F.col("by") - F.col("ay") * F.col("bx"), F.col("ax") * F.col("bx") + F.col("ay") * F.col("by")))
    stands = (F.hypot("ax", "ay") < 1e-9) | (F.hypot("bx", "by") < 1e-9)
    v = v.withColumn("turn", F.when(stands, 0.0).otherwise(sharp))
    # 1 and -1 for gentle turns to either side; a run goes on as long as that stays the same
    v = v.withColumn("side", F.when((F.abs("turn") > still) & (F.abs("turn") < curve), F.signum("turn")).otherwise(0.0))
    v = v.withColumn("starts", (F.col("side") == 0) | (F.col("side") != _cyclic("side", -1, ring, whole)))
    first = F.coalesce(F.min(F.when(F.col("starts"), F.col("i"))).over(W.partitionBy("s")), F.lit(0))
    v = v.withColumn("r", F.pmod(F.col("i") - first, F.col("n")))
    v = v.withColumn("run", F.max(F.when(F.col("starts") | (F.col("r") == 0), F.col("r"))).over(W.partitionBy("s").orderBy("r")))
    bent = (F.col("side") != 0) & (F.count(F.lit(1)).over(W.partitionBy("s", "run")) >= least)
    v = v.withColumn("stays", bent | (F.abs("turn") >= flat))
    v = v.withColumn("few", (F.col("n") < 5) | (F.count_if("stays").over(W.partitionBy("s")) < 3))
    return v.where("few or stays").select(F.col("s").alias(shape), F.col("i").alias("place"), "x", "y")
