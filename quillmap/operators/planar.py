"""Line work in the plane: splitting lines where they meet, the faces between them, and the outlines of cell regions.

Vertices are whole numbers of ``snap``, so that ends that meet are equal. Faces and outlines are cycles of directed edges:
each edge names the next by the turn at its end, and pointer doubling labels and orders the cycles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmap.operators import overlay
from quillmap.operators.spatial import cells_of_box
from quillmap.plans.cycles import cycles
from quillmap.plans.storage import keep

_ENDS = ("ax", "ay", "bx", "by")


def split_lines(lines: DataFrame, size: float, snap: float = 1e-3) -> DataFrame:
    """``ax, ay, bx, by`` in whole numbers of ``snap``: the pieces of straight lines between all places where they meet.

    Lines (columns ``ax, ay, bx, by``) are dealt to the grid cells of ``size`` that their boxes touch and meet there, so a
    long line is compared with its neighbours only. Where lines lie on each other, the shared piece comes once. Lines with a
    null or without length are left out; an empty table gives an empty result.
    """
    rows = lines.select(*[F.round(F.col(c) / snap).cast("long").alias(c) for c in _ENDS]).where(" and ".join(f"{c} is not null" for c in _ENDS)).where("ax <> bx or ay <> by").distinct()
    rows = keep(rows.withColumn("n", F.monotonically_increasing_id()), "lines")
    low = [F.least("ax", "bx"), F.least("ay", "by")]
    box = F.struct(low[0].alias("x"), low[1].alias("y"), (F.greatest("ax", "bx") - low[0]).alias("width"), (F.greatest("ay", "by") - low[1]).alias("height"))
    dealt = keep(rows.select("n", *_ENDS, F.explode(cells_of_box(box, size / snap)).alias("cell")), "line-cells")
    other = dealt.select("cell", *[F.col(c).alias(f"o{c}") for c in ("n", *_ENDS)])
    # two lines may share many cells; they meet in the first of them only
    first = [F.floor(F.greatest(F.least(f"a{c}", f"b{c}"), F.least(f"oa{c}", f"ob{c}")) / (size / snap)).cast("long") for c in "xy"]
    near = dealt.join(other, "cell").where((F.col("n") != F.col("on")) & (F.col("cell.i") == first[0]) & (F.col("cell.j") == first[1])).drop("cell")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    ox, oy = F.col("obx") - F.col("oax"), F.col("oby") - F.col("oay")
    turn = (dx * oy - dy * ox).cast("double")
    gx, gy = F.col("oax") - F.col("ax"), F.col("oay") - F.col("ay")
    t, u = (gx * oy - gy * ox) / turn, (gx * dy - gy * dx) / turn
    meets = F.when((turn != 0) & t.between(0.0, 1.0) & u.between(0.0, 1.0), t)
    # ends of the other line on this one
    along = [F.when(((px * dy - py * dx) == 0), (px * dx + py * dy) / (dx * dx + dy * dy).cast("double")) for px, py in ((gx, gy), (F.col("obx") - F.col("ax"), F.col("oby") - F.col("ay")))]
    places = near.select("n", *_ENDS, F.explode(F.array(meets, *along)).alias("t")).where("t > 0 and t < 1")
    places = places.unionByName(rows.select("n", *_ENDS, F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t")))
    at = places.select("n", F.round(F.col("ax") + F.col("t") * dx).cast("long").alias("x"), F.round(F.col("ay") + F.col("t") * dy).cast("long").alias("y"), "t")
    at = at.repartition("n").groupBy("n", "x", "y").agg(F.min("t").alias("t"))
    order = W.partitionBy("n").orderBy("t", "x", "y")
    pieces = at.select(F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(order).alias("bx"), F.lead("y").over(order).alias("by")).where("bx is not null")
    swap = F.struct("bx", "by") < F.struct("ax", "ay")
    return pieces.select(*[F.when(swap, F.col(o)).otherwise(F.col(c)).alias(c) for c, o in zip(_ENDS, ("bx", "by", "ax", "ay"), strict=True)]).distinct()


def face_edges(pieces: DataFrame) -> DataFrame:
    """``face, place, x, y, to_x, to_y``: directed edges of all faces in order; the side that a face lies on is the left one with y up.

    ``pieces`` meet at their ends only, as ``split_lines`` leaves them. At the end of an edge a face goes on along the next edge clockwise
    from the one it came by; an outer face, around a group of lines, comes out with negative area. Blind ends are walked
    round. A vertex's edges are sorted in one task: their number is that of lines that meet in a point.
    """
    return _linked_edges(pieces).drop("id")


def _linked_edges(pieces: DataFrame) -> DataFrame:
    """``face_edges`` with their ``id``: a piece has an even one and, for the way back, the odd one after it."""
    both = keep(pieces.select(*_ENDS, F.monotonically_increasing_id().alias("p")), "pieces")
    ahead = both.select((F.col("p") * 2).alias("id"), (F.col("p") * 2 + 1).alias("twin"), F.col("ax").alias("x"), F.col("ay").alias("y"), F.col("bx").alias("to_x"), F.col("by").alias("to_y"))
    back = both.select((F.col("p") * 2 + 1).alias("id"), (F.col("p") * 2).alias("twin"), F.col("bx").alias("x"), F.col("by").alias("y"), F.col("ax").alias("to_x"), F.col("ay").alias("to_y"))
    half = ahead.unionByName(back)
    around = W.partitionBy("x", "y").orderBy(F.atan2((F.col("to_y") - F.col("y")).cast("double"), (F.col("to_x") - F.col("x")).cast("double")), "id")
    last = F.last("id").over(around.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    links = half.select(F.col("twin").alias("node"), F.coalesce(F.lag("id").over(around), last).alias("after"))
    return half.join(cycles(links), F.col("id") == F.col("node")).select("id", F.col("ring").alias("face"), "place", "x", "y", "to_x", "to_y")


def faces(edges: DataFrame, snap: float = 1e-3) -> DataFrame:
    """``face, area, edges, x, y, width, height`` of the inner faces of ``face_edges``, in the lines' own measure."""
    area = F.sum((F.col("x").cast("double") * F.col("to_y") - F.col("to_x").cast("double") * F.col("y"))) / 2
    found = edges.groupBy("face").agg((area * snap * snap).alias("area"), F.count(F.lit(1)).alias("edges"), *[(F.min(c) * snap).alias(c) for c in "xy"], ((F.max("x") - F.min("x")) * snap).alias("width"), ((F.max("y") - F.min("y")) * snap).alias("height"))
    return found.where("area > 0")


def contours(cells: DataFrame, group: str, x: str = "x", y: str = "y") -> DataFrame:
    """``group, ring, place, x, y, to_x, to_y``: the sides of cell regions towards other cells, as directed edges in order of each ring.

    Cells of one group that share a side are one region; its cells lie to the left with y up, so outlines have positive
    and holes negative area. Regions that touch at a corner only have rings of their own. Repeated cells count once; cells
    with a null are left out; an empty table gives an empty result.
    """
    own = keep(cells.select(F.col(group).alias("g"), F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y")).where("g is not null and x is not null and y is not null").distinct(), "cells")
    # direction, the neighbour across, start and end of a side of the cell at 0, 0
    sides = ((0, (0, -1), (0, 0), (1, 0)), (1, (1, 0), (1, 0), (1, 1)), (2, (0, 1), (1, 1), (0, 1)), (3, (-1, 0), (0, 1), (0, 0)))

    def moved(v: tuple[int, int], a: str, b: str) -> list[Column]:
        return [(F.col("x") + v[0]).alias(a), (F.col("y") + v[1]).alias(b)]

    side = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), *moved(over, "ox", "oy"), *moved(a, "ax", "ay"), *moved(b, "bx", "by")) for d, over, a, b in sides]))
    edge = own.select("g", side.alias("s")).select("g", "s.*")
    rim = edge.join(own.select(F.col("g").alias("og"), F.col("x").alias("__x"), F.col("y").alias("__y")), (F.col("g") == F.col("og")) & (F.col("ox") == F.col("__x")) & (F.col("oy") == F.col("__y")), "left_anti")
    rim = keep(rim.select("g", "d", *_ENDS).withColumn("id", F.monotonically_increasing_id()), "rims")
    ahead = rim.select(F.col("g").alias("ng"), F.col("d").alias("nd"), F.col("ax").alias("nx"), F.col("ay").alias("ny"), F.col("id").alias("nid"))
    met = rim.join(ahead, (F.col("g") == F.col("ng")) & (F.col("bx") == F.col("nx")) & (F.col("by") == F.col("ny")))
    turn = F.pmod(F.col("nd") - F.col("d") + 2, F.lit(4))  # 3 left, 2 ahead, 1 right: a left turn stays with the own cell
    links = met.groupBy(F.col("id").alias("node")).agg(F.max_by("nid", turn).alias("after"))
    found = cycles(links)
    return rim.join(found, F.col("id") == F.col("node")).select(F.col("g").alias(group), "ring", "place", F.col("ax").alias("x"), F.col("ay").alias("y"), F.col("bx").alias("to_x"), F.col("by").alias("to_y"))


def corners(rim: DataFrame, group: str) -> DataFrame:
    """The edges of ``contours`` merged into straight ones, numbered anew: ``group, ring, place, x, y``, one row for each corner."""
    ring = W.partitionBy(group, "ring").orderBy("place")
    whole = ring.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    way = F.struct((F.col("to_x") - F.col("x")).alias("dx"), (F.col("to_y") - F.col("y")).alias("dy"))
    rows = rim.withColumn("way", way)
    rows = rows.withColumn("before", F.coalesce(F.lag("way").over(ring), F.last("way").over(whole)))
    level = F.col("before.dx") * F.col("way.dy") == F.col("before.dy") * F.col("way.dx")
    ahead = F.col("before.dx") * F.col("way.dx") + F.col("before.dy") * F.col("way.dy") > 0
    return rows.where(~(level & ahead)).select(group, "ring", (F.row_number().over(ring) - 1).alias("place"), "x", "y")


def _owners(edges: DataFrame, sides: DataFrame, order: DataFrame, size: float, snap: float) -> DataFrame:
    """``face, owner``: the first shape by ``order`` that each face lies in; faces in no shape are left out.

    A point just left of the face's longest side stands for it. It meets the shapes whose span in its strip it falls into, and
    is inside those of which an odd number of edges lies to its left.
    """
    dx, dy = (F.col("to_x") - F.col("x")).cast("double"), (F.col("to_y") - F.col("y")).cast("double")
    long = F.hypot(dx, dy)
    spot = F.struct(long.alias("n"), ((F.col("x") + F.col("to_x")) / 2 - dy / long / 4).alias("px"), ((F.col("y") + F.col("to_y")) / 2 + dx / long / 4).alias("py"))
    spots = sides.groupBy("face").agg(F.max(spot).alias("s")).select("face", (F.col("s.px") * snap).alias("px"), (F.col("s.py") * snap).alias("py"))
    spots = spots.withColumn("strip", F.floor(F.col("py") / size)).withColumn("tile", F.floor(F.col("px") / size))
    strips = keep(overlay.strips(edges, size), "strips")
    spans = strips.groupBy("id", "strip").agg(F.min(F.least("xa", "xb")).alias("x0"), F.max(F.greatest("xa", "xb")).alias("x1"))
    spans = spans.withColumn("tile", F.explode(F.sequence(F.floor(F.col("x0") / size), F.floor(F.col("x1") / size))))
    near = spots.join(spans, ["strip", "tile"]).where("px between x0 and x1").select("face", "id", "strip", "px", "py")
    at = F.col("xa") + (F.col("xb") - F.col("xa")) * (F.col("py") - F.col("ya")) / (F.col("yb") - F.col("ya"))
    left = near.join(strips, ["id", "strip"]).where("ya <= py and py < yb").where(at < F.col("px"))
    inside = left.groupBy("face", "id").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1")
    return inside.join(order, "id").groupBy("face").agg(F.min(F.struct("o", "id")).alias("m")).select("face", F.col("m.id").alias("owner"))


def _owned_rims(shapes: DataFrame, shape_id: str, rings: str, order: str, size: float, snap: float) -> DataFrame:
    """``owner, x, y, to_x, to_y``: the directed edges around what each shape keeps, see ``claimed``."""
    known = shapes.where(F.col(shape_id).isNotNull() & F.col(order).isNotNull())
    edges = keep(overlay.ring_edges(known, shape_id, rings).select("id", "ring", *[(F.round(F.col(c) / snap) * snap).alias(c) for c in _ENDS]), "ring-edges")
    sides = keep(_linked_edges(split_lines(edges, size, snap)).select("id", "face", "x", "y", "to_x", "to_y"), "faces")
    owner = keep(_owners(edges, sides, known.select(F.col(shape_id).alias("id"), F.col(order).alias("o")), size, snap), "owners")
    # both directions of a piece side by side: the even one leads from a to b
    even = F.col("id") % 2 == 0
    owned = sides.join(owner, "face", "left").groupBy(F.shiftright("id", 1).alias("p")).agg(
        *[F.max(F.when(even, F.col(c))).alias(n) for c, n in (("owner", "own"), ("x", "ax"), ("y", "ay"), ("to_x", "bx"), ("to_y", "by"))], F.max(F.when(~even, F.col("owner"))).alias("other")
    ).where("not own <=> other")
    way = [F.struct(F.col(k).alias("owner"), *[F.col(c).alias(n) for c, n in zip(ends, ("x", "y", "to_x", "to_y"), strict=True)]) for k, ends in (("own", _ENDS), ("other", ("bx", "by", "ax", "ay")))]
    return owned.select(F.explode(F.array(*way)).alias("s")).select("s.*").where("owner is not null")


def claimed(shapes: DataFrame, shape_id: str, rings: str, order: str, size: float, snap: float = 1e-3) -> DataFrame:
    """``id, ring, place, x, y, to_x, to_y``: what each shape keeps where all shapes overlap and the first by ``order`` takes each place.

    Outlines run round positive areas, holes round negative ones, in whole numbers of ``snap``. All edges are split where they
    meet, each face between them goes to its first shape, and the edges between faces of different owners are linked to rings
    by the next turn clockwise. Rings are straight and do not cross themselves; shapes with a null id or order take no part;
    equal orders go by id.
    """
    rim = keep(_owned_rims(shapes, shape_id, rings, order, size, snap).withColumn("id", F.monotonically_increasing_id()), "owned-rims")
    ahead = rim.select("owner", F.col("x").alias("to_x"), F.col("y").alias("to_y"), F.col("to_x").alias("nx"), F.col("to_y").alias("ny"), F.col("id").alias("nid"))
    met = rim.join(ahead, ["owner", "to_x", "to_y"])
    back = F.atan2((F.col("y") - F.col("to_y")).cast("double"), (F.col("x") - F.col("to_x")).cast("double"))
    on = F.atan2((F.col("ny") - F.col("to_y")).cast("double"), (F.col("nx") - F.col("to_x")).cast("double"))
    links = met.groupBy(F.col("id").alias("node")).agg(F.min_by("nid", F.pmod(back - on, F.lit(2 * math.pi))).alias("after"))
    found = cycles(links)
    return rim.join(found, F.col("id") == F.col("node")).select(F.col("owner").alias(shape_id), "ring", "place", "x", "y", "to_x", "to_y")


def resolved(shapes: DataFrame, shape_id: str, rings: str, order: str, size: float, snap: float = 1e-3, least: float = 0.5, rounding: float = 1e-3) -> DataFrame:
    """``id, area, kept, cut``: each shape's area, what ``claimed`` leaves of it, and whether it is cut.

    A shape that would lose more than a share of 1 - ``least`` of itself is left whole, overlaps and all: ``cut`` is false then, as
    for shapes that lose no more area than ``rounding``.
    """
    sizes = overlay.ring_areas(overlay.ring_edges(shapes, shape_id, rings)).withColumnRenamed("id", "__id")
    turned = (F.col("x").cast("double") * F.col("to_y") - F.col("to_x").cast("double") * F.col("y")) / 2
    left = _owned_rims(shapes, shape_id, rings, order, size, snap).groupBy(F.col("owner").alias(shape_id)).agg((F.sum(turned) * snap * snap).alias("kept"))
    rows = sizes.join(left, F.col("__id") == F.col(shape_id), "left").select(F.col("__id").alias(shape_id), "area", F.coalesce("kept", F.lit(0.0)).alias("kept"))
    cut = (F.col("area") - F.col("kept") > rounding) & (F.col("kept") >= least * F.col("area"))
    return rows.withColumn("cut", cut)
