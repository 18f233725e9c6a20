"""Nearest-neighbour, containment and coverage joins.

Joins by place run on grid cells: both sides are dealt to the integer cells that they touch, so the join is an equi-join,
and the exact predicate follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmap.functions import geometry as G
from quillmap.plans.storage import BROADCAST_ROWS, small

#: Parts of a group in a nearest-neighbour search whose query set is too large to broadcast.
SALTS = 32


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def cells_of_box(box: Column, size: float) -> Column:
    """The cells that a box touches, as an array of structs."""
    xs = F.sequence(_cell(box.x, size), _cell(box.x + box.width, size))
    ys = F.sequence(_cell(box.y, size), _cell(box.y + box.height, size))
    return F.flatten(F.transform(xs, lambda i: F.transform(ys, lambda j: F.struct(i.alias("i"), j.alias("j")))))


def fine(rows: DataFrame, area: float, size: float) -> float:
    """``size`` halved until ``area`` has as many cells of it as ``rows`` has rows (a kept table, counted), so that a cell holds a few."""
    n = rows.count()
    while size * size * n > 2 * area > 0:
        size /= 2
    return size


def points_in_polygons(points: DataFrame, polygons: DataFrame, size: float, point_id: str, polygon_id: str, order: str) -> DataFrame:
    """``points`` (``x, y``) with the first polygon, by ``order``, that holds each; null where none does.

    ``polygons`` has ``poly``, straight. Points are dealt to one cell each, so a crowded polygon spreads over its cells.
    """
    cut = polygons.select(polygon_id, order, "poly", F.explode(cells_of_box(G.bbox(F.col("poly")), size)).alias("c"))
    cut = cut.select(polygon_id, F.col(order).alias("__order"), "poly", F.col("c.i").alias("__i"), F.col("c.j").alias("__j"))
    near = points.withColumn("__i", _cell(F.col("x"), size)).withColumn("__j", _cell(F.col("y"), size))
    # Not broadcast, whatever the bytes of the file: points in one file would all be sorted by id in one task.
    hits = near.join(cut.hint("merge"), ["__i", "__j"]).where(G.contains(F.col("poly"), F.col("x"), F.col("y")))
    best = hits.groupBy(point_id).agg(F.min_by(polygon_id, F.struct("__order", polygon_id)).alias(polygon_id))
    return points.join(best, point_id, "left")


def nearest_in_group(points: DataFrame, others: DataFrame, group: str, score: Column, keep: Column | None = None, point_id: str = "id", other_id: str = "other_id", order: str = "other_id", most: int = BROADCAST_ROWS) -> DataFrame:
    """For each point, the other of its group with the least ``score`` (first of equals) among those where ``keep`` holds.

    ``points`` is a stated query set; each of its points meets all others of its group. A counted small set is broadcast, so
    that ``others`` stays where it is; beyond that, a group is dealt over ``SALTS`` tasks and the least of each is taken.
    """
    asked = small(points, most)
    if asked is points:
        asked = points.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        others = others.withColumn("__salt", F.pmod(F.xxhash64(other_id), F.lit(SALTS)))
        pairs = asked.join(others, [group, "__salt"])
    else:
        pairs = others.join(asked, group)
    if keep is not None:
        pairs = pairs.where(keep)
    best = pairs.groupBy(point_id).agg(F.min(F.struct(score.alias("score"), F.col(order).alias("o"), F.col(other_id).alias("v"))).alias("m"))
    return points.join(best, point_id, "left").select(points["*"], F.col("m.v").alias(other_id), F.col("m.score").alias("score"))


#: Unit vectors of the four directions; y grows downward.
DIRECTIONS = {"up": (0, -1), "down": (0, 1), "left": (-1, 0), "right": (1, 0)}


def ahead(direction: str, from_x: Column, from_y: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """How far a point lies ahead along the direction, and to its side."""
    ux, uy = DIRECTIONS[direction]
    return (x - from_x) * ux + (y - from_y) * uy, (x - from_x) * uy - (y - from_y) * ux


def direction_score(direction: str, from_x: Column, from_y: Column, from_box: Column | None, x: Column, y: Column, box: Column) -> tuple[Column, Column]:
    """Score of a candidate in a direction, and whether it lies ahead at all."""
    forward, lateral = ahead(direction, from_x, from_y, x, y)
    gap = forward
    if from_box is not None:
        gap = {"right": box.x - (from_box.x + from_box.width), "left": from_box.x - (box.x + box.width), "down": box.y - (from_box.y + from_box.height), "up": from_box.y - (box.y + box.height)}[direction]
    across = DIRECTIONS[direction][0] != 0
    at, low, width = (from_y, box.y, box.height) if across else (from_x, box.x, box.width)
    sideways = F.greatest(low - at, at - (low + width), F.lit(0.0))
    return F.greatest(gap, F.lit(0.0)) + 2 * sideways + 0.05 * F.abs(lateral), forward > 0


def nearest_colour(items: DataFrame, legend: DataFrame, item_id: str, sheet: str, own_limit: float, any_limit: float) -> DataFrame:
    """``items`` (``r, g, b``) with the nearest legend name of their sheet within a limit, else of any sheet within another.

    Colours are dealt to cells as wide as the limit, and each legend entry to the cells around its own, so both lookups are
    equi-joins, whatever the legend's size; first of equals by ``ord``. Colours with a null match nothing.
    """
    k = legend.select(F.col(sheet).alias("__sheet"), F.col("name").alias("__name"), F.col("ord").alias("__ord"), *[F.col(c).alias(f"__{c}") for c in "rgb"])
    d = F.sqrt(sum(((F.col(c) - F.col(f"__{c}")) * (F.col(c) - F.col(f"__{c}")) for c in "rgb"), F.lit(0.0)))

    def nearest(limit: float, into: str, same_sheet: bool) -> DataFrame:
        asked = items.select(item_id, sheet, "r", "g", "b", *[_cell(F.col(c), limit).alias(f"__at{c}") for c in "rgb"])
        around = k
        for c in "rgb":
            around = around.withColumn(f"__at{c}", F.explode(F.sequence(_cell(F.col(f"__{c}"), limit) - 1, _cell(F.col(f"__{c}"), limit) + 1)))
        pairs = asked.join(around, [f"__at{c}" for c in "rgb"])
        pairs = pairs.where(F.col(sheet) == F.col("__sheet")) if same_sheet else pairs
        pairs = pairs.withColumn("__d", d).where(F.col("__d") <= limit)
        return pairs.groupBy(item_id).agg(F.min(F.struct("__d", "__ord", "__name")).alias(into))

    found = items.join(nearest(own_limit, "own", True), item_id, "left").join(nearest(any_limit, "other", False), item_id, "left")
    return found.select(items["*"], F.coalesce("own.__name", "other.__name").alias("name"))


#: Grid points on a side of the cells by which coverage joins points and fills.
COARSE = 8


def coverage(rooms: DataFrame, fills: DataFrame, group: str, step: float, room_id: str = "room_id") -> DataFrame:
    """``room_id, name, fraction``: the share of a room's grid points that lie in any fill of that name.

    Both have ``poly`` (straight); fills have ``name``. Points meet the fills that touch their coarse cell. Grid points lie in the middle of cells ``step`` wide.
    """
    box = G.bbox(F.col("poly"))

    def steps(low: Column, width: Column) -> Column:
        return F.sequence(F.floor(low / step).cast("long"), F.floor((low + width) / step).cast("long"))

    grid = rooms.select(room_id, group, "poly", F.explode(steps(box.x, box.width)).alias("i"), steps(box.y, box.height).alias("js"))
    grid = grid.select(room_id, group, "poly", "i", F.explode("js").alias("j")).select(room_id, group, "poly", ((F.col("i") + 0.5) * step).alias("x"), ((F.col("j") + 0.5) * step).alias("y"))
    grid = grid.where(G.contains(F.col("poly"), F.col("x"), F.col("y"))).drop("poly")
    sizes = grid.groupBy(room_id).agg(F.count(F.lit(1)).alias("cells"))
    coarse = step * COARSE
    f = fills.select(group, "name", "poly", G.bbox(F.col("poly")).alias("b")).withColumn("c", F.explode(cells_of_box(F.col("b"), coarse)))
    f = f.withColumns({"__i": F.col("c.i"), "__j": F.col("c.j")}).drop("c")
    placed = grid.withColumns({"__i": _cell(F.col("x"), coarse), "__j": _cell(F.col("y"), coarse)})
    inside = (F.col("x") >= F.col("b.x")) & (F.col("x") <= F.col("b.x") + F.col("b.width")) & (F.col("y") >= F.col("b.y")) & (F.col("y") <= F.col("b.y") + F.col("b.height"))
    hits = placed.join(f, [group, "__i", "__j"]).where(inside & G.contains(F.col("poly"), F.col("x"), F.col("y"))).select(room_id, "name", "x", "y").distinct()
    return hits.groupBy(room_id, "name").agg(F.count(F.lit(1)).alias("hit")).join(sizes, room_id).select(room_id, "name", (F.col("hit") / F.col("cells")).alias("fraction"))


def best_cover(covers: DataFrame, room_id: str = "room_id", least: float = 0.5, review: float = 0.2) -> DataFrame:
    """Each room's name of largest coverage, the second where it reaches ``review``, and whether the first is assigned."""
    place = F.row_number().over(W.partitionBy(room_id).orderBy(F.desc("fraction"), "name"))
    best = covers.where(F.col("name").isNotNull()).withColumn("__place", place).where("__place <= 2")  # Spark limits groups before it deals them
    one, two = (F.max(F.when(F.col("__place") == k, F.struct("fraction", "name"))).alias(n) for k, n in ((1, "__one"), (2, "__two")))
    ranked = best.groupBy(room_id).agg(one, two)
    return ranked.select(room_id, "__one.name", "__one.fraction", F.when(F.col("__two.fraction") >= review, F.col("__two.name")).alias("second"), (F.col("__one.fraction") >= least).alias("assigned"))


def ordered_first(zones: DataFrame, points: DataFrame, size: float, point_id: str, zone_id: str, order: str, kind: str, otherwise: str) -> DataFrame:
    """``points`` with ``side``: the kind of the first zone, by ``order``, that holds each, or ``otherwise``."""
    found = points_in_polygons(points, zones, size, point_id, zone_id, order)
    kinds = zones.select(F.col(zone_id).alias("__zone"), F.col(kind).alias("__kind"))
    return found.join(kinds, F.col(zone_id) == F.col("__zone"), "left").withColumn("side", F.coalesce("__kind", F.lit(otherwise))).drop("__zone", "__kind")


def moved_focus(asked: DataFrame, others: DataFrame, group: str, direction: str, has_current: Column, point_id: str, other_id: str, from_box: Column, box: Column) -> DataFrame:
    """For each asked row the next other one: in the direction from a current row, else the nearest to the view's centre.

    Both have ``x, y`` (``ox, oy`` on the other side); null where nothing lies ahead.
    """
    score, ahead_of = direction_score(direction, F.col("x"), F.col("y"), from_box, F.col("ox"), F.col("oy"), box)
    step = nearest_in_group(asked.where(has_current), others, group, score, ahead_of & (F.col(point_id) != F.col(other_id)), point_id, other_id)
    away = F.sqrt((F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy")))
    start = nearest_in_group(asked.where(~has_current), others, group, away, None, point_id, other_id)
    return step.unionByName(start)
