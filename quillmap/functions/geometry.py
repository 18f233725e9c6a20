"""Planar geometry on polygons with straight and circular edges, as Column expressions.

A polygon is ``ARRAY<STRUCT<x, y, bulge>>``, closed implicitly. The bulge of a vertex bends the edge that starts there: it is
the tangent of a quarter of the arc's angle, null or 0 for a straight edge. y grows downward. Where a function needs a
polygon to be straight, ``flatten`` comes first.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column, bulge: Column | None = None) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), (F.lit(None) if bulge is None else bulge).cast("double").alias("bulge"))


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _next(poly: Column, i: Column) -> Column:
    return F.get(poly, F.pmod(i + 1, F.size(poly)))


def edges(poly: Column) -> Column:
    """``ARRAY<STRUCT<a, b>>``: every edge with its two ends."""
    return named(poly, lambda v: F.transform(v, lambda p, i: F.struct(p.alias("a"), _next(v, i).alias("b"))))


def arc(a: Column, b: Column) -> Column:
    """Centre, radius, start angle and signed sweep of the edge; null for a straight or degenerate one."""
    dx, dy = b.x - a.x, b.y - a.y
    chord, k = F.hypot(dx, dy), F.coalesce(a.bulge, F.lit(0.0))
    sweep = F.atan(k) * -4
    away = chord * (1 - k * k) / (4 * k)  # from the chord's middle to the centre
    cx, cy = (a.x + b.x) / 2 + dy / chord * away, (a.y + b.y) / 2 - dx / chord * away
    found = F.struct(cx.alias("cx"), cy.alias("cy"), F.hypot(a.x - cx, a.y - cy).alias("r"), F.atan2(a.y - cy, a.x - cx).alias("start"), sweep.alias("sweep"))
    return F.when((k != 0) & (chord >= 1e-9), found)


def flatten(poly: Column, most: float = math.pi / 12) -> Column:
    """The polygon with every arc replaced by points on it, no more than ``most`` radians apart."""

    def along(e: Column) -> Column:
        start = F.array(point(e.a.x, e.a.y))

        def inner(c: Column) -> Column:
            n = F.ceil(F.abs(c.sweep) / most).cast("int")
            return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda k: point(c.cx + c.r * F.cos(c.start + c.sweep * k / n), c.cy + c.r * F.sin(c.start + c.sweep * k / n))))

        bent = F.flatten(F.transform(F.array(arc(e.a, e.b)), lambda c: F.when(c.isNull(), start).otherwise(F.concat(start, F.coalesce(inner(c), F.slice(start, 1, 0))))))
        return bent

    return F.flatten(F.transform(edges(poly), along))


def bbox(poly: Column) -> Column:
    """``STRUCT<x, y, width, height>`` of a straight polygon."""

    def around(v: Column) -> Column:
        x, y = F.array_min(v.xs), F.array_min(v.ys)
        return F.struct(x.alias("x"), y.alias("y"), (F.array_max(v.xs) - x).alias("width"), (F.array_max(v.ys) - y).alias("height"))

    return named(F.struct(F.transform(poly, lambda p: p.x).alias("xs"), F.transform(poly, lambda p: p.y).alias("ys")), around)


def _sum(items: Column) -> Column:
    return F.reduce(items, F.lit(0.0), lambda s, v: s + v)


def doubled_area(poly: Column) -> Column:
    """Twice the signed area."""
    return _sum(F.transform(edges(poly), lambda e: e.a.x * e.b.y - e.b.x * e.a.y))


def area(poly: Column) -> Column:
    return F.abs(doubled_area(poly)) / 2


def centroid(poly: Column) -> Column:
    """``STRUCT<x, y>``; the middle of the box where the area vanishes."""
    twice, box = doubled_area(poly), bbox(poly)

    def side(c: str) -> Column:
        return _sum(F.transform(edges(poly), lambda e: (e.a[c] + e.b[c]) * (e.a.x * e.b.y - e.b.x * e.a.y))) / (3 * twice)

    flat = F.abs(twice) < 1e-9
    return F.struct(F.when(flat, box.x + box.width / 2).otherwise(side("x")).alias("x"), F.when(flat, box.y + box.height / 2).otherwise(side("y")).alias("y"))


def contains(poly: Column, x: Column, y: Column) -> Column:
    """Even-odd rule with half-open edges; arcs count as chords."""
    return _between(_crossings(edges(poly), y), x)


def _crossings(sides: Column, y: Column) -> Column:
    """Where the line at ``y`` meets the edges."""
    return F.transform(F.filter(sides, lambda e: (e.a.y > y) != (e.b.y > y)), lambda e: (e.b.x - e.a.x) * (y - e.a.y) / (e.b.y - e.a.y) + e.a.x)


def _between(crossings: Column, x: Column) -> Column:
    return F.pmod(F.size(F.filter(crossings, lambda v: x < v)), F.lit(2)) == 1


def edge_distance(poly: Column, x: Column, y: Column) -> Column:
    """The distance to the nearest edge."""
    return _away(edges(poly), x, y)


def _away(sides: Column, x: Column, y: Column) -> Column:
    def far(e: Column) -> Column:
        dx, dy = e.b.x - e.a.x, e.b.y - e.a.y
        length = dx * dx + dy * dy
        t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - e.a.x) * dx + (y - e.a.y) * dy) / length))).otherwise(F.lit(0.0))
        return named(t, lambda v: F.hypot(x - e.a.x - v * dx, y - e.a.y - v * dy))

    return F.array_min(F.transform(sides, far))


def label_point(poly: Column, cells: int = 24) -> Column:
    """The centroid if inside, else the grid point farthest from the edge; the first of equals wins."""

    def deepest(sides: Column, box: Column, c: Column) -> Column:
        steps = F.sequence(F.lit(1), F.lit(cells - 1))

        def inside(line: Column) -> Column:
            return F.filter(F.transform(steps, lambda j: F.struct((box.x + box.width * j / cells).alias("x"), line.y.alias("y"))), lambda p: _between(line.xs, p.x))

        def line(y: Column) -> Column:
            return named(F.struct(y.alias("y"), _crossings(sides, y).alias("xs")), inside)

        grid = F.flatten(F.transform(F.transform(steps, lambda i: box.y + box.height * i / cells), line))
        deep = F.transform(grid, lambda p, k: F.struct((-_away(sides, p.x, p.y)).alias("d"), k.alias("k"), p.alias("p")))
        return F.coalesce(F.array_min(deep).p, c)

    # Edges, box and centroid are bound once; inside the loops over the grid they would be worked out for every point.
    known = F.struct(edges(poly).alias("sides"), bbox(poly).alias("box"), centroid(poly).alias("c"))
    return named(known, lambda s: F.when(_between(_crossings(s.sides, s.c.y), s.c.x), s.c).otherwise(deepest(s.sides, s.box, s.c)))


def is_closed_shape(poly: Column) -> Column:
    """Three vertices, or two of which one bends its edge."""
    return (F.size(poly) >= 3) | ((F.size(poly) == 2) & F.exists(poly, lambda p: F.coalesce(p.bulge, F.lit(0.0)) != 0))


def moved(poly: Column, scale: float = 1.0, degrees: float = 0.0, dx: float = 0.0, dy: float = 0.0) -> Column:
    """A similarity: turned, scaled, then shifted."""
    c, s = scale * math.cos(math.radians(degrees)), scale * math.sin(math.radians(degrees))
    return F.transform(poly, lambda p: point(p.x * c - p.y * s + dx, p.x * s + p.y * c + dy, p.bulge))


def moved_back(poly: Column, scale: float = 1.0, degrees: float = 0.0, dx: float = 0.0, dy: float = 0.0) -> Column:
    """The inverse of ``moved``."""
    c, s = math.cos(math.radians(degrees)) / scale, math.sin(math.radians(degrees)) / scale
    return F.transform(poly, lambda p: point((p.x - dx) * c + (p.y - dy) * s, (p.y - dy) * c - (p.x - dx) * s, p.bulge))


def padded(box: Column, by: float) -> Column:
    return F.struct((box.x - by).alias("x"), (box.y - by).alias("y"), (box.width + 2 * by).alias("width"), (box.height + 2 * by).alias("height"))


def _shown(v: Column) -> Column:
    return F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(F.format_string("%.2f", v))


def svg_path(poly: Column, closed: bool = True) -> Column:
    """Path text with arcs; whole numbers without decimals, others with two. No vertices give an empty text.

    A closing straight edge is left to the ``Z``; an arc that ends where it starts shows nothing and is left out.
    """

    def place(mark: str, p: Column) -> Column:
        return F.concat(F.lit(mark), _shown(p.x), F.lit(" "), _shown(p.y))

    def step(e: Column, i: Column) -> Column:
        a = arc(e.a, e.b)
        size = F.concat(F.lit("A"), _shown(a.r), F.lit(" "), _shown(a.r))
        flags = F.concat_ws(" ", F.lit("0"), F.when(F.abs(e.a.bulge) > 1, "1").otherwise("0"), F.when(a.sweep > 0, "1").otherwise("0"))
        straight = F.coalesce(e.a.bulge, F.lit(0.0)) == 0
        return F.when(straight & (i < F.size(poly) - 1), place("L", e.b)).when(a.isNotNull(), F.concat_ws(" ", size, flags, place("", e.b)))

    steps = F.transform(edges(poly), step)
    if not closed:
        steps = F.slice(steps, 1, F.greatest(F.size(steps) - 1, F.lit(0)))
    path = F.concat_ws(" ", place("M", F.get(poly, F.lit(0))), F.array_compact(steps), F.lit("Z") if closed else F.lit(None).cast("string"))
    return F.when(F.size(poly) == 0, F.lit("")).otherwise(path)


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes."""
    w = F.greatest(F.lit(0.0), F.least(a.x + a.width, b.x + b.width) - F.greatest(a.x, b.x))
    h = F.greatest(F.lit(0.0), F.least(a.y + a.height, b.y + b.height) - F.greatest(a.y, b.y))
    both = a.width * a.height + b.width * b.height - w * h
    return F.when(both > 0, w * h / both).otherwise(F.lit(0.0))
