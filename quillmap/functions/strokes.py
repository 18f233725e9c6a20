"""Predicates and constructions over drawn strokes and outlines: wall lines, desk quads, curves, facades, equal splits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmap.functions import geometry as G
from quillmap.functions import shapes


def _length(e: Column) -> Column:
    return F.hypot(e.b.x - e.a.x, e.b.y - e.a.y)


def is_wall_stroke(a: Column, b: Column, black: Column, filled: Column, furniture: Column, border: Column, scale: Column, least: float = 0.5, margin: float = 3.0) -> Column:
    """Whether a stroke can be a wall: black, open, no furniture, long enough, and it starts inside the plan's border.

    ``border`` is a box; strokes that start within ``margin`` of it belong to the sheet's frame. ``least`` grows with ``scale``.
    """
    across = a.x.between(border.x + margin, border.x + border.width - margin)
    down = a.y.between(border.y + margin, border.y + border.height - margin)
    return black & ~filled & ~furniture & (F.hypot(b.x - a.x, b.y - a.y) >= least * scale) & across & down


def on_border(a: Column, b: Column, border: Column, slack: float = 0.5, reach: float = 1.0) -> Column:
    """Whether a stroke runs along a side of the border."""

    def along(p: Column, q: Column, low: Column, high: Column) -> Column:
        return (F.abs(p - q) < slack) & ((F.abs(p - low) < reach) | (F.abs(p - high) < reach))

    return along(a.x, b.x, border.x, border.x + border.width) | along(a.y, b.y, border.y, border.y + border.height)


def is_desk(quad: Column, stroke: Column, black: Column, scale: Column, least_stroke: float = 0.9, short: tuple[float, float] = (9.0, 20.0), long: tuple[float, float] = (18.0, 45.0)) -> Column:
    """Whether a quad is a work surface by its stroke and the lengths of its sides; the place is a join of its own."""

    def fits(sides: Column) -> Column:
        low, high = F.array_min(sides), F.array_max(sides)
        return low.between(short[0] * scale, short[1] * scale) & high.between(long[0] * scale, long[1] * scale)

    return black & (stroke >= least_stroke) & (F.size(quad) == 4) & G.named(F.transform(G.edges(quad), _length), fits)


def quad_centre(quad: Column) -> Column:
    """The mean of the vertices; null for no vertices."""
    n = F.nullif(F.size(quad), F.lit(0)).cast("double")

    def mean(axis: str) -> Column:
        return F.aggregate(F.transform(quad, lambda p: p[axis]), F.lit(0.0), lambda a, v: a + v) / n

    return F.when(n.isNotNull(), G.point(mean("x"), mean("y")))


def bezier(control: Column, points: int = 12) -> Column:
    """Evenly spaced points, by parameter, of the cubic curve with four control points; both ends are among them."""
    p = [F.get(control, F.lit(k)) for k in range(4)]

    def at(i: Column) -> Column:
        t = i / F.lit(float(points - 1))
        u = 1 - t
        weights = (u * u * u, 3 * u * u * t, 3 * u * t * t, t * t * t)
        return G.point(sum((w * q.x for w, q in zip(weights, p, strict=True)), F.lit(0.0)), sum((w * q.y for w, q in zip(weights, p, strict=True)), F.lit(0.0)))

    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at)


def facade_direction(outlines: Column, x: Column, y: Column, least: float = 100.0) -> Column:
    """``STRUCT<ux, uy>`` along the nearest edge of at least ``least`` of several outlines; null where none is so long.

    Of equally near edges the first counts.
    """

    def far(e: Column) -> Column:
        dx, dy, n = e.b.x - e.a.x, e.b.y - e.a.y, _length(e)
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - e.a.x) * dx + (y - e.a.y) * dy) / (n * n)))
        return F.struct(F.hypot(e.a.x + t * dx - x, e.a.y + t * dy - y).alias("dist"), (dx / n).alias("ux"), (dy / n).alias("uy"))

    def nearest(found: Column) -> Column:
        ranked = F.transform(found, lambda s, i: F.struct(s.dist.alias("dist"), i.alias("i"), s.ux.alias("ux"), s.uy.alias("uy")))
        return G.named(F.array_min(ranked), lambda m: F.when(m.isNotNull(), F.struct(m.ux.alias("ux"), m.uy.alias("uy"))))

    sides = F.flatten(F.transform(outlines, lambda o: G.edges(G.flatten(o))))
    return G.named(F.transform(F.filter(sides, lambda e: _length(e) >= least), far), nearest)


def equal_boxes(poly: Column, seeds: Column, degrees: Column) -> Column:
    """One square for each seed, side by side along the direction ``degrees``, as ``ARRAY<ARRAY<point>>`` in the seeds' order.

    The row is centred on the polygon and as long as it; the squares are dealt by the seeds' order along the row. Seeds that
    spread more across the direction than along it turn the row by a right angle. No seeds give no boxes.
    """
    ux, uy = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))

    def spread(points: Column, x: Column, y: Column) -> Column:
        on = F.transform(points, lambda p: p.x * x + p.y * y)
        return F.struct(F.array_min(on).alias("low"), F.array_max(on).alias("high"))

    def turned(s: Column) -> Column:
        across = (s.v.high - s.v.low) > (s.u.high - s.u.low)
        return F.struct(F.when(across, -uy).otherwise(ux).alias("x"), F.when(across, ux).otherwise(uy).alias("y"))

    def laid(u: Column) -> Column:
        def boxes(s: Column) -> Column:
            n = F.size(seeds).cast("double")
            side, first = (s.a.high - s.a.low) / n, s.a.low
            middle = (s.b.low + s.b.high) / 2
            on = F.transform(seeds, lambda p, i: F.struct((p.x * u.x + p.y * u.y).alias("at"), i.alias("i")))

            def box(me: Column) -> Column:
                rank = F.size(F.filter(on, lambda o: (o["at"] < me["at"]) | ((o["at"] == me["at"]) & (o.i < me.i)))).cast("double")
                low, left, right = middle - side / 2, first + rank * side, first + (rank + 1) * side

                def corner(along: Column, deep: Column) -> Column:
                    return G.point(along * u.x - deep * u.y, along * u.y + deep * u.x)

                return F.array(corner(left, low), corner(right, low), corner(right, low + side), corner(left, low + side))

            return F.transform(on, box)

        return G.named(F.struct(spread(poly, u.x, u.y).alias("a"), spread(poly, -u.y, u.x).alias("b")), boxes)

    row = G.named(F.struct(spread(seeds, ux, uy).alias("u"), spread(seeds, -uy, ux).alias("v")), turned)
    return F.when(F.size(seeds) > 0, G.named(row, laid)).otherwise(F.array().cast("array<array<struct<x:double,y:double,bulge:double>>>"))


def is_office(category: Column, name: Column) -> Column:
    """An office by category or by the word in its name; clusters of open desks are none."""
    name = F.coalesce(name, F.lit(""))
    return F.coalesce(category == "office", F.lit(False)) | (name.rlike(r"\bOffice\b") & ~name.startswith("Open Office"))


def is_room_shape(poly: Column, taken: Column, areas: tuple[float, float], most_taken: float = 0.3, least_side: float = 20.0, aspect: float = 6.0, fill: float = 0.5) -> Column:
    """Whether an unlabelled region can be a room; ``taken`` is the area of it that others cover.

    Its area lies in a range, little of it is taken, its least rectangle is neither narrow nor long, and it fills enough of it.
    """

    def fits(s: Column) -> Column:
        r = s.r
        return s.a.between(*areas) & (taken <= most_taken * s.a) & (r.width >= least_side) & (r.length <= aspect * r.width) & (s.a >= fill * r.length * r.width)

    return F.coalesce(G.named(F.struct(G.area(poly).alias("a"), shapes.least_rectangle(poly).alias("r")), fits), F.lit(False))
