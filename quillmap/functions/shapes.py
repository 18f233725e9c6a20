"""Shapes from shapes: clipping, least rectangles, tidying, ellipses, and the arithmetic of a view."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmap.functions import geometry as G


def _side(e: Column, p: Column) -> Column:
    return (e.b.x - e.a.x) * (p.y - e.a.y) - (e.b.y - e.a.y) * (p.x - e.a.x)


def _cut(shape: Column, edge: Column) -> Column:
    """The part of ``shape`` on the inner side of the line through ``edge``."""
    sides = F.transform(G.edges(shape), lambda e: F.struct(e.a.alias("a"), e.b.alias("b"), _side(edge, e.a).alias("d"), _side(edge, e.b).alias("n")))

    def piece(e: Column) -> Column:
        t = e.d / (e.d - e.n)
        meet = G.point(e.a.x + (e.b.x - e.a.x) * t, e.a.y + (e.b.y - e.a.y) * t)
        return F.array_compact(F.array(F.when(e.d >= 0, e.a), F.when((e.d >= 0) != (e.n >= 0), meet)))

    return F.flatten(F.transform(sides, piece))


def _turned(poly: Column) -> Column:
    return F.when(G.doubled_area(poly) < 0, F.reverse(poly)).otherwise(poly)


def _straight(poly: Column) -> Column:
    return F.transform(poly, lambda p: G.point(p.x, p.y))


def clip_convex(poly: Column, clip: Column) -> Column:
    """The part of ``poly`` inside the convex polygon ``clip``, cut edge by edge; empty where they are apart. Both straight."""
    return F.reduce(G.edges(_turned(clip)), _straight(poly), _cut)


def inset_convex(poly: Column, by: float) -> Column:
    """A convex straight polygon with every edge moved inward by ``by``; empty where nothing is left."""

    def inward(e: Column) -> Column:
        dx, dy = e.b.x - e.a.x, e.b.y - e.a.y
        n = F.hypot(dx, dy)
        sx, sy = -dy / n * by, dx / n * by
        return F.when(n > 0, F.struct(G.point(e.a.x + sx, e.a.y + sy).alias("a"), G.point(e.b.x + sx, e.b.y + sy).alias("b")))

    return F.reduce(F.array_compact(F.transform(G.edges(_turned(poly)), inward)), _straight(poly), _cut)


def hausdorff(a: Column, b: Column) -> Column:
    """The largest distance from a vertex of one straight polygon to the edges of the other, both ways."""

    def far(one: Column, other: Column) -> Column:
        return F.array_max(F.transform(one, lambda p: G.edge_distance(other, p.x, p.y)))

    return F.greatest(far(a, b), far(b, a))


def convex_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two convex polygons; 0 where both are without area."""
    def ratio(s: Column) -> Column:
        whole = s.a + s.b - s.both
        return F.when(whole > 0, s.both / whole).otherwise(F.lit(0.0))

    return G.named(F.struct(G.area(a).alias("a"), G.area(b).alias("b"), G.area(clip_convex(a, b)).alias("both")), ratio)


def least_rectangle(poly: Column) -> Column:
    """``STRUCT<area, x, y, ux, uy, length, width>`` of the smallest rectangle along an edge; ``u`` points along its long side.

    Null for a polygon whose edges all have no length.
    """


    def rectangle(s: Column) -> Column:
        a, b, ma, mb = s.a1 - s.a0, s.b1 - s.b0, (s.a0 + s.a1) / 2, (s.b0 + s.b1) / 2
        long = a >= b
        return F.struct((a * b).alias("area"), (s.ux * ma - s.uy * mb).alias("x"), (s.uy * ma + s.ux * mb).alias("y"), F.when(long, s.ux).otherwise(-s.uy).alias("ux"), F.when(long, s.uy).otherwise(s.ux).alias("uy"), F.greatest(a, b).alias("length"), F.least(a, b).alias("width"))

    def best(v: Column) -> Column:
        def direction(e: Column) -> Column:
            n = F.hypot(e.b.x - e.a.x, e.b.y - e.a.y)
            return F.when(n >= 1e-6, F.struct(((e.b.x - e.a.x) / n).alias("ux"), ((e.b.y - e.a.y) / n).alias("uy")))

        def spans(u: Column) -> Column:
            a, b = F.transform(v, lambda p: p.x * u.ux + p.y * u.uy), F.transform(v, lambda p: p.y * u.ux - p.x * u.uy)
            return F.struct(u.ux.alias("ux"), u.uy.alias("uy"), F.array_min(a).alias("a0"), F.array_max(a).alias("a1"), F.array_min(b).alias("b0"), F.array_max(b).alias("b1"))

        directions = F.array_compact(F.transform(G.edges(v), direction))
        return F.array_min(F.transform(F.transform(directions, spans), rectangle))

    return G.named(poly, best)


def without_straight_corners(poly: Column, slack: float) -> Column:
    """The polygon without the vertices that lie within ``slack`` of the line from the vertex kept before to the one after.

    Vertices of arcs stay, and so does the polygon if fewer than three vertices would be left.
    """

    def told(v: Column) -> Column:
        def step(s: Column, e: Column) -> Column:
            def judged(k: Column) -> Column:
                dx, dy, gx, gy = e.b.x - k.x, e.b.y - k.y, e.a.x - k.x, e.a.y - k.y
                off = G.named(F.hypot(dx, dy), lambda base: F.when(base > 0, F.abs(dx * gy - dy * gx) / base).otherwise(F.hypot(gx, gy)))
                bent = (F.coalesce(e.a.bulge, F.lit(0.0)) != 0) | (F.coalesce(k.bulge, F.lit(0.0)) != 0)
                return F.when(bent | (off > slack), F.concat(s, F.array(e.a))).otherwise(s)

            return G.named(F.when(F.size(s) > 0, F.element_at(s, -1)).otherwise(F.element_at(v, -1)), judged)

        kept = F.reduce(G.edges(v), F.slice(v, 1, 0), step)
        return F.when(F.size(v) < 4, v).otherwise(G.named(kept, lambda k: F.when(F.size(k) >= 3, k).otherwise(v)))

    return G.named(poly, told)


def ellipse(cx: Column, cy: Column, rx: Column, ry: Column, corners: int = 48) -> Column:
    """A closed polygon of points on an axis-aligned ellipse."""
    return F.transform(F.sequence(F.lit(0), F.lit(corners - 1)), lambda k: G.point(cx + rx * F.cos(k * (2 * math.pi / corners)), cy + ry * F.sin(k * (2 * math.pi / corners))))


def box_along(cx: Column, cy: Column, ux: Column, uy: Column, length: Column, width: Column) -> Column:
    """The four corners of a box around a middle, its length along the unit vector ``u``."""
    ax, ay, bx, by = ux * length / 2, uy * length / 2, -uy * width / 2, ux * width / 2
    return F.array(*[G.point(cx + s * ax + t * bx, cy + s * ay + t * by) for s, t in ((-1, -1), (1, -1), (1, 1), (-1, 1))])


def street_box(path: Column, width: Column, within: Column) -> Column:
    """The box of a street's points (arcs at one degree) whose x lies in ``within``, grown by half its width; ``within`` where none does."""
    some = F.filter(G.flatten(path, math.pi / 180), lambda p: (p.x >= within.x) & (p.x <= within.x + within.width))
    b, half = G.bbox(some), width / 2
    grown = F.struct((b.x - half).alias("x"), (b.y - half).alias("y"), (b.width + width).alias("width"), (b.height + width).alias("height"))
    return F.when(F.size(some) > 0, grown).otherwise(within)


def zoomed(view: Column, home_width: Column, factor: Column, x: Column, y: Column, least: float = 0.5, most: float = 8.0) -> Column:
    """The view after zooming about a point that stays in place; its width keeps between home over ``most`` and over ``least``."""
    width = F.least(home_width / least, F.greatest(home_width / most, view.width / factor))
    f = width / view.width
    return F.struct((x - (x - view.x) * f).alias("x"), (y - (y - view.y) * f).alias("y"), width.alias("width"), (view.height * f).alias("height"))


def union_box() -> Column:
    """Aggregate: the box around all boxes ``box`` of a group."""
    b = F.col("box")
    x, y = F.min(b.x), F.min(b.y)
    return F.struct(x.alias("x"), y.alias("y"), (F.max(b.x + b.width) - x).alias("width"), (F.max(b.y + b.height) - y).alias("height"))


def panned(view: Column, box: Column, margin: float = 40.0) -> Column:
    """The view moved as little as shows ``box`` with a margin; a side too long for the view is centred."""

    def side(at: str, size: str) -> Column:
        low, length = box[at] - margin, box[size] + 2 * margin
        return F.when(length >= view[size], low + (length - view[size]) / 2).otherwise(F.least(F.greatest(view[at], low + length - view[size]), low))

    return F.struct(side("x", "width").alias("x"), side("y", "height").alias("y"), view.width.alias("width"), view.height.alias("height"))


def bulge_through(a: Column, m: Column, b: Column) -> Column:
    """The bulge of the arc from ``a`` over ``m`` to ``b``: 0 where they are in line, null where the way turns back at ``m``.

    The way's turn at ``m`` is half of what the arc sweeps, and so the bulge is the tangent of half that turn.
    """
    ux, uy, vx, vy = m.x - a.x, m.y - a.y, b.x - m.x, b.y - m.y
    whole = F.hypot(ux, uy) * F.hypot(vx, vy) + ux * vx + uy * vy
    return F.when(whole > 1e-12, (uy * vx - ux * vy) / whole)


def circle_of(points: Column) -> Column:
    """``STRUCT<cx, cy, r, off>`` of the least-squares circle of a point list, ``off`` the largest miss; null for points in line."""

    def total(v: Column, f) -> Column:
        return F.reduce(v, F.lit(0.0), lambda s, p: s + f(p))

    def about(v: Column) -> Column:
        n = F.nullif(F.size(v), F.lit(0))
        return F.struct((total(v, lambda p: p.x) / n).alias("x"), (total(v, lambda p: p.y) / n).alias("y"))

    def powers(v: Column, c: Column) -> Column:
        def power(i: int, j: int) -> Column:
            return total(v, lambda p: F.pow(p.x - c.x, F.lit(i)) * F.pow(p.y - c.y, F.lit(j)))

        kinds = {"uu": (2, 0), "vv": (0, 2), "uv": (1, 1), "uuu": (3, 0), "vvv": (0, 3), "uvv": (1, 2), "uuv": (2, 1)}
        return F.struct(c.x.alias("x"), c.y.alias("y"), *[power(*ij).alias(k) for k, ij in kinds.items()])

    def solved(s: Column, n: Column) -> Column:
        det = s.uu * s.vv - s.uv * s.uv
        p, q = (s.uuu + s.uvv) / 2, (s.vvv + s.uuv) / 2
        u, v = (p * s.vv - q * s.uv) / det, (q * s.uu - p * s.uv) / det
        flat = det <= 1e-9 * (s.uu + s.vv) * (s.uu + s.vv)
        return F.when(~flat, F.struct((s.x + u).alias("cx"), (s.y + v).alias("cy"), F.sqrt(u * u + v * v + (s.uu + s.vv) / n).alias("r")))

    def measured(v: Column, c: Column) -> Column:
        off = F.array_max(F.transform(v, lambda p: F.abs(F.hypot(p.x - c.cx, p.y - c.cy) - c.r)))
        return F.when(c.isNotNull(), F.struct(c.cx.alias("cx"), c.cy.alias("cy"), c.r.alias("r"), off.alias("off")))

    def fit(v: Column) -> Column:
        return G.named(G.named(G.named(about(v), lambda c: powers(v, c)), lambda s: solved(s, F.size(v))), lambda c: measured(v, c))

    return G.named(points, fit)


def gentle(chain: Column, scale: float = 1.0, least: float = 10.0, most_turn: float = 35.0, radii: tuple[float, float] = (7.0, 24.0), slack: float = 0.6) -> Column:
    """Whether an open chain of at least four points is long enough and turns gently, and is not an arc of a radius in ``radii``."""

    def step(i: Column) -> Column:
        p, q = F.get(chain, i), F.get(chain, i + 1)
        return F.struct((q.x - p.x).alias("x"), (q.y - p.y).alias("y"), F.hypot(q.x - p.x, q.y - p.y).alias("n"))

    def bend(u: Column, v: Column) -> Column:
        return F.when((u.n >= 1e-6) & (v.n >= 1e-6), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (u.x * v.x + u.y * v.y) / (u.n * v.n))))))

    def judged(s: Column) -> Column:
        turns = F.transform(F.sequence(F.lit(0), F.size(s) - 2), lambda i: bend(F.get(s, i), F.get(s, i + 1)))
        first, last = F.get(chain, F.lit(0)), F.element_at(chain, -1)
        open_ = F.hypot(first.x - last.x, first.y - last.y) >= 2 * scale
        length = F.reduce(s, F.lit(0.0), lambda t, x: t + x.n)
        round_ = G.named(circle_of(chain), lambda c: F.coalesce((c.r >= radii[0] * scale) & (c.r <= radii[1] * scale) & (c.off <= slack * scale), F.lit(False)))
        return open_ & (length >= least * scale) & (F.coalesce(F.array_max(turns), F.lit(0.0)) <= most_turn) & ~round_

    steps = F.transform(F.sequence(F.lit(0), F.size(chain) - 2), step)
    return F.when(F.size(chain) < 4, F.lit(False)).otherwise(G.named(steps, judged))


def hull(points: Column) -> Column:
    """The convex hull of a point list as a polygon, from its least point on; points within an edge are left out.

    Each corner looks for the next one over all points, so the work is points times corners. Fewer than three corners are
    returned as they are; no points give an empty list.
    """

    def wrap(v: Column) -> Column:
        def next_of(at: Column) -> Column:
            def choose(best: Column, p: Column) -> Column:
                ux, uy, vx, vy = best.x - at.x, best.y - at.y, p.x - at.x, p.y - at.y
                side = ux * vy - uy * vx
                # coordinates far from the origin are rounded more coarsely than the distances between them
                last = 2e-15 * F.greatest(F.abs(at.x), F.abs(at.y))
                slack = 1e-12 * (F.abs(ux * vy) + F.abs(uy * vx)) + last * (F.abs(ux) + F.abs(uy) + F.abs(vx) + F.abs(vy))
                farther = (F.abs(side) <= slack) & (vx * vx + vy * vy > ux * ux + uy * uy)
                return F.when((side < -slack) | farther, p).otherwise(best)

            return F.reduce(v, at, choose)

        def step(s: Column, _: Column) -> Column:
            def grown(q: Column) -> Column:
                return F.when(q == F.get(s.ring, F.lit(0)), F.struct(s.ring.alias("ring"), F.lit(True).alias("done"))).otherwise(F.struct(F.concat(s.ring, F.array(q)).alias("ring"), F.lit(False).alias("done")))

            return F.when(s.done, s).otherwise(G.named(next_of(F.element_at(s.ring, -1)), grown))

        start = F.struct(F.slice(v, 1, 1).alias("ring"), F.lit(False).alias("done"))
        return F.transform(F.reduce(v, start, step).ring, lambda p: G.point(p.x, p.y))

    places = F.array_sort(F.array_distinct(F.transform(points, lambda p: F.struct(p.x.alias("x"), p.y.alias("y")))))
    return G.named(places, wrap)


def longest_edges(poly: Column, n: int = 2) -> Column:
    """The ``n`` longest edges, the longest first, equal ones in order: ``ARRAY<STRUCT<length, i, a, b>>``."""
    told = F.transform(G.edges(poly), lambda e, i: F.struct((-F.hypot(e.b.x - e.a.x, e.b.y - e.a.y)).alias("less"), i.alias("i"), e.a.alias("a"), e.b.alias("b")))
    return F.transform(F.slice(F.array_sort(told), 1, n), lambda e: F.struct((-e.less).alias("length"), e.i.alias("i"), e.a.alias("a"), e.b.alias("b")))


def edge_direction(poly: Column) -> Column:
    """Degrees of the longest edge, of equal ones the first; null for an empty polygon."""
    return G.named(F.get(longest_edges(poly, 1), F.lit(0)), lambda e: F.degrees(F.atan2(e.b.y - e.a.y, e.b.x - e.a.x)))


def _spun(p: Column, turn: Column, cx: Column, cy: Column) -> tuple[Column, Column]:
    """``x, y`` of a point after a turn by degrees around a centre."""
    c, s, dx, dy = F.cos(F.radians(turn)), F.sin(F.radians(turn)), p.x - cx, p.y - cy
    return cx + dx * c - dy * s, cy + dx * s + dy * c


def turned_to_axis(poly: Column, axis: Column, limit: float = 15.0, least: float = 0.05, digits: int = 1) -> Column:
    """``poly`` turned around the mean of its vertices until its longest edge lies along or across ``axis`` (degrees).

    Vertices are rounded and keep their arcs. A polygon that is off by more than ``limit`` or less than ``least`` stays as it is,
    as does an empty one; a null polygon or axis gives the polygon.
    """

    def told(v: Column) -> Column:
        def by(t: Column) -> Column:
            n = F.size(v)
            mean = F.struct((F.aggregate(v, F.lit(0.0), lambda s, p: s + p.x) / n).alias("x"), (F.aggregate(v, F.lit(0.0), lambda s, p: s + p.y) / n).alias("y"))

            def moved_points(m: Column) -> Column:
                def one(p: Column) -> Column:
                    x, y = _spun(p, t, m.x, m.y)
                    return F.struct(F.round(x, digits).alias("x"), F.round(y, digits).alias("y"), p.bulge.alias("bulge"))

                return F.transform(v, one)

            return F.when(F.abs(t).between(least, limit), G.named(mean, moved_points)).otherwise(v)

        return G.named(F.pmod(axis - edge_direction(v) + 45, F.lit(90.0)) - 45, by)

    return G.named(poly, told)


def box_of_axis(poly: Column, axis: Column | None = None) -> Column:
    """Corners of the least box around the vertices that lies along ``axis`` (degrees), or along the longest edge."""

    def told(v: Column) -> Column:
        def by(t: Column) -> Column:
            zero = F.lit(0.0)

            def flat(p: Column) -> Column:
                x, y = _spun(p, -t, zero, zero)
                return G.point(x, y)

            def back(b: Column) -> Column:
                corners = F.array(*[G.point(b.x + i * b.width, b.y + j * b.height) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1))])
                return F.transform(corners, lambda p: G.point(*_spun(p, t, zero, zero)))

            return G.named(G.bbox(F.transform(v, flat)), back)

        return G.named(edge_direction(v) if axis is None else axis, by)

    return G.named(poly, told)


def _rays(e: Column, ox: Column, oy: Column, degrees: Column) -> Column:
    """Where rays from a point in an ellipse leave it, for an array of directions. What all rays share is worked out once."""

    def all_rays(k: Column) -> Column:
        # In the ellipse's own axes, as parts of them, it is the unit circle.
        def ray(d: Column) -> Column:
            unit = F.struct(((d.x * k.c + d.y * k.s) / k.a).alias("x"), ((d.y * k.c - d.x * k.s) / k.b).alias("y"))

            def reach(u: Column) -> Column:
                parts = F.struct((k.px * u.x + k.py * u.y).alias("along"), (u.x * u.x + u.y * u.y).alias("square"))
                return G.named(parts, lambda q: (F.sqrt(q.along * q.along - q.square * (k.px * k.px + k.py * k.py - 1)) - q.along) / q.square)

            return G.named(G.named(unit, reach), lambda f: G.point(k.ox + f * d.x, k.oy + f * d.y))

        directions = F.transform(degrees, lambda t: F.struct(F.cos(F.radians(t)).alias("x"), F.sin(F.radians(t)).alias("y")))
        return F.transform(directions, ray)

    def placed(t: Column) -> Column:
        dx, dy = t.ox - e.cx, t.oy - e.cy
        px, py = (dx * t.c + dy * t.s) / e.a, (dy * t.c - dx * t.s) / e.b
        return G.named(F.struct(t.ox.alias("ox"), t.oy.alias("oy"), t.c.alias("c"), t.s.alias("s"), e.a.alias("a"), e.b.alias("b"), px.alias("px"), py.alias("py")), all_rays)

    return G.named(F.struct(F.cos(F.radians(e.turn)).alias("c"), F.sin(F.radians(e.turn)).alias("s"), ox.alias("ox"), oy.alias("oy")), placed)


def leaves_ellipse(e: Column, ox: Column, oy: Column, degrees: Column) -> Column:
    """The point where a ray from ``(ox, oy)`` inside an ellipse (``cx, cy, a, b, turn`` in degrees) leaves it."""
    return F.get(_rays(e, ox, oy, F.array(degrees)), F.lit(0))


def band(inner: Column, outer: Column, low: Column, high: Column, steps: int = 40) -> Column:
    """The polygon between two ellipses from ``low`` to ``high`` degrees, seen from the inner one's centre: out there, back inside."""
    turns = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: low + (high - low) * i / steps)
    return F.concat(_rays(outer, inner.cx, inner.cy, turns), F.reverse(_rays(inner, inner.cx, inner.cy, turns)))


def without_jogs(poly: Column, jog: float, degrees: float) -> Column:
    """``poly`` with each edge below ``jog`` replaced by its middle where the edges beside it run within ``degrees`` of each other.

    Edges are judged on the polygon as given, from its first vertex on; the end of a replaced edge starts none of its own. Null and
    empty polygons stay as they are.
    """

    def told(v: Column) -> Column:
        def at(i: Column) -> Column:
            return F.get(v, F.pmod(i, F.size(v)))

        def edge(p: Column, i: Column) -> Column:
            q, before, after = at(i + 1), at(i - 1), at(i + 2)
            ax, ay, bx, by = p.x - before.x, p.y - before.y, after.x - q.x, after.y - q.y
            long = (F.hypot(ax, ay) > 1e-9) & (F.hypot(bx, by) > 1e-9)
            bend = F.abs(F.degrees(F.atan2(ax * by - ay * bx, ax * bx + ay * by)))
            short = (F.hypot(q.x - p.x, q.y - p.y) < jog) & long & (bend < degrees)
            return F.struct(p.alias("p"), G.point((p.x + q.x) / 2, (p.y + q.y) / 2).alias("mid"), short.alias("short"))

        def step(s: Column, e: Column) -> Column:
            starts = e.short & ~s.skip
            grown = F.when(s.skip, s.out).when(starts, F.concat(s.out, F.array(e.mid))).otherwise(F.concat(s.out, F.array(e.p)))
            return F.struct(grown.alias("out"), starts.alias("skip"))

        return F.aggregate(F.transform(v, edge), F.struct(F.slice(v, 1, 0).alias("out"), F.lit(False).alias("skip")), step, lambda s: s.out)

    return G.named(poly, told)
