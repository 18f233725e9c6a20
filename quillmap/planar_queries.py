"""Overlays, faces and outlines bound to the tables of a data folder, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmap.functions import geometry as G
from quillmap.operators import fields, matching, outlines, overlay, planar, relate, sides, spatial, voronoi
from quillmap.plans.storage import dealt, keep
from quillmap.queries import query
from quillmap.shape_queries import _RECTS, _rect, _rects
from quillmap.sources.tables import table
from quillmap.view_queries import _RASTER, _SPOTS, _spots

# L-shapes with a hole, and U-shapes beside them: in SQL, boxes that count once or minus once.
_BOXES = f"""{_RECTS}, l AS (SELECT k, unnest([(x, y, w + 4, h + 4, 1), (x + w, y + h, 4, 4, -1), (x + 1, y + 1, 1, 2, -1)]) AS b FROM b),
    u AS (SELECT k, unnest([(x + k % 5 * 0.5, y + k % 7 * 0.5, w + 2, h + 2, 1), (x + k % 5 * 0.5 + 1, y + k % 7 * 0.5 + 2, 1, h, -1)]) AS b FROM b),
    q AS (SELECT l.k AS a, u.k AS b, sum(l.b[5] * u.b[5] * greatest(0.0, least(l.b[1] + l.b[3], u.b[1] + u.b[3]) - greatest(l.b[1], u.b[1])) * greatest(0.0, least(l.b[2] + l.b[4], u.b[2] + u.b[4]) - greatest(l.b[2], u.b[2]))) AS shared
          FROM l JOIN u ON l.b[1] < u.b[1] + u.b[3] AND u.b[1] < l.b[1] + l.b[3] AND l.b[2] < u.b[2] + u.b[4] AND u.b[2] < l.b[2] + l.b[4] GROUP BY ALL),
    z AS (SELECT a, b, (m.w + 4) * (m.h + 4) - 18 AS area_a, (n.w + 2) * (n.h + 2) - n.h AS area_b, shared FROM q JOIN b m ON m.k = a JOIN b n ON n.k = b WHERE shared > 0),
    i AS (SELECT *, round(shared / (area_a + area_b - shared), 9) AS iou FROM z)"""


def _ring(*points):
    return F.array(*[G.point(x, y) for x, y in points])


def _shapes(spark, d):
    x, y, w, h = (F.col(c) for c in "xywh")
    bent = _ring((x, y), (x + w + 4, y), (x + w + 4, y + h), (x + w, y + h), (x + w, y + h + 4), (x, y + h + 4))
    rects = dealt(_rects(spark, d), "k")
    ell = rects.select("k", F.array(bent, _rect(x + 1, y + 1, F.lit(1.0), F.lit(2.0))).alias("rings"))
    moved = rects.withColumn("x", x + F.col("k") % 5 * 0.5).withColumn("y", y + F.col("k") % 7 * 0.5)
    top = y + h + 2
    cup = _ring((x, y), (x + w + 2, y), (x + w + 2, top), (x + 2, top), (x + 2, y + 2), (x + 1, y + 2), (x + 1, top), (x, top))
    return ell, moved.select("k", F.array(cup).alias("rings"))


@query(f"WITH {_BOXES} SELECT a, b, area_a, area_b, round(shared, 6) AS shared, iou FROM i")
def polygon_overlay(spark, d):
    """Common areas of concave shapes, one with a hole."""
    found = overlay.shared_areas(*_shapes(spark, d), size=16.0, shape_id="k")
    return found.select("a", "b", "area_a", "area_b", F.round("shared", 6).alias("shared"), F.round("iou", 9).alias("iou"))


@query(
    f"""WITH RECURSIVE {_BOXES}, o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY iou DESC, a, b) AS n FROM i WHERE iou >= 0.4),
        f AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS la, []::BIGINT[] AS lb, NULL::BIGINT AS a, NULL::BIGINT AS b, NULL::DOUBLE AS iou, false AS hit UNION ALL
              SELECT o.n, CASE WHEN list_contains(la, o.a) OR list_contains(lb, o.b) THEN la ELSE list_append(la, o.a) END,
                     CASE WHEN list_contains(la, o.a) OR list_contains(lb, o.b) THEN lb ELSE list_append(lb, o.b) END, o.a, o.b, o.iou,
                     NOT (list_contains(la, o.a) OR list_contains(lb, o.b)) FROM f JOIN o ON o.n = f.n + 1)
        SELECT a, b, iou FROM f WHERE hit"""
)
def iou_matches(spark, d):
    """Shapes matched by their overlap, the best first."""
    return overlay.best_matches(overlay.shared_areas(*_shapes(spark, d), size=16.0, shape_id="k"), 0.4)


# Rows of 32 cells of 3 by 2 with walls between some of them; the last row may be short.
_WALLED = """w AS (SELECT p_partkey AS k, p_partkey // 32 AS r, p_partkey % 32 AS c, p_partkey % 32 = 0 OR p_size % 3 <> 0 AS wall FROM part),
    g AS (SELECT *, sum(wall::INT) OVER (PARTITION BY r ORDER BY c) AS run FROM w)"""


@query(f"WITH {_WALLED} SELECT min(c) * 3.0::DOUBLE AS x, r * 2.0::DOUBLE AS y, count(*) * 3.0::DOUBLE AS width, 2.0::DOUBLE AS height, count(*) * 6.0::DOUBLE AS area FROM g GROUP BY r, run")
def wall_faces(spark, d):
    """Faces between long level walls and the upright ones that stand on them; walls end blind or on another."""
    k, part = F.col("p_partkey"), table(spark, d, "part")
    r, c = F.floor(k / 32), k % 32
    rows = part.groupBy(r.alias("r")).agg(((F.max(c) + 1) * 3.0).alias("to"))

    def line(ax, ay, bx, by):
        return [v.cast("double").alias(n) for n, v in (("ax", ax), ("ay", ay), ("bx", bx), ("by", by))]

    level = rows.select(F.col("r"), "to", F.explode(F.array(F.lit(0), F.lit(1))).alias("up")).select(*line(F.lit(0), (F.col("r") + F.col("up")) * 2, F.col("to"), (F.col("r") + F.col("up")) * 2))
    ends = rows.select(*line(F.col("to"), F.col("r") * 2, F.col("to"), F.col("r") * 2 + 2))
    upright = part.where((c == 0) | (F.col("p_size") % 3 != 0)).select(*line(c * 3, r * 2, c * 3, r * 2 + 2))
    blind = part.select(*line(c * 3 + 1, r * 2, c * 3 + 1, r * 2 + 1))
    lines = level.unionByName(ends).unionByName(upright).unionByName(blind)
    found = planar.faces(planar.face_edges(planar.split_lines(lines, 8.0)))
    return found.select(*[F.round(v, 6).alias(v) for v in ("x", "y", "width", "height", "area")])


@query(
    f"""WITH {_SPOTS}, v AS (SELECT DISTINCT floor, x + i AS x, y + j AS y FROM s, range(2) a(i), range(2) b(j)),
        n AS (SELECT v.floor, v.x, v.y, count_if(s.x = v.x - 1 AND s.y = v.y - 1) AS p, count_if(s.x = v.x AND s.y = v.y - 1) AS q, count_if(s.x = v.x - 1 AND s.y = v.y) AS r, count_if(s.x = v.x AND s.y = v.y) AS t
              FROM v JOIN s ON s.floor = v.floor AND s.x BETWEEN v.x - 1 AND v.x AND s.y BETWEEN v.y - 1 AND v.y GROUP BY ALL),
        c AS (SELECT floor, sum(CASE WHEN p + q + r + t = 1 OR p + q + r + t = 3 THEN 1 WHEN p + q + r + t = 2 AND p = t THEN 2 ELSE 0 END) AS corners,
              sum(CASE p + q + r + t WHEN 1 THEN 1 WHEN 3 THEN -1 WHEN 2 THEN CASE WHEN p = t THEN 2 ELSE 0 END ELSE 0 END) // 4 AS rings_less_holes FROM n GROUP BY floor)
        SELECT floor, corners::BIGINT AS corners, rings_less_holes::BIGINT AS rings_less_holes, (SELECT count(*) FROM s WHERE s.floor = c.floor)::DOUBLE AS area FROM c"""
)
def cell_contours(spark, d):
    """Corners of all rings, outlines less holes and the area inside, floor by floor."""
    rim = planar.contours(_spots(spark, d), "floor")
    turned = (F.col("x") * F.col("to_y") - F.col("to_x") * F.col("y")) / 2
    rings = rim.groupBy("floor", "ring").agg(F.sum(turned).alias("area")).groupBy("floor").agg(F.sum(F.signum("area")).cast("long").alias("rings_less_holes"), F.sum("area").alias("area"))
    bends = planar.corners(rim, "floor").groupBy(F.col("floor").alias("f")).agg(F.count(F.lit(1)).alias("corners"))
    return rings.join(bends, F.col("floor") == F.col("f")).select("floor", "corners", "rings_less_holes", "area")


# outlines and lines


def _bulged(spark, d):
    """Boxes whose upper side bows out as an arc, given by nine points on it."""
    part = table(spark, d, "part")
    k, w, h = F.col("p_partkey"), (4 + F.col("p_size") % 11).cast("double"), (3 + F.col("p_partkey") % 13).cast("double")
    half = F.radians(20.0 + k % 5 * 6)
    r = w / 2 / F.sin(half)
    turns = F.sequence(F.lit(0), F.lit(8))
    bow = F.transform(turns, lambda i: G.point(w / 2 + r * F.sin(half * (1 - i / 4)), h + r * (F.cos(half * (1 - i / 4)) - F.cos(half))))
    ring = F.concat(F.array(G.point(F.lit(0.0), F.lit(0.0)), G.point(w, F.lit(0.0))), bow)
    return part.select("p_partkey", F.posexplode(ring).alias("place", "p")).select("p_partkey", "place", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


@query(
    """SELECT p_partkey, 4 AS corners, round(-tan(radians(20 + p_partkey % 5 * 6) / 2), 6) AS bulge, round((4 + p_size % 11)::DOUBLE, 6) AS x, round((3 + p_partkey % 13)::DOUBLE, 6) AS y FROM part"""
)
def fitted_arcs(spark, d):
    """The arc that stands for the bowed side, and where it starts."""
    found = outlines.arcs(_bulged(spark, d), "p_partkey", 0.05, 2.5)
    bow = F.max_by(F.struct("x", "y", "bulge"), F.col("bulge").isNotNull())
    rows = found.groupBy("p_partkey").agg(F.count(F.lit(1)).cast("int").alias("corners"), bow.alias("a"))
    return rows.select("p_partkey", "corners", *[F.round(f"a.{c}", 6).alias(c) for c in ("bulge", "x", "y")])


_LINES = """v AS (SELECT p_partkey AS k, i, i * 3 AS x, (p_partkey * (i * i + 3) + p_size * i) % 11 AS y FROM part, range(9) t(i))"""


def _lines(spark, d):
    k, i = F.col("p_partkey"), F.col("place")
    part = table(spark, d, "part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("place"))
    return part.select(k, i, (i * 3).alias("x"), ((k * (i * i + 3) + F.col("p_size") * i) % 11).alias("y"))


@query(
    f"""WITH {_LINES}, c AS MATERIALIZED (SELECT a.k, a.i, b.i AS j, sum(((b.x - a.x) * (m.y - a.y) - (b.y - a.y) * (m.x - a.x)) ** 2) / any_value((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS cost
        FROM v a JOIN v b ON b.k = a.k AND b.i > a.i JOIN v m ON m.k = a.k AND m.i >= a.i AND m.i <= b.i GROUP BY ALL),
        t AS (SELECT p.k, p.j AS one, q.j AS two, p.cost + q.cost + r.cost AS error FROM c p JOIN c q ON q.k = p.k AND q.i = p.j JOIN c r ON r.k = p.k AND r.i = q.j WHERE p.i = 0 AND r.j = 8)
        SELECT k AS p_partkey, round(min(error), 6) AS error, arg_min(one, (error, one, two)) AS one, arg_min(two, (error, one, two)) AS two FROM t GROUP BY k"""
)
def straight_pieces(spark, d):
    """Lines of nine vertices as three chords."""
    found = outlines.straight_pieces(_lines(spark, d), "p_partkey", 3)
    return found.select("p_partkey", F.round("error", 6).alias("error"), F.get("places", F.lit(1)).alias("one"), F.get("places", F.lit(2)).alias("two"))


@query(
    f"""WITH RECURSIVE {_LINES}, r AS (SELECT k, 0::BIGINT AS lo, 8::BIGINT AS hi FROM v WHERE i = 0 UNION ALL
        SELECT k, unnest([lo, cut]), unnest([cut, hi]) FROM (
          SELECT r.k, r.lo, r.hi, arg_max(m.i, (abs((b.x - a.x) * (m.y - a.y) - (b.y - a.y) * (m.x - a.x)) / sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2), -m.i)) AS cut,
                 max(abs((b.x - a.x) * (m.y - a.y) - (b.y - a.y) * (m.x - a.x)) / sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2)) AS far
          FROM r JOIN v a ON a.k = r.k AND a.i = r.lo JOIN v b ON b.k = r.k AND b.i = r.hi JOIN v m ON m.k = r.k AND m.i > r.lo AND m.i < r.hi GROUP BY ALL) WHERE far > 2.25)
        SELECT DISTINCT k AS p_partkey, unnest([lo, hi]) AS place FROM r"""
)
def simplified_lines(spark, d):
    return outlines.simplified(_lines(spark, d), "p_partkey", 2.25).select("p_partkey", F.col("place").cast("long").alias("place"))


@query(
    """WITH s AS (SELECT p_partkey % 2 AS floor, (p_partkey * 7 // 3) % 97 AS x, (p_partkey * 11 // 5) % 50 AS y, min(p_size % 7) AS label FROM part GROUP BY ALL),
       f AS (SELECT floor, i AS x, j AS y, min((i - s.x) ** 2 + (j - s.y) ** 2) AS square, arg_min(label, ((i - s.x) ** 2 + (j - s.y) ** 2, label)) AS label
             FROM s, range(97) a(i), range(50) b(j) GROUP BY ALL)
       SELECT floor, x, y, square::BIGINT AS square, label::BIGINT AS label FROM f"""
)
def cell_distances(spark, d):
    """Every cell of two floors with the nearest part's spot."""
    spots = _spots(spark, d).withColumn("label", F.col("p_size") % 7)
    frame = spots.select("floor").distinct().select("floor", F.lit(0).alias("x0"), F.lit(96).alias("x1"), F.lit(0).alias("y0"), F.lit(49).alias("y1"))
    return fields.nearest_labels(spots, "floor", "x", "y", "label", frame)


@query(
    f"""WITH {_RASTER}, o AS (SELECT x, y, min(k) AS k FROM c GROUP BY x, y), n AS (SELECT k, count(*)::DOUBLE AS kept FROM o GROUP BY k)
        SELECT b.k, w * h AS area, coalesce(kept, 0.0) AS kept, coalesce(kept, 0.0) < w * h AND coalesce(kept, 0.0) >= 0.5 * w * h AS cut FROM b LEFT JOIN n USING (k)"""
)
def resolved_overlaps(spark, d):
    """Overlapping boxes, of which the first keeps a place and the others are cut."""
    shapes = _rects(spark, d).select("k", F.array(_rect(*(F.col(c) for c in "xywh"))).alias("rings"))
    found = planar.resolved(shapes.withColumn("o", F.col("k")), "k", "rings", "o", 16.0)
    return found.select("k", F.round("area", 6).alias("area"), F.round("kept", 6).alias("kept"), "cut")


@query(
    """WITH s AS (SELECT s_suppkey, (s_suppkey * 37.137) % 101 AS x, (s_suppkey * 53.71) % 67 AS y FROM supplier), c AS (SELECT c_custkey, (c_custkey * 13.713) % 101 AS x, (c_custkey * 7.919) % 67 AS y FROM customer)
       SELECT c_custkey, arg_min(s_suppkey, (s.x - c.x) ** 2 + (s.y - c.y) ** 2) AS s_suppkey FROM c, s GROUP BY c_custkey"""
)
def voronoi_cells(spark, d):
    """The supplier in whose cell each customer lies."""
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    seeds = table(spark, d, "supplier").select(k, (k * 37137 % 101000 / 1000).alias("x"), (k * 5371 % 6700 / 100).alias("y"))
    places = table(spark, d, "customer").select(c, (c * 13713 % 101000 / 1000).alias("x"), (c * 7919 % 67000 / 1000).alias("y"))
    cells = keep(voronoi.voronoi(seeds, "s_suppkey", (0.0, 0.0, 101.0, 67.0), 8.0).select("s_suppkey", "poly"), "cells")
    return spatial.points_in_polygons(places, cells, spatial.fine(cells, 101.0 * 67.0, 8.0), "c_custkey", "s_suppkey", "s_suppkey").select("c_custkey", "s_suppkey")


_TURN = "4 * atan(0.5)"  # of an arc with a bulge of a half; it is drawn by eight chords


@query(
    f"""WITH {_RECTS} SELECT k, 11 AS corners, round(w * h + (0.625 * h) ** 2 / 2 * (8 * sin({_TURN} / 8) - sin({_TURN})), 6) AS area, round(x, 6) AS x, round(w + 0.25 * h, 6) AS width, round(h, 6) AS height FROM b"""
)
def bent_outlines(spark, d):
    """Boxes whose right side bows out as an arc, drawn by chords."""
    x, y, w, h = (F.col(c) for c in "xywh")
    bowed = F.array(G.point(x, y), G.point(x + w, y, F.lit(-0.5)), G.point(x + w, y + h), G.point(x, y + h))
    flat = _rects(spark, d).select("k", G.flatten(bowed).alias("p")).select("k", "p", G.bbox(F.col("p")).alias("b"))
    return flat.select("k", F.size("p").alias("corners"), F.round(G.area(F.col("p")), 6).alias("area"), *[F.round(f"b.{c}", 6).alias(c) for c in ("x", "width", "height")])


@query(
    """WITH l AS (SELECT p_partkey % 4 AS level, p_brand AS name, count(*)::INT AS shapes, arg_min(p_partkey, (p_size, p_partkey))::BIGINT AS first_shape FROM part GROUP BY ALL),
       c AS (SELECT p_brand AS name, arg_min(p_type, (p_size, p_type)) AS colour FROM part GROUP BY ALL) SELECT level, name, shapes, first_shape, colour FROM l JOIN c USING (name)"""
)
def sheet_shadings(spark, d):
    """Shapes of each brand on four sheets, with the brand's first colour."""
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select((k % 4).alias("level"), "p_brand", "p_type", F.col("p_size").alias("o"), k.alias("shape"))
    lists, firsts = relate.shadings(rows, "level", "p_brand", "p_type", "shape", "o")
    return lists.join(firsts, "p_brand").select("level", F.col("p_brand").alias("name"), F.size("shapes").alias("shapes"), F.get("shapes", F.lit(0)).alias("first_shape"), F.col("p_type").alias("colour"))


@query(
    """WITH m AS (SELECT c_custkey, (c_custkey * 13.713) % 101 AS x, (c_custkey * 7.919) % 67 AS y FROM customer), d AS (SELECT s_suppkey, (s_suppkey * 37.137) % 101 AS x, (s_suppkey * 53.71) % 67 AS y FROM supplier),
       n AS (SELECT c_custkey, s_suppkey, sqrt((d.x - m.x) ** 2 + (d.y - m.y) ** 2) AS far FROM m, d)
       SELECT c_custkey, arg_min(s_suppkey, (far, s_suppkey)) FILTER (far < 3.5) AS s_suppkey, round(min(far) FILTER (far < 3.5), 6) AS distance FROM n GROUP BY c_custkey"""
)
def mentioned_doors(spark, d):
    """The nearest door of each mention, if one is near."""
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    mentions = table(spark, d, "customer").select(c, (c * 13713 % 101000 / 1000).alias("x"), (c * 7919 % 67000 / 1000).alias("y"))
    doors = table(spark, d, "supplier").select(s, (s * 37137 % 101000 / 1000).alias("x"), (s * 5371 % 6700 / 100).alias("y"))
    return matching.nearest_within(mentions, doors, 3.5, "c_custkey", "s_suppkey").select("c_custkey", "s_suppkey", F.round("distance", 6).alias("distance"))


_COMPARED = f"""{_BOXES}, j AS (SELECT l.k, sum(l.b[5] * u.b[5] * greatest(0.0, least(l.b[1] + l.b[3], u.b[1] + u.b[3]) - greatest(l.b[1], u.b[1])) * greatest(0.0, least(l.b[2] + l.b[4], u.b[2] + u.b[4]) - greatest(l.b[2], u.b[2]))) AS shared FROM l JOIN u ON l.k = u.k GROUP BY l.k),
    v AS (SELECT b.k, p_type, CASE WHEN b.k % 10 = 0 THEN 'hand' WHEN w = 9 THEN 'missing' WHEN h > 8 THEN 'tall' ELSE 'room' END AS status,
          CASE WHEN b.k % 10 > 0 AND w <> 9 THEN round(shared / ((w + 4) * (h + 4) - 18 + (w + 2) * (h + 2) - h - shared), 9) END AS iou FROM b JOIN j USING (k))"""


def _compared(spark, d):
    drawn, traced = _shapes(spark, d)
    kinds = _rects(spark, d).select("k", "w", "h", F.when(F.col("h") > 8, "tall").otherwise("room").alias("kind"))
    traced = traced.join(kinds.where("w <> 9"), "k").select("k", "rings", "kind")
    return overlay.compared(drawn.withColumn("exempt", F.col("k") % 10 == 0), traced, 16.0, "k")


@query(f"WITH {_COMPARED} SELECT k, status, iou FROM v")
def compared_shapes(spark, d):
    """Each drawn shape's overlap with the traced one of its id, and what became of the others."""
    return _compared(spark, d).select("k", "status", F.round("iou", 9).alias("iou"))


@query(f"WITH {_COMPARED} SELECT p_type, count(*) AS n, count(iou) AS traced, count_if(status = 'missing')::BIGINT AS missing, count_if(status = 'hand')::BIGINT AS hand FROM v GROUP BY p_type")
def trace_statuses(spark, d):
    return overlay.status_counts(_compared(spark, d).join(_rects(spark, d).select("k", "p_type"), "k"), "p_type")


# Nine points along each side of a box, off it by a slant of its own and by steps; the last side of each seventh box has three.
_TRACED_POINTS = f"""{_RECTS}, g AS (SELECT k, x, y, w, h, s, j, (j + 1) / 10.0::DOUBLE AS t, (k * 3 + j * j + s) % 5 * 0.03 + (k + s) % 4 * 0.02 * j - 0.07 AS o FROM b, range(4) a(s), range(9) c(j) WHERE NOT (k % 7 = 0 AND s = 3 AND j > 2)),
    p AS (SELECT k, s * 9 + j AS i, CASE s WHEN 0 THEN x + w * t WHEN 1 THEN x + w + o WHEN 2 THEN x + w - w * t ELSE x + o END AS px, CASE s WHEN 0 THEN y + o WHEN 1 THEN y + h * t WHEN 2 THEN y + h + o ELSE y + h - h * t END AS py FROM g),
    e AS (SELECT k, s, x + CASE WHEN s IN (1, 2) THEN w ELSE 0 END AS ax, y + CASE WHEN s IN (2, 3) THEN h ELSE 0 END AS ay, CASE s WHEN 0 THEN w WHEN 2 THEN -w ELSE 0 END AS dx, CASE s WHEN 1 THEN h WHEN 3 THEN -h ELSE 0 END AS dy FROM b, range(4) a(s)),
    f AS (SELECT p.k, p.i, p.px, p.py, e.s, e.ax, e.ay, dx, dy, least(greatest(((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy), 0.0), 1.0) AS t FROM p JOIN e USING (k)),
    n AS (SELECT k, i, any_value(px) AS px, any_value(py) AS py, arg_min(s, ((px - ax - t * dx) ** 2 + (py - ay - t * dy) ** 2, s)) AS s FROM f GROUP BY k, i),
    l AS (SELECT k, s, avg(px) AS x, avg(py) AS y, atan2(2 * covar_pop(px, py), var_pop(px) - var_pop(py)) / 2 AS a FROM n GROUP BY k, s HAVING count(*) >= 6)"""


@query(
    f"""WITH {_TRACED_POINTS}, c AS (SELECT e.k, e.s, e.ax, e.ay, m.x AS x1, m.y AS y1, m.a AS a1, l.x AS x2, l.y AS y2, l.a AS a2, abs(sin(l.a - m.a)) >= sin(radians(20)) AS meet,
          ((l.x - m.x) * sin(l.a) - (l.y - m.y) * cos(l.a)) / nullif(sin(l.a - m.a), 0) AS u, coalesce(l.x, m.x) AS x3, coalesce(l.y, m.y) AS y3, coalesce(l.a, m.a) AS a3
        FROM e LEFT JOIN l ON l.k = e.k AND l.s = e.s LEFT JOIN l m ON m.k = e.k AND m.s = (e.s + 3) % 4)
        SELECT k, s AS corner, round(CASE WHEN meet THEN x1 + u * cos(a1) WHEN a3 IS NULL THEN ax ELSE x3 + ((ax - x3) * cos(a3) + (ay - y3) * sin(a3)) * cos(a3) END, 5) + 0.0 AS x,
               round(CASE WHEN meet THEN y1 + u * sin(a1) WHEN a3 IS NULL THEN ay ELSE y3 + ((ax - x3) * cos(a3) + (ay - y3) * sin(a3)) * sin(a3) END, 5) + 0.0 AS y FROM c"""
)
def straightened_boxes(spark, d):
    """Boxes set by points that were traced along their sides."""
    x, y, w, h, j = (F.col(c) for c in "xywhj")
    t, s = (j + 1) / 10, F.col("s")
    off = (F.col("k") * 3 + j * j + s) % 5 * 0.03 + (F.col("k") + s) % 4 * 0.02 * j - 0.07
    boxes = _rects(spark, d)
    rows = dealt(boxes, "k").select("k", "x", "y", "w", "h", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("s")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(8)))).where(~((F.col("k") % 7 == 0) & (s == 3) & (j > 2)))
    places = F.when(s == 0, G.point(x + w * t, y + off)).when(s == 1, G.point(x + w + off, y + h * t)).when(s == 2, G.point(x + w - w * t, y + h + off)).otherwise(G.point(x + off, y + h - h * t))
    points = rows.select("k", places.alias("p")).select("k", "p.x", "p.y")
    found = sides.straightened(points, boxes.select("k", _rect(x, y, w, h).alias("poly")), "k")
    return found.select("k", F.posexplode("poly").alias("corner", "p")).select("k", F.col("corner").cast("long").alias("corner"), (F.round("p.x", 5) + 0.0).alias("x"), (F.round("p.y", 5) + 0.0).alias("y"))


# Boxes whose lower side is two facets, whose left side has a small dent, and whose upper side bows out over seven vertices.
_FACETS = """v AS (SELECT p_partkey AS k, i, CASE i WHEN 0 THEN 0 WHEN 1 THEN w / 2 WHEN 2 THEN w WHEN 10 THEN 0.02 * (k % 3) * h ELSE w / 2 + w * cos(radians(a)) / 2 END AS x,
        CASE i WHEN 0 THEN 0 WHEN 1 THEN -0.02 * w * (k % 4) WHEN 2 THEN 0 WHEN 10 THEN h / 2 ELSE h + w * 0.05 * (k % 7) * sin(radians(a)) END AS y
      FROM (SELECT p_partkey, p_partkey AS k, i, (4 + p_size % 11)::DOUBLE AS w, (3 + p_partkey % 13)::DOUBLE AS h, (i - 3) * 30.0::DOUBLE AS a FROM part, range(11) t(i)))"""


@query(
    f"""WITH {_FACETS}, e AS (SELECT a.k, a.i, a.x, a.y, a.x - p.x AS ax, a.y - p.y AS ay, n.x - a.x AS bx, n.y - a.y AS b_y FROM v a JOIN v p ON p.k = a.k AND p.i = (a.i + 10) % 11 JOIN v n ON n.k = a.k AND n.i = (a.i + 1) % 11),
        t AS (SELECT k, i, x, y, CASE WHEN ax * ax + ay * ay < 1e-18 OR bx * bx + b_y * b_y < 1e-18 THEN 0 ELSE degrees(atan2(ax * b_y - ay * bx, ax * bx + ay * b_y)) END AS turn FROM e),
        s AS (SELECT *, CASE WHEN abs(turn) > 0.3 AND abs(turn) < 12 THEN sign(turn) ELSE 0 END AS side FROM t),
        c AS (SELECT m.k, m.i, m.x, m.y, m.turn, m.side <> 0 AND (f.side = m.side AND g.side = m.side OR g.side = m.side AND n.side = m.side OR n.side = m.side AND o.side = m.side) AS bent
              FROM s m JOIN s f ON f.k = m.k AND f.i = (m.i + 9) % 11 JOIN s g ON g.k = m.k AND g.i = (m.i + 10) % 11 JOIN s n ON n.k = m.k AND n.i = (m.i + 1) % 11 JOIN s o ON o.k = m.k AND o.i = (m.i + 2) % 11)
        SELECT k AS p_partkey, i::BIGINT AS place, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM c WHERE bent OR abs(turn) >= 6"""
)
def merged_facets(spark, d):
    """Outlines of parts without the corners between facets of one wall; curves keep theirs."""
    k, i, w, h = (F.col(c) for c in ("p_partkey", "place", "w", "h"))
    part = table(spark, d, "part").select(k, (4 + F.col("p_size") % 11).cast("double").alias("w"), (3 + k % 13).cast("double").alias("h"), F.explode(F.sequence(F.lit(0), F.lit(10))).alias("place"))
    a = F.radians((i - 3) * 30.0)
    x = F.when(i == 0, 0.0).when(i == 1, w / 2).when(i == 2, w).when(i == 10, 0.02 * (k % 3) * h).otherwise(w / 2 + w * F.cos(a) / 2)
    y = F.when(i == 0, 0.0).when(i == 1, -0.02 * w * (k % 4)).when(i == 2, 0.0).when(i == 10, h / 2).otherwise(h + w * 0.05 * (k % 7) * F.sin(a))
    found = outlines.without_facets(part.select(k, i, x.alias("x"), y.alias("y")), "p_partkey")
    return found.select("p_partkey", F.col("place").cast("long").alias("place"), (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y"))
