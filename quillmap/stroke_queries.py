"""The stroke, outline and splitting operators bound to the tables of a data folder, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmap.functions import geometry as G
from quillmap.functions import strokes
from quillmap.plans.storage import dealt
from quillmap.queries import query
from quillmap.shape_queries import _RECTS, _rect, _rects
from quillmap.sources.tables import table

_ENDS = "s AS (SELECT c_custkey AS k, (c_custkey % 120)::DOUBLE AS ax, (c_custkey % 95)::DOUBLE AS ay, c_acctbal / 500 AS dx, (c_custkey % 7) / 4.0::DOUBLE AS dy, c_mktsegment AS kind FROM customer)"


def _ends(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("k"), (k % 120).cast("double").alias("ax"), (k % 95).cast("double").alias("ay"), (F.col("c_acctbal") / 500).alias("dx"), (k % 7 / 4.0).alias("dy"), F.col("c_mktsegment").alias("kind"))


@query(
    f"""WITH {_ENDS} SELECT k, kind <> 'BUILDING' AND kind <> 'MACHINERY' AND sqrt(dx * dx + dy * dy) >= 0.75 AND ax >= 3 AND ax <= 97 AND ay >= 3 AND ay <= 77 AS wall,
        (abs(dx) < 0.5 AND (ax < 1 OR abs(ax - 100) < 1)) OR (abs(dy) < 0.5 AND (ay < 1 OR abs(ay - 80) < 1)) AS frame FROM s"""
)
def wall_strokes(spark, d):
    x, y = F.col("ax"), F.col("ay")
    a, b = G.point(x, y), G.point(x + F.col("dx"), y + F.col("dy"))
    border = F.struct(*[F.lit(v).alias(n) for n, v in (("x", 0.0), ("y", 0.0), ("width", 100.0), ("height", 80.0))])
    kind = F.col("kind")
    wall = strokes.is_wall_stroke(a, b, F.lit(True), kind == "BUILDING", kind == "MACHINERY", border, F.lit(1.5))
    return _ends(spark, d).select("k", wall.alias("wall"), strokes.on_border(a, b, border).alias("frame"))


@query(f"WITH {_RECTS} SELECT k, least(w, h) BETWEEN 4.5 AND 10 AND greatest(w, h) BETWEEN 9 AND 22.5 AND p_type <> 'PROMO' AS desk, x + w / 2 AS cx, y + h / 2 AS cy FROM b")
def desk_quads(spark, d):
    x, y, w, h = (F.col(c) for c in "xywh")
    quad = _rect(x, y, w, h)
    centre = strokes.quad_centre(quad)
    return _rects(spark, d).select("k", strokes.is_desk(quad, F.lit(1.0), F.col("p_type") != "PROMO", F.lit(0.5)).alias("desk"), centre.x.alias("cx"), centre.y.alias("cy"))


@query(
    f"""WITH {_RECTS}, t AS (SELECT k, x, y, w, h, i / 11.0::DOUBLE AS t FROM b, range(0, 12) r(i)) SELECT k, round(sum(3 * (1 - t) * t * t * (x + w) + 3 * (1 - t) ** 2 * t * (x + w) + (1 - t) ** 3 * x + t ** 3 * x), 6) AS sx,
        round(sum((1 - t) ** 3 * y + 3 * (1 - t) ** 2 * t * y + 3 * (1 - t) * t * t * (y + h) + t ** 3 * (y + h)), 6) AS sy FROM t GROUP BY k"""
)
def curve_points(spark, d):
    x, y, w, h = (F.col(c) for c in "xywh")

    def total(points, axis):
        return F.round(F.aggregate(F.transform(points, lambda p: p[axis]), F.lit(0.0), lambda a, v: a + v), 6)

    curve = G.named(strokes.bezier(_rect(x, y, w, h)), lambda p: F.struct(total(p, "x").alias("sx"), total(p, "y").alias("sy")))
    return _rects(spark, d).select("k", curve.alias("c")).select("k", "c.*")


@query(
    f"""WITH {_RECTS}, e AS (SELECT k, unnest([1, 2, 3, 4]) AS i, unnest([1.0, w + 1, h + 1, 1.0]) AS away, unnest([w, h, w, h]) AS length FROM b),
        r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY away, i) AS n FROM e WHERE length >= 6)
        SELECT b.k, CASE i WHEN 1 THEN 1 WHEN 3 THEN -1 WHEN 2 THEN 0 WHEN 4 THEN 0 END::DOUBLE AS ux, CASE i WHEN 2 THEN 1 WHEN 4 THEN -1 WHEN 1 THEN 0 WHEN 3 THEN 0 END::DOUBLE AS uy
        FROM b LEFT JOIN r ON r.k = b.k AND n = 1"""
)
def facades(spark, d):
    x, y, w, h = (F.col(c) for c in "xywh")
    u = strokes.facade_direction(F.array(_rect(x, y, w, h)), x - 1, y - 1, 6.0)
    return _rects(spark, d).select("k", u.alias("u")).select("k", (F.col("u.ux") + 0.0).alias("ux"), (F.col("u.uy") + 0.0).alias("uy"))


@query(
    f"""WITH {_RECTS}, n AS (SELECT *, w / 3 AS side FROM b), c AS (SELECT k, unnest([1, 2, 3]) AS seed, unnest([2, 0, 1]) AS rank, x, y, h, side FROM n)
        SELECT k, seed, round(x + rank * side, 6) AS x0, round(y + h / 2 - side / 2, 6) AS y0, round(side, 6) AS side FROM c"""
)
def bank_cells(spark, d):
    x, y, w, h = (F.col(c) for c in "xywh")
    seeds = F.array(*[G.point(x + w * f, y + h / 2) for f in (0.9, 0.1, 0.4)])
    cells = dealt(_rects(spark, d), "k").select("k", F.posexplode(strokes.equal_boxes(_rect(x, y, w, h), seeds, F.lit(0.0))).alias("i", "box"))
    box = G.bbox(F.col("box"))
    return cells.select("k", (F.col("i") + 1).alias("seed"), F.round(box.x, 6).alias("x0"), F.round(box.y, 6).alias("y0"), F.round(box.width, 6).alias("side"))


@query("SELECT p_partkey, p_type = 'PROMO' OR (p_size > 20 AND p_size <= 40) AS office FROM part")
def offices(spark, d):
    name = F.when(F.col("p_size") > 40, F.concat(F.lit("Open Office "), "p_brand")).when(F.col("p_size") > 20, F.concat(F.col("p_brand"), F.lit(" Office"))).when(F.col("p_size") > 10, F.concat(F.lit("Officer "), "p_brand"))
    return table(spark, d, "part").select("p_partkey", strokes.is_office(F.when(F.col("p_type") == "PROMO", "office"), name).alias("office"))


@query(f"WITH {_RECTS} SELECT k, w * h BETWEEN 30 AND 150 AND k % 13 <= 0.3 * w * h AND least(w, h) >= 4 AND greatest(w, h) <= 3 * least(w, h) AS room FROM b")
def room_shapes(spark, d):
    x, y, w, h = (F.col(c) for c in "xywh")
    return _rects(spark, d).select("k", strokes.is_room_shape(_rect(x, y, w, h), (F.col("k") % 13).cast("double"), (30.0, 150.0), least_side=4.0, aspect=3.0).alias("room"))
