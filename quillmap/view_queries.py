"""The display, drawing and region operators bound to the tables of a data folder, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmap.functions import geometry as G
from quillmap.functions import marks, shapes
from quillmap.operators import grid
from quillmap.plans.storage import dealt
from quillmap.queries import _polygons, query
from quillmap.shape_queries import _RECTS, _rect, _rects
from quillmap.sources import records
from quillmap.sources.tables import table

# shapes


@query("SELECT p_partkey, round(n * tan(pi() / n) * greatest(0.0, (2 + p_size % 6) * cos(pi() / n) - 1.5) ** 2, 5) AS area FROM (SELECT *, 3 + p_partkey % 5 AS n FROM part)")
def inset_area(spark, d):
    return _polygons(spark, d).select("p_partkey", F.round(G.area(shapes.inset_convex(F.col("poly"), 1.5)), 5).alias("area"))


_SHIFT = f"""{_RECTS}, s AS (SELECT * FROM b UNION ALL SELECT k, p_type, x + k % 4, y + 1, w + 1, h + k % 3 FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY y) AS side FROM s),
    v AS (SELECT k, side, unnest([x, x + w, x + w, x]) AS x, unnest([y, y, y + h, y + h]) AS y FROM r),
    f AS (SELECT v.k, v.side, v.x, v.y, CASE WHEN v.x BETWEEN r.x AND r.x + r.w AND v.y BETWEEN r.y AND r.y + r.h THEN least(v.x - r.x, r.x + r.w - v.x, v.y - r.y, r.y + r.h - v.y)
          ELSE sqrt(greatest(r.x - v.x, 0, v.x - r.x - r.w) ** 2 + greatest(r.y - v.y, 0, v.y - r.y - r.h) ** 2) END AS dist FROM v JOIN r ON r.k = v.k AND r.side <> v.side)"""


@query(f"WITH {_SHIFT} SELECT k, round(max(dist), 8) AS dist FROM f GROUP BY k")
def hausdorff_shift(spark, d):
    k, x, y, w, h = (F.col(c) for c in "kxywh")
    two = shapes.hausdorff(_rect(x, y, w, h), _rect(x + k % 4, y + 1, w + 1, h + k % 3))
    return _rects(spark, d).select("k", F.round(two, 8).alias("dist"))


@query(
    f"""WITH {_RECTS} SELECT k, CASE WHEN w + 10 >= 15 THEN x - 5 + (w + 10 - 15) / 2 ELSE least(greatest(100, x + w + 5 - 15), x - 5) END AS x,
        CASE WHEN h + 10 >= 20 THEN y - 5 + (h + 10 - 20) / 2 ELSE least(greatest(90, y + h + 5 - 20), y - 5) END AS y FROM b"""
)
def panned_view(spark, d):
    view = F.struct(F.lit(100.0).alias("x"), F.lit(90.0).alias("y"), F.lit(15.0).alias("width"), F.lit(20.0).alias("height"))
    box = F.struct("x", "y", F.col("w").alias("width"), F.col("h").alias("height"))
    return _rects(spark, d).select("k", shapes.panned(view, box, 5.0).alias("v")).select("k", "v.x", "v.y")


@query("SELECT c_custkey, round(-tan(radians(c_custkey % 150 - 75) / 2), 6) + 0.0 AS bulge FROM customer")
def arc_through(spark, d):
    k = F.col("c_custkey")
    sweep, r = F.radians((k % 150 - 75) * 2), 3.0 + k % 7

    def at(share: float):
        angle = F.radians(k % 360) + sweep * share
        return G.point(k % 50 + r * F.cos(angle), k % 30 + r * F.sin(angle))

    bulge = shapes.bulge_through(at(0.0), at(0.3), at(1.0))
    return table(spark, d, "customer").select("c_custkey", (F.round(F.coalesce(bulge, F.lit(0.0)), 6) + 0.0).alias("bulge"))


@query(
    """WITH c AS (SELECT c_custkey, 0.53 + c_custkey % 60 AS r, 3.5 + c_custkey % 43 AS turn FROM customer)
       SELECT c_custkey, 2 * r * abs(sin(radians(2.5 * turn))) >= 2 AND 10 * r * sin(radians(turn / 2)) >= 10 AND turn <= 35 AND NOT r BETWEEN 7 AND 24 AS gentle FROM c"""
)
def gentle_chains(spark, d):
    k = F.col("c_custkey")
    chain = F.array(*[G.point(40 + (0.53 + k % 60) * F.cos(F.radians((3.5 + k % 43) * i)), 40 + (0.53 + k % 60) * F.sin(F.radians((3.5 + k % 43) * i))) for i in range(6)])
    return table(spark, d, "customer").select("c_custkey", chain.alias("chain")).select("c_custkey", shapes.gentle(F.col("chain")).alias("gentle"))


@query(
    """SELECT k, CASE WHEN k % 3 = 2 THEN 'M-7 -3.5 L-7 3.5 A7 7 0 0 0 0 -3.5 M7 -3.5 L7 3.5 A7 7 0 0 1 0 -3.5' WHEN k % 3 = 1 THEN 'M-7 7 L-7 -7 A14 14 0 0 1 7 7'
       ELSE 'M-7 -7 L-7 7 A14 14 0 0 0 7 -7' END AS path FROM (SELECT p_partkey AS k FROM part)"""
)
def door_glyphs(spark, d):
    k, x, y, w = (F.col(c) for c in "kxyw")
    out = G.point(x, F.when(k % 3 == 1, y - w).otherwise(y + w))
    return _rects(spark, d).select("k", marks.door_swing(G.point(x, y), G.point(x + w, y), out, F.when(k % 3 == 2, 2).otherwise(1), 14.0).alias("path"))


# names and labels

_KINDS = {"BUILDING": "Meeting Room", "MACHINERY": "Lab", "FURNITURE": "Open Workspace"}


@query(
    """WITH c AS (SELECT c_custkey AS k, c_mktsegment AS kind, c_nationkey AS floor, CASE c_custkey % 3 WHEN 0 THEN c_custkey::VARCHAR WHEN 1 THEN 'B' || c_custkey ELSE 'Wing ' || c_custkey END AS key,
              CASE WHEN c_custkey % 5 = 0 THEN 'Hall' END AS name, CASE WHEN c_custkey % 7 < 3 THEN 'North' END AS wing FROM customer)
       SELECT k, floor || '-' || CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN 'b' ELSE 'wing-' END || k AS id,
              coalesce(name, CASE kind WHEN 'BUILDING' THEN 'Meeting Room' WHEN 'MACHINERY' THEN 'Lab' WHEN 'FURNITURE' THEN 'Open Workspace' ELSE 'Room' END || ' ' || key) AS name,
              CASE WHEN k % 3 < 2 THEN key ELSE coalesce(name, key) END AS label, concat_ws(',', lower(wing), CASE WHEN k % 3 < 2 THEN key END, 'x') AS tags FROM c"""
)
def made_spaces(spark, d):
    k = F.col("c_custkey")
    key = F.concat(F.when(k % 3 == 0, "").when(k % 3 == 1, "B").otherwise("Wing "), k.cast("string"))
    made = marks.space(F.col("c_nationkey").cast("string"), key, F.col("c_mktsegment"), F.when(k % 7 < 3, "North"), _KINDS, name=F.when(k % 5 == 0, "Hall"), tags=F.array(F.lit("x")))
    return table(spark, d, "customer").select(k.alias("k"), made.alias("m")).select("k", "m.id", "m.name", "m.label", F.array_join("m.tags", ",").alias("tags"))


@query(
    """SELECT p_partkey, coalesce(CASE WHEN p_partkey % 2 = 0 THEN p_brand || '|below' END, p_name) || CASE WHEN p_partkey % 3 = 0 THEN '|one caption that is|too long for a line' ELSE '' END
       || CASE WHEN p_partkey % 4 = 0 THEN '|Ada|Byrd|Max' ELSE '' END AS lines FROM part"""
)
def label_blocks(spark, d):
    k = F.col("p_partkey")
    label = F.when(k % 2 == 0, F.concat("p_brand", F.lit("\nbelow")))
    lines = marks.label_lines(label, F.col("p_name"), F.when(k % 3 == 0, "one caption that is too long for a line"), F.when(k % 4 == 0, F.array(F.lit("Ada Byrd"), F.lit("Max"))))
    return table(spark, d, "part").select("p_partkey", F.array_join(lines, "|").alias("lines"))


@query(f"WITH {_RECTS} SELECT k, CASE WHEN w * h >= 60 AND k % 4 = 0 THEN 'Reading Room' END AS caption FROM b")
def captions(spark, d):
    k, x, y, w, h = (F.col(c) for c in "kxywh")
    name = F.when(k % 4 == 0, "Reading Room ").when(k % 4 == 1, "Office ").when(k % 4 == 2, "").otherwise("Hall x")
    return _rects(spark, d).select("k", marks.caption(F.concat(name, F.when(k % 4 < 3, k.cast("string")).otherwise("")), k.cast("string"), _rect(x, y, w, h), 60.0).alias("caption"))


@query(
    """SELECT p_partkey, coalesce((SELECT string_agg('line ' || i || ' needs 4 values', ';' ORDER BY i) FROM range(1, 3 + 1) t(i) WHERE (p_size + i - 1) % 6 < 4), '') || '/' ||
       CASE WHEN p_partkey % 4 < 2 THEN 'door 1 needs 2 values' ELSE '' END || '/' || CASE WHEN p_size % 3 <> 1 THEN 'guide g needs 3 points' ELSE '' END AS problems FROM part"""
)
def patch_problems(spark, d):
    def ones(n):
        return F.array_repeat(F.lit(1.0), n.cast("int"))

    size, key = F.col("p_size"), F.col("p_partkey")
    none = F.array().cast("array<array<double>>")
    guides = F.create_map(F.lit("g"), F.array_repeat(ones(F.lit(2)), (2 + size % 3).cast("int")))
    parts = [
        records.patch_problems(F.array(*[ones((size + i) % 6) for i in range(3)]), none, F.lit(None).cast("map<string,array<array<double>>>")),
        records.patch_problems(none, F.array(ones(key % 4)), F.lit(None).cast("map<string,array<array<double>>>")),
        records.patch_problems(none, none, guides),
    ]
    return table(spark, d, "part").select("p_partkey", F.concat_ws("/", *[F.array_join(p, ";") for p in parts]).alias("problems"))


# numbering and regions


@query("SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS n FROM customer")
def numbered_marks(spark, d):
    return grid.numbered(table(spark, d, "customer").select("c_mktsegment", "c_acctbal", "c_custkey"), "c_mktsegment", "c_acctbal", "c_custkey").drop("c_acctbal")


# Spots of all parts on two floors; wide floors, so that regions stay small.
_SPOTS = "s AS (SELECT DISTINCT p_partkey % 2 AS floor, (p_partkey * 7 // 3) % 97 AS x, (p_partkey * 11 // 5) % 50 AS y FROM part)"
_CELLS = f"""{_SPOTS}, r AS (SELECT floor, x, y, x AS rx, y AS ry FROM s UNION SELECT c.floor, c.x, c.y, r.rx, r.ry FROM r JOIN s c ON c.floor = r.floor AND abs(c.x - r.x) + abs(c.y - r.y) = 1),
    m AS (SELECT floor, x, y, min((rx, ry)) AS least FROM r GROUP BY ALL), g AS (SELECT floor, x, y, least[1] AS region_x, least[2] AS region_y FROM m)"""


def _spots(spark, d, width: int = 97):
    k = F.col("p_partkey")
    return table(spark, d, "part").select((k % 2).alias("floor"), (F.floor(k * 7 / 3) % width).alias("x"), (F.floor(k * 11 / 5) % 50).alias("y"), "p_size")


@query(f"WITH RECURSIVE {_CELLS} SELECT * FROM g")
def cell_regions(spark, d):
    return grid.regions(_spots(spark, d), "floor")


_SIZES = "SELECT floor, region_x, region_y, count(*) AS cells, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM g GROUP BY ALL"


@query(f"WITH RECURSIVE {_CELLS} {_SIZES}")
def region_sizes(spark, d):
    return grid.region_sizes(grid.regions(_spots(spark, d), "floor"), "floor")


@query(
    f"""WITH RECURSIVE {_CELLS}, l AS (SELECT DISTINCT p_partkey % 2 AS floor, (p_partkey * 7 // 3) % 97 AS x, (p_partkey * 11 // 5) % 50 AS y, p_size % 7 AS label FROM part)
        SELECT floor, region_x, region_y, count(DISTINCT label) AS labels FROM g JOIN l USING (floor, x, y) GROUP BY ALL"""
)
def region_labels(spark, d):
    spots = _spots(spark, d).withColumn("label", F.col("p_size") % 7)
    return grid.labels_per_region(grid.regions(spots, "floor"), spots, "floor")


# The same on floors so narrow that nearly all spots touch.
_DENSE_CELLS = _CELLS.replace("% 97", "% 60")


@query(f"WITH RECURSIVE {_DENSE_CELLS} SELECT * FROM g")
def all_cell_regions(spark, d):
    return grid.regions(_spots(spark, d, 60), "floor")


@query(f"WITH RECURSIVE {_DENSE_CELLS} {_SIZES}")
def all_region_sizes(spark, d):
    return grid.region_sizes(grid.regions(_spots(spark, d, 60), "floor"), "floor")


# rasters


def _whole_rects(spark, d):
    return _rects(spark, d).select("k", _rect(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("poly"))


_RASTER = f"{_RECTS}, u AS (SELECT k, unnest(range(x::BIGINT, (x + w)::BIGINT)) AS x, y, h FROM b), c AS (SELECT k, x, unnest(range(y::BIGINT, (y + h)::BIGINT)) AS y FROM u)"


@query(f"WITH {_RASTER}, o AS (SELECT x, y, min(k) AS k FROM c GROUP BY x, y) SELECT k, count(*) AS cells, min(x) AS x, max(y) AS y FROM o GROUP BY k")
def owned_cells(spark, d):
    cells = grid.owned(grid.rasterised(dealt(_whole_rects(spark, d), "k"), 1.0, "k"), "k", keep_cols=("k",))
    return cells.groupBy("k").agg(F.count(F.lit(1)).alias("cells"), F.min("x").alias("x"), F.max("y").alias("y"))


_DENSE_SPOTS = _SPOTS.replace("% 97", "% 60")


def _closed_sql(spots: str) -> str:
    return f"""WITH {spots}, d AS (SELECT DISTINCT floor, x + i AS x, y + j AS y FROM s, range(-1, 2) a(i), range(-1, 2) b(j)),
        e AS (SELECT floor, x + i AS x, y + j AS y FROM d, range(-1, 2) a(i), range(-1, 2) b(j)) SELECT floor, x, y FROM e GROUP BY ALL HAVING count(*) = 9"""


@query(_closed_sql(_SPOTS))
def closed_cells(spark, d):
    return grid.closed(_spots(spark, d), 1, "floor")


@query(_closed_sql(_DENSE_SPOTS))
def all_closed_cells(spark, d):
    return grid.closed(_spots(spark, d, 60), 1, "floor")


def _grown_sql(spots: str, rounds: int) -> str:
    out = f"WITH {spots}, g0 AS (SELECT *, x * 100 + y AS label FROM s WHERE x % 4 = 0)"
    for n in range(rounds):
        out += f""", g{n + 1} AS (SELECT * FROM g{n} UNION ALL SELECT s.floor, s.x, s.y, min(label) FROM s JOIN g{n} g ON g.floor = s.floor AND abs(g.x - s.x) + abs(g.y - s.y) = 1
                WHERE (s.floor, s.x, s.y) NOT IN (SELECT (floor, x, y) FROM g{n}) GROUP BY s.floor, s.x, s.y)"""
    return f"{out} SELECT floor, x, y, label FROM g{rounds}"


def _grown(spots):
    return grid.grown(spots.where("x % 4 = 0").withColumn("label", F.col("x") * 100 + F.col("y")), spots, 3, "floor")


@query(_grown_sql(_SPOTS, 3))
def grown_cells(spark, d):
    return _grown(_spots(spark, d))


@query(_grown_sql(_DENSE_SPOTS, 3))
def all_grown_cells(spark, d):
    return _grown(_spots(spark, d, 60))


@query("SELECT p_partkey, 3 + p_partkey % 5 AS corners, round((3 + p_partkey % 5) / 2 * (2 + p_size % 6) ** 2 * sin(2 * pi() / (3 + p_partkey % 5)), 5) AS area FROM part")
def hull_area(spark, d):
    poly = F.col("poly")
    middles = F.transform(G.edges(poly), lambda e: G.point((e.a.x * 2 + e.b.x) / 3, (e.a.y * 2 + e.b.y) / 3))
    inner = F.transform(middles, lambda p: G.point((p.x + F.get(middles, F.lit(0)).x) / 2, (p.y + F.get(middles, F.lit(0)).y) / 2))
    ring = dealt(_polygons(spark, d), "p_partkey").select("p_partkey", shapes.hull(F.concat(inner, F.reverse(poly), poly)).alias("h"))
    return ring.select("p_partkey", F.size("h").cast("long").alias("corners"), F.round(G.area(F.col("h")), 5).alias("area"))
