"""The matching, shape and naming operators bound to the tables of a data folder, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.functions import geometry as G
from quillmap.functions import directory, markdown, naming, shapes
from quillmap.operators import analytics, matching
from quillmap.queries import _CORNERS, _POINTS, _points, _polygons, query
from quillmap.sources.tables import table

# greedy matches: suppliers with the nations of their region, by how near two numbers are

_PAIRS = """p AS (SELECT s_suppkey AS s, b.n_nationkey AS n, abs((s_suppkey * 37 % 101) - (b.n_nationkey * 53 % 101))::DOUBLE AS cost
            FROM supplier JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON a.n_regionkey = b.n_regionkey
            WHERE abs((s_suppkey * 37 % 101) - (b.n_nationkey * 53 % 101)) <= 30)"""


def _greedy_sql(order: str) -> str:
    return f"""WITH RECURSIVE {_PAIRS}, o AS (SELECT *, row_number() OVER (ORDER BY {order}) AS i FROM p),
        f AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS ss, []::BIGINT[] AS ns, NULL::BIGINT AS s, NULL::BIGINT AS n, NULL::DOUBLE AS cost, false AS hit UNION ALL
              SELECT o.i, CASE WHEN list_contains(ss, o.s) OR list_contains(ns, o.n) THEN ss ELSE list_append(ss, o.s) END,
                     CASE WHEN list_contains(ss, o.s) OR list_contains(ns, o.n) THEN ns ELSE list_append(ns, o.n) END, o.s, o.n, o.cost,
                     NOT (list_contains(ss, o.s) OR list_contains(ns, o.n)) FROM f JOIN o ON o.i = f.i + 1)
        SELECT s, n, cost FROM f WHERE hit"""


def _pairs(spark, d) -> DataFrame:
    a, b = table(spark, d, "nation"), table(spark, d, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").alias("region"))
    both = table(spark, d, "supplier").join(a, F.col("s_nationkey") == F.col("n_nationkey")).join(b, F.col("n_regionkey") == F.col("region"))
    cost = F.abs(F.col("s_suppkey") * 37 % 101 - F.col("n") * 53 % 101).cast("double")
    return both.select(F.col("s_suppkey").alias("s"), F.col("n").cast("long").alias("n"), cost.alias("cost")).where("cost <= 30")


@query(_greedy_sql("cost, s, n"))
def greedy_match(spark, d):
    return matching.greedy_pairs(_pairs(spark, d), "s", "n", cost=F.col("cost"))


@query(_greedy_sql("n, cost, s"))
def greedy_in_order(spark, d):
    return matching.greedy_pairs(_pairs(spark, d), "s", "n", place=F.col("n"), cost=F.col("cost")).select("s", "n", "cost")


# neighbours

_CENTRES = "k AS (SELECT p_partkey, (p_partkey % 40) * 10.0::DOUBLE AS cx, (p_partkey // 40) * 10.0::DOUBLE AS cy FROM part)"


def _centres(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", (k % 40 * 10.0).alias("x"), (F.floor(k / 40) * 10.0).alias("y"))


@query(
    f"""WITH {_POINTS}, {_CENTRES}, r AS (SELECT c_custkey, px, py, p_partkey, row_number() OVER (PARTITION BY c_custkey ORDER BY sqrt((px - cx) * (px - cx) + (py - cy) * (py - cy)), p_partkey) AS n
          FROM p JOIN k ON sqrt((px - cx) * (px - cx) + (py - cy) * (py - cy)) < 6)
        SELECT k.p_partkey, coalesce(string_agg('n' || r.c_custkey, ' ' ORDER BY py, px), '') AS name FROM k LEFT JOIN r ON r.p_partkey = k.p_partkey AND r.n = 1 GROUP BY k.p_partkey"""
)
def named_numbers(spark, d):
    names = _points(spark, d).withColumn("text", F.concat(F.lit("n"), F.col("c_custkey").cast("string")))
    return matching.named_numbers(names, _centres(spark, d), 6.0, "c_custkey", "p_partkey", "text")


@query(
    f"""WITH {_CORNERS}, {_POINTS}, a AS (SELECT p_partkey, abs(sum(ax * b_y - bx * ay)) / 2 AS area, min(ax) AS x0, max(ax) AS x1, min(ay) AS y0, max(ay) AS y1 FROM e GROUP BY p_partkey),
        c2 AS (SELECT c_custkey, px, py, p_partkey, area FROM p JOIN a ON area >= 20 AND px BETWEEN x0 - 1 AND x1 + 1 AND py BETWEEN y0 - 1 AND y1 + 1),
        q AS (SELECT c_custkey, px, py, p_partkey, area, (ay > py) <> (b_y > py) AND px < (bx - ax) * (py - ay) / (b_y - ay) + ax AS cross_,
              ax, ay, bx - ax AS dx, b_y - ay AS dy, greatest(0.0, least(1.0, ((px - ax) * (bx - ax) + (py - ay) * (b_y - ay)) / ((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)))) AS t FROM c2 JOIN e USING (p_partkey)),
        g AS (SELECT c_custkey, p_partkey, any_value(area) AS area, count_if(cross_) % 2 = 1 AS inside, min(sqrt((px - ax - t * dx) * (px - ax - t * dx) + (py - ay - t * dy) * (py - ay - t * dy))) AS dist FROM q GROUP BY ALL),
        h AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY NOT inside, CASE WHEN inside THEN 0 ELSE dist END, round(area, 6), p_partkey) AS n FROM g WHERE inside OR dist <= 1)
        SELECT p.c_custkey, h.p_partkey, h.inside FROM p LEFT JOIN h ON h.c_custkey = p.c_custkey AND h.n = 1"""
)
def holding_face(spark, d):
    faces = _polygons(spark, d).select("p_partkey", "poly")
    return matching.holding_face(_points(spark, d), faces, 16.0, 1.0, 20.0, "c_custkey", "p_partkey").select("c_custkey", "p_partkey", "inside")


# rectangles of different widths, as polygons in Spark and as boxes in SQL

_RECTS = "b AS (SELECT p_partkey AS k, p_type, (p_partkey % 40) * 10.0::DOUBLE AS x, (p_partkey // 40) * 10.0::DOUBLE AS y, (4 + p_size % 11)::DOUBLE AS w, (3 + p_partkey % 13)::DOUBLE AS h FROM part)"


def _rects(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    x, y, w, h = k % 40 * 10.0, F.floor(k / 40) * 10.0, (4 + F.col("p_size") % 11).cast("double"), (3 + k % 13).cast("double")
    return table(spark, d, "part").select(k.alias("k"), "p_type", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def _rect(x, y, w, h):
    return F.array(G.point(x, y), G.point(x + w, y), G.point(x + w, y + h), G.point(x, y + h))


@query(
    f"""WITH {_RECTS} SELECT * FROM (SELECT a.k AS a, b.k AS b, greatest(0.0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0.0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS area
        FROM b a JOIN b ON a.k < b.k AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h) WHERE area >= 0.5"""
)
def overlap_pairs(spark, d):
    poly = _rect(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    return matching.overlaps(_rects(spark, d).select("k", poly.alias("poly")), 16.0, "k")


_TRACED = f"""{_RECTS}, t AS (SELECT k, x + k % 3 AS x, y, w, h + k % 2 AS h FROM b WHERE w <> 9),
              m AS (SELECT b.k, p_type, greatest(0.0, least(b.x + b.w, t.x + t.w) - greatest(b.x, t.x)) * greatest(0.0, least(b.y + b.h, t.y + t.h) - greatest(b.y, t.y)) AS shared, b.w * b.h AS one, t.w * t.h AS two FROM b LEFT JOIN t USING (k)),
              j AS (SELECT k, p_type, CASE WHEN two IS NOT NULL THEN round(shared / (one + two - shared), 9) END AS iou FROM m)"""


def _traced(spark, d) -> DataFrame:
    """Committed rectangles with the overlap of traced ones, which are shifted; those of one width were not traced."""
    old = _rects(spark, d)
    k = F.col("k")
    new = old.where("w <> 9").select("k", _rect(F.col("x") + k % 3, F.col("y"), F.col("w"), F.col("h") + k % 2).alias("traced"))
    both = old.join(new, "k", "left")
    iou = F.when(F.col("traced").isNotNull(), F.round(shapes.convex_iou(_rect(F.col("x"), F.col("y"), F.col("w"), F.col("h")), F.col("traced")), 9))
    return both.select("k", "p_type", iou.alias("iou"))


@query(
    f"""WITH {_TRACED} SELECT p_type, count(*) AS n, count_if(iou IS NULL) AS missing, count_if(iou >= 0.95) AS iou_0_95, count_if(iou >= 0.9) AS iou_0_9, count_if(iou >= 0.8) AS iou_0_8,
        list_sort(list(iou) FILTER (iou IS NOT NULL))[(count(iou) // 2 + 1)::INT] AS middle FROM j GROUP BY p_type"""
)
def parity_report(spark, d):
    return analytics.parity(_traced(spark, d), "p_type", "iou")


@query(f"WITH {_TRACED} SELECT k, iou FROM j WHERE iou IS NULL OR iou < 0.8 ORDER BY iou NULLS FIRST, k")
def parity_worst(spark, d):
    return analytics.worst(_traced(spark, d), "iou", "k").select("k", "iou")


_KIND = "CASE WHEN k % 3 = 0 THEN 'pocket' WHEN k % 29 = 0 THEN 'large' ELSE 'room' END"


@query(
    f"""WITH {_RECTS}, z AS (SELECT k, x, y, w * 0.6 AS w, h * 0.6 AS h, {_KIND} AS kind FROM b),
        n AS (SELECT a.k AS pocket, count_if(b.kind = 'room') AS n, count_if(b.kind = 'large') AS large, min(CASE WHEN b.kind = 'room' THEN b.k END) AS room FROM z a JOIN z b ON a.k <> b.k
              AND a.x - 1 <= b.x + b.w + 1 AND b.x - 1 <= a.x + a.w + 1 AND a.y - 1 <= b.y + b.h + 1 AND b.y - 1 <= a.y + a.h + 1 WHERE a.kind = 'pocket' GROUP BY a.k)
        SELECT pocket, room FROM n WHERE n = 1 AND large = 0"""
)
def pocket_rooms(spark, d):
    kind = F.when(F.col("k") % 3 == 0, "pocket").when(F.col("k") % 29 == 0, "large").otherwise("room")
    box = F.struct("x", "y", (F.col("w") * 0.6).alias("width"), (F.col("h") * 0.6).alias("height"))
    return matching.sole_neighbour(_rects(spark, d).select("k", box.alias("box"), kind.alias("kind")), 16.0, 2.0, "k")


# strokes and lines

_STROKES = """s AS (SELECT c_custkey AS k, (c_custkey % 61) * 9.0::DOUBLE AS mx, (c_custkey % 7) * 9.0::DOUBLE AS my, 10.0 + c_custkey % 5 AS len, radians((c_custkey * 23) % 180) AS t FROM customer),
              st AS (SELECT k, mx - cos(t) * len / 2 AS ax, my - sin(t) * len / 2 AS ay, mx + cos(t) * len / 2 AS bx, my + sin(t) * len / 2 AS b_y FROM s)"""


@query(
    f"""WITH {_STROKES} SELECT a.k AS a, b.k AS b FROM s a JOIN s b ON a.mx = b.mx AND a.my = b.my AND a.k < b.k WHERE abs(a.len - b.len) <= 3.5
        AND least((a.k * 23 % 180 - b.k * 23 % 180 + 180) % 180, (b.k * 23 % 180 - a.k * 23 % 180 + 180) % 180) BETWEEN 61 AND 120"""
)
def crossing_strokes(spark, d):
    k = F.col("c_custkey")
    mx, my, n, t = k % 61 * 9.0, k % 7 * 9.0, 10.0 + k % 5, F.radians((k * 23) % 180)
    st = table(spark, d, "customer").select(k.alias("k"), *[(m + s * f(t) * n / 2).alias(c) for c, m, s, f in (("ax", mx, -1, F.cos), ("ay", my, -1, F.sin), ("bx", mx, 1, F.cos), ("b_y", my, 1, F.sin))])
    return matching.crossing_strokes(st, "k", 3.0, 3.5, 60.5, 120.0)


_LINES = "l AS (SELECT s_suppkey AS k, s_nationkey AS own, (s_suppkey * 41 % 360) / 2.0::DOUBLE AS angle, (s_suppkey * 17 % 400) / 4.0::DOUBLE AS o, 1.0 + s_suppkey % 9 AS w FROM supplier)"
_PARALLEL = f"{_LINES}, m AS (SELECT a.k AS a, b.k AS b FROM l a JOIN l b ON a.k < b.k AND a.own <> b.own AND least((a.angle - b.angle + 180) % 180, (b.angle - a.angle + 180) % 180) <= 12 AND abs(a.o - b.o) <= 3)"


def _lines(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("k"), F.col("s_nationkey").alias("own"), (k * 41 % 360 / 2).alias("angle"), (k * 17 % 400 / 4).alias("offset"), (1.0 + k % 9).alias("w"))


@query(f"WITH {_PARALLEL} SELECT a, b FROM m")
def parallel_pairs(spark, d):
    return matching.near_parallel(_lines(spark, d), "k", "own", 12.0, 3.0)


@query(
    f"""WITH RECURSIVE {_PARALLEL}, u AS (SELECT a, b FROM m UNION SELECT b, a FROM m), r AS (SELECT a AS k, a AS label FROM u UNION SELECT u.b, r.label FROM r JOIN u ON u.a = r.k),
        c AS (SELECT k, min(label) AS label FROM r GROUP BY k), s AS (SELECT label, sum(w * cos(radians(angle))) AS c, sum(w * sin(radians(angle))) AS s, sum(w * o) / sum(w) AS o FROM c JOIN l USING (k) GROUP BY label)
        SELECT label, round(c / sqrt(c * c + s * s), 8) + 0.0 AS nx, round(s / sqrt(c * c + s * s), 8) + 0.0 AS ny, round(o, 8) AS "offset" FROM s"""
)
def mean_lines(spark, d):
    lines = _lines(spark, d)
    groups = matching.parallel_groups(lines, "k", "own", 12.0, 3.0)
    found = analytics.mean_line(lines.join(groups, F.col("k") == F.col("node")).withColumn("angle", F.radians("angle")), "label", "angle", "offset", "w")
    return found.select("label", *[(F.round(c, 8) + 0.0).alias(c) for c in ("nx", "ny", "offset")])


@query(
    f"""WITH {_RECTS}, o AS (SELECT s_suppkey AS suite, (s_suppkey % 13) * 30.0::DOUBLE + 0.13 AS x, (s_suppkey % 17) * 25.0::DOUBLE + 0.13 AS y FROM supplier)
        SELECT b.k, suite FROM b JOIN o ON (b.x + b.w / 2 > o.x AND b.x + b.w / 2 < o.x + 21.3 AND b.y + b.h / 2 > o.y AND b.y + b.h / 2 < o.y + 17.7)
                                        OR (o.x + 10.65 > b.x AND o.x + 10.65 < b.x + b.w AND o.y + 8.85 > b.y AND o.y + 8.85 < b.y + b.h)"""
)
def suite_members(spark, d):
    rooms = _rects(spark, d).select("k", _rect(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("poly"), (F.col("x") + F.col("w") / 2).alias("x"), (F.col("y") + F.col("h") / 2).alias("y"))
    k = F.col("s_suppkey")
    x, y = k % 13 * 30.0 + 0.13, k % 17 * 25.0 + 0.13
    suites = table(spark, d, "supplier").select(k.alias("suite"), _rect(x, y, F.lit(21.3), F.lit(17.7)).alias("poly"), (x + 10.65).alias("x"), (y + 8.85).alias("y"))
    return matching.members(rooms, suites, 16.0, "k", "suite")


# shapes of one row


@query(
    f"""WITH {_CORNERS}, u AS (SELECT e.p_partkey, e.i, (bx - ax) / sqrt((bx - ax) ** 2 + (b_y - ay) ** 2) AS ux, (b_y - ay) / sqrt((bx - ax) ** 2 + (b_y - ay) ** 2) AS uy FROM e),
        r AS (SELECT u.p_partkey, u.i, (max(x * ux + y * uy) - min(x * ux + y * uy)) * (max(y * ux - x * uy) - min(y * ux - x * uy)) AS area FROM u JOIN c ON c.p_partkey = u.p_partkey GROUP BY ALL)
        SELECT p_partkey, round(min(area), 4) AS area FROM r GROUP BY p_partkey"""
)
def least_rectangle(spark, d):
    return _polygons(spark, d).select("p_partkey", F.round(shapes.least_rectangle(F.col("poly")).area, 4).alias("area"))


@query(
    """WITH v AS (SELECT c_custkey, (c_custkey % 90)::DOUBLE AS x, (c_custkey % 70)::DOUBLE AS y, 100.0::DOUBLE AS w, least(200.0, greatest(12.5, 100.0 / exp(c_acctbal / 1000))) AS nw FROM customer)
       SELECT c_custkey, round(50 - (50 - x) * (nw / w), 6) + 0.0 AS x, round(40 - (40 - y) * (nw / w), 6) + 0.0 AS y, round(nw, 6) AS width, round(80 * (nw / w), 6) AS height FROM v"""
)
def zoomed_view(spark, d):
    k = F.col("c_custkey")
    view = F.struct((k % 90).cast("double").alias("x"), (k % 70).cast("double").alias("y"), F.lit(100.0).alias("width"), F.lit(80.0).alias("height"))
    z = table(spark, d, "customer").select("c_custkey", shapes.zoomed(view, F.lit(100.0), F.exp(F.col("c_acctbal") / 1000), F.lit(50.0), F.lit(40.0)).alias("z"))
    return z.select("c_custkey", *[(F.round(f"z.{c}", 6) + 0.0).alias(c) for c in ("x", "y", "width", "height")])


@query(f"WITH {_RECTS} SELECT p_type, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS width, max(y + h) - min(y) AS height FROM b GROUP BY p_type")
def union_boxes(spark, d):
    box = F.struct("x", "y", F.col("w").alias("width"), F.col("h").alias("height"))
    return _rects(spark, d).select("p_type", box.alias("box")).groupBy("p_type").agg(shapes.union_box().alias("u")).select("p_type", "u.*")


@query(f"WITH {_POINTS} SELECT c_custkey % 5 AS floor, (min(px) - 20)::DOUBLE AS x, (min(py) - 20)::DOUBLE AS y, (max(px) - min(px) + 40)::DOUBLE AS width, (max(py) - min(py) + 40)::DOUBLE AS height FROM p GROUP BY ALL")
def outline_frame(spark, d):
    return analytics.frame(_points(spark, d).withColumn("floor", F.col("c_custkey") % 5), "floor")


@query("WITH v AS (SELECT DISTINCT c_mktsegment, c_acctbal FROM customer), g AS (SELECT c_mktsegment, c_acctbal - lag(c_acctbal) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) AS gap FROM v) SELECT c_mktsegment, round(min(gap), 6) AS pitch FROM g GROUP BY c_mktsegment")
def least_gap(spark, d):
    return analytics.least_gap(table(spark, d, "customer"), "c_mktsegment", "c_acctbal").withColumn("pitch", F.round("pitch", 6))


@query(
    """SELECT p_partkey, 'M' || x || ' ' || y || ' L' || (x + 4) || ' ' || y || ' L' || (x + 4) || ' ' || (y + 3) || ' Z' AS path, (x + 2)::DOUBLE AS centre,
       least(x::DOUBLE % 3, 3 - x::DOUBLE % 3) AS dist FROM (SELECT p_partkey, p_partkey % 40 AS x, p_size AS y FROM part)"""
)
def path_text(spark, d):
    x, y = (F.col("p_partkey") % 40).cast("double"), F.col("p_size").cast("double")
    poly = F.array(G.point(x, y), G.point(x + 4, y), G.point(x + 4, y + 3))
    square = _rect(F.lit(0.0), F.lit(-100.0), F.lit(3.0), F.lit(200.0))
    b = G.bbox(poly)
    return table(spark, d, "part").select("p_partkey", G.svg_path(poly).alias("path"), (b.x + b.width / 2).alias("centre"), G.edge_distance(square, F.pmod(x, F.lit(3.0)), F.lit(0.0)).alias("dist"))


# names

_PLAN = ("FACULTY OFFICE", "HUDDLE", "OPEN OFFICE", "MRI LAB", "GREEN ROOM", "PIAZZA INFORMAL COLLAB", "IT HELP", "PROJECT RM.", "CORRIDOR", "O'NEIL STUDY", "TA HOURS", "", "COPY/PRINTER")


# The categories of these names, by hand from the words in them.
_KINDS = ("office", "meeting", "open", "lab", "amenity", "study", "service", "meeting", "circulation", "study", "study", "office", "copy")

_SHOWN = ("Office", "Huddle Room", "Open Office", "MRI Lab", "Green Room", "Piazza – Informal Collab", "IT Help", "Project Room", "Corridor", "O''Neil Study", "TA Hours", "Room", "Copy/Printer")


@query(
    f"""WITH n AS (SELECT p_partkey, [{", ".join("'" + p.replace("'", "''") + "'" for p in _PLAN)}][p_partkey % 13 + 1] AS name, [{", ".join(f"'{s}'" for s in _SHOWN)}][p_partkey % 13 + 1] AS shown,
        CASE WHEN p_partkey % 31 = 0 THEN 'CORR' ELSE '' END || p_partkey AS number FROM part)
        SELECT p_partkey, CASE WHEN p_partkey % 31 = 0 THEN 'circulation' ELSE {list(_KINDS)}[p_partkey % 13 + 1] END AS category, shown || ' ' || number AS display FROM n"""
)
def plan_names(spark, d):
    k = F.col("p_partkey")
    name = F.get(F.array(*[F.lit(p) for p in _PLAN]), (k % 13).cast("int"))
    number = F.concat(F.when(k % 31 == 0, "CORR").otherwise(""), k.cast("string"))
    return table(spark, d, "part").select("p_partkey", naming.category(name, number).alias("category"), naming.display_name(name, number).alias("display"))


@query("SELECT conv_id, turn, NULL::VARCHAR AS title, '<h3>' || role || E'</h3>\\n<ul>\\n<li>turn <strong>' || turn || E'</strong> goes on</li>\\n</ul>\\n<hr>\\n<p>by <code>a &lt; *b*</code> and <em>' || role || '</em></p>' AS html FROM conversations WHERE role IS NOT NULL AND turn IS NOT NULL")
def markdown_html(spark, d):
    source = F.concat(F.lit("## "), F.col("role"), F.lit("\n\n- turn **"), F.col("turn").cast("string"), F.lit("**\n  goes on\n---\nby `a < *b*`\nand *"), F.col("role"), F.lit("*\n"))
    rows = table(spark, d, "conversations").where("role is not null and turn is not null")
    return rows.select("conv_id", "turn", markdown.rendered(source).alias("m")).select("conv_id", "turn", "m.title", "m.html")


# directory pages and annotations


@query("SELECT (100 + c_custkey % 800)::VARCHAR AS room, string_agg(initcap_ || ' N' || c_custkey, ',' ORDER BY c_custkey) AS names FROM (SELECT *, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS initcap_ FROM customer) GROUP BY ALL")
def directory_rooms(spark, d):
    k = F.col("c_custkey").cast("string")
    room = (100 + F.col("c_custkey") % 800).cast("string")
    html = F.concat(F.lit('<div><h3><a href="/x/People/p'), k, F.lit('">N'), k, F.lit(", "), F.initcap("c_mktsegment"), F.lit("</a></h3>\n<p><strong>Professor</strong><br/> Tower Building, Room "), room, F.lit(" &amp; 555<br><strong>Email</strong> 999 Tower</p></div>"))
    found = directory.entries(table(spark, d, "customer").select("c_custkey", html.alias("html")), "c_custkey", "html", "/People/", "Tower")
    return directory.people_of_rooms(found, "c_custkey").select("room", F.array_join("names", ",").alias("names"))


@query(
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_linenumber * 10 + l_quantity % 7 AS down FROM lineitem), g AS (SELECT *, CASE WHEN down - lag(down) OVER w > 11 THEN 1 ELSE 0 END AS cut FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY down, l_linenumber)),
       b AS (SELECT *, sum(cut) OVER (PARTITION BY l_orderkey ORDER BY down, l_linenumber) AS block FROM g), t AS (SELECT l_orderkey, block, string_agg(l_linenumber::VARCHAR, ' ' ORDER BY down, l_linenumber) AS text FROM b GROUP BY ALL)
       SELECT l_orderkey, string_agg(text, '|' ORDER BY block) AS blocks FROM t GROUP BY l_orderkey"""
)
def stacked_lines(spark, d):
    n = F.col("l_linenumber")
    line = F.struct((n * 10 + F.col("l_quantity") % 7).alias("down"), F.lit(0.0).alias("a0"), F.lit(9.0).alias("a1"), F.lit(10.0).alias("size"), n.cast("string").alias("text"))
    rooms = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"))
    return rooms.select("l_orderkey", F.array_join(F.transform(directory.stacked(F.col("lines"), 1.1), lambda b: F.array_join(b, " ")), "|").alias("blocks"))


@query("SELECT c_custkey, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' Stone;Max Byrd' AS names, '31' || (c_custkey % 90 + 10) || ';Scholars' AS dropped FROM customer")
def annotation_names(spark, d):
    lines = F.array(F.concat(F.lit("Staff "), F.initcap("c_mktsegment"), F.lit(" Stone (away) & Max")), F.lit("Byrd,"), F.concat(F.lit("31"), (F.col("c_custkey") % 90 + 10).cast("string")), F.lit("; Scholars"))
    found = table(spark, d, "customer").select("c_custkey", directory.block_names(lines, frozenset({"staff", "scholars"})).alias("f"))
    return found.select("c_custkey", F.array_join("f.names", ";").alias("names"), F.array_join("f.dropped", ";").alias("dropped"))


@query(
    f"""WITH {_RECTS} SELECT k, least(greatest(px, x), x + w) AS on_x, y + h AS on_y, sqrt((px - least(greatest(px, x), x + w)) ** 2 + 4) AS distance
        FROM (SELECT *, x + k % 20 AS px FROM b)"""
)
def snapped_doors(spark, d):
    r = _rects(spark, d)
    doors = r.select("k", (F.col("x") + F.col("k") % 20).alias("x"), (F.col("y") + F.col("h") + 2).alias("y"))
    rooms = r.select("k", _rect(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("poly"))
    return matching.snapped(doors, rooms, "k", "k").select("k", "on_x", "on_y", "distance")
