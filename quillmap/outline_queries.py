"""Record lists, outlines, pairs within a table and change streams bound to the tables of a data folder, each with its SQL for DuckDB.

The streaming forms run here on a table as on a stream that has ended.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmap.functions import geometry as G
from quillmap.functions import marks, naming, shapes
from quillmap.functions import text as X
from quillmap.operators import matching
from quillmap.plans.storage import dealt, new_path
from quillmap.queries import query
from quillmap.shape_queries import _RECTS, _rect, _rects
from quillmap.sources import records
from quillmap.sources.tables import table
from quillmap.streaming import changes


def _box(x, y, width, height):
    return F.struct(*[v.cast("double").alias(n) for n, v in (("x", x), ("y", y), ("width", width), ("height", height))])


# outlines


@query(f"WITH {_RECTS} SELECT k, CASE WHEN k % 3 = 2 THEN 5 ELSE 4 END AS corners, round(w * h - CASE WHEN k % 3 = 2 THEN 0.05 * w ELSE 0 END, 6) AS area FROM b")
def plain_corners(spark, d):
    """A rectangle whose lower edge has a vertex in its middle that lies 0, 0.05 or 0.1 off the line."""
    x, y, w, h = (F.col(c) for c in "xywh")
    dented = F.array(G.point(x, y), G.point(x + w / 2, y + F.col("k") % 3 * 0.05), G.point(x + w, y), G.point(x + w, y + h), G.point(x, y + h))
    kept = _rects(spark, d).select("k", shapes.without_straight_corners(dented, F.lit(0.08)).alias("p"))
    return kept.select("k", F.size("p").alias("corners"), F.round(F.abs(G.area(F.col("p"))), 6).alias("area"))


@query(f"WITH {_RECTS} SELECT k, round(24 * sin(pi() / 24) * w * h, 5) AS area, round(x - w, 6) AS low, round(2 * h, 6) AS height FROM b")
def ellipses(spark, d):
    x, y, w, h = (F.col(c) for c in "xywh")
    e = _rects(spark, d).select("k", shapes.ellipse(x, y, w, h).alias("p")).select("k", F.round(F.abs(G.area(F.col("p"))), 5).alias("area"), G.bbox(F.col("p")).alias("b"))
    return e.select("k", "area", F.round("b.x", 6).alias("low"), F.round("b.height", 6).alias("height"))


@query(f"WITH {_RECTS} SELECT k, CASE WHEN k % 2 = 0 THEN 5 ELSE 6 END AS corners, CASE WHEN k % 2 = 0 THEN y + 0.25 ELSE y END AS second_y, round(w * h - CASE WHEN k % 2 = 0 THEN 0.25 ELSE 1 END * w, 6) AS area FROM b")
def stepped_outlines(spark, d):
    """Rectangles whose lower edge has a step of 0.5 or of 2 in its middle."""
    x, y, w, h = (F.col(c) for c in "xywh")
    s = F.when(F.col("k") % 2 == 0, 0.5).otherwise(2.0)
    stepped = F.array(*[G.point(*p) for p in ((x, y), (x + w / 2, y), (x + w / 2, y + s), (x + w, y + s), (x + w, y + h), (x, y + h))])
    p = _rects(spark, d).select("k", shapes.without_jogs(stepped, 1.0, 10.0).alias("p"))
    return p.select("k", F.size("p").alias("corners"), F.get("p", F.lit(1)).y.alias("second_y"), F.round(F.abs(G.area(F.col("p"))), 6).alias("area"))


@query(f"WITH {_RECTS} SELECT k, CASE k % 3 WHEN 0 THEN x WHEN 1 THEN x + w + 12 ELSE x + w END AS head_x, CASE k % 3 WHEN 2 THEN y + h + 12 ELSE y END AS head_y FROM b")
def arrow_heads(spark, d):
    """Where lines of one, two and three vertices carry their label."""
    k, x, y, w, h = (F.col(c) for c in "kxywh")
    line = F.slice(F.array(G.point(x, y), G.point(x + w, y), G.point(x + w, y + h)), F.lit(1), (k % 3 + 1).cast("int"))
    head = _rects(spark, d).select("k", marks.arrow_head(line).alias("p"))
    return head.select("k", F.col("p.x").alias("head_x"), F.col("p.y").alias("head_y"))


def _tilted(x, y, w, h, turn):
    """A rectangle turned around its middle by degrees."""
    c, s = F.cos(F.radians(turn)), F.sin(F.radians(turn))
    return F.array(*[G.point(x + w / 2 + i * w / 2 * c - j * h / 2 * s, y + h / 2 + i * w / 2 * s + j * h / 2 * c) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))])


@query(
    f"""WITH {_RECTS}, t AS (SELECT *, CASE WHEN abs(k % 41 - 19.5) <= 15 THEN 0 ELSE radians(k % 41 - 19.5) END AS t FROM b)
       SELECT k, round(x + w / 2 - w / 2 * cos(t) + h / 2 * sin(t), 6) AS first_x, round(y + h / 2 - w / 2 * sin(t) - h / 2 * cos(t), 6) AS first_y,
       round(x + w / 2 + w / 2 * cos(t) - h / 2 * sin(t), 6) AS third_x FROM t"""
)
def axis_boxes(spark, d):
    """Rectangles that stand up to 20.5 degrees off the axis; those within 15 are turned onto it."""
    x, y, w, h = (F.col(c) for c in "xywh")
    p = _rects(spark, d).select("k", shapes.turned_to_axis(_tilted(x, y, w, h, F.col("k") % 41 - 19.5), F.lit(0.0)).alias("p"))
    first, third = F.get("p", F.lit(0)), F.get("p", F.lit(2))
    return p.select("k", F.round(first.x, 6).alias("first_x"), F.round(first.y, 6).alias("first_y"), F.round(third.x, 6).alias("third_x"))


@query(
    f"""WITH {_RECTS} SELECT k, round(w * h, 6) AS own, round((w * cos(radians(k % 80)) + h * sin(radians(k % 80))) * (w * sin(radians(k % 80)) + h * cos(radians(k % 80))), 6) AS level,
       round(w * h, 6) AS along FROM b"""
)
def fitted_boxes(spark, d):
    """Areas of the boxes around tilted rectangles: along the longest edge, level, and along the tilt."""
    x, y, w, h = (F.col(c) for c in "xywh")
    turn = F.col("k") % 80
    p = _rects(spark, d).select("k", turn.cast("double").alias("t"), _tilted(x, y, w, h, turn).alias("p"))

    def size(axis):
        return F.round(F.abs(G.area(shapes.box_of_axis(F.col("p"), axis))), 6)

    return p.select("k", size(None).alias("own"), size(F.lit(0.0)).alias("level"), size(F.col("t")).alias("along"))


@query(
    f"""WITH {_RECTS}, r AS (SELECT k, x, y, w, list_transform(range(0, 9), lambda i: 1 / sqrt((cos(radians(k % 50 + 10 * i)) / (3 * w)) ** 2 + (sin(radians(k % 50 + 10 * i)) / (2 * w + h)) ** 2)) AS far FROM b)
       SELECT k, round(x + far[1] * cos(radians(k % 50)), 6) AS first_x, round(y + far[1] * sin(radians(k % 50)), 6) AS first_y,
       round(sin(radians(10)) / 2 * (list_sum(list_transform(range(1, 9), lambda i: far[i] * far[i + 1])) - 8 * w * w), 5) AS area FROM r"""
)
def bands(spark, d):
    """Bands of 80 degrees between a circle and an ellipse around it."""
    k, x, y, w, h = (F.col(c) for c in "kxywh")

    def ellipse(a, b, turn):
        return F.struct(x.alias("cx"), y.alias("cy"), a.alias("a"), b.alias("b"), turn.alias("turn"))

    rows = _rects(spark, d).select("k", ellipse(w, w, F.lit(30.0)).alias("i"), ellipse(2 * w + h, 3 * w, F.lit(90.0)).alias("o"))
    p = rows.select("k", shapes.band(F.col("i"), F.col("o"), k % 50, k % 50 + 80, 8).alias("p"))
    first = F.get("p", F.lit(0))
    return p.select("k", F.round(first.x, 6).alias("first_x"), F.round(first.y, 6).alias("first_y"), F.round(F.abs(G.area(F.col("p"))), 5).alias("area"))


@query(f"WITH {_RECTS} SELECT k, round(x - 0.3 * w + 0.4 * h, 6) AS first_x, round(y - 0.4 * w - 0.3 * h, 6) AS first_y, round(w * h, 6) AS area FROM b")
def turned_boxes(spark, d):
    x, y, w, h = (F.col(c) for c in "xywh")
    p = _rects(spark, d).select("k", shapes.box_along(x, y, F.lit(0.6), F.lit(0.8), w, h).alias("p"))
    first = F.get("p", F.lit(0))
    return p.select("k", F.round(first.x, 6).alias("first_x"), F.round(first.y, 6).alias("first_y"), F.round(F.abs(G.area(F.col("p"))), 6).alias("area"))


@query(
    f"""WITH {_RECTS} SELECT k, CASE WHEN x <= 100 THEN x - 2 ELSE 0 END AS x, CASE WHEN x <= 100 THEN y - 2 ELSE 0 END AS y,
        CASE WHEN x > 100 THEN 100 WHEN x + w <= 100 THEN w + 4 ELSE 4 END AS width, CASE WHEN x > 100 THEN 80 ELSE 4 END AS height FROM b"""
)
def street_boxes(spark, d):
    x, y, w, h = (F.col(c) for c in "xywh")
    path = F.array(G.point(x, y), G.point(x + w, y), G.point(x + 500, y + h))
    within = _box(F.lit(0), F.lit(0), F.lit(100), F.lit(80))
    return _rects(spark, d).select("k", shapes.street_box(path, F.lit(4.0), within).alias("b")).select("k", "b.*")


# The marks of hooks lie on a grid of whole numbers, so that distances agree to the last bit.
@query(
    """WITH a AS (SELECT range + 2 AS a FROM range(5)), g AS (SELECT a, i::DOUBLE AS y, j::DOUBLE AS x FROM a, range(1, 24) r(i), range(1, 24) s(j) WHERE i < a OR j > 24 - a),
        m AS (SELECT a, x, y, least(y, 24 - x, sqrt(greatest(24 - a - x, 0) ** 2 + (24 - y) ** 2), sqrt((x - 24 + a) ** 2 + greatest(a - y, 0) ** 2),
          sqrt((y - a) ** 2 + greatest(x - 24 + a, 0) ** 2), sqrt(x ** 2 + greatest(y - a, 0) ** 2)) AS far FROM g),
        b AS (SELECT a, x, y FROM m QUALIFY row_number() OVER (PARTITION BY a ORDER BY far DESC, y, x) = 1)
        SELECT p_partkey AS k, (p_partkey % 40) * 10 + x AS x, (p_partkey // 40) * 10 + y AS y FROM part JOIN b ON a = p_partkey % 5 + 2"""
)
def hook_labels(spark, d):
    """Labels of hooks, whose centroids lie outside."""
    a = (F.col("k") % 5 + 2).cast("double")
    x, y = F.col("x"), F.col("y")
    hook = F.array(*[G.point(x + px, y + py) for px, py in ((F.lit(0), F.lit(0)), (F.lit(24), F.lit(0)), (F.lit(24), F.lit(24)), (24 - a, F.lit(24)), (24 - a, a), (F.lit(0), a))])
    # Few rows of much work each: they are dealt to more tasks than their file has.
    return dealt(_rects(spark, d), "k").select("k", hook.alias("p")).select("k", G.label_point(F.col("p")).alias("l")).select("k", "l.x", "l.y")


@query(f"WITH {_RECTS} SELECT k, round((y - 3) / 2, 6) AS x, round((5 - x - w) / 2, 6) AS y, round(h / 2, 6) AS width, round(w / 2, 6) AS height FROM b")
def moved_back(spark, d):
    b = G.bbox(G.moved_back(_rect(*(F.col(c) for c in "xywh")), 2.0, 90.0, 5.0, 3.0))
    return _rects(spark, d).select("k", b.alias("b")).select("k", *[F.round(F.col(f"b.{c}"), 6).alias(c) for c in ("x", "y", "width", "height")])


@query(f"WITH {_RECTS} SELECT k, round((w - 2) * (h - 1) / (2 * w * h - (w - 2) * (h - 1)), 8) AS iou FROM b")
def shifted_boxes(spark, d):
    x, y, w, h = (F.col(c) for c in "xywh")
    return _rects(spark, d).select("k", F.round(G.box_iou(_box(x, y, w, h), _box(x + 2, y + 1, w, h)), 8).alias("iou"))


@query(f"WITH {_RECTS} SELECT k, CASE WHEN k % 4 = 0 THEN 'desk.svg' WHEN k % 4 = 1 AND w >= 9 AND h >= 8 THEN 'steps.svg' WHEN k % 4 = 2 THEN 'cup.svg' END AS icon FROM b")
def icons(spark, d):
    k = F.col("k")
    tags = F.when(k % 4 == 0, F.array(F.lit("red"), F.lit("desk"), F.lit("cafe"))).when(k % 4 == 1, F.array(F.lit("stairs"), F.lit("desk"))).when(k % 4 == 2, F.array(F.lit("cafe")))
    known = {"desk": "desk.svg", "stairs": "steps.svg", "cafe": "cup.svg"}
    return _rects(spark, d).select("k", naming.icon(tags, known, _box(*(F.col(c) for c in "xywh")), ("steps.svg",), 9.0, 8.0).alias("icon"))


# pairs within a table and leftovers of a match


@query(
    """WITH e AS (SELECT p_partkey // 4 AS g, p_partkey % 4 AS place, p_partkey AS a, p_partkey + 1 AS b, (p_partkey * 7) % 5 AS cost FROM part WHERE p_partkey % 4 < 3),
        m AS (SELECT g, max(cost) FILTER (place = 0) AS c0, max(cost) FILTER (place = 1) AS c1, max(cost) FILTER (place = 2) AS c2 FROM e GROUP BY g)
        SELECT a, b FROM e JOIN m USING (g) WHERE (place = 1) = coalesce(c1 < coalesce(c0, 9) AND c1 <= coalesce(c2, 9), false)"""
)
def double_doors(spark, d):
    """Leaves in rows of four, each a candidate for the next one of its row."""
    k = F.col("p_partkey")
    pairs = table(spark, d, "part").where(k % 4 < 3).select(k.alias("a"), (k + 1).alias("b"), (k * 7 % 5).alias("cost"))
    return matching.pair_up(pairs, "a", "b", cost=F.col("cost"))


@query(
    """WITH n AS (SELECT n_nationkey::BIGINT AS dot, n_regionkey AS sheet, n_name FROM nation), s AS (SELECT s_suppkey AS name, n_regionkey AS sheet, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey),
        m AS (SELECT dot, name FROM n JOIN s ON dot = name AND n.sheet = s.sheet),
        l AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY n_name, dot) AS i FROM n WHERE dot NOT IN (SELECT dot FROM m)),
        r AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY s_acctbal, name) AS i FROM s WHERE name NOT IN (SELECT name FROM m))
        SELECT dot, name FROM m UNION ALL SELECT dot, name FROM l JOIN r ON l.sheet = r.sheet AND l.i = r.i"""
)
def zipped_names(spark, d):
    nations = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("dot"), F.col("n_regionkey").alias("sheet"), "n_name")
    sellers = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("name"), F.col("n_regionkey").alias("sheet"), "s_acctbal")
    met = nations.join(sellers.withColumnRenamed("sheet", "there"), (F.col("dot") == F.col("name")) & (F.col("sheet") == F.col("there"))).select("dot", "name")
    return matching.zip_rest(nations, sellers, met, "sheet", "dot", "name", F.col("n_name"), F.col("s_acctbal"))


# records


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END AS bent, p_size + 1.5::DOUBLE AS sum_x FROM part")
def json_vertices(spark, d):
    k, x = F.col("p_partkey"), F.col("p_size").cast("double")
    raw = F.array(F.array(x, F.lit(0.0), (k % 3).cast("double")), F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(0.5), F.lit(2.0), F.lit(0.0)))
    v = table(spark, d, "part").select("p_partkey", records.vertices(raw).alias("v"))
    bent = F.size(F.filter("v", lambda p: p.bulge.isNotNull()))
    return v.select("p_partkey", bent.alias("bent"), F.aggregate("v", F.lit(0.0), lambda s, p: s + p.x).alias("sum_x"))


@query("SELECT p_partkey, i::INTEGER AS pos, p_size + i AS width, CASE WHEN i = 0 AND p_size % 2 = 0 THEN 2 ELSE 1 END AS leaves FROM part, range(2) r(i)")
def door_rows(spark, d):
    size = F.col("p_size")
    one = F.struct(size.alias("width"), F.when(size % 2 == 0, 2).alias("leaves"))
    two = F.struct((size + 1).alias("width"), F.lit(None).cast("int").alias("leaves"))
    return records.doors(table(spark, d, "part").select("p_partkey", F.array(one, two).alias("doors")), "doors")


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 0 WHEN p_partkey % 3 = 0 THEN 1 ELSE 2 END AS n FROM part")
def stored_lists(spark, d):
    """Stored corrections: every fifth text is cut off, every third holds a correction without an id."""
    k = F.col("p_partkey")
    items = F.array(*[F.struct(i.cast("string").alias("id"), F.col("p_brand").alias("text")) for i in (k, F.when(k % 3 != 0, k))])
    stored = F.when(k % 5 == 0, F.substring(F.to_json(items), 1, 12)).otherwise(F.to_json(items))
    return table(spark, d, "part").select("p_partkey", F.size(records.stored_list(stored)).alias("n"))


@query("SELECT p_partkey, concat_ws(' · ', nullif(p_name, ''), CASE WHEN p_size % 2 = 0 THEN nullif(p_type, '') END, nullif(p_brand, '')) AS line FROM part")
def correction_lines(spark, d):
    floor = F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("")
    return table(spark, d, "part").select("p_partkey", X.correction_line(F.col("p_name"), floor, F.col("p_brand")).alias("line"))


@query("SELECT n_nationkey, n_name FROM nation")
def strict_round_trip(spark, d):
    """Nations written in the order of their names and read again with their schema."""
    path = new_path(spark, "listing")
    records.write_ordered(table(spark, d, "nation").select("n_nationkey", "n_name"), path, "n_name")
    return records.strict_json(spark, path, T.StructType([T.StructField("n_nationkey", T.IntegerType()), T.StructField("n_name", T.StringType())]))


# change streams


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_events(spark, d):
    return changes.latest_values(table(spark, d, "events"), "user_id", "event_id", "event_type")


@query("SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def daily_counts(spark, d):
    counts = changes.windowed_counts(table(spark, d, "events"), "ts", "event_type", "1 day", "2 hours")
    return counts.select(F.col("window.start").cast("timestamp").cast("long").alias("day"), "event_type", "n")
