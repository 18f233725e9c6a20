"""Lists, panels, filters and further matching bound to the tables of a data folder, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmap.functions import cards, shapes
from quillmap.functions import geometry as G
from quillmap.operators import analytics, grid, matching, relate, search, spatial
from quillmap.queries import _CORNERS, _POINTS, _VECTORS, _asked, _candidates, _points, _polygons, _vectors, query
from quillmap.shape_queries import _LINES, _RECTS, _lines, _rect, _rects
from quillmap.sources.tables import table

# search


def _person_sql(t: str) -> str:
    return f"""CASE WHEN n = '{t}' OR k = '{t}' OR p = '{t}' THEN 100 WHEN len(list_filter(string_split_regex(p, '\\s+'), lambda w: starts_with(w, '{t}'))) > 0 THEN 60 WHEN contains(p, '{t}') THEN 45
      WHEN starts_with(n, '{t}') THEN 40 WHEN contains(n, '{t}') THEN 25 WHEN contains(k, '{t}') THEN 20 WHEN contains(d, '{t}') THEN 5 ELSE -1000000 END"""


@query(
    f"""SELECT p_partkey, p_type, score FROM (SELECT p_partkey, p_type, {_person_sql("wid")} + {_person_sql("brand#1")} AS score
        FROM (SELECT *, lower(p_type) AS n, p_partkey::VARCHAR AS k, lower(p_name) AS p, 'made by ' || lower(p_brand) AS d FROM part)) WHERE score > 0 ORDER BY score DESC, p_type, p_partkey LIMIT 20"""
)
def ranked_search_people(spark, d):
    found = search.ranked_search(table(spark, d, "part"), " Wid  BRAND#1 ", id_col="p_partkey", name=F.col("p_type"), order=F.col("p_partkey"), people=F.array("p_name"), description=F.concat(F.lit("Made by "), "p_brand"), limit=20)
    return found.select("p_partkey", "p_type", "score")


@query(
    """SELECT c_custkey, c_mktsegment <> 'FURNITURE' AS searchable, c_mktsegment NOT IN ('FURNITURE') AND c_name <> 'Customer#000000001' AND c_mktsegment IN ('BUILDING', 'FURNITURE') AS listed,
       c_nationkey % 5 = 2 AND c_custkey <> 7 AND c_mktsegment <> 'FURNITURE' AND c_mktsegment IN ('BUILDING', 'AUTOMOBILE') AS navigable, c_nationkey % 5 = 2 AS drawn,
       c_nationkey % 5 = 2 AND c_acctbal > 0 AS marked FROM customer"""
)
def map_filters(spark, d):
    kind, here = F.col("c_mktsegment"), F.col("c_nationkey") % 5 == 2
    at = F.when(F.col("c_acctbal") > 0, F.struct("c_acctbal"))
    return table(spark, d, "customer").select(
        "c_custkey",
        search.searchable(kind, ("FURNITURE",)).alias("searchable"),
        search.listed(kind, F.col("c_name"), ("FURNITURE",), "Customer#000000001", ["BUILDING", "FURNITURE"]).alias("listed"),
        search.navigable(kind, here, F.col("c_custkey") == 7, ("FURNITURE",), ["BUILDING", "AUTOMOBILE"]).alias("navigable"),
        here.alias("drawn"),
        (here & at.isNotNull()).alias("marked"),
    )


@query("SELECT event_id, CASE WHEN user_id % 6 > 0 THEN ((event_id % 8 + CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END) % (user_id % 6) + user_id % 6) % (user_id % 6) END AS active FROM events")
def wrapped_index(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select("event_id", cards.next_index(i % 8, F.when(i % 3 == 0, -1).otherwise(1), F.col("user_id") % 6).alias("active"))


# panels and lists

_PEOPLE = "CASE WHEN p_size % 4 = 0 THEN []::VARCHAR[] WHEN p_size % 4 = 1 THEN [p_name] ELSE [p_name, p_brand] END"


def _people():
    empty = F.array().cast("array<string>")
    return F.when(F.col("p_size") % 4 == 0, empty).when(F.col("p_size") % 4 == 1, F.array("p_name")).otherwise(F.array("p_name", "p_brand"))


@query(
    f"""WITH s AS (SELECT *, {_PEOPLE} AS people, CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN 'Dept ' || p_type END AS dept FROM part)
        SELECT p_partkey, CASE WHEN len(people) > 0 THEN p_type || ' · ' || array_to_string(people, ', ') ELSE p_type END AS title,
        array_to_string(list_filter([array_to_string(people, ', '), coalesce(dept, '')], lambda x: x <> ''), ' · ') AS subtitle,
        CASE WHEN len(people) > 0 THEN p_type || ', ' || array_to_string(people, ', ') ELSE p_type END AS spoken,
        array_to_string(list_filter(['Floor=' || p_partkey % 5, CASE WHEN p_size % 2 = 0 THEN 'Wing=Northeast' END, 'Type=' || p_type, CASE WHEN dept <> '' THEN 'Department=' || dept END,
          CASE len(people) WHEN 0 THEN NULL WHEN 1 THEN 'Occupant=' || people[1] ELSE 'Occupants=' || array_to_string(people, chr(10)) END,
          CASE WHEN p_size % 7 <> 0 THEN 'Capacity=' || p_size % 7 END, CASE WHEN p_partkey % 2 = 0 THEN 'Tags=' || p_brand || ' new' END], lambda x: x IS NOT NULL), ';') AS facts FROM s"""
)
def space_cards(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    dept = F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit("Dept "), "p_type"))
    tags = F.when(k % 2 == 0, F.array("p_brand", F.lit("new")))
    told = cards.facts((k % 5).cast("string"), F.when(size % 2 == 0, "Northeast").otherwise(""), F.col("p_type"), dept, _people(), size % 7, tags)
    lines = F.array_join(F.transform(told, lambda f: F.concat(f.label, F.lit("="), f.value)), ";")
    name = F.col("p_type")
    return table(spark, d, "part").select("p_partkey", cards.title(name, _people()).alias("title"), cards.subtitle(_people(), dept).alias("subtitle"), cards.spoken(name, _people()).alias("spoken"), lines.alias("facts"))


@query(
    """SELECT p_partkey, array_to_string(list_sort(list_distinct([p_type, lower(p_brand), 'suite'] || CASE WHEN p_size % 2 = 0 THEN ['PROMO', p_type] ELSE []::VARCHAR[] END)), ',') AS tags,
       array_to_string(CASE WHEN p_type IN ('PROMO', 'SMALL') THEN list_filter(['PROMO', 'SMALL'], lambda x: x <> p_type) ELSE ['PROMO', 'SMALL', p_type] END, ',') AS toggled FROM part"""
)
def tag_lists(spark, d):
    own = F.array(F.col("p_type"), F.lower("p_brand"), F.lit("suite"))
    more = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("PROMO"), F.col("p_type")))
    chosen = F.array(F.lit("PROMO"), F.lit("SMALL"))
    return table(spark, d, "part").select("p_partkey", F.array_join(cards.merged_tags(own, more), ",").alias("tags"), F.array_join(cards.toggled(chosen, F.col("p_type")), ",").alias("toggled"))


@query(
    """WITH c AS (SELECT p_partkey, (p_size % 11) / 10.0::DOUBLE AS r, (p_partkey % 3) / 2.0::DOUBLE AS g, (p_partkey % 5) / 4.0::DOUBLE AS b FROM part)
       SELECT p_partkey, r > 0.97 AND g > 0.97 AND b > 0.97 AS white, r < 0.05 AND g < 0.05 AND b < 0.05 AS black, printf('#%02x%02x%02x', round(r * 255)::INT, round(g * 255)::INT, round(b * 255)::INT) AS hex FROM c"""
)
def colour_tests(spark, d):
    from quillmap.functions.text import hex_colour

    k = F.col("p_partkey")
    c = (F.col("p_size") % 11 / 10.0, k % 3 / 2.0, k % 5 / 4.0)
    return table(spark, d, "part").select("p_partkey", cards.is_white(*c).alias("white"), cards.is_black(*c).alias("black"), hex_colour(*c).alias("hex"))


@query(
    """SELECT event_id, starts_with(event_type, 'c') AND value <= 8.6 AND NOT regexp_full_match(CASE WHEN event_id % 3 = 0 THEN event_id::VARCHAR || ' ' ELSE props END, '[0-9\\s]*') AS kept FROM events"""
)
def annotation_filter(spark, d):
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.col("event_id").cast("string"), F.lit(" "))).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", cards.annotation_kept(F.col("event_type"), F.col("value"), text, "c", 8.6).alias("kept"))


@query(
    """WITH c AS (SELECT c_custkey, c_nationkey % 5 AS floor, CASE WHEN c_custkey % 4 = 0 THEN c_name || ' (' || c_custkey || ')' WHEN c_custkey % 4 = 1 THEN c_custkey::VARCHAR
         WHEN c_custkey % 4 = 2 THEN 'point (' || c_custkey % 90 || ', ' || c_custkey % 70 || ')' ELSE 'floor' END AS place, CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_mktsegment END AS who, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE ' move it ' END AS note FROM customer)
       SELECT 0::BIGINT AS pos, 'Map corrections (' || count(*) || ')' AS line FROM c UNION ALL
       SELECT row_number() OVER (ORDER BY c_custkey), '- Floor ' || floor || ' · ' || place || CASE WHEN trim(who) <> '' THEN ' · name/occupant: ' || trim(who) ELSE '' END || ' · ' || CASE WHEN trim(note) = '' THEN '(no note)' ELSE trim(note) END FROM c"""
)
def corrections_report(spark, d):
    k = F.col("c_custkey")
    place = cards.correction_place(F.when(k % 4 == 0, F.col("c_name")), F.when(k % 4 <= 1, k.cast("string")), F.when(k % 4 == 2, k % 90), F.when(k % 4 == 2, k % 70))
    line = cards.report_line((F.col("c_nationkey") % 5).cast("string"), place, F.when(k % 3 == 0, " ").otherwise(F.col("c_mktsegment")), F.when(k % 5 == 0, "").otherwise(" move it "))
    return relate.report("Map corrections", table(spark, d, "customer").select("c_custkey", line.alias("line")), "c_custkey", "line")


@query(
    """WITH p AS (SELECT 'customer ' || c_custkey AS problem FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'part ' || p_partkey FROM part WHERE p_size = 50)
       SELECT count(*) AS n, CASE count(*) WHEN 0 THEN 'no problems' WHEN 1 THEN '1 problem' ELSE count(*) || ' problems' END AS summary FROM p"""
)
def problem_summary(spark, d):
    return relate.problem_summary(_problems(spark, d))


def _problems(spark, d):
    idle = relate.unmatched(table(spark, d, "customer"), "c_custkey", table(spark, d, "orders"), "o_custkey").select(F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("problem"))
    large = table(spark, d, "part").where("p_size = 50").select(F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("problem"))
    return relate.problems_in_order([idle, large])


@query(
    """SELECT 0 AS section, 'customer ' || c_custkey AS problem FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 1, 'part ' || p_partkey FROM part WHERE p_size = 50"""
)
def problem_list(spark, d):
    return _problems(spark, d)


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def floor_dimension(spark, d):
    rows = relate.with_dimension(table(spark, d, "customer"), table(spark, d, "nation"), "c_nationkey", "n_nationkey")
    return relate.with_dimension(rows, table(spark, d, "region"), "n_regionkey", "r_regionkey").select("c_custkey", "n_name", "r_name")


# orders of lists


@query("SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS n FROM part")
def by_level(spark, d):
    """Floors by level, the highest first, and pieces by area, the largest first: one rule."""
    rows = table(spark, d, "part").select("p_brand", "p_partkey", (-F.col("p_size")).alias("level"))
    return grid.numbered(rows, "p_brand", "level", "p_partkey").select("p_brand", "p_partkey", "n")


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_custkey::VARCHAR) AS n FROM customer")
def directory_order(spark, d):
    rows = table(spark, d, "customer").select(F.lit(0).alias("all"), "c_custkey", F.col("c_custkey").cast("string").alias("room"))
    return grid.numbered(rows, "all", "room").select("c_custkey", "n")


@query("SELECT l_returnflag, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_discount, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem")
def diff_order(spark, d):
    order = ("l_discount", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return grid.numbered(table(spark, d, "lineitem").select("l_returnflag", *order), "l_returnflag", *order).select("l_returnflag", "l_orderkey", "l_linenumber", "n")


# shapes and matches


@query(f"WITH {_RECTS} SELECT k, round(2 * greatest(w, h), 8) AS total, CASE WHEN w >= h THEN 0 ELSE 1 END AS first FROM b")
def longest_edges(spark, d):
    two = _rects(spark, d).select("k", shapes.longest_edges(_rect(F.col("x"), F.col("y"), F.col("w"), F.col("h"))).alias("e"))
    return two.select("k", F.round(F.aggregate("e", F.lit(0.0), lambda s, e: s + e.length), 8).alias("total"), F.get("e", F.lit(0)).i.alias("first"))


@query("WITH a AS (SELECT l_suppkey AS k, (l_partkey * 37 % 720 - 360 + 45 + 720) % 90 - 45.0::DOUBLE AS a FROM lineitem) SELECT k, round(median(a), 8) AS direction FROM a GROUP BY k HAVING count(*) > 1")
def desk_direction(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_partkey") * 37 % 720 - 360).cast("double").alias("angle"))
    return analytics.median_direction(rows, "k", "angle").select("k", F.round("direction", 8).alias("direction"))


@query(
    """WITH m AS (SELECT label, avg(embedding[1]::DOUBLE) AS mx, avg(embedding[2]::DOUBLE) AS my FROM embeddings GROUP BY label),
       d AS (SELECT label, mx, my, embedding[1]::DOUBLE - mx AS u, embedding[2]::DOUBLE - my AS v FROM embeddings JOIN m USING (label)),
       s AS (SELECT label, count(*) AS n, sum(u * u) AS uu, sum(v * v) AS vv, sum(u * v) AS uv, sum(u * u * u + u * v * v) AS p, sum(v * v * v + v * u * u) AS q FROM d GROUP BY label),
       c AS (SELECT *, (p * vv - q * uv) / 2 / (uu * vv - uv * uv) AS a, (q * uu - p * uv) / 2 / (uu * vv - uv * uv) AS b FROM s)
       SELECT label, round(max(abs(sqrt((u - a) ** 2 + (v - b) ** 2) - sqrt(a * a + b * b + (uu + vv) / n))), 6) AS residual FROM d JOIN c USING (label) GROUP BY label"""
)
def circle_residual(spark, d):
    v = _vectors(spark, d)
    found = analytics.circle_residual(v, analytics.circle_fit(v, "label", "x", "y"), "label", "x", "y")
    return found.select("label", F.round("residual", 6).alias("residual"))


@query(
    """WITH e AS (SELECT user_id, event_id, (event_id * 37 % 360)::DOUBLE AS angle FROM events), g AS (SELECT *, CASE WHEN angle - lag(angle) OVER w > 25 THEN 1 ELSE 0 END AS cut FROM e WINDOW w AS (PARTITION BY user_id ORDER BY angle, event_id)),
       r AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY angle, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g),
       z AS (SELECT *, max(run) OVER u AS last, min(angle) OVER u AS low, max(angle) OVER u AS high FROM r WINDOW u AS (PARTITION BY user_id))
       SELECT user_id, event_id, (CASE WHEN last > 0 AND run = last AND low + 360 - high <= 25 THEN 0 ELSE run END)::BIGINT AS run FROM z"""
)
def circular_clusters(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") * 37 % 360).cast("double").alias("angle"))
    return analytics.circular_runs(e, "user_id", "angle", "event_id").select("user_id", "event_id", F.col("run").cast("long").alias("run"))


@query(
    f"""WITH {_LINES}, s AS (SELECT *, k % 23 * 2.0 AS low, k % 23 * 2.0 + w AS high FROM l)
        SELECT a.k AS a, b.k AS b FROM s a JOIN s b ON a.k < b.k AND a.own <> b.own AND least((a.angle - b.angle + 180) % 180, (b.angle - a.angle + 180) % 180) <= 12 AND abs(a.o - b.o) <= 3 AND b.low <= a.high + 4 AND a.low <= b.high + 4"""
)
def parallel_walls(spark, d):
    lines = _lines(spark, d).withColumn("low", F.col("k") % 23 * 2.0).withColumn("high", F.col("low") + F.col("w"))
    return matching.near_parallel(lines, "k", "own", 12.0, 3.0, 4.0)


@query(
    f"""WITH {_POINTS}, w AS (SELECT s_suppkey * 13 % 400 AS ax, s_suppkey * 29 % 500 AS ay, s_suppkey * 13 % 400 + s_suppkey % 9 AS bx, s_suppkey * 29 % 500 + s_suppkey % 6 AS b_y FROM supplier),
        l AS (SELECT *, (bx - ax) ** 2 + (b_y - ay) ** 2 AS q FROM w WHERE sqrt((bx - ax) ** 2 + (b_y - ay) ** 2) >= 3),
        t AS (SELECT c_custkey, px, py, ax, ay, bx - ax AS dx, b_y - ay AS dy, greatest(0.0, least(1.0, ((px - ax) * (bx - ax) + (py - ay) * (b_y - ay)) / q)) AS s FROM p JOIN l ON abs(px - ax) < 30 AND abs(py - ay) < 30)
        SELECT DISTINCT c_custkey FROM t WHERE sqrt((ax + s * dx - px) ** 2 + (ay + s * dy - py) ** 2) <= 2 + c_custkey % 5 + 0.5"""
)
def column_strokes(spark, d):
    k = F.col("s_suppkey")
    strokes = table(spark, d, "supplier").select((k * 13 % 400).cast("double").alias("ax"), (k * 29 % 500).cast("double").alias("ay"), (k * 13 % 400 + k % 9).cast("double").alias("bx"), (k * 29 % 500 + k % 6).cast("double").alias("b_y"))
    circles = _points(spark, d).select("c_custkey", F.col("x").alias("cx"), F.col("y").alias("cy"), (2 + F.col("c_custkey") % 5).cast("double").alias("r"))
    return matching.touching(circles, strokes, 16.0, "c_custkey", 3.0).select("c_custkey")


@query(
    f"""WITH {_CORNERS}, {_POINTS}, b AS (SELECT p_partkey, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM c GROUP BY p_partkey),
        near AS (SELECT c_custkey, px, py, p_partkey FROM p JOIN b ON px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1),
        hit AS (SELECT c_custkey, p_partkey FROM near JOIN e USING (p_partkey) WHERE (ay > py) <> (b_y > py) AND px < (bx - ax) * (py - ay) / (b_y - ay) + ax GROUP BY ALL HAVING count(*) % 2 = 1),
        f AS (SELECT c_custkey, min(p_partkey) AS p_partkey FROM p LEFT JOIN hit USING (c_custkey) GROUP BY c_custkey)
        SELECT c_custkey, coalesce(p_type, 'corridor') AS side FROM f LEFT JOIN part USING (p_partkey)"""
)
def side_classes(spark, d):
    zones = _polygons(spark, d).withColumn("ord", F.col("p_partkey"))
    return spatial.ordered_first(zones, _points(spark, d), 16.0, "c_custkey", "p_partkey", "ord", "p_type", "corridor").select("c_custkey", "side")


@query(
    f"""WITH {_VECTORS}, s AS (SELECT a.vec_id, b.vec_id AS o, greatest((a.y - 0.05) - (b.y + 0.05), 0.0) + 2 * greatest((b.x - 0.05) - a.x, a.x - (b.x + 0.05), 0.0) + 0.05 * abs(b.x - a.x) AS score
        FROM v a JOIN v b ON a.label = b.label AND b.vec_id <> a.vec_id AND a.y - b.y > 0 WHERE a.vec_id % 100 = 0
        UNION ALL SELECT a.vec_id, b.vec_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) FROM v a JOIN v b ON a.label = b.label WHERE a.vec_id % 100 = 50)
        SELECT v.vec_id, (SELECT o FROM s WHERE s.vec_id = v.vec_id ORDER BY score, o LIMIT 1) AS other_id FROM v WHERE vec_id % 50 = 0"""
)
def focus_moves(spark, d):
    def box(x, y):
        return F.struct((F.col(x) - 0.05).alias("x"), (F.col(y) - 0.05).alias("y"), F.lit(0.1).alias("width"), F.lit(0.1).alias("height"))

    found = spatial.moved_focus(_asked(spark, d), _candidates(spark, d), "label", "up", F.col("vec_id") % 100 == 0, "vec_id", "other_id", box("x", "y"), box("ox", "oy"))
    return found.select("vec_id", "other_id")


@query(f"WITH {_CORNERS} SELECT p_partkey, round(2 * min(x), 6) AS x FROM c GROUP BY p_partkey")
def scaled_boxes(spark, d):
    """Boxes of shapes that a similarity has moved there and back again, doubled."""
    there = _polygons(spark, d).select("p_partkey", F.transform("poly", lambda p: G.point(p.x * 2, p.y * 2)).alias("poly"))
    return there.select("p_partkey", F.round(G.bbox(F.col("poly")).x, 6).alias("x"))
