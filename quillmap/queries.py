"""The record, text and shape operators bound to the tables of a data folder, each with its SQL for DuckDB."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmap.functions import geometry as G
from quillmap.functions import text as X
from quillmap.operators import analytics, people, relate, search, spatial, state
from quillmap.plans.components import components
from quillmap.sources import records
from quillmap.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# search and filters

_TERMS = "econ re"


def _term_sql(t: str) -> str:
    return f"""CASE WHEN n = '{t}' OR k = '{t}' THEN 100 WHEN starts_with(n, '{t}') THEN 40 WHEN contains(n, '{t}') THEN 25 WHEN contains(k, '{t}') THEN 20
      WHEN len(list_filter(string_split_regex(d, '[\\s,]+'), lambda w: starts_with(w, '{t}'))) > 0 THEN 18
      WHEN len(list_filter(g, lambda w: contains(w, '{t}'))) > 0 THEN 15 ELSE -1000000 END"""


@query(
    f"""SELECT p_partkey, p_name, score FROM (SELECT p_partkey, p_name, {" + ".join(_term_sql(t) for t in _TERMS.split())} AS score
        FROM (SELECT *, lower(p_name) AS n, p_partkey::VARCHAR AS k, lower(p_type) AS d, [lower(p_brand)] AS g FROM part)) WHERE score > 0
        ORDER BY score DESC, p_name, p_partkey LIMIT 8"""
)
def ranked_search_part(spark, d):
    found = search.ranked_search(table(spark, d, "part"), _TERMS, id_col="p_partkey", name=F.col("p_name"), order=F.col("p_partkey"), department=F.col("p_type"), tags=F.array("p_brand"))
    return found.select("p_partkey", "p_name", "score")


@query(
    """SELECT c_custkey, c_mktsegment IN ('BUILDING', 'MACHINERY') AS chosen, true AS unfiltered,
       c_mktsegment <> 'FURNITURE' AND c_name <> 'Customer#000000001' AS listed FROM customer"""
)
def facet_filter(spark, d):
    kind = F.col("c_mktsegment")
    return table(spark, d, "customer").select("c_custkey", search.facets(kind, ["BUILDING", "MACHINERY"]).alias("chosen"), search.facets(kind, []).alias("unfiltered"), search.listable(kind, F.col("c_name"), ("FURNITURE",), "Customer#000000001").alias("listed"))


@query(
    """SELECT n_nationkey, count(s_suppkey) AS n, (SELECT count(*) FROM supplier) AS total, (SELECT count(*) FROM nation) AS n_groups
       FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey"""
)
def group_listing(spark, d):
    return relate.listing(table(spark, d, "nation"), table(spark, d, "supplier"), "n_nationkey", "s_nationkey")


# joins and sets


@query(
    """SELECT c_custkey, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey), '') AS orders, count(o_orderkey) AS n
       FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"""
)
def left_assign(spark, d):
    out = relate.assign_lists(table(spark, d, "customer"), table(spark, d, "orders"), "c_custkey", "o_custkey", F.col("o_orderkey"), F.col("o_orderkey"), "items")
    return out.select("c_custkey", F.array_join("items", ",").alias("orders"), F.size("items").cast("long").alias("n"))


@query(
    """SELECT c_custkey, lower(c_mktsegment) || CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN ',reservable' ELSE '' END AS tags
       FROM customer"""
)
def semi_tag(spark, d):
    c = table(spark, d, "customer").withColumn("tags", F.array(F.lower("c_mktsegment")))
    out = relate.tag_members(c, table(spark, d, "orders").where("o_orderstatus = 'P'"), "c_custkey", "o_custkey", "tags", "reservable")
    return out.select("c_custkey", F.array_join("tags", ",").alias("tags"))


@query(
    """SELECT 'customer' AS side, c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
       UNION ALL SELECT 'part', p_partkey FROM part WHERE p_partkey + CASE WHEN p_size % 10 = 0 THEN 1000000000 ELSE 0 END NOT IN (SELECT l_partkey FROM lineitem)"""
)
def anti_unmatched(spark, d):
    a = relate.unmatched(table(spark, d, "customer"), "c_custkey", table(spark, d, "orders"), "o_custkey").select(F.lit("customer").alias("side"), F.col("c_custkey").alias("k"))
    # Sizes that end in 0 get keys that no line has.
    parts = table(spark, d, "part").withColumn("key", F.col("p_partkey") + F.when(F.col("p_size") % 10 == 0, 1_000_000_000).otherwise(0))
    b = relate.unmatched(parts, "key", table(spark, d, "lineitem"), "l_partkey")
    return a.unionByName(b.select(F.lit("part").alias("side"), F.col("p_partkey").alias("k")))


@query(
    """WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages),
       r AS (SELECT page_id, regexp_extract(path, '^/([^/]*)', 1) AS f, regexp_extract(path, '([^/]*)/?$', 1) AS room FROM p),
       g AS (SELECT page_id, CASE WHEN f IN (SELECT lang FROM documents) THEN f ELSE 'en' END AS floor, room FROM r)
       SELECT page_id, floor, min(doc_id) AS doc_id FROM g LEFT JOIN documents ON lang = floor AND (doc_id::VARCHAR = room OR lang || '-' || doc_id::VARCHAR = room)
       GROUP BY page_id, floor"""
)
def route_lookup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    floors = docs.select(F.col("lang").alias("known")).distinct()
    first, last = records.route(F.col("url"))
    pages = table(spark, d, "pages").select("page_id", first.alias("f"), last.alias("room")).join(floors, F.col("f") == F.col("known"), "left")
    pages = pages.select("page_id", F.coalesce("known", F.lit("en")).alias("floor"), "room")
    # Each way to write a room is a key of its own, so that the match stays an equi-join.
    keys = docs.select("doc_id", "lang", F.explode(F.array(F.col("doc_id").cast("string"), F.concat_ws("-", "lang", F.col("doc_id").cast("string")))).alias("key"))
    return relate.first_match(pages, keys, (F.col("floor") == F.col("lang")) & (F.col("room") == F.col("key")), "page_id", F.col("doc_id"), ["doc_id"]).select("page_id", "floor", "doc_id")


@query("SELECT 'a' AS source, o_orderkey AS k, o_orderstatus AS kind FROM orders UNION ALL SELECT 'b', l_orderkey, l_linestatus FROM lineitem")
def union_by_source(spark, d):
    a = table(spark, d, "orders").select(F.lit("a").alias("source"), F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("kind"))
    return a.unionByName(table(spark, d, "lineitem").select(F.lit("b").alias("source"), F.col("l_orderkey").alias("k"), F.col("l_linestatus").alias("kind")))


@query("SELECT 'a' AS source, o_orderkey AS k FROM orders UNION ALL SELECT 'b', l_orderkey FROM lineitem")
def all_by_source(spark, d):
    a = table(spark, d, "orders").select(F.lit("a").alias("source"), F.col("o_orderkey").alias("k"))
    return a.unionByName(table(spark, d, "lineitem").select(F.lit("b").alias("source"), F.col("l_orderkey").alias("k")))


def _years(spark, d):
    o = table(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    return (o.where(F.col("y") == y).select(F.col("o_custkey").alias("k")) for y in (1996, 1997))


_YEARS = "a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1996), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1997)"


@query(f"WITH {_YEARS} SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'gone' WHEN a.k IS NULL THEN 'added' ELSE 'kept' END AS status FROM a FULL JOIN b ON a.k = b.k")
def except_both(spark, d):
    return relate.gone_and_added(*_years(spark, d), "k")


@query(f"WITH {_YEARS} SELECT k FROM a INTERSECT SELECT k FROM b")
def intersect_ids(spark, d):
    a, b = _years(spark, d)
    return a.intersect(b)


_MAPS = "a AS (SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_regionkey <= 2), b AS (SELECT n_nationkey AS k, 'new ' || n_name AS v FROM nation WHERE n_regionkey >= 2)"


def _maps(spark, d):
    n = table(spark, d, "nation").withColumnRenamed("n_nationkey", "k")
    return n.where("n_regionkey <= 2").select("k", F.col("n_name").alias("v")), n.where("n_regionkey >= 2").select("k", F.concat(F.lit("new "), "n_name").alias("v"))


@query(f"WITH {_MAPS} SELECT coalesce(a.k, b.k) AS k, coalesce(b.v, a.v) AS v FROM a FULL JOIN b ON a.k = b.k")
def map_override(spark, d):
    return relate.override(*_maps(spark, d), "k", "v")


@query(f"WITH {_MAPS} SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, b.v) AS v FROM a FULL JOIN b ON a.k = b.k")
def map_first_wins(spark, d):
    return relate.override(*_maps(spark, d), "k", "v", last_wins=False)


# validation and keys


@query("SELECT l_orderkey, l_linenumber, n::INT AS occurrence FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem) WHERE n > 1")
def dup_ids(spark, d):
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return relate.repeats(table(spark, d, "lineitem"), "l_orderkey", order).select("l_orderkey", "l_linenumber", "occurrence")


@query("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT CASE WHEN p_size <= 45 THEN p_partkey ELSE -p_partkey END FROM part)")
def fk_violations(spark, d):
    return relate.unmatched(table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), "l_partkey", table(spark, d, "part").select(F.when(F.col("p_size") <= 45, F.col("p_partkey")).otherwise(-F.col("p_partkey")).alias("known")), "known")


@query("SELECT p_partkey, p_size % 4 >= 3 OR (p_size % 4 = 2 AND p_partkey % 2 = 1) AS valid FROM part")
def shape_check(spark, d):
    bulge = F.when(F.col("p_partkey") % 2 == 1, 1.0)
    n = (F.col("p_size") % 4).cast("int")
    poly = F.slice(F.array(*[G.point(F.lit(k), F.lit(k * k), bulge) for k in range(3)]), 1, n)
    return table(spark, d, "part").select("p_partkey", G.is_closed_shape(poly).alias("valid"))


@query("SELECT p_partkey, CASE WHEN n = 1 THEN p_brand ELSE p_brand || '-' || n END AS unique_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_type <> 'ECONOMY', p_partkey) AS n FROM part)")
def suffix_ids(spark, d):
    return relate.suffixed(table(spark, d, "part"), "p_brand", [F.col("p_type") != "ECONOMY", F.col("p_partkey")], "unique_brand").select("p_partkey", "unique_brand")


# names


def _names(spark, d):
    p = table(spark, d, "part").where("p_name is not null")
    lists = p.groupBy("p_brand").agg(F.sort_array(F.collect_set(F.when(F.col("p_size") < 5, F.col("p_name")))).alias("one"), F.sort_array(F.collect_set(F.when(F.col("p_size") >= 5, F.col("p_name")))).alias("two"))
    return lists


_KEY = "regexp_replace(lower({0}), '[^a-z]', '', 'g')"
_SAME = (
    f"(levenshtein({_KEY.format('{a}')}, {_KEY.format('{b}')}) <= 1 OR (len(string_split({{a}}, ' ')) >= 2 AND len(string_split({{b}}, ' ')) >= 2 AND "
    f"((string_split({{a}}, ' ')[-1] = string_split({{b}}, ' ')[-1] AND {{a}}[1] = {{b}}[1]) OR "
    f"(string_split({{a}}, ' ')[1] = string_split({{b}}, ' ')[1] AND length(string_split({{a}}, ' ')[-1]) >= 6 AND string_split({{a}}, ' ')[-1][1:6] = string_split({{b}}, ' ')[-1][1:6]))))"
)
_LISTS = """l AS (SELECT p_brand, coalesce(list_sort(list(DISTINCT p_name) FILTER (p_size < 5)), []) AS one, coalesce(list_sort(list(DISTINCT p_name) FILTER (p_size >= 5)), []) AS two
            FROM part WHERE p_name IS NOT NULL GROUP BY p_brand)"""


@query(
    f"""WITH RECURSIVE {_LISTS}, f AS (SELECT p_brand, 0 AS i, one AS acc, two FROM l UNION ALL
        SELECT p_brand, i + 1, CASE WHEN len(list_filter(acc, lambda h: {_SAME.format(a="h", b="two[i + 1]")})) > 0 THEN acc ELSE list_append(acc, two[i + 1]) END, two FROM f WHERE i < len(two))
        SELECT p_brand, array_to_string(acc, '|') AS names FROM f WHERE i = len(two)"""
)
def fuzzy_merge(spark, d):
    return _names(spark, d).select("p_brand", F.array_join(people.merge_names(F.col("one"), F.col("two")), "|").alias("names"))


@query(
    f"""WITH {_LISTS}, k AS (SELECT *, substr(p_brand, 7)::INT AS no FROM l),
        r AS (SELECT p_brand, no, CASE WHEN no % 3 = 1 THEN list_filter(two, lambda n: NOT {_SAME.format(a="n", b="two[1]")}) ELSE two END AS people FROM k WHERE no % 3 <> 0)
        SELECT p_brand, array_to_string(people, '|') AS names FROM r WHERE no % 3 = 2 OR len(people) > 0"""
)
def fix_list(spark, d):
    lists = _names(spark, d).select("p_brand", F.col("two").alias("names"))
    no = F.substring("p_brand", 7, 9).cast("int") % 3
    fixes = lists.select("p_brand", (no == 0).alias("vacant"), F.when(no == 1, F.slice("names", 1, 1)).alias("remove")).where("vacant or remove is not null")
    return people.corrected(lists, fixes, "p_brand", "names").select("p_brand", F.array_join("names", "|").alias("names"))


@query("SELECT p_partkey, CASE WHEN contains(p_name, ' ') THEN regexp_extract(p_name, '^(.*) ([^ ]*)$', 1) || '|' || regexp_extract(p_name, '^(.*) ([^ ]*)$', 2) ELSE p_name END AS lines FROM part")
def name_lines(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(X.name_lines(F.col("p_name")), "|").alias("lines"))


@query("SELECT doc_id, array_to_string(regexp_extract_all(trim(regexp_replace(text, '\\s+', ' ', 'g')), '(?s)(.{1,22}|[^ ]+)(?: |$)', 1), '|') AS lines FROM documents")
def word_wrap(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(X.wrap_words(F.col("text"), 22), "|").alias("lines"))


@query(
    """SELECT c_custkey, '4-' || CASE WHEN c_custkey % 2 = 0 THEN lower('B') ELSE '' END || c_custkey AS space_id,
       nullif(upper(regexp_extract('4-' || CASE WHEN c_custkey % 2 = 0 THEN 'b' ELSE '' END || c_custkey, '^[^-]+-([a-z]?\\d+[a-z]?)$', 1)), '') AS number,
       CASE WHEN length(c_custkey::VARCHAR) >= 4 AND c_custkey % 2 = 1 THEN CASE WHEN (c_custkey::VARCHAR)[2] IN ('1', '2') THEN 'Northeast' WHEN (c_custkey::VARCHAR)[2] IN ('3', '4') THEN 'Southwest' END END AS wing,
       lower(regexp_replace(c_name || ' o''x', '[\\s''’]+', '-', 'g')) AS slug, floor(c_acctbal * 10 + 0.5) / 10 AS rounded,
       replace(replace(c_mktsegment || '&<', '&', '&amp;'), '<', '&lt;') AS escaped FROM customer"""
)
def text_keys(spark, d):
    sid = F.concat(F.lit("4-"), F.when(F.col("c_custkey") % 2 == 0, "b").otherwise(""), F.col("c_custkey").cast("string"))
    number = X.space_number(sid)
    return table(spark, d, "customer").select("c_custkey", sid.alias("space_id"), number.alias("number"), X.wing(number).alias("wing"), X.slug(F.concat("c_name", F.lit(" o'x"))).alias("slug"), X.half_up(F.col("c_acctbal")).alias("rounded"), X.escape_html(F.concat("c_mktsegment", F.lit("&<"))).alias("escaped"))


@query(
    """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<a href="[^"]*">[^<]*</a>')) AS a FROM pages)
       SELECT page_id, regexp_extract(a, 'href="([^"]*)"', 1) AS href, regexp_extract(a, '>([^<]*)<', 1) AS label, count(*) AS n FROM l GROUP BY ALL"""
)
def html_extract(spark, d):
    a = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('(?s)<a href="[^"]*">[^<]*</a>'), F.lit(0))).alias("a"))
    return a.groupBy("page_id", F.regexp_extract("a", 'href="([^"]*)"', 1).alias("href"), F.regexp_extract("a", ">([^<]*)<", 1).alias("label")).agg(F.count(F.lit(1)).alias("n"))


_PLAIN = "regexp_replace(html, '<[^>]*>', ' ', 'g')"
for _a, _b in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", "\u00a0")):
    _PLAIN = f"replace({_PLAIN}, '{_a}', '{_b}')"
_PLAIN = f"regexp_replace({_PLAIN}, '&amp;?', '&', 'g')"


@query(f"SELECT page_id, trim(regexp_replace({_PLAIN}, '[ \\t\\n\\r\\f]+', ' ', 'g')) AS text FROM pages")
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", X.plain_text(F.col("html")).alias("text"))


# geometry: a part is a polygon of 3 to 7 corners around a point, all from its key

_N = "(3 + p_partkey % 5)"
_CORNERS = f"""c AS (SELECT p_partkey, i, {_N} AS n, (p_partkey % 40) * 10 + (2 + p_size % 6) * cos(2 * pi() * i / {_N}) AS x, (p_partkey // 40) * 10 + (2 + p_size % 6) * sin(2 * pi() * i / {_N}) AS y
              FROM part, range(7) t(i) WHERE i < {_N}),
              e AS (SELECT a.p_partkey, a.i, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM c a JOIN c b ON a.p_partkey = b.p_partkey AND b.i = (a.i + 1) % a.n)"""


def _polygons(spark, d) -> DataFrame:
    key, n = F.col("p_partkey"), (3 + F.col("p_partkey") % 5).cast("int")
    turn = F.lit(2 * math.pi)
    r = 2 + F.col("p_size") % 6
    poly = F.transform(F.sequence(F.lit(0), n - 1), lambda i: G.point((key % 40) * 10 + r * F.cos(turn * i / n), F.floor(key / 40) * 10 + r * F.sin(turn * i / n)))
    return table(spark, d, "part").select("p_partkey", "p_size", "p_type", poly.alias("poly"))


@query(f"WITH {_CORNERS} SELECT p_partkey, round(min(x), 6) AS x, round(min(y), 6) AS y, round(max(x) - min(x), 6) AS width, round(max(y) - min(y), 6) AS height FROM c GROUP BY p_partkey")
def bbox(spark, d):
    b = _polygons(spark, d).select("p_partkey", G.bbox(F.col("poly")).alias("b"))
    return b.select("p_partkey", *[F.round(f"b.{c}", 6).alias(c) for c in ("x", "y", "width", "height")])


@query(f"WITH {_CORNERS} SELECT p_partkey, round(sum((ax + bx) * (ax * b_y - bx * ay)) / (3 * sum(ax * b_y - bx * ay)), 5) + 0.0 AS x, round(sum((ay + b_y) * (ax * b_y - bx * ay)) / (3 * sum(ax * b_y - bx * ay)), 5) + 0.0 AS y FROM e GROUP BY p_partkey")
def centroid(spark, d):
    c = _polygons(spark, d).select("p_partkey", G.centroid(F.col("poly")).alias("c"))
    return c.select("p_partkey", (F.round("c.x", 5) + 0.0).alias("x"), (F.round("c.y", 5) + 0.0).alias("y"))


@query(f"WITH {_CORNERS} SELECT p_partkey, round(abs(sum(ax * b_y - bx * ay)) / 2, 5) AS area FROM e GROUP BY p_partkey")
def polygon_area(spark, d):
    return _polygons(spark, d).select("p_partkey", F.round(G.area(F.col("poly")), 5).alias("area"))


_POINTS = "p AS (SELECT c_custkey, c_custkey % 400 + 0.25 AS px, (c_custkey * 7) % 500 + 0.35 AS py FROM customer)"


def _points(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", (k % 400 + 0.25).cast("double").alias("x"), ((k * 7) % 500 + 0.35).cast("double").alias("y"))


@query(
    f"""WITH {_CORNERS}, {_POINTS}, b AS (SELECT p_partkey, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM c GROUP BY p_partkey),
        near AS (SELECT c_custkey, px, py, p_partkey FROM p JOIN b ON px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1),
        hit AS (SELECT c_custkey, p_partkey FROM near JOIN e USING (p_partkey) WHERE (ay > py) <> (b_y > py) AND px < (bx - ax) * (py - ay) / (b_y - ay) + ax GROUP BY ALL HAVING count(*) % 2 = 1)
        SELECT c_custkey, min(p_partkey) AS p_partkey FROM p LEFT JOIN hit USING (c_custkey) GROUP BY c_custkey"""
)
def point_in_polygon_join(spark, d):
    polys = _polygons(spark, d).withColumn("ord", F.col("p_partkey"))
    return spatial.points_in_polygons(_points(spark, d), polys, 16.0, "c_custkey", "p_partkey", "ord").select("c_custkey", "p_partkey")


_VECTORS = "v AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"


def _vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))


def _asked(spark, d) -> DataFrame:
    """The query set of searches: every vector whose id is divisible by 50, looked up among all of them."""
    return _vectors(spark, d).where("vec_id % 50 = 0")


def _candidates(spark, d) -> DataFrame:
    return _vectors(spark, d).select("label", F.col("vec_id").alias("other_id"), F.col("x").alias("ox"), F.col("y").alias("oy"))


@query(
    f"""WITH {_VECTORS} SELECT a.vec_id, (SELECT b.vec_id FROM v b WHERE b.label = a.label AND b.vec_id <> a.vec_id
        ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.vec_id LIMIT 1) AS other_id FROM v a WHERE a.vec_id % 50 = 0"""
)
def nearest(spark, d):
    score = F.sqrt((F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy")))
    return spatial.nearest_in_group(_asked(spark, d), _candidates(spark, d), "label", score, F.col("vec_id") != F.col("other_id"), "vec_id").select("vec_id", "other_id")


@query(
    f"""WITH {_VECTORS}, s AS (SELECT a.vec_id, b.vec_id AS o, greatest((b.x - 0.05) - (a.x + 0.05), 0.0) + 2 * greatest((b.y - 0.05) - a.y, a.y - (b.y - 0.05 + 0.1), 0.0) + 0.05 * abs(b.y - a.y) AS score
        FROM v a JOIN v b ON a.label = b.label AND b.vec_id <> a.vec_id AND b.x - a.x > 0 WHERE a.vec_id % 50 = 0)
        SELECT v.vec_id, (SELECT o FROM s WHERE s.vec_id = v.vec_id ORDER BY score, o LIMIT 1) AS other_id FROM v WHERE vec_id % 50 = 0"""
)
def nearest_in_direction(spark, d):
    def box(x, y):
        return F.struct((F.col(x) - 0.05).alias("x"), (F.col(y) - 0.05).alias("y"), F.lit(0.1).alias("width"), F.lit(0.1).alias("height"))

    score, before = spatial.direction_score("right", F.col("x"), F.col("y"), F.struct((F.col("x") - 0.05).alias("x"), F.col("y").alias("y"), F.lit(0.1).alias("width"), F.lit(0.1).alias("height")), F.col("ox"), F.col("oy"), box("ox", "oy"))
    return spatial.nearest_in_group(_asked(spark, d), _candidates(spark, d), "label", score, before & (F.col("vec_id") != F.col("other_id")), "vec_id").select("vec_id", "other_id")


@query(
    """WITH i AS (SELECT p_partkey, p_type, (p_size % 10) / 10.0::DOUBLE AS r, (p_partkey % 7) / 7.0::DOUBLE AS g, (p_partkey % 11) / 11.0::DOUBLE AS b FROM part),
       l AS (SELECT n_nationkey AS ord, n_name AS name, ['ECONOMY', 'STANDARD', 'PROMO', 'LARGE', 'SMALL'][n_nationkey % 5 + 1] AS sheet, (n_nationkey % 5) / 5.0::DOUBLE AS lr, (n_nationkey % 3) / 3.0::DOUBLE AS lg, (n_nationkey % 4) / 4.0::DOUBLE AS lb FROM nation),
       x AS (SELECT p_partkey, p_type, sheet, ord, name, sqrt((r - lr) * (r - lr) + (g - lg) * (g - lg) + (b - lb) * (b - lb)) AS d FROM i, l)
       SELECT p_partkey, coalesce((SELECT name FROM x WHERE x.p_partkey = i.p_partkey AND sheet = i.p_type AND d <= 0.55 ORDER BY d, ord LIMIT 1),
                                  (SELECT name FROM x WHERE x.p_partkey = i.p_partkey AND d <= 0.3 ORDER BY d, ord LIMIT 1)) AS name FROM i"""
)
def nearest_colour(spark, d):
    k = F.col("p_partkey")
    items = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("sheet"), (F.col("p_size") % 10 / 10.0).alias("r"), (k % 7 / 7.0).alias("g"), (k % 11 / 11.0).alias("b"))
    n = F.col("n_nationkey")
    sheets = F.array(*[F.lit(x) for x in ("ECONOMY", "STANDARD", "PROMO", "LARGE", "SMALL")])
    legend = table(spark, d, "nation").select(n.alias("ord"), F.col("n_name").alias("name"), F.get(sheets, n % 5).alias("sheet"), (n % 5 / 5.0).alias("r"), (n % 3 / 3.0).alias("g"), (n % 4 / 4.0).alias("b"))
    return spatial.nearest_colour(items, legend, "p_partkey", "sheet", 0.55, 0.3).select("p_partkey", "name")


# Rooms and fills are rectangles of a grid of five sheets.
_ROOMS = """rooms AS (SELECT s_suppkey AS room_id, s_suppkey % 5 AS floor, (s_suppkey % 20) * 10.0 AS x0, (s_suppkey % 20) * 10.0 + 8 AS x1, 0.0 AS y0, 4.0 + s_suppkey % 7 AS y1 FROM supplier),
            fills AS (SELECT n_nationkey % 5 AS floor, 'd' || (n_nationkey % 4) AS name, n_nationkey * 8.0 AS x0, n_nationkey * 8.0 + 13 AS x1, 1.0 AS y0, 7.0 AS y1 FROM nation),
            grid AS (SELECT room_id, floor, i + 0.5 AS x, j + 0.5 AS y FROM rooms, range(0, 210) a(i), range(0, 12) b(j) WHERE i + 0.5 > x0 AND i + 0.5 < x1 AND j + 0.5 > y0 AND j + 0.5 < y1),
            sizes AS (SELECT room_id, count(*) AS cells FROM grid GROUP BY room_id),
            hits AS (SELECT DISTINCT room_id, name, x, y FROM grid JOIN fills USING (floor) WHERE x > x0 AND x < x1 AND y > y0 AND y < y1),
            cover AS (SELECT room_id, name, count(*) / any_value(cells) AS fraction FROM hits JOIN sizes USING (room_id) GROUP BY room_id, name)"""


def _cover(spark, d) -> DataFrame:
    def box(x, y, w, h):
        return F.array(G.point(x, y), G.point(x + w, y), G.point(x + w, y + h), G.point(x, y + h))

    k, n = F.col("s_suppkey"), F.col("n_nationkey")
    rooms = table(spark, d, "supplier").select(k.alias("room_id"), (k % 5).cast("long").alias("floor"), box(k % 20 * 10.0, F.lit(0.0), F.lit(8.0), 4.0 + k % 7).alias("poly"))
    fills = table(spark, d, "nation").select((n % 5).cast("long").alias("floor"), F.concat(F.lit("d"), (n % 4).cast("string")).alias("name"), box(n * 8.0, F.lit(1.0), F.lit(13.0), F.lit(6.0)).alias("poly"))
    return spatial.coverage(rooms, fills, "floor", 1.0)


@query(f"WITH {_ROOMS} SELECT room_id, name, round(fraction, 9) AS fraction FROM cover")
def area_coverage(spark, d):
    return _cover(spark, d).select("room_id", "name", F.round("fraction", 9).alias("fraction"))


@query(
    f"""WITH {_ROOMS}, r AS (SELECT *, row_number() OVER (PARTITION BY room_id ORDER BY fraction DESC, name) AS n FROM cover)
        SELECT a.room_id, a.name, round(a.fraction, 9) AS fraction, CASE WHEN b.fraction >= 0.2 THEN b.name END AS second, a.fraction >= 0.5 AS assigned
        FROM r a LEFT JOIN r b ON a.room_id = b.room_id AND b.n = 2 WHERE a.n = 1"""
)
def top1_coverage(spark, d):
    return spatial.best_cover(_cover(spark, d)).withColumn("fraction", F.round("fraction", 9))


# aggregates


@query("SELECT l_returnflag, count(*) AS n, count_if(l_discount >= 0.05) AS disc_0_05, count_if(l_discount >= 0.08) AS disc_0_08, count_if(l_quantity > 40) AS large FROM lineitem GROUP BY l_returnflag")
def threshold_counts(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), *analytics.reached(F.col("l_discount"), (0.05, 0.08), "disc"), F.count_if(F.col("l_quantity") > 40).alias("large"))


@query("SELECT c_mktsegment, list_sort(list(c_acctbal))[(count(c_acctbal) // 2 + 1)::INT] AS upper_median, count(*) AS n, count_if(c_acctbal < 0) AS below FROM customer GROUP BY c_mktsegment")
def upper_median(spark, d):
    c = table(spark, d, "customer").select("c_mktsegment", "c_acctbal")
    counts = c.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("below"))
    return counts.join(analytics.medians(c, "c_mktsegment", "c_acctbal"), "c_mktsegment", "left").select("c_mktsegment", F.col("upper").alias("upper_median"), "n", "below")


@query("SELECT l_returnflag, round(atan2(sum(l_quantity * sin(l_discount * 4)), sum(l_quantity * cos(l_discount * 4))) / 4, 8) AS direction FROM lineitem GROUP BY l_returnflag")
def weighted_direction(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(analytics.mean_direction(F.col("l_discount"), F.col("l_quantity")), 8).alias("direction"))


@query(
    """WITH m AS (SELECT label, avg(embedding[1]::DOUBLE) AS mx, avg(embedding[2]::DOUBLE) AS my FROM embeddings GROUP BY label),
       d AS (SELECT label, mx, my, embedding[1]::DOUBLE - mx AS u, embedding[2]::DOUBLE - my AS v FROM embeddings JOIN m USING (label)),
       s AS (SELECT label, any_value(mx) AS mx, any_value(my) AS my, count(*) AS n, sum(u * u) AS uu, sum(v * v) AS vv, sum(u * v) AS uv, sum(u * u * u + u * v * v) AS p, sum(v * v * v + v * u * u) AS q FROM d GROUP BY label),
       c AS (SELECT *, (p * vv - q * uv) / 2 / (uu * vv - uv * uv) AS a, (q * uu - p * uv) / 2 / (uu * vv - uv * uv) AS b FROM s)
       SELECT label, round(a + mx, 6) AS cx, round(b + my, 6) AS cy, round(sqrt(a * a + b * b + (uu + vv) / n), 6) AS r FROM c"""
)
def circle_fit(spark, d):
    found = analytics.circle_fit(_vectors(spark, d), "label", "x", "y")
    return found.select("label", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "r")])


@query(
    """WITH g AS (SELECT user_id, event_id, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
       r AS (SELECT user_id, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g JOIN events USING (user_id, event_id))
       SELECT user_id, run::BIGINT AS run, count(*) AS n FROM r GROUP BY ALL"""
)
def gap_clusters(spark, d):
    e = table(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("at"))
    gap = F.expr("at.ts - prev.ts > INTERVAL 6 HOURS")
    return analytics.runs(e, "user_id", "at", gap).groupBy("user_id", F.col("run").cast("long").alias("run")).agg(F.count(F.lit(1)).alias("n"))


# state


@query(
    """SELECT event_id, user_id, event_type, previous FROM (SELECT *, lag(event_type) OVER w AS previous, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
       WHERE n = 1 OR event_type IS DISTINCT FROM previous"""
)
def state_changes(spark, d):
    log = table(spark, d, "events").withColumn("seq", F.struct("ts", "event_id"))
    return state.changes(log, "user_id", "seq", "event_type").select("event_id", "user_id", "event_type", "previous")


@query(
    """WITH l AS (SELECT event_id, user_id, event_id % 9 AS k, value, CASE WHEN event_id % 97 = 0 THEN 'clear' WHEN event_id % 5 = 0 THEN 'remove' WHEN event_id % 3 = 0 THEN 'edit' ELSE 'add' END AS op FROM events),
       c AS (SELECT user_id, max(event_id) AS cleared FROM l WHERE op = 'clear' GROUP BY user_id),
       r AS (SELECT l.*, row_number() OVER (PARTITION BY l.user_id, k ORDER BY event_id DESC) AS n FROM l LEFT JOIN c USING (user_id) WHERE op <> 'clear' AND (cleared IS NULL OR event_id > cleared))
       SELECT user_id, k, event_id, value FROM r WHERE n = 1 AND op <> 'remove'"""
)
def log_fold(spark, d):
    i = F.col("event_id")
    op = F.when(i % 97 == 0, "clear").when(i % 5 == 0, "remove").when(i % 3 == 0, "edit").otherwise("add")
    log = table(spark, d, "events").select("event_id", "user_id", (i % 9).alias("k"), "value", op.alias("op"))
    return state.latest(log, "user_id", "k", "event_id", "op", ["value"])


@query(
    """SELECT user_id, arg_max(value, event_id) FILTER (event_type = 'click') AS click, arg_max(value, event_id) FILTER (event_type = 'error') AS error,
       count_if(event_type = 'click') > 0 AS click_set, count_if(event_type = 'error') > 0 AS error_set FROM events GROUP BY user_id"""
)
def state_store(spark, d):
    return state.state_at_end(table(spark, d, "events"), "user_id", "event_id", "event_type", "value", ["click", "error"])


@query("SELECT p_partkey AS node, min(p_partkey) OVER g AS label FROM part WINDOW g AS (PARTITION BY p_brand, p_size) QUALIFY count(*) OVER g > 1")
def graph_components(spark, d):
    """Parts linked to the next one of their brand and size; the chains are put together again."""
    following = F.lead("p_partkey").over(W.partitionBy("p_brand", "p_size").orderBy("p_partkey"))
    return components(table(spark, d, "part").select(F.col("p_partkey").alias("a"), following.alias("b")))


# projections


@query(
    """SELECT p_partkey, array_to_string(list_filter([p_type, CASE WHEN p_size > 25 THEN 'Size ' || p_size END, nullif(p_brand, 'Brand#1')], lambda x: x IS NOT NULL), ' · ') AS facts,
       CASE WHEN p_name LIKE '%ring%' THEN 'stairs' WHEN p_name LIKE '%widget%' THEN 'printer' ELSE 'other' END AS kind FROM part"""
)
def details(spark, d):
    facts = F.array_compact(F.array("p_type", F.when(F.col("p_size") > 25, F.concat(F.lit("Size "), F.col("p_size").cast("string"))), F.nullif("p_brand", F.lit("Brand#1"))))
    kind = F.when(F.contains("p_name", F.lit("ring")), "stairs").when(F.contains("p_name", F.lit("widget")), "printer").otherwise("other")
    return table(spark, d, "part").select("p_partkey", F.array_join(facts, " · ").alias("facts"), kind.alias("kind"))


@query(
    """WITH u AS (SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '&ref=x', '') AS url FROM pages)
       SELECT page_id, split_part(url, '?', 1) || '?' || CASE WHEN contains(url, '?') THEN regexp_extract(url, '\\?(.*)$', 1) || '&' ELSE '' END || 'room=7' AS url FROM u"""
)
def url_write(spark, d):
    url = F.regexp_replace(F.regexp_replace("url", "#.*$", ""), "&ref=x", "")
    return table(spark, d, "pages").select("page_id", records.with_parameter(url, "room", F.lit("7")).alias("url"))
