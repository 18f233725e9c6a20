"""Semantics on small inline frames with invented names."""

import math

import pytest
from pyspark.sql import functions as F

from quillmap.functions import geometry as G
from quillmap.functions import text as X
from quillmap.operators import analytics, people, relate, search, spatial, state
from quillmap.plans.components import components
from quillmap.sources import records
from quillmap.streaming import changes


def value(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0].v


def lit_poly(*points):
    return F.array(*[G.point(F.lit(float(p[0])), F.lit(float(p[1])), F.lit(float(p[2])) if len(p) > 2 else None) for p in points])


SPACES = [(0, "4-a1", "Quiet Lab", ["Ada Byrd"], "Maths, Physics", ["ne"]), (1, "4-b2", "Room", None, None, None), (2, "4-c3", "Lab", ["Max Stone", "Ada"], "Art", ["north"])]


def spaces(spark):
    return spark.createDataFrame(SPACES, "ord long, id string, name string, people array<string>, department string, tags array<string>")


@pytest.mark.parametrize(("query", "want"), [("ada", [(2, 100), (0, 60)]), ("ada zzz", []), ("  ", []), ("LAB", [(2, 100), (0, 25)]), ("one", [(2, 45)]), ("phys", [(0, 18)]), ("nor", [(2, 15)]), ("b2", [(1, 20)]), ("4-b2", [(1, 100)]), ("room", [(1, 100)]), ("quiet byrd", [(0, 100)])])
def test_ranked_search(spark, query, want):
    found = search.ranked_search(spaces(spark), query, id_col="id", name=F.col("name"), order=F.col("ord"), people=F.col("people"), department=F.col("department"), tags=F.col("tags"))
    assert [(r.ord, r.score) for r in found.collect()] == want


@pytest.mark.parametrize(("a", "b", "same"), [("Ada Byrd", "Ada Bird", True), ("Venka Rao", "V. Rao", True), ("Ada Byrd", "Max Byrd", False), ("Zoë Ångström", "zoe angstrom", True), ("Ada Parameswara", "Ada Parameswinkel", True), ("Ada Stone", "Ada Sand", False), ("", "", True), ("Ada", "Max", False)])
def test_same_person(spark, a, b, same):
    assert value(spark, X.same_person(F.lit(a), F.lit(b))) is same


def test_names(spark):
    assert value(spark, people.merge_names(F.array(F.lit("Ada Byrd")), F.array(F.lit("A. Byrd"), F.lit("Max Stone"), F.lit("Max Ston")))) == ["Ada Byrd", "Max Stone"]
    assert value(spark, people.merge_names(F.lit(None).cast("array<string>"), F.array(F.lit("Ada Byrd")))) == ["Ada Byrd"]
    lists = spark.createDataFrame([("1", ["Ada Byrd"]), ("2", ["Ada Byrd", "Max Stone"]), ("3", ["Ada Byrd"]), ("4", [])], "room string, names array<string>")
    fixes = spark.createDataFrame([("1", True, None), ("2", False, ["A Byrd"]), ("3", None, ["Ada Bird"])], "room string, vacant boolean, remove array<string>")
    assert {r.room: r.names for r in people.corrected(lists, fixes, "room", "names").collect()} == {"2": ["Max Stone"], "4": []}
    assert value(spark, X.tidy_name(F.lit("Byrd, Ada"))) == "Ada Byrd" and value(spark, X.tidy_name(F.lit(" Byrd,"))) == "Byrd,"
    assert value(spark, X.name_lines(F.lit("Ada M Byrd"))) == ["Ada M", "Byrd"] and value(spark, X.name_lines(F.lit("Ada"))) == ["Ada"]
    assert value(spark, X.wrap_words(F.lit("a bb ccccccccc d e"), 4)) == ["a bb", "ccccccccc", "d e"] and value(spark, X.wrap_words(F.lit(" "), 4)) == []


def test_texts(spark):
    assert value(spark, X.space_number(F.lit("4-4123b"))) == "4123B" and value(spark, X.space_number(F.lit("4-room-2"))) is None
    assert [value(spark, X.wing(F.lit(n))) for n in ("4123", "4323", "B123", "41")] == ["Northeast", "Southwest", None, None]
    assert value(spark, X.half_up(F.lit(-0.25))) == -0.2 and value(spark, X.hex_colour(F.lit(1.0), F.lit(0.5), F.lit(0.0))) == "#ff8000"
    assert value(spark, X.plain_text(F.lit("<p>a&nbsp;&amp;lt;<b>b</b></p>"))) == "a &lt; b"
    assert value(spark, X.escape_html(F.lit("<'\"&>"))) == "&lt;&#39;&quot;&amp;&gt;"
    assert value(spark, X.correction_line(F.lit("Lab"), F.lit(""), F.lit("wrong door"))) == "Lab · wrong door"


def test_shapes(spark):
    box = lit_poly((0, 0), (2, 0), (2, 1), (0, 1))
    circle = lit_poly((0, 0, 1), (2, 0, 1))
    line = lit_poly((0, 0), (1, 0), (2, 0))
    assert value(spark, G.area(box)) == 2 and tuple(value(spark, G.centroid(box))) == (1, 0.5) and tuple(value(spark, G.centroid(line))) == (1, 0)
    assert [value(spark, G.is_closed_shape(p)) for p in (circle, lit_poly((0, 0), (2, 0)), line)] == [True, False, True]
    flat = G.flatten(circle)
    b = value(spark, G.bbox(flat))
    assert b.width == pytest.approx(2, abs=0.02) and b.height == pytest.approx(2, abs=0.02) and value(spark, G.area(flat)) == pytest.approx(math.pi, rel=0.02)
    assert value(spark, F.size(G.flatten(box))) == 4 and value(spark, F.size(flat)) == 24
    assert value(spark, G.contains(box, F.lit(1.0), F.lit(0.5))) and not value(spark, G.contains(box, F.lit(3.0), F.lit(0.5)))
    assert value(spark, G.edge_distance(box, F.lit(1.0), F.lit(0.25))) == 0.25
    assert tuple(value(spark, G.label_point(box))) == (1, 0.5)
    hook = lit_poly((0, 0), (10, 0), (10, 10), (9, 10), (9, 1), (0, 1))
    p = value(spark, G.label_point(hook))
    assert value(spark, G.contains(hook, F.lit(p.x), F.lit(p.y)))
    there = G.moved(box, 2.0, 30.0, 5.0, -1.0)
    back = value(spark, G.moved_back(there, 2.0, 30.0, 5.0, -1.0))
    assert [(round(q.x, 9), round(q.y, 9)) for q in back] == [(0, 0), (2, 0), (2, 1), (0, 1)]
    assert value(spark, G.svg_path(box)) == "M0 0 L2 0 L2 1 L0 1 Z" and value(spark, G.svg_path(circle)) == "M0 0 A1 1 0 0 0 2 0 A1 1 0 0 0 0 0 Z"
    assert value(spark, G.box_iou(G.bbox(box), G.padded(G.bbox(box), 1.0))) == pytest.approx(2 / 12)


def test_arc_bows_right_of_travel(spark):
    half = value(spark, G.flatten(lit_poly((0, 0, 1), (2, 0), (1, -3))))
    assert max(p.y for p in half) == pytest.approx(1, abs=0.02)


def test_relations(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    right = spark.createDataFrame([(1, 5), (1, 4), (9, 1)], "r long, v long")
    got = {r.k: r.vs for r in relate.assign_lists(left, right, "k", "r", F.col("v"), F.col("v"), "vs").collect()}
    assert got == {1: [4, 5], 2: [], None: []}
    tagged = left.withColumn("tags", F.array(F.lit("reservable")))
    assert {r.k: r.tags for r in relate.tag_members(tagged, right, "k", "r", "tags", "reservable").collect()} == {1: ["reservable"] * 2, 2: ["reservable"], None: ["reservable"]}
    assert [r.r for r in relate.unmatched(right, "r", left, "k").collect()] == [9]
    assert {(r.k, r.status) for r in relate.gone_and_added(left, right.withColumnRenamed("r", "k"), "k").where("k is not null").collect()} == {(1, "kept"), (2, "gone"), (9, "added")}
    assert {(r.r, r.id) for r in relate.suffixed(right, "r", [F.col("v")], "id").collect()} == {(1, "1"), (1, "1-2"), (9, "9")}


def test_components_of_chain(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    assert {(r.node, r.label) for r in components(chain).collect()} == {(k, 0) for k in range(41)} | {(100, 100), (101, 100)}
    assert components(chain.limit(0)).count() == 0


def test_circle_and_runs(spark):
    pts = [(1, 3 + 2 * math.cos(a), -1 + 2 * math.sin(a)) for a in range(6)] + [(2, float(a), 0.0) for a in range(3)]
    got = {r.g: r for r in analytics.circle_fit(spark.createDataFrame(pts, "g long, x double, y double"), "g", "x", "y").collect()}
    assert (got[1].cx, got[1].cy, got[1].r) == pytest.approx((3, -1, 2)) and got[2].r is None
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 9), ("b", 5)], "g string, t long")
    assert {(r.g, r.t, r.run) for r in analytics.runs(rows, "g", "t", F.col("t") - F.col("prev") > 3).collect()} == {("a", 1, 0), ("a", 2, 0), ("a", 9, 1), ("b", 5, 0)}
    v = spark.createDataFrame([(float(k),) for k in (4, 2, 3, 1)], "v double")
    assert v.agg(analytics.upper_median("v").alias("m")).collect()[0].m == 3


def test_direction(spark):
    pts = spark.createDataFrame([(1, "f", 0.0, 0.0), (2, "g", 0.0, 0.0)], "id long, g string, x double, y double")
    others = spark.createDataFrame([(10, "f", 5.0, 0.0), (11, "f", 4.0, 3.0), (12, "f", -1.0, 0.0)], "other_id long, g string, ox double, oy double")
    box = F.struct(F.col("ox").alias("x"), F.col("oy").alias("y"), F.lit(0.0).alias("width"), F.lit(0.0).alias("height"))
    for way, want in (("right", 10), ("left", 12), ("down", 11), ("up", None)):
        score, ok = spatial.direction_score(way, F.col("x"), F.col("y"), None, F.col("ox"), F.col("oy"), box)
        for most in (0, 10):  # dealt over salts, and broadcast
            assert {r.id: r.other_id for r in spatial.nearest_in_group(pts, others, "g", score, ok, most=most).collect()} == {1: want, 2: None}


def test_logs(spark):
    log = spark.createDataFrame([("s", 1, "a", "add", "x"), ("s", 2, "b", "add", "y"), ("s", 3, "a", "edit", "z"), ("s", 4, "b", "remove", None), ("t", 1, "a", "add", "x"), ("t", 2, None, "clear", None), ("t", 3, "c", "add", "w")], "scope string, seq long, id string, op string, text string")
    assert {(r.scope, r.id, r.text) for r in state.latest(log, "scope", "id", "seq", "op", ["text"]).collect()} == {("s", "a", "z"), ("t", "c", "w")}
    end = {r.scope: r for r in state.state_at_end(log, "scope", "seq", "id", "text", ["a", "b"]).collect()}
    assert end["s"].a == "z" and end["s"].b is None and end["s"].b_set and not end["t"].b_set
    assert [r.seq for r in state.changes(log.where("scope = 's'"), "scope", "seq", "text").orderBy("seq").collect()] == [1, 2, 3, 4]


def test_records(spark, tmp_path):
    raw = F.from_json(F.lit("[[0,0],[1,2,0.5],[3,4,0]]"), "array<array<double>>")
    assert [tuple(p) for p in value(spark, records.vertices(raw))] == [(0, 0, None), (1, 2, 0.5), (3, 4, None)]
    assert value(spark, records.stored_list(F.lit("not json"))) == [] and len(value(spark, records.stored_list(F.lit('[{"id":"a"},{"name":"b"}]')))) == 1
    url = F.lit("https://x.example/floor-4/?a=1&room=9")
    assert value(spark, records.with_parameter(url, "room", F.lit("7"))).endswith("?a=1&room=7") and value(spark, records.with_parameter(url, "room", F.lit(None).cast("string"))).endswith("?a=1")
    assert value(spark, F.struct(*records.route(url))) == ("floor-4", "floor-4")
    d = spark.createDataFrame([(1, [(0.0, 2), (1.0, None)])], "floor long, doors array<struct<a:double,leaves:int>>")
    assert [(r.pos, r.leaves) for r in records.doors(d, "doors").collect()] == [(0, 2), (1, 1)]
    records.write_ordered(spaces(spark).select("ord", "id"), str(tmp_path / "out"), "id")
    assert records.strict_json(spark, str(tmp_path / "out"), spaces(spark).select("ord", "id").schema).count() == 3


def test_stream(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = changes.latest_values(events, "user_id", "event_id", "event_type").writeStream.format("memory").queryName("latest").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    want = spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"))
    assert spark.table("latest").select("user_id", "event_type").exceptAll(want).count() == 0


def test_windowed_stream(spark, sf, tmp_path):
    """Files in the order of time, so that the watermark drops nothing; the last day stays open until a later row."""
    all_rows = spark.read.parquet(f"{sf}/events.parquet")
    last = all_rows.agg(F.max("ts") + F.expr("interval 3 days")).collect()[0][0]
    late = all_rows.limit(1).withColumn("ts", F.lit(last))
    for k, part in enumerate((all_rows, late)):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    events = spark.readStream.schema(all_rows.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counts = changes.windowed_counts(events, "ts", "event_type", "1 day", "2 hours")
    q = counts.writeStream.format("memory").queryName("daily").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = all_rows.groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").count()
    got = spark.table("daily").select("window.start", "event_type", "n")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_oracles(spark, sf):
    """Every SQL text gives the query's rows, at the smallest size."""
    import glob
    import os

    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")

    def rows(names, found):
        order = sorted(range(len(names)), key=names.__getitem__)
        return sorted(repr([float(r[k]) if isinstance(r[k], (int, float)) else r[k] for k in order]) for r in found)

    for name, sql in entry.oracle_sql().items():
        got, want = entry.queries()[name](spark, sf), con.sql(sql)
        assert sorted(got.columns) == sorted(want.columns), name
        assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall()), name
    assert entry.entry(spark).count() > 0


def test_union_of_whole_tables(spark, sf):
    from quillmap.queries import all_by_source

    got = {r.source: (r["count"], r.total) for r in all_by_source(spark, sf).groupBy("source").agg(F.count("*").alias("count"), F.sum("k").alias("total")).collect()}
    tables = (("a", "orders", "o_orderkey"), ("b", "lineitem", "l_orderkey"))
    assert got == {n: tuple(spark.read.parquet(f"{sf}/{t}.parquet").agg(F.count("*"), F.sum(k)).collect()[0]) for n, t, k in tables}
