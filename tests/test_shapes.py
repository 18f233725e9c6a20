"""Matching, shapes, Markdown and plan names on small inline frames."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillmap.functions import geometry as G
from quillmap.functions import directory, markdown, marks, naming, shapes
from quillmap.operators import analytics, matching, spatial
from quillmap.plans.components import components
from quillmap.plans.storage import dealt
from __spark_entry__ import QUERIES


def value(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0].v


def lit_poly(*points):
    return F.array(*[G.point(F.lit(float(x)), F.lit(float(y))) for x, y in points])


SQUARE = ((0, 0), (2, 0), (2, 2), (0, 2))


def greedy(pairs):
    left, right, out = set(), set(), set()
    for c, a, b in sorted(pairs):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            out.add((a, b))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_is_the_pass_in_order(spark, seed):
    r = random.Random(seed)
    pairs = [(r.randrange(6), r.randrange(20), r.randrange(15)) for _ in range(120)]
    df = spark.createDataFrame(pairs + pairs[:5] + [(None, 1, 1), (1, None, 1)], "c long, a long, b long")
    got = matching.greedy_pairs(df, "a", "b", cost=F.col("c")).collect()
    assert {(x.a, x.b) for x in got} == greedy(pairs) and len(got) == len(greedy(pairs))


def test_greedy_rounds_do_not_broadcast_many_matches(spark, monkeypatch):
    """What a round takes is a file of few bytes, of which a broadcast makes many."""
    plans = []
    monkeypatch.setattr(matching, "keep", lambda df, label, keep=matching.keep: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, label))
    pairs = spark.range(60_000).select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("c"))
    assert matching.greedy_pairs(pairs, "a", "b", cost=F.col("c")).count() == 60_000
    assert len(plans) == 4 and not any("BroadcastHashJoin" in p and "LeftAnti" in p for p in plans)


def test_greedy_of_nothing(spark):
    assert matching.greedy_pairs(spark.createDataFrame([], "a long, b long, c double"), "a", "b", cost=F.col("c")).collect() == []


def test_rest_is_zipped(spark):
    dots = spark.createDataFrame([("s", 1, 0.0), ("s", 2, 9.0), ("s", 3, 5.0)], "sheet string, dot long, y double")
    names = spark.createDataFrame([("s", "n1", 4.0), ("s", "n2", 8.0), ("s", "n3", 1.0)], "sheet string, name string, y double")
    match = spark.createDataFrame([(1, "n3")], "dot long, name string")
    got = matching.zip_rest(dots, names, match, "sheet", "dot", "name", F.col("y"), F.col("y")).collect()
    assert sorted(map(tuple, got)) == [(1, "n3"), (2, "n2"), (3, "n1")]


def test_nearest_and_names(spark):
    names = spark.createDataFrame([("a", 0.0, 1.0, "HALL /"), ("b", 1.0, 2.0, "NORTH"), ("c", 90.0, 0.0, "LOST"), ("d", None, 0.0, "NULL")], "id string, x double, y double, text string")
    numbers = spark.createDataFrame([("1", 0.0, 0.0), ("2", 50.0, 50.0)], "no string, x double, y double")
    assert {r.no: r.name for r in matching.named_numbers(names, numbers, 10.0, "id", "no", "text").collect()} == {"1": "HALL /NORTH", "2": ""}


def test_names_of_one_place_go_by_text(spark):
    rows = [(1, 0.0, 1.0, "n9"), (2, 0.0, 1.0, "n10"), (3, 2.0, 1.0, "a"), (4, 0.0, 1.0, "n1"), (5, 2.0, 0.0, "z")]
    numbers = spark.createDataFrame([("1", 0.0, 0.0)], "no string, x double, y double")
    for some in (rows, rows[::-1], rows[2:] + rows[:2]):
        names = spark.createDataFrame(some, "id long, x double, y double, text string").repartition(3)
        assert [r.name for r in matching.named_numbers(names, numbers, 10.0, "id", "no", "text").collect()] == ["z n1 n10 n9 a"]


def test_clip_and_iou(spark):
    assert value(spark, G.area(shapes.clip_convex(lit_poly(*SQUARE), lit_poly((1, 1), (3, 1), (3, 3), (1, 3))))) == 1
    assert value(spark, G.area(shapes.clip_convex(lit_poly(*SQUARE), lit_poly((1, 3), (3, 3), (3, 1), (1, 1))))) == 1
    assert value(spark, F.size(shapes.clip_convex(lit_poly(*SQUARE), lit_poly((5, 5), (6, 5), (6, 6))))) == 0
    assert value(spark, shapes.convex_iou(lit_poly(*SQUARE), lit_poly(*SQUARE))) == 1
    assert value(spark, shapes.convex_iou(lit_poly(*SQUARE), lit_poly((1, 0), (3, 0), (3, 2), (1, 2)))) == pytest.approx(1 / 3)


def test_rectangles_and_corners(spark):
    r = value(spark, shapes.least_rectangle(lit_poly((0, 0), (4, 4), (3, 5), (-1, 1))))
    assert (r.area, r.length, r.width) == pytest.approx((8, 32**0.5, 2**0.5)) and abs(r.ux) == pytest.approx(0.5**0.5)
    assert value(spark, shapes.least_rectangle(lit_poly((1, 1), (1, 1)))) is None
    assert len(value(spark, shapes.without_straight_corners(lit_poly((0, 0), (1, 0.01), (2, 0), (2, 2), (0, 2)), 0.1))) == 4
    assert len(value(spark, shapes.without_straight_corners(lit_poly((0, 0), (1, 0), (2, 0)), 0.1))) == 3
    box = value(spark, G.bbox(shapes.box_along(F.lit(1.0), F.lit(2.0), F.lit(0.0), F.lit(1.0), F.lit(6.0), F.lit(2.0))))
    assert tuple(box) == pytest.approx((0, -1, 2, 6))
    assert value(spark, G.area(shapes.ellipse(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(1.0)))) == pytest.approx(6.28, abs=0.05)


def test_view_and_street(spark):
    view = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(100.0).alias("width"), F.lit(50.0).alias("height"))
    assert tuple(value(spark, shapes.zoomed(view, F.lit(100.0), F.lit(2.0), F.lit(50.0), F.lit(25.0)))) == (25, 12.5, 50, 25)
    assert value(spark, shapes.zoomed(view, F.lit(100.0), F.lit(99.0), F.lit(0.0), F.lit(0.0))).width == 12.5
    assert tuple(value(spark, shapes.street_box(lit_poly((10, 5), (40, 5), (400, 5)), F.lit(4.0), view))) == (8, 3, 34, 4)
    assert value(spark, shapes.street_box(lit_poly((500, 5), (600, 5)), F.lit(4.0), view)).width == 100


@pytest.mark.parametrize(
    ("source", "title", "html"),
    [
        ("# Top\n## Sub ##\ntext\nmore", "Top", "<h3>Sub</h3>\n<p>text more</p>"),
        ("# A\n# B", "A", "<h2>B</h2>"),
        ("- a\n- b\n  on\n\n- c", None, "<ul>\n<li>a</li>\n<li>b on</li>\n</ul>\n<ul>\n<li>c</li>\n</ul>"),
        ("1. a\n* b", None, "<ol>\n<li>a</li>\n</ol>\n<ul>\n<li>b</li>\n</ul>"),
        ("a\n***\n**b** [c](d) `x<**y**` _e_", None, "<p>a</p>\n<hr>\n<p><strong>b</strong> <a href=\"d\">c</a> <code>x&lt;**y**</code> <em>e</em></p>"),
        ("snake_case_name and 2*3*4", None, "<p>snake_case_name and 2*3*4</p>"),
        ("", None, ""),
    ],
)
def test_markdown(spark, source, title, html):
    got = value(spark, markdown.rendered(F.lit(source)))
    assert (got.title, got.html) == (title, html)


def test_markdown_null(spark):
    assert value(spark, markdown.rendered(F.lit(None).cast("string"))) is None


@pytest.mark.parametrize(("name", "number", "kind", "shown"), [("FACULTY OFFICE", "3117", "office", "Office 3117"), ("HUDDLE", "3189", "meeting", "Huddle Room 3189"), ("STORAGE", "CORR1", "circulation", "Storage CORR1"), ("OPEN OFFICE", "1", "open", "Open Office 1"), ("", "9", "office", "Room 9"), ("COPY/PRINTER", "2", "copy", "Copy/Printer 2")])
def test_plan_names(spark, name, number, kind, shown):
    assert value(spark, naming.category(F.lit(name), F.lit(number))) == kind
    assert value(spark, naming.display_name(F.lit(name), F.lit(number))) == shown


def test_icon_needs_room(spark):
    def box(w, h):
        return F.struct(F.lit(w).alias("width"), F.lit(h).alias("height"))

    tags, icons = F.array(F.lit("ne"), F.lit("steps")), {"steps": "stairs", "wc": "toilet"}
    assert value(spark, naming.icon(tags, icons, box(40.0, 50.0))) == "stairs"
    assert value(spark, naming.icon(tags, icons, box(40.0, 40.0))) is None
    assert value(spark, naming.icon(F.array(F.lit("wc")), icons, box(1.0, 1.0))) == "toilet"


def test_gap_and_worst(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("a", 4.0), ("a", 6.0), ("b", 1.0)], "g string, v double")
    assert {r.g: r.pitch for r in analytics.least_gap(df, "g", "v").collect()} == {"a": 2.0, "b": None}
    scores = spark.createDataFrame([(1, 0.7), (2, None), (3, 0.9), (4, 0.1)], "k long, iou double")
    assert [r.k for r in analytics.worst(scores, "iou", "k").collect()] == [2, 4, 1]


def test_pair_up(spark):
    r = random.Random(5)
    pairs = sorted({(a, b) for a, b in ((r.randrange(30), r.randrange(30)) for _ in range(60)) if a < b})
    used, want = set(), []
    for a, b in pairs:
        if not {a, b} & used:
            used |= {a, b}
            want.append((a, b))
    got = matching.pair_up(spark.createDataFrame(pairs, "a long, b long"), "a", "b", first=F.col("a"), second=F.col("b")).collect()
    assert sorted(map(tuple, got)) == want


ROLES = frozenset({"dean", "staff", "lab"})


@pytest.mark.parametrize(
    ("lines", "names", "dropped"),
    [
        (["Ada Byrd", "Max Stone"], ["Ada Byrd", "Max Stone"], []),
        (["Ada", "Byrd", "and Max", "de Stone"], ["Ada Byrd", "Max de Stone"], []),
        (["Staff Ada Byrd", "Dean", "Byrd"], ["Ada Byrd Byrd"], ["Dean"]),
        (["Stone", "Lab"], [], ["Lab", "Stone"]),
        (["CS Lab"], [], ["CS Lab"]),
        (["Room 3123A / Ada O’Neil [a", "b]"], ["Ada O'Neil"], ["Room 3123A"]),
        ([], [], []),
    ],
)
def test_names_in(spark, lines, names, dropped):
    got = value(spark, directory.block_names(F.lit(lines) if lines else F.array().cast("array<string>"), ROLES))
    assert (got.names, got.dropped) == (names, dropped)


def test_stacked_keeps_several_blocks_open(spark):
    rows = [(0.0, 0.0, 9.0, 5.0, "a1"), (0.0, 50.0, 59.0, 5.0, "b1"), (6.0, 1.0, 8.0, 5.0, "a2"), (6.0, 51.0, 58.0, 5.0, "b2"), (30.0, 0.0, 9.0, 5.0, "c1")]
    df = spark.createDataFrame([(rows,)], "l array<struct<down:double,a0:double,a1:double,size:double,text:string>>")
    assert df.select(directory.stacked(F.col("l"), 1.5).alias("v")).collect()[0].v == [["a1", "a2"], ["b1", "b2"], ["c1"]]


def test_directory_without_entries(spark):
    empty = directory.entries(spark.createDataFrame([(1, "<p>none</p>")], "id long, html string"), "id", "html", "/p/", "Tower")
    with pytest.raises(ValueError, match="layout"):
        directory.people_of_rooms(empty, "id")
    assert value(spark, directory.building_room(F.lit("b412 tower, phone"), "Tower")) == "B412"


def test_turned_to_axis_and_boxes_of_an_axis(spark):
    wedge = F.array(G.point(F.lit(0.0), F.lit(0.0)), G.point(F.lit(20.0), F.lit(1.0), F.lit(0.3)), G.point(F.lit(20.0), F.lit(4.0)))
    got = value(spark, shapes.turned_to_axis(wedge, F.lit(0.0)))
    assert [p.bulge for p in got] == [None, 0.3, None] and got[0].y == got[2].y == 2.6
    skew = lit_poly((0, 0), (10, 6), (9, 8))
    for same in (skew, lit_poly(*SQUARE), lit_poly((0, 0), (0, 0), (0, 0))):
        assert value(spark, shapes.turned_to_axis(same, F.lit(0.0))) == value(spark, same)
    none = F.lit(None).cast("array<struct<x:double,y:double,bulge:double>>")
    assert value(spark, shapes.turned_to_axis(none, F.lit(0.0))) is None and value(spark, shapes.turned_to_axis(skew, F.lit(None).cast("double"))) == value(spark, skew)
    assert value(spark, G.area(shapes.box_of_axis(skew))) < value(spark, G.area(shapes.box_of_axis(skew, F.lit(0.0)))) == 80.0


def test_rays_leave_ellipses(spark):
    e = F.struct(*[F.lit(v).alias(n) for n, v in (("cx", 1.0), ("cy", 2.0), ("a", 5.0), ("b", 3.0), ("turn", 30.0))])
    for deg in (0, 77, 200):
        p = value(spark, shapes.leaves_ellipse(e, F.lit(2.0), F.lit(1.5), F.lit(deg)))
        t = math.radians(30)
        u, v = (p.x - 1) * math.cos(t) + (p.y - 2) * math.sin(t), (p.y - 2) * math.cos(t) - (p.x - 1) * math.sin(t)
        assert abs(u * u / 25 + v * v / 9 - 1) < 1e-9
        assert abs(math.degrees(math.atan2(p.y - 1.5, p.x - 2)) % 360 - deg) < 1e-9


def test_without_jogs(spark):
    def corners(*points):
        return [(p.x, p.y) for p in value(spark, shapes.without_jogs(lit_poly(*points), 1.0, 10.0))]

    assert corners((0, 0), (5, 0), (5, 0.5), (9, 0.5), (9, 9), (0, 9)) == [(0, 0), (5, 0.25), (9, 0.5), (9, 9), (0, 9)]
    short_corner = ((0, 0), (5, 0), (5, 0.5), (9, 9))
    assert corners(*short_corner) == list(short_corner)
    # Two short edges in a row on one line: the first goes, the second starts at its end and stays.
    assert corners((0, 0), (5, 0), (5.5, 0), (6, 0), (9, 0), (9, 9)) == [(0, 0), (5.25, 0), (6, 0), (9, 0), (9, 9)]
    none = "array<struct<x:double,y:double,bulge:double>>"
    assert value(spark, shapes.without_jogs(F.array().cast(none), 1.0, 10.0)) == [] and value(spark, shapes.without_jogs(F.lit(None).cast(none), 1.0, 10.0)) is None


def test_arrow_head_of_no_stretch(spark):
    none = "array<struct<x:double,y:double,bulge:double>>"
    assert value(spark, marks.arrow_head(F.array().cast(none))) is None and value(spark, marks.arrow_head(F.lit(None).cast(none))) is None
    p = value(spark, marks.arrow_head(lit_poly((1, 2), (1, 2))))
    assert (p.x, p.y) == (1.0, 2.0)


def test_joins_by_cells_are_not_broadcast(spark, tmp_path):
    """A file of few bytes may hold many rows, which one task would then sort."""
    spark.range(30).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    polys = rows.select(F.col("id").alias("f"), F.col("id").alias("o"), G.moved(lit_poly(*SQUARE), 3.0).alias("poly"))
    points = rows.select("id", (F.col("id") / 9).alias("x"), F.lit(1.0).alias("y"))
    joins = (spatial.points_in_polygons(points, polys, 4.0, "id", "f", "o"), matching.holding_face(points, polys, 4.0, 1.0, 0.0, "id", "f"), matching.overlaps(polys, 4.0, "f"))
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in joins]
    assert all("(strategy=merge)" in p for p in plans) and [df.count() for df in joins] == [30, 30, 435]


def test_groups_of_parallel_lines_with_copies(spark):
    r = random.Random(4)
    kinds = [(r.randrange(4), r.randrange(360) / 2, r.randrange(80) / 1.0) for _ in range(60)]
    lines = spark.createDataFrame([(k, *r.choice(kinds)) for k in range(150)], "k long, own long, angle double, offset double")
    got = {(x.node, x.label) for x in matching.parallel_groups(lines, "k", "own", 9.0, 2.0).collect()}
    assert got == {(x.node, x.label) for x in components(matching.near_parallel(lines, "k", "own", 9.0, 2.0)).collect()} and got


def test_a_crowded_bucket_is_dealt_to_many_tasks(spark):
    strokes = spark.range(40).select("id", *[(s * f(F.radians(F.col("id") * 9.0)) * 5).alias(c) for c, s, f in (("ax", -1, F.cos), ("ay", -1, F.sin), ("bx", 1, F.cos), ("b_y", 1, F.sin))])
    found = matching.crossing_strokes(strokes, "id", 3.0, 0.5, 60.5, 120.0)
    turn = lambda a, b: abs((9 * a - 9 * b + 90) % 180 - 90)
    assert {tuple(x) for x in found.collect()} == {(a, b) for a in range(40) for b in range(a + 1, 40) if 60.5 <= turn(a, b) <= 120}
    assert found.rdd.getNumPartitions() >= 32


def test_much_work_on_rows_of_a_small_file_is_dealt_to_tasks(spark, sf):
    for name in ("hook_labels", "bank_cells", "hull_area"):
        assert QUERIES[name](spark, sf).rdd.getNumPartitions() >= 32
    assert dealt(spark.range(50_000), "id", rows=1_000).rdd.getNumPartitions() == 50
