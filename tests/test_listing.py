"""Panels, filters, orders, medians and further matching on small frames, against direct versions."""

import html
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quillmap.functions import cards, text
from quillmap.operators import analytics, grid, matching, relate, search, spatial


def test_unescaped_like_the_standard_library(spark):
    cases = ["", "a &amp;lt; b", "&copy;&#169;&#xA9;&#XA9", "&am &ampx &amp", "&notit; &notin; &NotEqualTilde;", "&#0; &#xD800; &#x110000; &#128; &#159; &#129;", "&bogus; &; & &&amp;", "&#32;x&#x1F600;", "&lt", "AT&T &nbsp;", "&CounterClockwiseContourIntegral;", "&#xg; &#;"]
    frame = spark.createDataFrame(list(enumerate(cases)) + [(99, None)], "k int, t string")
    got = {r.k: r.v for r in frame.select("k", text.unescaped(F.col("t")).alias("v")).collect()}
    assert got.pop(99) is None
    for k, t in enumerate(cases):
        want = html.unescape(t)
        assert got[k] == want, t


def greedy(words, most):
    lines = []
    for w in words:
        if lines and len(lines[-1]) + 1 + len(w) <= most:
            lines[-1] += " " + w
        else:
            lines.append(w)
    return lines


def test_wrap_words(spark):
    rng = random.Random(3)
    cases = [" ".join("x" * rng.randint(1, 30) for _ in range(n)) for n in (0, 1, 5, 50, 20_000)] + ["a\n\tb  c", "  ", None, "éé ü" * 9]
    frame = spark.createDataFrame(list(enumerate(cases)), "k int, t string")
    for r in frame.select("k", "t", text.wrap_words(F.col("t"), 22).alias("v")).collect():
        assert r.v == (None if r.t is None else greedy(r.t.split(), 22))


def test_cards(spark):
    rows = [("Lab", ["A", "B"], "Dept", 3), ("Lab", ["A"], "", 0), ("Lab", [], None, None), ("Lab", None, "Dept", 3)]
    frame = spark.createDataFrame(rows, "name string, people array<string>, dept string, capacity int")
    name, people, dept = F.col("name"), F.col("people"), F.col("dept")
    got = frame.select(cards.title(name, people), cards.subtitle(people, dept), cards.spoken(name, people), cards.facts(F.lit("1"), F.lit(None).cast("string"), F.lit("lab"), dept, people, F.col("capacity"), F.array(F.lit("t")))).collect()
    assert [tuple(r)[:3] for r in got] == [("Lab · A, B", "A, B · Dept", "Lab, A, B"), ("Lab · A", "A", "Lab, A"), ("Lab", "", "Lab"), ("Lab", "Dept", "Lab")]
    assert [[x.label for x in r[3]] for r in got] == [["Floor", "Type", "Department", "Occupants", "Capacity", "Tags"], ["Floor", "Type", "Occupant", "Tags"], ["Floor", "Type", "Tags"], ["Floor", "Type", "Department", "Capacity", "Tags"]]
    one = spark.range(1).select(cards.toggled(F.array(F.lit("a")), F.lit("a")), cards.toggled(F.array(F.lit("a")), F.lit("b")), cards.merged_tags(F.array(F.lit("b"), F.lit("a")), F.lit(None).cast("array<string>")), cards.next_index(F.lit(0), F.lit(-1), F.lit(4)), cards.next_index(F.lit(0), F.lit(1), F.lit(0)), cards.new_id()).collect()[0]
    assert tuple(one)[:5] == ([], ["a", "b"], ["a", "b"], 3, None) and re.fullmatch(r"[0-9a-z]{9,}", one[5])


@pytest.mark.parametrize("n", [0, 1, 2, 7, 8, 500])
def test_medians(spark, n):
    rng = random.Random(n)
    rows = [(g, float(rng.randint(0, 20))) for g in ("a", "b", None) for _ in range(n)] + [("c", None)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = {r.g: (r.upper, r.middle) for r in analytics.medians(frame, "g", "v").collect()}
    want = {}
    for g in ("a", "b", None):
        v = sorted(x for h, x in rows if h == g and x is not None)
        if v:
            want[g] = (v[n // 2], (v[(n - 1) // 2] + v[n // 2]) / 2)
    assert got == want


def test_suffixed_and_report(spark):
    frame = spark.createDataFrame([("x", 3), ("x", 1), ("y", 2), (None, 5), ("x", 2)], "key string, o int").repartition(3)
    got = {(r.key, r.o): r.u for r in relate.suffixed(frame, "key", [F.col("o")], "u").collect()}
    assert got == {("x", 1): "x", ("x", 2): "x-2", ("x", 3): "x-3", ("y", 2): "y", (None, 5): None}
    lines = relate.report("Head", frame.withColumn("line", F.col("o").cast("string")), "o", "line").orderBy("pos").collect()
    assert [r.line for r in lines] == ["Head (5)", "1", "2", "2", "3", "5"]
    assert [r.line for r in relate.report("Head", frame.limit(0).withColumn("line", F.lit("")), "o", "line").collect()] == ["Head (0)"]
    none = relate.problem_summary(relate.problems_in_order([frame.limit(0).select(F.col("key").alias("problem"))])).collect()[0]
    assert (none.n, none.summary) == (0, "no problems")


def test_search_order_and_filters(spark):
    frame = spark.createDataFrame([(1, "b one"), (2, "B one"), (3, "a one"), (4, "a one"), (5, None)], "id long, name string")
    found = search.ranked_search(frame, "ONE", id_col="id", name=F.col("name"), order=F.col("id")).collect()
    assert [r.id for r in found] == [3, 4, 1, 2]
    assert search.ranked_search(frame, "  ", id_col="id", name=F.col("name"), order=F.col("id")).count() == 0
    kinds = spark.createDataFrame([("lab",), ("hall",)], "c string").select("c", search.navigable(F.col("c"), F.lit(True), F.lit(False), ("hall",), [], ()).alias("n"), search.listed(F.col("c"), F.lit("x"), ("hall",), "Room", ["lab", "hall"]).alias("l"))
    assert {r.c: (r.n, r.l) for r in kinds.collect()} == {"lab": (True, True), "hall": (False, False)}


def test_circular_runs(spark):
    frame = spark.createDataFrame([("a", x, k) for k, x in enumerate((5.0, 20.0, 100.0, 110.0, 350.0))] + [("b", 10.0, 9)], "g string, angle double, o int")
    got = {(r.g, r.angle): r.run for r in analytics.circular_runs(frame, "g", "angle", "o").collect()}
    assert got == {("a", 5.0): 0, ("a", 20.0): 0, ("a", 100.0): 1, ("a", 110.0): 1, ("a", 350.0): 0, ("b", 10.0): 0}
    assert analytics.circular_runs(frame.limit(0), "g", "angle", "o").count() == 0


def test_touching(spark):
    circles = spark.createDataFrame([(1, 0.0, 0.0, 2.0), (2, 50.0, 0.0, 2.0), (3, 0.0, 20.0, 2.0)], "id int, cx double, cy double, r double")
    strokes = spark.createDataFrame([(2.4, -5.0, 2.4, 5.0), (50.0, 1.0, 51.0, 1.0), (-30.0, 20.0, 40.0, 20.0)], "ax double, ay double, bx double, b_y double")
    assert {r.id for r in matching.touching(circles, strokes, 4.0, "id", 3.0).collect()} == {1, 3}


def test_colour_cells_lose_nothing(spark):
    rng = random.Random(5)
    items = [(k, f"s{k % 3}", *(rng.random() for _ in range(3))) for k in range(200)] + [(999, "s0", None, 0.1, 0.1)]
    legend = [(k, f"n{k}", f"s{k % 4}", *(rng.random() for _ in range(3))) for k in range(30)]
    got = spatial.nearest_colour(spark.createDataFrame(items, "id int, sheet string, r double, g double, b double"), spark.createDataFrame(legend, "ord int, name string, sheet string, r double, g double, b double"), "id", "sheet", 0.4, 0.2)
    for r in got.collect():
        item = next(x for x in items if x[0] == r.id)
        if item[2] is None:
            assert r.name is None
            continue
        near = sorted((math.dist(item[2:], x[3:]), x[0], x[1], x[2]) for x in legend)
        own = [x for x in near if x[3] == item[1] and x[0] <= 0.4]
        other = [x for x in near if x[0] <= 0.2]
        assert r.name == (own[0][2] if own else other[0][2] if other else None)


def test_coverage_at_coarse_cells(spark):
    def box(x0, y0, x1, y1):
        return [{"x": float(x), "y": float(y), "bulge": None} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]

    schema = "room_id int, floor int, poly array<struct<x double, y double, bulge double>>"
    rooms = spark.createDataFrame([(1, 0, box(0, 0, 20, 10)), (2, 1, box(0, 0, 4, 4))], schema)
    fills = spark.createDataFrame([(0, "a", box(-5, -5, 10, 20)), (0, "a", box(5, 0, 15, 10)), (0, "b", box(19, 9, 40, 40))], "floor int, name string, poly array<struct<x double, y double, bulge double>>")
    got = {(r.room_id, r.name): r.fraction for r in spatial.coverage(rooms, fills, "floor", 1.0).collect()}
    assert got == {(1, "a"): 0.75, (1, "b"): 1 / 200}


def test_region_labels(spark):
    cells = spark.createDataFrame([(0, 0, 0, "p"), (0, 1, 0, "q"), (0, 1, 0, "p"), (0, 5, 5, None), (1, 0, 0, "p")], "floor int, x int, y int, label string")
    got = grid.labels_per_region(grid.regions(cells, "floor"), cells, "floor").collect()
    assert [(r.floor, r.region_x, r.labels) for r in got] == [(0, 0, 2), (1, 0, 1), (0, 5, 0)]
