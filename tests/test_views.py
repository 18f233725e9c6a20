"""Drawing, labels, numbering and regions on small inline frames, against direct versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillmap.functions import geometry as G
from quillmap.functions import marks, shapes
from quillmap.operators import grid
from quillmap.sources import records


def value(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0].v


def poly(*points):
    return F.array(*[G.point(F.lit(float(x)), F.lit(float(y))) for x, y in points])


def box(x, y, w, h):
    return F.struct(*[F.lit(float(v)).alias(n) for n, v in (("x", x), ("y", y), ("width", w), ("height", h))])


SQUARE = ((0, 0), (10, 0), (10, 10), (0, 10))


@pytest.mark.parametrize("by, area", [(0.0, 100.0), (2.0, 36.0), (5.0, 0.0), (6.0, 0.0)])
def test_inset(spark, by, area):
    for ring in (SQUARE, SQUARE[::-1], (*SQUARE, SQUARE[-1])):  # both ways round, and with a repeated vertex
        assert value(spark, F.coalesce(G.area(shapes.inset_convex(poly(*ring), by)), F.lit(0.0))) == pytest.approx(area)


def test_hausdorff(spark):
    assert value(spark, shapes.hausdorff(poly(*SQUARE), poly(*SQUARE))) == 0
    assert value(spark, shapes.hausdorff(poly(*SQUARE), poly((3, 3), (7, 3), (7, 7), (3, 7)))) == pytest.approx(math.hypot(3, 3))


def test_panned(spark):
    def at(b, margin=1.0):
        return tuple(value(spark, shapes.panned(box(0, 0, 20, 20), b, margin)))

    assert at(box(5, 5, 2, 2)) == (0, 0, 20, 20)
    assert at(box(30, -9, 2, 2)) == (13, -10, 20, 20)
    assert at(box(10, 0, 40, 2)) == (20, -1, 20, 20)


def test_bulge_meets_the_middle_point(spark):
    r = random.Random(4)
    for _ in range(8):
        turn, start = r.uniform(-5.5, 5.5), r.uniform(0, 6)
        a, m, b = ((3 + 2 * math.cos(start + turn * t), 1 + 2 * math.sin(start + turn * t)) for t in (0, r.uniform(0.2, 0.8), 1))
        k = value(spark, shapes.bulge_through(*[G.point(F.lit(x), F.lit(y)) for x, y in (a, m, b)]))
        c = value(spark, G.arc(G.point(F.lit(a[0]), F.lit(a[1]), F.lit(k)), G.point(F.lit(b[0]), F.lit(b[1]))))
        assert (c.cx, c.cy, c.r, c.sweep) == pytest.approx((3, 1, 2, turn))


def test_bulge_of_lines(spark):
    points = [G.point(F.lit(float(x)), F.lit(0.0)) for x in (0, 1, 3)]
    assert value(spark, shapes.bulge_through(*points)) == 0
    assert value(spark, shapes.bulge_through(points[0], points[2], points[1])) is None


def test_circle_of(spark):
    around = [(5 + 3 * math.cos(t), -2 + 3 * math.sin(t)) for t in (0.1, 0.8, 2.0, 4.0)]
    assert tuple(value(spark, shapes.circle_of(poly(*around)))) == pytest.approx((5, -2, 3, 0), abs=1e-9)
    assert value(spark, shapes.circle_of(poly((0, 0), (1, 1), (2, 2)))) is None
    assert value(spark, shapes.circle_of(F.slice(poly(*SQUARE), 1, 0))) is None


def test_gentle(spark):
    line = [(4.0 * k, 0.2 * k * k) for k in range(6)]
    assert value(spark, shapes.gentle(poly(*line)))
    assert not value(spark, shapes.gentle(poly(*line[:3])))
    assert not value(spark, shapes.gentle(poly(*line, (0, 0))))
    assert not value(spark, shapes.gentle(poly(*[(0.1 * x, 0.1 * y) for x, y in line])))
    assert not value(spark, shapes.gentle(poly(*[(10 * math.cos(t / 4), 10 * math.sin(t / 4)) for t in range(7)])))
    assert value(spark, shapes.gentle(poly(*[(60 * math.cos(t / 4), 60 * math.sin(t / 4)) for t in range(7)])))


def test_space(spark):
    rows = spark.createDataFrame([("3", "3161", "meeting", "Northeast", None, None, None), ("3", "Men’s Room", "x", None, None, None, ["t"]), ("3", "a1", None, None, "Hall", "H", None)], "f string, k string, c string, w string, n string, l string, t array<string>")
    made = [tuple(r.m) for r in rows.select(marks.space(*map(F.col, "fkcw"), {"meeting": "Meeting Room"}, F.col("n"), F.col("l"), F.col("t")).alias("m")).collect()]
    assert made == [("3-3161", "Meeting Room 3161", "3161", ["northeast", "3161"]), ("3-men-s-room", "Room Men’s Room", "Men’s Room", ["t"]), ("3-a1", "Hall", "H", [])]


def test_label_lines(spark):
    none = F.lit(None).cast("string")
    assert value(spark, marks.label_lines(none, F.lit("Lab 1"), none, F.lit(None).cast("array<string>"))) == ["Lab 1"]
    assert value(spark, marks.label_lines(F.lit("a\nb"), F.lit("x"), F.lit("c d"), F.array(F.lit("Ada May Byrd"), F.lit("Max")), 1)) == ["a", "b", "c", "d", "Ada May", "Byrd", "Max"]


def test_caption(spark):
    def of(name, number, side):
        return value(spark, marks.caption(F.lit(name), F.lit(number), poly((0, 0), (side, 0), (side, side), (0, side))))

    assert of("Great Hall 12", "12", 100) == "Great Hall"
    assert of("Great Hall 12", "12", 99) is None and of("Office 12", "12", 100) is None and of("12", "12", 100) is None and of("Great Hall", "12", 100) is None


def test_door_without_width(spark):
    p = G.point(F.lit(1.0), F.lit(1.0))
    assert value(spark, marks.door_swing(p, p, p, F.lit(2), 14.0)) == "M0 0 L0 0 A0 0 0 0 0 0 0 M0 0 L0 0 A0 0 0 0 0 0 0"


def test_patch_problems(spark):
    one = F.array(F.lit(1.0))
    nothing = F.lit(None).cast("array<array<double>>")
    assert value(spark, records.patch_problems(nothing, nothing, F.lit(None).cast("map<string,array<array<double>>>"))) == []
    assert value(spark, records.patch_problems(F.array(one), F.array(one), F.create_map(F.lit("g"), F.array(one)))) == ["line 1 needs 4 values", "door 1 needs 2 values", "guide g needs 3 points"]


@pytest.mark.parametrize("n", [0, 300])
def test_numbered(spark, n):
    r = random.Random(5)
    rows = [(r.choice(["hot", "hot", "hot", "b", None]), r.choice([None, 1, 2, 3]), k, "kept") for k in range(n)]
    got = grid.numbered(spark.createDataFrame(rows, "g string, v int, k long, __size string"), "g", "v", "k").collect()
    want = {}
    for g in {x[0] for x in rows}:
        for at, x in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is not None, x[1] or 0, x[2])), 1):
            want[x[2]] = at
    assert {x.k: x.n for x in got} == want and len(got) == n and all(x["__size"] == "kept" for x in got)


def flooded(cells, steps):
    left, out = set(cells), {}
    while left:
        first = min(left)
        front, found = [first], {first}
        while front:
            g, x, y = front.pop()
            for dx, dy in steps:
                c = (g, x + dx, y + dy)
                if c in left and c not in found:
                    found.add(c)
                    front.append(c)
        left -= found
        out |= {c: first[1:] for c in found}
    return out


@pytest.mark.parametrize("corners", [False, True])
def test_regions(spark, corners):
    r = random.Random(6)
    cells = [(r.randrange(2), r.randrange(9), r.randrange(9)) for _ in range(70)]
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (corners or not (a and b))]
    got = grid.regions(spark.createDataFrame([*cells, *cells[:5], (None, 1, 1), (1, None, 1)], "g int, x int, y int"), "g", corners=corners)
    assert {(c.g, c.x, c.y): (c.region_x, c.region_y) for c in got.collect()} == flooded(cells, steps)
    sizes = grid.region_sizes(got, "g").collect()
    assert sum(s.cells for s in sizes) == len(set(cells)) and [s.cells for s in sizes] == sorted((s.cells for s in sizes), reverse=True)


def test_regions_of_nothing(spark):
    assert grid.regions(spark.createDataFrame([], "g int, x int, y int"), "g").collect() == []


def test_cell_queries_over_all_parts(spark):
    from quillmap import view_queries as V

    d = "/root/testdata/sf0.01"
    keys = [p.p_partkey for p in spark.read.parquet(f"{d}/part.parquet").select("p_partkey").collect()]
    spots = {(k % 2, k * 7 // 3 % 60, k * 11 // 5 % 50) for k in keys}
    sides = [(1, 0), (-1, 0), (0, 1), (0, -1)]
    want = flooded(spots, sides)
    got = {(c.floor, c.x, c.y): (c.region_x, c.region_y) for c in V.all_cell_regions(spark, d).collect()}
    assert got == want and set(got) == spots
    sizes = [s.cells for s in V.all_region_sizes(spark, d).collect()]
    assert sum(sizes) == len(spots) and sizes == sorted(sizes, reverse=True) and sizes[0] > 1
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    wide = {(g, x + a, y + b) for g, x, y in spots for a, b in near}
    assert {tuple(c) for c in V.all_closed_cells(spark, d).collect()} == {(g, x, y) for g, x, y in wide if all((g, x + a, y + b) in wide for a, b in near)}
    grown = {(g, x, y): x * 100 + y for g, x, y in spots if x % 4 == 0}
    for _ in range(3):
        new = {}
        for (g, x, y), v in grown.items():
            for a, b in sides:
                if (c := (g, x + a, y + b)) in spots and c not in grown:
                    new[c] = min(v, new.get(c, v))
        grown |= new
    assert {(c.floor, c.x, c.y): c.label for c in V.all_grown_cells(spark, d).collect()} == grown


def chain_hull(points):
    def half(ps):
        out = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    ps = sorted(set(points))
    return set(half(ps) + half(ps[::-1])) if len(ps) > 1 else set(ps)


@pytest.mark.parametrize("n, size", [(0, 1), (1, 9), (2, 9), (30, 6), (60, 40)])
def test_hull(spark, n, size):
    r = random.Random(n)
    points = [(float(r.randrange(size)), float(r.randrange(size))) for _ in range(n)]
    rows = spark.createDataFrame([([(*p, None) for p in points + points[:2]],), ([(float(k), 2.0 * k, 0.0) for k in range(4)],)], "v array<struct<x: double, y: double, bulge: double>>")
    got, line = [[(p.x, p.y) for p in x.h] for x in rows.select(shapes.hull(F.col("v")).alias("h")).collect()]
    assert set(got) == chain_hull(points) and len(got) == len(set(got))
    assert line == [(0, 0), (3, 6)]


def test_owned(spark):
    shapes_ = spark.createDataFrame([(1, 0.0, 4.0), (2, 2.0, 4.0), (3, 2.0, 4.0)], "id long, x double, w double")
    x, w = F.col("x"), F.col("w")
    cells = grid.rasterised(shapes_.select("id", F.array(G.point(x, F.lit(0.0)), G.point(x + w, F.lit(0.0)), G.point(x + w, F.lit(1.0)), G.point(x, F.lit(1.0))).alias("poly")), 1.0)
    assert sorted((c.id, c.x, c.y) for c in cells.collect()) == [(k, x, 0) for k, low in ((1, 0), (2, 2), (3, 2)) for x in range(low, low + 4)]
    rank = F.when(F.col("id") == 1, 5).otherwise(1)
    assert {(c.x, c.id) for c in grid.owned(cells.withColumn("rank", rank), "rank", "id").collect()} == {(0, 1), (1, 1), (2, 2), (3, 2), (4, 2), (5, 2)}


def test_closed(spark):
    r = random.Random(7)
    cells = {(r.randrange(2), r.randrange(12), r.randrange(12)) for _ in range(60)}
    got = grid.closed(spark.createDataFrame([*cells, *list(cells)[:4]], "g int, x int, y int"), 1, "g").collect()
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    wide = {(g, x + a, y + b) for g, x, y in cells for a, b in near}
    assert {tuple(c) for c in got} == {(g, x, y) for g, x, y in wide if all((g, x + a, y + b) in wide for a, b in near)} and len(got) >= len(cells)


@pytest.mark.parametrize("rounds", [0, 2, 50])
def test_grown(spark, rounds):
    r = random.Random(8)
    free = {(1, x, y) for x in range(10) for y in range(10) if r.random() < 0.7}
    seeds = [(*c, k) for k, c in enumerate(sorted(free)[::17])] + [(1, -5, 0, 9)]
    want = {s[:3]: s[3] for s in seeds if s[:3] in free}
    for _ in range(rounds):
        new = {}
        for (g, x, y), v in want.items():
            for c in ((g, x + 1, y), (g, x - 1, y), (g, x, y + 1), (g, x, y - 1)):
                if c in free and c not in want:
                    new[c] = min(v, new.get(c, v))
        want |= new
    got = grid.grown(spark.createDataFrame(seeds, "g int, x int, y int, label int"), spark.createDataFrame([*free, (1, None, 1)], "g int, x int, y int"), rounds, "g").collect()
    assert {(c.g, c.x, c.y): c.label for c in got} == want and len(got) == len(want)


def test_rasterised_is_the_cells_whose_middles_are_inside(spark):
    r = random.Random(9)
    rings = [(k, [(r.uniform(-6, 6), r.uniform(-6, 6), None) for _ in range(3 + k % 5)]) for k in range(12)] + [(98, []), (99, [(0.0, 0.0, None)])]
    items = spark.createDataFrame(rings, "id int, poly array<struct<x: double, y: double, bulge: double>>")
    places = spark.range(-20, 20).select(F.col("id").alias("x")).crossJoin(spark.range(-20, 20).select(F.col("id").alias("y")))
    want = items.where("id < 90").crossJoin(places).where(G.contains(F.col("poly"), (F.col("x") + 0.5) * 0.5, (F.col("y") + 0.5) * 0.5)).select("id", "x", "y")
    got = sorted(map(tuple, grid.rasterised(items, 0.5).collect()))
    assert got == sorted(map(tuple, want.collect())) and got


@pytest.mark.parametrize("far", [16390.0, 1.8e6])
def test_hull_far_from_the_origin(spark, far):
    corners = [(340 + r * math.cos(2 * math.pi * i / 7), far + r * math.sin(2 * math.pi * i / 7)) for r in (2, 5) for i in range(7)]
    rows = []
    for poly in (corners[:7], corners[7:]):
        on = [((2 * a + c) / 3, (2 * b + d) / 3) for (a, b), (c, d) in zip(poly, poly[1:] + poly[:1])]
        rows.append((on + poly[::-1] + poly, sorted(poly)))
    df = spark.createDataFrame([(pts, want) for pts, want in rows], "v array<struct<x: double, y: double>>, want array<struct<x: double, y: double>>")
    for r in df.select("want", shapes.hull(F.col("v")).alias("h")).collect():
        assert sorted((p.x, p.y) for p in r.h) == [(p.x, p.y) for p in r.want]
