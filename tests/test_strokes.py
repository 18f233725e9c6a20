"""Strokes, curves, facades, equal splits and code-module sources on small inline input, against direct versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillmap.functions import geometry as G
from quillmap.functions import strokes
from quillmap.sources import records


def value(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0].v


def point(x, y):
    return G.point(F.lit(float(x)), F.lit(float(y)))


def poly(*points):
    return F.array(*[point(*p) for p in points]) if points else F.array().cast("array<struct<x:double,y:double,bulge:double>>")


def border():
    return F.struct(*[F.lit(v).alias(n) for n, v in (("x", 0.0), ("y", 0.0), ("width", 100.0), ("height", 80.0))])


@pytest.mark.parametrize("a, b, flags, want", [((5, 5), (9, 5), (True, False, False), True), ((5, 5), (5.2, 5), (True, False, False), False), ((1, 5), (9, 5), (True, False, False), False), ((5, 5), (200, 5), (True, False, False), True), ((5, 5), (9, 5), (False, False, False), False), ((5, 5), (9, 5), (True, True, False), False), ((5, 5), (9, 5), (True, False, True), False), ((3, 77), (3, 70), (True, False, False), True)])
def test_wall_stroke(spark, a, b, flags, want):
    assert value(spark, strokes.is_wall_stroke(point(*a), point(*b), *map(F.lit, flags), border(), F.lit(1.0))) is want


@pytest.mark.parametrize("a, b, want", [((0, 3), (0.2, 50), True), ((99.5, 3), (99.5, 50), True), ((50, 3), (50, 50), False), ((4, 79.6), (60, 80), True), ((0, 3), (9, 50), False)])
def test_on_border(spark, a, b, want):
    assert value(spark, strokes.on_border(point(*a), point(*b), border())) is want


@pytest.mark.parametrize("quad, stroke, black, want", [(((0, 0), (30, 0), (30, 12), (0, 12)), 1.0, True, True), (((0, 0), (30, 0), (30, 12), (0, 12)), 0.5, True, False), (((0, 0), (30, 0), (30, 12), (0, 12)), 1.0, False, False), (((0, 0), (60, 0), (60, 12), (0, 12)), 1.0, True, False), (((0, 0), (30, 0), (30, 12)), 1.0, True, False), ((), 1.0, True, False)])
def test_desk(spark, quad, stroke, black, want):
    assert value(spark, strokes.is_desk(poly(*quad), F.lit(stroke), F.lit(black), F.lit(1.0))) is want


def test_quad_centre(spark):
    c = value(spark, strokes.quad_centre(poly((0, 0), (4, 0), (4, 2), (0, 2))))
    assert (c.x, c.y) == (2.0, 1.0)
    assert value(spark, strokes.quad_centre(poly())) is None


def test_bezier(spark):
    got = value(spark, strokes.bezier(poly((0, 0), (1, 2), (3, 2), (4, 0)), 5))
    assert [p.x for p in got] == pytest.approx([0, 0.90625, 2, 3.09375, 4])
    assert [p.y for p in got] == pytest.approx([0, 1.125, 1.5, 1.125, 0])


def test_facade(spark):
    square = poly((0, 0), (10, 0), (10, 4), (0, 4))
    near = value(spark, strokes.facade_direction(F.array(square, poly((0, 20), (3, 24), (0, 28))), F.lit(5.0), F.lit(3.5), 6.0))
    assert (near.ux, near.uy) == pytest.approx((-1, 0))
    other = value(spark, strokes.facade_direction(F.array(square, poly((0, 20), (30, 60), (0, 60))), F.lit(9.0), F.lit(33.0), 6.0))
    assert (other.ux, other.uy) == pytest.approx((0.6, 0.8))
    assert value(spark, strokes.facade_direction(F.array(square), F.lit(0.0), F.lit(0.0), 11.0)) is None


def test_equal_boxes(spark):
    got = value(spark, strokes.equal_boxes(poly((0, 0), (30, 0), (30, 14), (0, 14)), poly((25, 7), (2, 7), (12, 7)), F.lit(0.0)))
    assert [[(round(p.x, 6), round(p.y, 6)) for p in b] for b in got] == [[(x, 2.0), (x + 10, 2.0), (x + 10, 12.0), (x, 12.0)] for x in (20.0, 0.0, 10.0)]
    tied = value(spark, strokes.equal_boxes(poly((0, 0), (8, 0), (8, 4), (0, 4)), poly((5, 2), (5, 2)), F.lit(0.0)))
    assert [round(b[0].x, 6) for b in tied] == [0.0, 4.0]
    assert value(spark, strokes.equal_boxes(poly((0, 0), (8, 0), (8, 4), (0, 4)), poly(), F.lit(0.0))) == []
    # Seeds that spread across the direction turn the row.
    turned = value(spark, strokes.equal_boxes(poly((0, 0), (8, 0), (8, 20), (0, 20)), poly((4, 3), (4, 15)), F.lit(0.0)))
    assert [sorted({round(p.y, 6) for p in b}) for b in turned] == [[0.0, 10.0], [10.0, 20.0]]


def test_equal_boxes_areas(spark):
    draw = random.Random(5)
    for _ in range(4):
        n, turn, length = draw.randint(1, 5), draw.uniform(0, 90), draw.uniform(10, 40)
        c, s = math.cos(math.radians(turn)), math.sin(math.radians(turn))
        corners = [(x * c - y * s, x * s + y * c) for x, y in ((0, 0), (length, 0), (length, 3), (0, 3))]
        seeds = [(x * c, x * s) for x in (draw.uniform(0, length) for _ in range(n))]
        boxes = strokes.equal_boxes(poly(*corners), poly(*seeds), F.lit(turn))
        assert value(spark, F.transform(boxes, G.area)) == pytest.approx([(length / n) ** 2] * n)


@pytest.mark.parametrize("category, name, want", [("office", None, True), ("lab", "Main Office 3", True), ("lab", "Open Office 3", False), ("lab", "Officer", False), (None, None, False), ("office", "Open Office", True)])
def test_office(spark, category, name, want):
    assert value(spark, strokes.is_office(F.lit(category).cast("string"), F.lit(name).cast("string"))) is want


@pytest.mark.parametrize("corners, taken, want", [(((0, 0), (40, 0), (40, 30), (0, 30)), 0.0, True), (((0, 0), (40, 0), (40, 30), (0, 30)), 500.0, False), (((0, 0), (60, 0), (60, 15), (0, 15)), 0.0, False), (((0, 0), (200, 0), (200, 21), (0, 21)), 0.0, False), (((0, 0), (90, 0), (90, 10), (10, 10), (10, 90), (0, 90)), 0.0, False), ((), 0.0, False)])
def test_room_shape(spark, corners, taken, want):
    assert value(spark, strokes.is_room_shape(poly(*corners), F.lit(taken), (500.0, 5000.0))) is want


MODULE = """import x from './y';

export const frame = { x: 58, y: -4.5 };
export const rooms: Row[] = [
  [undefined, '10', 'study', [[1.5, 2.0], [3.0, 4.0, 0.25]]],
  ['North', '11\\'s "B"', 'a: b, undefined', [[1.0, 2.0]], { name: 'Hall: one', tags: ['x', 'y'] }],
];
export const none: Row[] = [
];
"""


def test_module_rows(spark, tmp_path):
    (tmp_path / "a.ts").write_text(MODULE)
    got = [r.row for r in records.module_rows(spark, str(tmp_path), "rooms").orderBy("line").collect()]
    assert got[0][:3] == [None, "10", "study"] and len(got[0]) == 4
    assert got[1][:3] == ["North", "11's \"B\"", "a: b, undefined"]
    read = records.module_rows(spark, str(tmp_path), "rooms").select("line", F.from_json(F.get("row", F.lit(3)), "array<array<double>>").alias("p"), F.from_json(F.get("row", F.lit(4)), "name string, tags array<string>").alias("more")).orderBy("line").collect()
    assert read[0].p == [[1.5, 2.0], [3.0, 4.0, 0.25]] and read[0].more is None
    assert read[1].more.name == "Hall: one" and read[1].more.tags == ["x", "y"]
    assert records.module_rows(spark, str(tmp_path), "none").count() == 0
    assert records.module_rows(spark, str(tmp_path), "absent").count() == 0
    frame = records.module_frame(spark, str(tmp_path), "frame").collect()[0]
    assert (frame.x, frame.y) == (58.0, -4.5)
    lost = records.module_frame(spark, str(tmp_path), "absent").collect()[0]
    assert (lost.x, lost.y) == (None, None)
