"""Voronoi cells tile their box, and each point of a cell has its seed nearest."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillmap.functions import geometry as G
from quillmap.operators.matching import nearest_within
from quillmap.operators.spatial import fine
from quillmap.operators.voronoi import voronoi

KIND = "k long, x double, y double, id string, poly string, i int"
BOX = (0.0, 0.0, 30.0, 20.0)


def frame(spark, points):
    return spark.createDataFrame([(k, x, y, "o", "o", 1) for k, x, y in points], KIND).repartition(3)


@pytest.mark.parametrize("n, size", [(1, 5.0), (2, 3.0), (40, 2.0), (40, 40.0)])
def test_cells_tile_the_box(spark, n, size):
    rng = random.Random(n)
    # most points in one corner, so that some cells reach far over empty grid cells
    points = [(k, rng.uniform(0, 8 if k % 4 else 30), rng.uniform(0, 6 if k % 4 else 20)) for k in range(n)]
    odd = [(900, points[0][1], points[0][2]), (901, None, 1.0), (None, 2.0, 2.0), (902, -1.0, 5.0)]
    rows = voronoi(frame(spark, points + odd), "k", BOX, size).select("k", "x", "y", "poly", G.area(F.col("poly")).alias("area")).collect()
    assert sorted(r.k for r in rows) == list(range(n)) and sum(r.area for r in rows) == pytest.approx(600)
    for r in rows:
        mx, my = sum(p.x for p in r.poly) / len(r.poly), sum(p.y for p in r.poly) / len(r.poly)
        for x, y in [(p.x * 0.999 + mx * 0.001, p.y * 0.999 + my * 0.001) for p in r.poly]:
            assert min(points, key=lambda q: (q[1] - x) ** 2 + (q[2] - y) ** 2)[0] == r.k


def test_no_points(spark):
    assert voronoi(frame(spark, []), "k", BOX, 5.0).collect() == []


def test_grids_grow_with_the_points(spark):
    """So that a cell holds a few points, however many the table has."""
    for n in (100, 10_000):
        assert n * fine(spark.range(n), 600.0, 8.0) ** 2 <= 2 * 600 < 4 * n * fine(spark.range(n), 600.0, 8.0) ** 2
    assert fine(spark.range(3), 600.0, 8.0) == 8.0 and fine(spark.range(9), 0.0, 8.0) == 8.0


def test_nearest_within_looks_into_farther_rings(spark):
    rng = random.Random(8)
    others = [(k, rng.randrange(60) / 2, rng.randrange(8) / 2) for k in range(700)] + [(900, None, 1.0), (901, 29.0, 40.0)]
    points = [(k, rng.uniform(-9, 39), rng.choice([rng.uniform(0, 4), rng.uniform(-9, 50)])) for k in range(150)] + [(200, None, 2.0)]
    got = nearest_within(spark.createDataFrame(points, "p long, x double, y double"), spark.createDataFrame(others, "o long, x double, y double"), 7.0, "p", "o").collect()
    assert len(got) == len(points)
    for r in got:
        near = [] if r.x is None else sorted((math.hypot(r.x - x, r.y - y), k) for k, x, y in others if x is not None and math.hypot(r.x - x, r.y - y) < 7)
        assert (r.o, r.distance) == ((near[0][1], pytest.approx(near[0][0])) if near else (None, None))
    none = nearest_within(spark.createDataFrame(points, "p long, x double, y double"), spark.createDataFrame([], "o long, x double, y double"), 7.0, "p", "o").collect()
    assert len(none) == len(points) and all(r.o is None for r in none)
