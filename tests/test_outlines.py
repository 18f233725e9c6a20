"""Arcs, straight pieces and simplification on small inline frames, against direct versions."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from quillmap.functions import geometry as G
from quillmap.operators import outlines

KIND = "shape string, place long, x double, y double, n string, r string, run string, bulge string"


def frame(spark, shapes):
    return spark.createDataFrame([(s, 2 * k, None if x is None else float(x), float(y), "o", "o", "o", "o") for s, pts in shapes.items() for k, (x, y) in enumerate(pts)], KIND).repartition(3)


def arc(cx, cy, r, start, sweep, n):
    return [(cx + r * math.cos(start + sweep * k / n), cy + r * math.sin(start + sweep * k / n)) for k in range(n + 1)]


def found(df):
    out = {}
    for r in df.orderBy("shape", "place").collect():
        out.setdefault(r["shape"], []).append(r)
    return out


@pytest.mark.parametrize("noise", [0.0, 1e-7])
def test_arcs_come_back(spark, noise):
    rng = random.Random(5)
    shapes, want = {}, {}
    for k in range(6):
        sweep = math.radians(rng.uniform(25, 95)) * (-1) ** k
        start = rng.uniform(0, 6)
        run = arc(3, 4, rng.uniform(20, 30), start, sweep, 9 + k)
        run = [(x + rng.uniform(-noise, noise), y + rng.uniform(-noise, noise)) for x, y in run]
        far = (3 + 90 * math.cos(start + sweep / 2 + math.pi), 4 + 90 * math.sin(start + sweep / 2 + math.pi))
        ring = [far, *run]
        turn = k % len(ring)
        shapes[f"s{k}"] = ring[turn:] + ring[:turn]
        want[f"s{k}"] = (run[0], run[-1], far, sweep)
    got = found(outlines.arcs(frame(spark, shapes), "shape", 0.01, 12.0))
    for s, (a, b, far, sweep) in want.items():
        assert sorted((r.x, r.y) for r in got[s]) == sorted((a, b, far))
        bulge = next(r.bulge for r in got[s] if (r.x, r.y) == a)
        assert abs(bulge) == pytest.approx(abs(math.tan(sweep / 4)), abs=1e-6) and all(r.bulge is None for r in got[s] if (r.x, r.y) != a)
    # the arcs that these bulges draw lie on the points
    rows = spark.createDataFrame([(s, [(r.x, r.y, r.bulge) for r in rs]) for s, rs in got.items()], "shape string, poly array<struct<x:double,y:double,bulge:double>>")
    flat = rows.select("shape", G.flatten(F.col("poly"), 0.02).alias("p")).collect()
    for r in flat:
        assert all(min(math.hypot(p.x - x, p.y - y) for p in r.p) < 0.3 for x, y in shapes[r["shape"]])


def test_arcs_split_and_leave(spark):
    circle = arc(0, 0, 10, 0, 2 * math.pi, 40)[:-1]
    two = arc(0, 0, 30, 0, 0.8, 8) + [(x, y) for x, y in arc(0, 0, 30, 0.8, 0.8, 8)[1:]]
    square = [(0, 0), (9, 0), (9, 9), (0, 9)]
    got = found(outlines.arcs(frame(spark, {"circle": circle, "two": [(-80, -80), *two], "square": square, "pair": [(0, 0), (1, 1)], "one": [(5, 5)], "gap": [(None, 1), *square]}), "shape", 0.01, 9.5))
    assert [abs(r.bulge) for r in got["circle"]] == [pytest.approx(math.tan(math.pi / 8))] * 4  # halves turn by too much
    assert len(got["two"]) == 3 and sum(r.bulge is not None for r in got["two"]) == 1
    assert [(r.x, r.y, r.bulge) for r in got["square"]] == [(*map(float, p), None) for p in square] and len(got["gap"]) == 4
    assert len(got["pair"]) == 2 and len(got["one"]) == 1
    assert outlines.arcs(frame(spark, {}), "shape", 0.1, 5.0).collect() == []


def cost(p, i, j):
    (ax, ay), (bx, by) = p[i], p[j]
    dx, dy = bx - ax, by - ay
    if not dx and not dy:
        return float(sum((x - ax) ** 2 + (y - ay) ** 2 for x, y in p[i : j + 1]))
    return sum((dx * (y - ay) - dy * (x - ax)) ** 2 for x, y in p[i : j + 1]) / (dx * dx + dy * dy)


@pytest.mark.parametrize("pieces", [1, 2, 4])
def test_straight_pieces_equal_brute_force(spark, pieces):
    rng = random.Random(pieces)
    shapes = {f"s{k}": [(rng.randrange(30), rng.randrange(30)) for _ in range(n)] for k, n in enumerate((1, 2, 3, 5, 9, 10))}
    got = {r["shape"]: r for r in outlines.straight_pieces(frame(spark, shapes), "shape", pieces).collect()}
    assert got.keys() == shapes.keys()
    for s, p in shapes.items():
        last, use = len(p) - 1, min(pieces, len(p) - 1)
        ways = [(0, *mid, last) for mid in itertools.combinations(range(1, last), use - 1)] if use else [(0,)]
        best = min((sum(cost(p, a, b) for a, b in itertools.pairwise(w)), w) for w in ways)
        assert got[s].error == pytest.approx(best[0]) and tuple(got[s].places) == best[1]
    assert outlines.straight_pieces(frame(spark, {}), "shape", 2).collect() == []


def split(p, lo, hi, off):
    (ax, ay), (bx, by) = p[lo], p[hi]
    length = math.hypot(bx - ax, by - ay)
    far = [(abs((bx - ax) * (y - ay) - (by - ay) * (x - ax)) / length if length else math.hypot(x - ax, y - ay), -k) for k, (x, y) in enumerate(p[lo + 1 : hi], lo + 1)]
    if not far or max(far)[0] <= off:
        return [lo, hi]
    at = -max(far)[1]
    return split(p, lo, at, off) + split(p, at, hi, off)


def test_simplified_equals_recursion(spark):
    rng = random.Random(2)
    shapes = {f"s{k}": [(x, rng.uniform(0, 9)) for x in range(k * 5)] for k in range(1, 9)} | {"ring": [(0, 0), (5, 0), (5, 5), (0, 5), (0, 0)], "one": [(1, 1)], "same": [(1, 1)] * 4}
    got = found(outlines.simplified(frame(spark, shapes), "shape", 2.0))
    for s, p in shapes.items():
        assert [r.place for r in got[s]] == sorted(set(split(p, 0, len(p) - 1, 2.0))), s
    assert outlines.simplified(frame(spark, {}), "shape", 1.0).collect() == []


def test_without_facets(spark):
    rng = random.Random(12)
    shapes = {"square": [(0, 0), (4, 0), (4, 4), (0, 4)], "round": [(math.cos(k / 20 * math.pi), math.sin(k / 20 * math.pi)) for k in range(40)], "line": [(k, 0) for k in range(7)]}
    shapes |= {"dot": [(1, 1)] * 6, "facet": [(0, 0), (5, 0.1), (10, 0), (10, 9), (0, 9)]}
    for name in "abcdefgh":
        way, pts = 0.0, [(0.0, 0.0)]
        for _ in range(rng.randint(5, 24)):
            way += math.radians(rng.choice([0, 0.2, 3, 3, 4, 8, 8, 11, 13, -3, -8, 40, 90]))
            step = rng.uniform(1, 3)
            pts.append((pts[-1][0] + step * math.cos(way), pts[-1][1] + step * math.sin(way)))
        shapes[name] = pts

    def direct(pts):
        n = len(pts)
        turns = []
        for i, (x, y) in enumerate(pts):
            (px, py), (qx, qy) = pts[i - 1], pts[(i + 1) % n]
            a, b = (x - px, y - py), (qx - x, qy - y)
            turns.append(0.0 if math.hypot(*a) < 1e-9 or math.hypot(*b) < 1e-9 else math.degrees(math.atan2(a[0] * b[1] - a[1] * b[0], a[0] * b[0] + a[1] * b[1])))
        side = [math.copysign(1, t) if 0.3 < abs(t) < 12 else 0 for t in turns]
        bent = [any(all(side[(i - k + m) % n] == side[i] != 0 for m in range(3)) for k in range(3)) for i in range(n)]
        stay = [i for i in range(n) if bent[i] or abs(turns[i]) >= 6]
        return stay if n >= 5 and len(stay) >= 3 else list(range(n))

    got = {s: [r.place for r in rows] for s, rows in found(outlines.without_facets(frame(spark, shapes | {None: [(1, 1)] * 5, "gap": [(None, 1)]}), "shape")).items()}
    assert got == {s: direct(pts) for s, pts in shapes.items()} and got["facet"] == [0, 2, 3, 4]
    assert outlines.without_facets(frame(spark, shapes).limit(0), "shape").count() == 0


def test_many_vertices_are_not_broadcast(spark):
    """Their file is of few bytes, of which a broadcast makes many."""
    points = spark.range(60_000).select(F.floor(F.col("id") / 6).alias("shape"), (F.col("id") % 6).alias("place"), (F.col("id") % 6).alias("x"), (F.col("id") % 2 * 5).alias("y"))
    kept = outlines.simplified(points, "shape", 1.0)
    assert "BroadcastHashJoin" not in kept._jdf.queryExecution().executedPlan().toString()
    assert kept.count() == 60_000
