"""Outlines set straight by traced points, and drawn shapes against traced ones, on small inline frames."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from quillmap.operators import overlay, sides

POINTS = "shape string, x double, y double, side string, angle string"
OUTLINES = "shape string, poly array<struct<x: double, y: double, bulge: double>>, side string, n string"


def direct(corners, points, least, least_angle):
    """Corners by principal axes and a linear solve."""
    n = len(corners)
    held = [[] for _ in corners]
    for p in points:
        away = []
        for i, a in enumerate(corners):
            d = np.subtract(corners[(i + 1) % n], a)
            t = min(max(np.dot(np.subtract(p, a), d) / (d @ d), 0), 1)
            away.append(float(np.linalg.norm(np.subtract(p, a) - t * d)))
        held[away.index(min(away))].append(p)
    lines = []
    for pts in held:
        if len(pts) < least:
            lines.append(None)
            continue
        m = np.mean(pts, axis=0)
        lines.append((m, np.linalg.svd(np.array(pts) - m)[2][0]))
    out = []
    for i, q in enumerate(corners):
        a, b = lines[i - 1], lines[i]
        if a and b and abs(a[1][0] * b[1][1] - a[1][1] * b[1][0]) >= math.sin(math.radians(least_angle)):
            s = np.linalg.solve(np.column_stack([a[1], -b[1]]), b[0] - a[0])
            out.append(a[0] + s[0] * a[1])
        elif a or b:
            m, d = b or a
            out.append(m + np.dot(np.subtract(q, m), d) * d)
        else:
            out.append(np.array(q, float))
    return out


def test_straightened(spark):
    rng = random.Random(6)
    shapes, points = {}, {}
    for name, n, count in (("tri", 3, 9), ("five", 5, 12), ("flat", 12, 14), ("few", 4, 3), ("some", 6, None)):
        r = [rng.uniform(8, 12) for _ in range(n)]
        shapes[name] = [(1e5 + r[i] * math.cos(2 * math.pi * i / n + 0.3), r[i] * math.sin(2 * math.pi * i / n + 0.3)) for i in range(n)]
        points[name] = []
        for i, (ax, ay) in enumerate(shapes[name]):
            bx, by = shapes[name][(i + 1) % n]
            for _ in range(count or rng.choice([2, 9])):
                t = rng.uniform(0.05, 0.95)
                points[name].append((ax + t * (bx - ax) + rng.gauss(0, 0.05), ay + t * (by - ay) + rng.gauss(0, 0.05)))
    rows = [(k, *p, "o", "o") for k, ps in points.items() for p in ps] + [(None, 1.0, 1.0, "o", "o"), ("tri", None, 1.0, "o", "o"), ("gone", 1.0, 1.0, "o", "o")]
    own = [(k, [(x, y, 0.5) for x, y in c], "o", "o") for k, c in shapes.items()]
    own += [("bare", [(0.0, 0.0, None), (1.0, 0.0, None), (0.0, 1.0, None)], "o", "o"), ("none", [], "o", "o"), ("null", None, "o", "o"), (None, [(0.0, 0.0, None)], "o", "o")]
    found = sides.straightened(spark.createDataFrame(rows, POINTS).repartition(3), spark.createDataFrame(own, OUTLINES), "shape")
    assert found.columns == ["shape", "poly", "side", "n"]
    got = {r.shape: r.poly for r in found.collect()}
    for k, c in shapes.items():
        np.testing.assert_allclose([(p.x, p.y) for p in got[k]], direct(c, points[k], 6, 20.0), atol=1e-6)
    assert [(p.x, p.y) for p in got["bare"]] == [(0, 0), (1, 0), (0, 1)] and got["none"] == [] and got["null"] is None and len(got[None]) == 1
    assert sides.straightened(spark.createDataFrame([], POINTS), spark.createDataFrame([], OUTLINES), "shape").count() == 0
    # points in one place make no line
    same = spark.createDataFrame([("tri", 1e5 + 1.0, 2.0, "o", "o")] * 9, POINTS)
    assert sides.side_lines(same, spark.createDataFrame(own, OUTLINES), "shape").count() == 0


def box(x, y, w, h):
    return [[(x, y), (x + w, y), (x + w, y + h), (x, y + h)]]


def test_compared(spark):
    kind = "id long, rings array<array<struct<x: double, y: double>>>, exempt boolean, kind string, hand string, found string"

    def frame(rows):
        return spark.createDataFrame([(i, [[(float(x), float(y)) for x, y in r] for r in rings], e, k, "o", "o") for i, rings, e, k in rows], kind)

    drawn = frame([(1, box(0, 0, 4, 4), False, None), (2, box(0, 0, 4, 4), True, None), (3, box(9, 9, 2, 2), None, None), (4, box(0, 0, 40, 2), False, None), (5, box(0, 0, 1, 1), False, None), (None, box(0, 0, 1, 1), False, None)])
    traced = frame([(1, box(2, 0, 4, 4), None, "room"), (2, box(0, 0, 4, 4), None, "room"), (4, box(0, 1, 40, 2), None, "open"), (5, box(50, 50, 1, 1), None, None), (9, box(0, 0, 4, 4), None, "room")])
    found = overlay.compared(drawn, traced, 3.0)
    got = {r.id: (r.status, None if r.iou is None else round(r.iou, 9)) for r in found.collect()}
    assert got == {1: ("room", round(1 / 3, 9)), 2: ("hand", None), 3: ("missing", None), 4: ("open", round(1 / 3, 9)), 5: (None, 0.0)}
    assert [tuple(r) for r in overlay.status_counts(found).collect()] == [(5, 3, 1, 1)]
    assert overlay.compared(drawn.limit(0), traced, 3.0).count() == 0
    assert {r.status for r in overlay.compared(drawn, traced.limit(0), 3.0).collect()} == {"hand", "missing"}
    assert found.where(F.col("iou") > 1).count() == 0


def test_outlines_are_not_broadcast_by_the_size_of_their_file(spark, tmp_path):
    spark.range(20_000).write.parquet(str(tmp_path / "keys"))
    keys = spark.read.parquet(str(tmp_path / "keys"))
    corner = [F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(None).cast("double").alias("bulge")) for x, y in ((0, 0), (9, 0), (9, 9), (0, 9))]
    points = keys.select("id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("j")).select("id", F.col("j").cast("double").alias("x"), F.lit(0.5).alias("y"))
    found = sides.straightened(points, keys.select("id", F.array(*corner).alias("poly")), "id", least=2)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 20_000
