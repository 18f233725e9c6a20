"""Overlays, faces, contours and cycles on small inline frames, against direct versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillmap import planar_queries
from quillmap.functions import geometry as G
from quillmap.functions import shapes
from quillmap.operators import overlay, planar
from quillmap.plans import cycles as cycles_module
from quillmap.plans.cycles import cycles

RINGS = "id long, rings array<array<struct<x:double,y:double,bulge:double>>>, a string, strip int, side int"


def frame(spark, items):
    return spark.createDataFrame([(i, None if rings is None else [[(float(x), float(y), None) for x, y in r] for r in rings], "x", 1, 2) for i, rings in items], RINGS).repartition(3)


def turned(ring, degrees, dx=0.0, dy=0.0):
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return [(x * c - y * s + dx, x * s + y * c + dy) for x, y in ring]


BOX = [(0, 0), (6, 0), (6, 6), (0, 6)]
HOLE = [(2, 2), (4, 2), (4, 4), (2, 4)]
CUP = [(1, 1), (9, 1), (9, 8), (7, 8), (7, 3), (3, 3), (3, 8), (1, 8)]


@pytest.mark.parametrize("degrees", [0, 17, 90, 211.5])
@pytest.mark.parametrize("size", [2.5, 50.0])
def test_overlay_of_concave_shapes(spark, degrees, size):
    """A ring and a cup share 10 + 4 - 1 - 1 whole cells, whichever way the plane is turned and cut."""
    cells = [(x + 0.5, y + 0.5) for x in range(6) for y in range(6) if not (2 <= x < 4 and 2 <= y < 4)]
    both = sum((1 <= x <= 9 and 1 <= y <= 8) and not (3 <= x <= 7 and y >= 3) for x, y in cells)
    a = frame(spark, [(1, [turned(BOX, degrees), turned(HOLE, degrees)]), (2, None), (None, [BOX]), (3, []), (4, [turned(BOX, degrees, 100, 100)]), (5, [[(0, 0), (5, 5)]])])
    b = frame(spark, [(7, [turned(CUP[::-1], degrees)]), (8, [turned(BOX, degrees)])])
    got = {(r.a, r.b): r for r in overlay.shared_areas(a, b, size).collect()}
    assert got.keys() == {(1, 7), (1, 8)}
    assert got[1, 7].shared == pytest.approx(both) and got[1, 7].area_a == pytest.approx(32) and got[1, 7].area_b == pytest.approx(56 - 20)
    assert got[1, 7].iou == pytest.approx(both / (32 + 36 - both)) and got[1, 8].iou == pytest.approx(32 / 36)


def test_overlay_equals_convex_clipping(spark):
    rng = random.Random(3)
    items = []
    for k in range(40):
        angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(6))
        cx, cy, r = rng.uniform(0, 20), rng.uniform(0, 20), rng.uniform(1, 6)
        items.append((k, [[(cx + r * math.cos(t), cy + r * math.sin(t)) for t in angles]]))
    table = frame(spark, items)
    got = {(r.a, r.b): r.iou for r in overlay.shared_areas(table, None, 4.0).collect()}
    one = table.select(F.col("id").alias("a"), F.col("rings")[0].alias("p"))
    pairs = one.crossJoin(one.select(F.col("a").alias("b"), F.col("p").alias("q"))).where("a < b")
    want = {(r.a, r.b): r.v for r in pairs.select("a", "b", shapes.convex_iou(F.col("p"), F.col("q")).alias("v")).collect() if r.v > 1e-9}
    assert {k for k, v in got.items() if v > 1e-9} == want.keys() and all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())


def test_overlay_of_nothing_and_touching(spark):
    assert overlay.shared_areas(frame(spark, []), frame(spark, [(1, [BOX])]), 2.0).collect() == []
    assert overlay.shared_areas(frame(spark, [(1, [BOX]), (2, [turned(BOX, 0, 6)]), (3, [HOLE])]), None, 2.0).select("a", "b").collect() == [(1, 3)]
    pairs = overlay.shared_areas(frame(spark, [(1, [BOX]), (2, [turned(BOX, 0, 1)]), (3, [turned(BOX, 0, 2)])]), frame(spark, [(8, [turned(BOX, 0, 1)]), (9, [turned(BOX, 0, 3)])]), 3.0)
    assert sorted((r.a, r.b) for r in overlay.best_matches(pairs, 0.3).collect()) == [(2, 8), (3, 9)]


def test_cycles(spark):
    rng = random.Random(1)
    for n in (1, 2, 7, 64, 300):
        order = list(range(n))
        rng.shuffle(order)
        after = dict(zip(range(n), order, strict=True))
        got = {r.node: (r.ring, r.place) for r in cycles(spark.createDataFrame(list(after.items()), "node long, after long")).collect()}
        want = {}
        for k in range(n):
            if k not in want:
                at, steps = k, 0
                while at not in want:
                    want[at] = (k, steps)
                    at, steps = after[at], steps + 1
        assert got == want
    assert cycles(spark.createDataFrame([], "node long, after long")).collect() == []


LINES = "ax double, ay double, bx double, by double, n long, t double"


def test_faces_of_crossing_lines(spark):
    """Lines right through a box: the faces tile it, and Euler's formula counts them."""
    rng = random.Random(6)
    edge = [(0, 0, 20, 0), (20, 0, 20, 10), (20, 10, 0, 10), (0, 10, 0, 0)]
    through = [(rng.uniform(0, 20), 0, rng.uniform(0, 20), 10) for _ in range(7)] + [(0, rng.uniform(1, 9), 20, rng.uniform(1, 9)) for _ in range(5)]
    more = [(5, 0, 15, 0), (3, 3, 3, 3), (None, 1, 2, 3), edge[0], (20, 0, 0, 0)]  # on another line, without length, null, repeated
    rows = [(*[None if v is None else float(v) for v in line], 1, 0.5) for line in edge + through + more]
    pieces = planar.split_lines(spark.createDataFrame(rows, LINES).repartition(3), 3.0, 1e-6)
    got = pieces.collect()
    points = {p for r in got for p in ((r.ax, r.ay), (r.bx, r.by))}
    found = planar.faces(planar.face_edges(pieces), 1e-6).collect()
    assert len(found) == len(got) - len(points) + 1
    assert sum(r.area for r in found) == pytest.approx(200, abs=1e-4) and all(r.area > 0 for r in found)
    assert planar.faces(planar.face_edges(planar.split_lines(spark.createDataFrame([], LINES), 3.0))).collect() == []


def test_faces_with_blind_ends_and_islands(spark):
    rows = [(0, 0, 9, 0), (9, 0, 9, 9), (9, 9, 0, 9), (0, 9, 0, 0), (4, 0, 4, 3), (6, 6, 7, 6), (7, 6, 7, 7), (7, 7, 6, 7), (6, 7, 6, 6)]
    lines = spark.createDataFrame([(*map(float, r), 1, 0.5) for r in rows], LINES)
    edges = planar.face_edges(planar.split_lines(lines, 4.0))
    assert sorted((r.area, r.edges) for r in planar.faces(edges).collect()) == [(pytest.approx(1.0), 4), (pytest.approx(81.0), 7)]
    for ring in {r.face for r in edges.collect()}:
        own = sorted((r.place, (r.x, r.y), (r.to_x, r.to_y)) for r in edges.where(F.col("face") == ring).collect())
        assert [p for p, *_ in own] == list(range(len(own))) and all(own[k][2] == own[(k + 1) % len(own)][1] for k in range(len(own)))


def regions(cells):
    left, out = set(cells), []
    while left:
        todo = [left.pop()]
        own = set(todo)
        while todo:
            x, y = todo.pop()
            for c in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if c in left:
                    left.remove(c)
                    own.add(c)
                    todo.append(c)
        out.append(own)
    return out


def test_contours_are_rings_around_regions(spark):
    rng = random.Random(8)
    cells = {(rng.randrange(14), rng.randrange(14)) for _ in range(110)} | {(20 + x, y) for x in range(4) for y in range(4) if (x, y) not in ((1, 1), (2, 2))}
    rows = [("f", x, y, "o") for x, y in cells] + [("f", *next(iter(cells)), "o"), (None, 1, 1, "o"), ("g", 0, None, "o"), ("h", 3, 3, "o")]
    rim = planar.contours(spark.createDataFrame(rows, "floor string, x long, y long, ring string"), "floor")
    areas, ends = {}, {}
    for r in rim.collect():
        key = r.floor, r.ring
        areas[key] = areas.get(key, 0) + (r.x * r.to_y - r.to_x * r.y) / 2
        ends.setdefault(key, []).append((r.place, (r.x, r.y), (r.to_x, r.to_y)))
    for own in ends.values():
        own.sort()
        assert all(own[k][2] == own[(k + 1) % len(own)][1] for k in range(len(own)))
    found = regions(cells)
    space = {(x, y) for x in range(-2, 30) for y in range(-2, 20)} - cells
    # the outside touches at corners, as its cells lie between regions that do not
    left, holes = set(space), []
    while left:
        todo = [left.pop()]
        own = set(todo)
        while todo:
            x, y = todo.pop()
            for c in ((x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                if c in left:
                    left.remove(c)
                    own.add(c)
                    todo.append(c)
        holes.append(own)
    holes = [h for h in holes if (-2, -2) not in h]
    own = [a for (f, _), a in areas.items() if f == "f"]
    assert sum(own) == len(cells) and sum(a > 0 for a in own) == len(found)
    assert sorted(-a for a in own if a < 0) == sorted(float(len(h)) for h in holes)
    bends = planar.corners(rim, "floor").where("floor = 'h'").orderBy("place").collect()
    assert [(r.x, r.y) for r in bends] in ([(3, 3), (4, 3), (4, 4), (3, 4)], [(4, 3), (4, 4), (3, 4), (3, 3)], [(4, 4), (3, 4), (3, 3), (4, 3)], [(3, 4), (3, 3), (4, 3), (4, 4)])
    assert planar.contours(spark.createDataFrame([], "floor string, x long, y long"), "floor").collect() == []


@pytest.mark.parametrize("degrees", [0, 33])
def test_claimed_places(spark, degrees):
    """A cup in front of a box with a hole, a box within it, and one that loses most of itself."""
    small = [(4, 4.5), (6, 4.5), (6, 5.5), (4, 5.5)]
    rings = {2: ([BOX, HOLE], 2), 1: ([CUP], 1), 3: ([[(2, 1), (5, 1), (5, 3.5), (2, 3.5)]], 9), 4: ([[(20, 0), (30, 0), (30, 10), (20, 10)]], 3), 5: ([[(22, 2), (24, 2), (24, 4), (22, 4)]], 0), 6: ([small], None)}
    rows = [(k, [[(float(x), float(y), None) for x, y in turned(r, degrees)] for r in rs], o, "x") for k, (rs, o) in rings.items()]
    table = spark.createDataFrame(rows, "k long, rings array<array<struct<x:double,y:double,bulge:double>>>, o int, owner string").drop("owner").repartition(3)
    got = {r.k: r for r in planar.resolved(table, "k", "rings", "o", 4.0, 1e-6).collect()}
    # the box's cells outside of the cup and the hole; what the third keeps lies behind both
    box = sum(not (2 <= x < 4 and 2 <= y < 4) and not (1 <= x <= 9 and 1 <= y <= 8 and not (3 <= x <= 7 and y >= 3)) for x, y in ((i + 0.5, j + 0.5) for i in range(6) for j in range(6)))
    assert got[1].kept == pytest.approx(36, abs=1e-4) and not got[1].cut and got[2].kept == pytest.approx(box, abs=1e-4)
    assert got[2].cut == (box >= 16) and got[3].kept == pytest.approx(0.5, abs=1e-4) and not got[3].cut
    assert got[4].kept == pytest.approx(96, abs=1e-4) and got[4].cut and got[5].kept == pytest.approx(4, abs=1e-4) and got[6].kept == 0
    rim = planar.claimed(table, "k", "rings", "o", 4.0, 1e-6).where("k = 4")
    ends = {}
    for r in rim.orderBy("place").collect():
        ends.setdefault(r.ring, []).append(((r.x, r.y), (r.to_x, r.to_y)))
    assert sorted(len(e) for e in ends.values()) == [4, 4] and all(e[i][1] == e[(i + 1) % 4][0] for e in ends.values() for i in range(4))
    assert planar.claimed(table.limit(0), "k", "rings", "o", 4.0).collect() == []


def test_finished_cycles_are_not_written_again(spark, monkeypatch):
    """Cycles of 1 to 8 nodes beside one of 300: each is done when a stretch is twice as long, right to the last place."""
    r = random.Random(5)
    nodes, after, want, i = r.sample(range(10**6), 2100), {}, {}, 0
    for n in [300] + [1 + k % 8 for k in range(400)]:
        ring, i = nodes[i : i + n], i + n
        at = ring.index(min(ring))
        for k, v in enumerate(ring):
            after[v], want[v] = ring[(k + 1) % n], (min(ring), (k - at) % n)
    written = []
    monkeypatch.setattr(cycles_module, "keep", lambda df, label, keep=cycles_module.keep: written.append(kept := keep(df, label)) or kept)
    got = {x.node: (x.ring, x.place) for x in cycles(spark.createDataFrame(list(after.items()), "node long, after long")).collect()}
    assert got == want
    rows = [w.count() for w in written]
    assert rows[0] == len(after) and rows[5:] == [300] * (len(rows) - 5) and len(rows) == 11


def test_resolved_links_edges_once(spark, monkeypatch):
    """What a shape keeps is a sum over its rim, whatever the order of its edges."""
    calls = []
    monkeypatch.setattr(planar, "cycles", lambda links, own=planar.cycles: calls.append(1) or own(links))
    table = frame(spark, [(1, [BOX, HOLE]), (2, [BOX]), (3, [CUP]), (4, [turned(BOX, 30, 40, 0)])]).withColumn("o", F.col("id"))
    got = {r.id: (r.area, r.kept) for r in planar.resolved(table, "id", "rings", "o", 2.5).collect()}
    assert len(calls) == 1
    assert got[1] == pytest.approx((32, 32)) and got[2] == pytest.approx((36, 4)) and got[3] == pytest.approx((36, 36 - 16)) and got[4] == pytest.approx((36, 36), abs=0.05)


@pytest.mark.parametrize("degrees", [0, 17])
def test_overlay_of_repeated_ids(spark, degrees):
    """Rows of one id count by the even-odd rule, whichever way their rings run, in areas too."""
    wide = turned([(-1, -1), (20, -1), (20, 7), (-1, 7)], degrees)
    a = frame(spark, [(1, [turned(BOX, degrees)]), (1, [turned([(x + 3, y) for x, y in BOX[::-1]], degrees)]), (2, [turned(BOX, degrees)]), (2, [turned([(x + 8, y) for x, y in BOX[::-1]], degrees)]), (3, [turned(BOX, degrees), turned(HOLE, degrees)])])
    got = {r.a: r for r in overlay.shared_areas(a, frame(spark, [(7, [wide])]), 2.5).collect()}
    assert got.keys() == {1, 2, 3}
    for k, area in ((1, 36), (2, 72), (3, 32)):
        assert (got[k].area_a, got[k].area_b, got[k].shared) == pytest.approx((area, 168, area))


def test_overlay_writes_no_pairs(spark, monkeypatch):
    """Thirty boxes on each other make 435 pairs; what is written grows with the boxes."""
    written = []
    monkeypatch.setattr(overlay, "keep", lambda df, label, keep=overlay.keep: written.append(kept := keep(df, label)) or kept)
    pairs = overlay.shared_areas(frame(spark, [(k, [turned(BOX, 0, k / 64)]) for k in range(30)]), None, 8.0)
    assert {(r.a, r.b): r.shared for r in pairs.collect()} == {(a, b): 6 * (6 - (b - a) / 64) for a in range(30) for b in range(a + 1, 30)}
    assert sum(w.count() for w in written) == 60


def test_shapes_of_a_small_file_are_dealt_to_tasks(spark, sf):
    """Edges are made and cut where the shapes lie; a file of few bytes would be one task."""
    for side in planar_queries._shapes(spark, sf):
        assert side.rdd.getNumPartitions() >= 32 and side.count() == spark.read.parquet(f"{sf}/part.parquet").count()
