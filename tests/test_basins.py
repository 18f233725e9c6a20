"""Basins by height against a spanning forest built edge by edge, and regions dealt to them."""

import random

from pyspark.sql import functions as F

from quillmap.operators import basins, grid
from quillmap.plans import storage

CELLS = "floor string, x long, y long, height double, u string, v string, way string"
SEEDS = "floor string, x long, y long, label long, u string"


def forest(heights, seeds):
    """Labels by joining cells in the order of edges, and passes by relaxing to a standstill."""
    root = {c: c for c in heights}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    edges = []
    for (x, y), h in heights.items():
        for d in ((x + 1, y), (x, y + 1)):
            if d in heights:
                edges.append((max(h, heights[d]), min(h, heights[d]), (x, y), d))
    label = dict(seeds)
    for _, _, a, b in sorted(edges):
        a, b = find(a), find(b)
        if a != b and not (a in label and b in label):
            root[a] = b
            if a in label:
                label[b] = label.pop(a)
    passes = {c: heights[c] for c in seeds}
    moving = True
    while moving:
        moving = False
        for high, _, a, b in edges:
            for p, q in ((a, b), (b, a)):
                if p in passes and max(high, passes[p]) < passes.get(q, float("inf")):
                    passes[q] = max(high, passes[p])
                    moving = True
    return {c: (label[find(c)], passes[c]) for c in heights if find(c) in label}


def test_basins(spark):
    rng = random.Random(8)
    floors = {"flat": (1, 6, 7, 2), "steps": (3, 9, 8, 4), "rough": (1000, 13, 11, 7), "holes": (5, 12, 12, 5), "one": (9, 1, 1, 1), "dry": (9, 4, 4, 0)}
    ground, marks, want = [], [], {}
    for f, (levels, w, h, n) in floors.items():
        cells = {(x, y): float(rng.randrange(levels)) for x in range(w) for y in range(h) if f != "holes" or rng.random() < 0.7}
        seeds = {c: rng.randrange(9) for c in rng.sample(sorted(cells), n)}
        ground += [(f, *c, v, "o", "o", "o") for c, v in cells.items()]
        marks += [(f, *c, k, "o") for c, k in seeds.items()]
        want |= {(f, *c): v for c, v in forest(cells, seeds).items()}
    again = [(*ground[0][:3], ground[0][3] + 1, "o", "o", "o"), (None, 1, 1, 1.0, "o", "o", "o"), ("flat", None, 1, 1.0, "o", "o", "o"), ("flat", 50, 50, None, "o", "o", "o")]
    more = [(*marks[0][:3], marks[0][3] + 1, "o"), ("flat", 99, 99, 1, "o"), ("dry", 1, 1, None, "o"), (None, 1, 1, 1, "o")]
    found = basins.basins(spark.createDataFrame(ground + again, CELLS).repartition(3), spark.createDataFrame(marks + more, SEEDS), "floor").collect()
    assert {(r.floor, r.x, r.y): (r.label, r["pass"]) for r in found} == want and len(found) == len(want)


def test_basins_of_nothing(spark):
    cells, seeds = spark.createDataFrame([], CELLS), spark.createDataFrame([], SEEDS)
    assert basins.basins(cells, seeds, "floor").collect() == []
    some = spark.createDataFrame([("a", 0, 0, 1.0, "o", "o", "o"), ("a", 1, 0, 2.0, "o", "o", "o")], CELLS)
    assert basins.basins(some, seeds, "floor").collect() == []
    assert basins.basins(cells, spark.createDataFrame([("a", 0, 0, 1, "o")], SEEDS), "floor").collect() == []


def test_long_corridor(spark):
    """Heights that fall along a winding way make one basin of many that wait for each other."""
    n = 300
    cells = spark.createDataFrame([("a", i, 0, float(n - i), "o", "o", "o") for i in range(n)], CELLS)
    found = basins.basins(cells, spark.createDataFrame([("a", n - 1, 0, 7, "o")], SEEDS), "floor").collect()
    assert {(r.x, r.label, r["pass"]) for r in found} == {(i, 7, float(n - i)) for i in range(n)}


def test_dealt_regions(spark):
    row = [("a", x, 0) for x in range(10)] + [("a", x, 2) for x in range(10)] + [("a", x, 4) for x in range(10)] + [("a", x, 6) for x in range(4)] + [("a", 0, 8)]
    found = grid.regions(spark.createDataFrame(row, "floor string, x long, y long"), "floor")
    owner = [("a", x, 0, 1 if x else 2) for x in range(10)] + [("a", x, 2, 1 if x < 5 else 2) for x in range(9)]
    owner += [("a", x, 4, x) for x in range(10)] + [("a", x, 6, None) for x in range(4)]
    got = basins.dealt_regions(found, spark.createDataFrame(owner, "floor string, x long, y long, label long"), "floor")
    assert {(r.region_y, r.label, r.cells, r.whole) for r in got.collect()} == {(0, 1, 10, True), (2, 1, 5, False), (2, 2, 4, False), *((4, k, 1, False) for k in range(10))}


def test_many_cells_are_not_broadcast(spark):
    """The files of numbers that rise take few bytes, of which a broadcast makes many."""
    cells = spark.range(60_000).select(F.lit(1).alias("g"), (F.col("id") % 300 * 2).alias("x"), (F.floor(F.col("id") / 300) * 2).alias("y"))
    found = grid.regions(cells, "g")
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.where("x = region_x and y = region_y").count() == 60_000


def test_kept_tables_of_many_rows_stay_apart(spark):
    many, few = (storage.keep(spark.range(n), "t") for n in (60_000, 10))
    plans = [a.join(storage.apart(b), "id")._jdf.queryExecution().executedPlan().toString() for a, b in ((spark.range(10**7), many), (many, few))]
    assert "BroadcastHashJoin" not in plans[0] and "BroadcastHashJoin" in plans[1]
