"""Distances and nearest labels over cells, against every pair."""

import random

from quillmap.operators import fields

KIND = "floor string, x long, y long, label long, g string, h string, l string"


def test_envelope_takes_the_least_of_all():
    rng = random.Random(3)
    for _ in range(300):
        places = sorted(rng.sample(range(-9, 30), rng.randint(1, 9)))
        heights, labels = [rng.randrange(60) for _ in places], [rng.randrange(4) for _ in places]
        got = fields.envelope(places, heights, labels, -3, 25)
        assert got == [min(((x - q) ** 2 + h, k) for q, h, k in zip(places, heights, labels, strict=True)) for x in range(-3, 26)]


def test_nearest_labels(spark):
    rng = random.Random(4)
    marks = {f: [(rng.randrange(-2, 15), rng.randrange(-2, 12), rng.randrange(5)) for _ in range(n)] for f, n in (("a", 1), ("b", 6), ("c", 40))}
    rows = [(f, *m, "o", "o", "o") for f, ms in marks.items() for m in [*ms, ms[0]]] + [(None, 1, 1, 1, "o", "o", "o"), ("b", None, 1, 0, "o", "o", "o"), ("b", 1, 1, None, "o", "o", "o")]
    frame = spark.createDataFrame([(f, 0, 12, 0, 9) for f in ("a", "b", "c", "none")], "floor string, x0 long, x1 long, y0 long, y1 long")
    got = {(r.floor, r.x, r.y): (r.square, r.label) for r in fields.nearest_labels(spark.createDataFrame(rows, KIND).repartition(3), "floor", "x", "y", "label", frame).collect()}
    assert got == {(f, x, y): min(((x - a) ** 2 + (y - b) ** 2, k) for a, b, k in ms) for f, ms in marks.items() for x in range(13) for y in range(10)}
    assert fields.nearest_labels(spark.createDataFrame([], KIND), "floor", "x", "y", "label", frame).collect() == []
