"""Vector operators: nulls, non-finite numbers, ties, repeated rows, other lengths, empty tables, clashing extra columns."""

import hashlib
import math

import numpy as np
import pytest

from quillmap.llm import centroid_clusters, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, q string, code string, k string, of int, error string, v string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", 1, "x", "x") for r in rows], SCHEMA).repartition(3)


def random_rows(n, width, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    return [(int(k), [float(x) for x in rng.normal(size=width).astype(np.float32) * np.float32(scale)], int(k % 3) if k % 5 else None) for k in range(n)]


def fits(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def whole(v):
    return [math.floor(float(np.float32(x)) * 1024) for x in v]


def brute_codes(rows, parts, entries, rounds):
    kept = sorted(((i, whole(v), l) for i, v, l in rows if fits(v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[r[1][p * width : (p + 1) * width] for p in range(parts)] for r in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(books[p])) for p, v in enumerate(c)] for c in cut]

    for _ in range(rounds):
        chosen = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [c[p] for c, a in zip(cut, chosen) if a[p][1] == k]
                if own:
                    books[p][k] = [sum(col) // len(own) for col in zip(*own)]
    chosen = assign()
    out = [(r[0], "".join(f"{k:02x}" for _, k in a), sum(d for d, _ in a), r[2]) for r, a in zip(kept, chosen)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    sums = {}
    for _, _, e, l in out:
        sums[l] = sums.get(l, 0) + e
    return sorted(((i, c, e, sums[l], digest) for i, c, e, l in out), key=str)


ODD = [(900, None, 1), (901, [], 1), (902, [1.0, None] * 4, 1), (903, [float("nan")] * 8, 2), (904, [float("inf")] + [0.0] * 7, 2)]


@pytest.mark.parametrize("scale", [1.0, 1e-3, 900.0])
def test_codes_equal_brute_force(spark, scale):
    rows = random_rows(90, 8, 1, scale)
    rows += [rows[3], (None, rows[4][1], None), (3, rows[5][1], 7)]  # a repeated row, a null id, a repeated id
    found = vector_codes.vector_codes(frame(spark, rows + [r for r in ODD if r[1] != []]), entries=20, rounds=3)
    assert sorted([tuple(r) for r in found.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()], key=str) == brute_codes(rows, 4, 20, 3)


def test_codes_of_few_rows_other_lengths_and_great_numbers(spark):
    rows = random_rows(5, 8, 2)
    others = [(50, [1.0, 2.0, 3.0], 1), (51, [1.0] * 16, 1), (52, [3e30] * 8, 1), (53, [], 9)]
    found = vector_codes.vector_codes(frame(spark, rows + others + ODD)).collect()
    by = {r.vec_id: r for r in found}
    assert sorted(by) == [0, 1, 2, 3, 4, 50, 51, 52, 53, 901]
    assert all(by[k].code is None and by[k].error is None for k in (50, 51, 52, 53)) and by[53].label_error is None
    assert [tuple(by[k])[1:3] for k in range(5)] == [(f"{k:02x}" * 4, 0) for k in range(5)]  # each its own entry
    assert vector_codes.vector_codes(frame(spark, ODD)).where("vec_id <> 901").count() == 0
    assert vector_codes.vector_codes(frame(spark, [])).collect() == []


def test_equal_entries_go_to_the_lower_index(spark):
    found = vector_codes.vector_codes(frame(spark, [(k, [1.0] * 8, 0) for k in range(300)])).collect()
    assert {r.code for r in found} == {"00000000"} and len(found) == 300


def test_ring_reads_whole_annulus():
    rng = np.random.default_rng(5)
    for top in (3, 200, 2**21, 2**25):
        entries, parts = rng.integers(-top, top, (200, 16)), rng.integers(-top, top, (700, 16))
        index, best = vector_codes.Ring(entries).nearest(parts)
        every = ((parts[:, None] - entries[None]) ** 2).sum(2)
        assert (index == every.argmin(1)).all() and (best == every.min(1)).all()


def test_decoding_gives_the_entries(spark):
    coded, books = vector_codes.compress(frame(spark, random_rows(40, 8, 3)), entries=6, rounds=2)
    rows = {k: whole(v) for k, v, _ in random_rows(40, 8, 3)}
    for r in coded.collect():
        assert sum((a - b) ** 2 for a, b in zip(vector_codes.decoded(books, r.code), rows[r.vec_id])) == r.error


def brute_clusters(rows, clusters, rounds):
    kept = [(i, whole(v)) for i, v, _ in rows if fits(v) and len(v) == 64]
    first = sorted((i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept)[:clusters]
    cents = [v for _, _, v in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(cents)) for _, v in kept]

    for _ in range(rounds):
        chosen = assign()
        for k in range(len(cents)):
            own = [v for (_, v), a in zip(kept, chosen) if a[1] == k]
            if own:
                cents[k] = [sum(col) // len(own) for col in zip(*own)]
    chosen = assign()
    total = sum(d for d, _ in chosen)
    by = [sum(d for d, k in chosen if k == n) for n in range(len(cents))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, k, d, by[k], total, sha[k]) for (i, _), (d, k) in zip(kept, chosen)), key=str)


COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@pytest.mark.parametrize("n", [150, 5, 1])
def test_clusters_equal_brute_force(spark, n):
    rows = random_rows(n, 64, 7)
    rows += [rows[0], rows[0], (None, rows[-1][1], 1), (700, [0.0] * 64, 1), (701, [0.0] * 64, 1)]
    found = centroid_clusters.centroid_clusters(frame(spark, rows + ODD + [(800, [1.0] * 63, 1), (801, [1.0] * 63 + [None], 1)]))
    assert sorted([tuple(r) for r in found.select(*COLUMNS).collect()], key=str) == brute_clusters(rows, 8, 10)


def test_clusters_of_nothing_and_great_numbers(spark):
    assert centroid_clusters.centroid_clusters(frame(spark, [])).collect() == []
    assert centroid_clusters.centroid_clusters(frame(spark, ODD)).collect() == []
    rows = random_rows(20, 64, 8)
    found = {r.vec_id: r for r in centroid_clusters.centroid_clusters(frame(spark, [*rows, (99, [3e30] * 64, 1)])).collect()}
    assert len(found) == 21 and found[99].cluster is None and found[99].distance is None and found[99].inertia == found[0].inertia


def test_screening_skips_what_it_may():
    rng = np.random.default_rng(9)
    cents = rng.integers(-300, 300, (8, 64)) * np.array([1, 4, 16, 1, 2, 8, 1, 32])[:, None]
    rows = np.concatenate([c + rng.integers(-9, 9, (50, 64)) for c in cents])
    cluster, best, exact = centroid_clusters.nearest(rows, centroid_clusters.segment_squares(rows, 8), cents)
    every = ((rows[:, None] - cents[None]) ** 2).sum(2)
    assert (cluster == every.argmin(1)).all() and (best == every.min(1)).all() and exact < 2 * len(rows)
