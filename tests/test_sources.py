"""Text of any encoding, level modules, patch files and map filters."""

import json

import pytest
from pyspark.sql import functions as F

from quillmap.operators import matching, relate, search
from quillmap.sources import modules, records


def test_text_files(spark, tmp_path):
    (tmp_path / "a.html").write_bytes("Grüße\n".encode() + b"\xff\xe9 end")
    (tmp_path / "b.html").write_bytes(b"")
    got = {r.file.rsplit("/", 1)[1]: r.text for r in modules.text_files(spark, str(tmp_path)).collect()}
    assert got == {"a.html": "Grüße\n�� end"}
    (tmp_path / "c.txt").write_bytes("é".encode("latin-1"))
    assert modules.text_files(spark, str(tmp_path / "c.txt"), "ISO-8859-1").collect()[0].text == "é"


ROOMS = "floor string, id long, name string, poly array<array<double>>, more struct<tags:array<string>>, level string, part int, sort string"
ODD = "it's \\ a \"b\", [c],"


def test_levels_are_written_sorted_and_read_back(spark, tmp_path):
    rows = [("1", 2, "b", [[1.0, 2.5], [3.0, 4.0]], (["x"],)), ("1", 1, ODD, None, None), ("2", 3, None, [], ([],)), (None, 9, "lost", None, None), ("1", 2, "b", [[1.0, 2.5]], None)]
    frame = spark.createDataFrame([(*r, "o", 1, "o") for r in rows], ROOMS).repartition(3)
    doors = spark.createDataFrame([("2", 5.5), ("2", -1.0)], "floor string, at double")
    path = str(tmp_path / "levels")
    for _ in range(2):  # a second write replaces the first
        modules.write_levels([modules.section(frame, "floor", 0, "rooms", ["id", "name", "poly", "more"], ["id", "name"]), modules.section(doors, "floor", 1, "doors", ["at"], ["at"])], path)
    two = [f for f in (tmp_path / "levels/level=2").iterdir() if f.suffix == ".txt"]
    assert len(two) == 1 and two[0].read_text().split("\n")[:-1] == ["export const rooms = [", "  [3, undefined, [], {\"tags\":[]}],", "];", "export const doors = [", "  [-1.0],", "  [5.5],", "];"]
    read = modules.level_rows(records.module_rows(spark, path, "rooms"), "id long, name string, poly array<array<double>>, more struct<tags:array<string>>")
    got = [tuple(r) for r in read.orderBy("level", "line").collect()]
    assert [(r[0], r[1], r[2], r[3]) for r in got] == [("1", 0, 1, ODD), ("1", 1, 2, "b"), ("1", 2, 2, "b"), ("2", 0, 3, None)]
    assert got[0][4] is None and got[3][4] == [] and got[3][5].tags == []
    assert [r.at for r in modules.level_rows(records.module_rows(spark, path, "doors"), "at double").orderBy("line").collect()] == [-1.0, 5.5]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|MALFORMED"):
        modules.level_rows(records.module_rows(spark, path, "rooms"), "id long, name long").collect()


def test_numbers_of_constants(spark, tmp_path):
    (tmp_path / "level1.ts").write_text("export const size = { width: 12.5, height: -3 };\n")
    (tmp_path / "level2.ts").write_text("export const size = { height: 7, width: 1 };\nconst x = 1;\n")
    (tmp_path / "level3.ts").write_text("const x = 1;")
    got = {r.file[-9:-3]: (r.width, r.height) for r in modules.numbers(spark, str(tmp_path), "size", "width", "height").collect()}
    assert got == {"level1": (12.5, -3.0), "level2": (1.0, 7.0), "level3": (None, None)}


def test_patches(spark, tmp_path):
    assert modules.patches(spark, str(tmp_path / "absent")).count() == 0
    (tmp_path / "good.json").write_text(json.dumps({"floor": "1", "lines": [[0, 1, 2, 3, "n"]], "guides": {"a": [[0, 0], [1, 1], [2, 0]]}}) + "\n")
    good = modules.patches(spark, str(tmp_path)).collect()
    assert [(r.floor, r.lines[0][4], r.doors) for r in good] == [("1", "n", None)]
    (tmp_path / "bad.json").write_text(json.dumps({"floor": "2", "lines": [[0, 1]], "doors": [[1]]}) + "\n")
    with pytest.raises(Exception, match="2: line 1 needs 4 values; door 1 needs 2 values"):
        modules.patches(spark, str(tmp_path)).select("floor").collect()
    told = {r.floor: r.problems for r in modules.patches(spark, str(tmp_path), strict=False).collect()}
    assert told == {"1": [], "2": ["line 1 needs 4 values", "door 1 needs 2 values"]}
    (tmp_path / "worse").mkdir()
    (tmp_path / "worse/worse.json").write_text("{no json\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        modules.patches(spark, str(tmp_path / "worse")).collect()


def test_floor_filters(spark):
    rows = [(1, "a", True, 1.0), (2, "a", False, None), (3, "a", None, 2.0), (4, "b", True, 1.0), (5, None, True, 1.0)]
    items = spark.createDataFrame(rows, "id long, floor_id string, shown boolean, at double")
    ids = lambda df: sorted(r.id for r in df.collect())
    here = F.lit("a")
    assert ids(search.on_floor(items, here)) == [1, 2, 3] and ids(search.shown_doors(items, here)) == [1] and ids(search.marked(items, here)) == [1, 3]
    assert ids(search.on_floor(items, F.lit(None).cast("string"))) == [] and ids(search.on_floor(items.limit(0), here)) == []


def test_importable_and_pick(spark):
    rows = spark.createDataFrame([(1, "office", "4100"), (2, "circulation", "4101"), (3, "lab", "room-7"), (4, None, "4102"), (5, "lab", None)], "n long, kind string, id string")
    assert sorted(r.n for r in rows.where(search.importable(F.col("kind"), F.col("id"))).collect()) == [1, 4]
    found = spark.createDataFrame([("s", "4100"), ("t", "nowhere"), ("u", None)], "session string, place string")
    places = spark.createDataFrame([("4100", 4, "x"), (None, 5, "y")], "place string, floor int, field string")
    assert sorted(map(tuple, search.pick(found, places, "place", "floor").collect())) == [("s", "floor", "4"), ("s", "selected", "4100")]


def test_shadings(spark):
    rows = [(1, "a", "red", "p", 2), (1, "a", "blue", "q", 1), (2, "a", None, "r", 0), (1, None, "x", "s", 0), (2, "b", None, "t", None), (1, "a", "green", "u", None)]
    lists, firsts = relate.shadings(spark.createDataFrame(rows, "level int, name string, colour string, shape string, o int"), "level", "name", "colour", "shape", "o")
    assert {(r.level, r.name): r.shapes for r in lists.collect()} == {(1, "a"): ["q", "p", "u"], (2, "a"): ["r"], (2, "b"): ["t"]}
    assert [tuple(r) for r in firsts.collect()] == [("a", "blue")]


def test_seed_takes_no_face_above_the_cap(spark):
    def square(s):
        return [(0.0, 0.0, None), (s, 0.0, None), (s, s, None), (0.0, s, None)]

    faces = spark.createDataFrame([(1, square(4.0)), (2, square(9.0))], "f int, poly array<struct<x:double,y:double,bulge:double>>")
    points = spark.createDataFrame([(1, 2.0, 2.0), (2, 7.0, 7.0)], "p int, x double, y double")
    for cap, want in ((None, {1: 1, 2: 2}), (50.0, {1: 1, 2: None})):
        assert {r.p: r.f for r in matching.holding_face(points, faces, 5.0, 1.0, 1.0, "p", "f", cap).collect()} == want
