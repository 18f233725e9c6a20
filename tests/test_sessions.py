"""Correction lists as a stream, in any order and cut, against the fold of the whole log."""

import random

from quillmap.operators import state
from quillmap.streaming import sessions

KIND = "scope string, seq long, op string, entry string, value string"


def log(n):
    rng = random.Random(n)
    rows = [(rng.choice("abc"), k, rng.choices(["add", "edit", "remove", "clear"], [6, 4, 3, 1])[0], rng.choice("pqrst"), f"v{k}") for k in range(n)]
    return [(s, k, op, None if op == "clear" else e, None if op in ("clear", "remove") or k % 9 == 0 else v) for s, k, op, e, v in rows]


def test_stream_equals_fold(spark, tmp_path):
    rows = log(240)
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    odd = [(None, 5, "add", "p", "x"), ("a", None, "add", "p", "x"), ("a", 999, "add", None, "x")]
    for k in range(4):
        spark.createDataFrame(shuffled[k::4] + odd, KIND).coalesce(1).write.parquet(f"{tmp_path}/log/{k}")

    def feed(some):
        stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log/{some}")
        return sessions.run_to_end(sessions.list_changes(stream), f"{tmp_path}/out")

    assert feed("[01]").count() > 0
    got = sessions.folded(feed("*"))  # goes on where the first run ended
    whole = state.latest(spark.createDataFrame(rows, KIND), "scope", "entry", "seq", "op", ["value"])
    want = {(r.scope, r.entry): (r.seq, r.value) for r in whole.collect()}
    assert {(r.scope, r.entry): (r.seq, r.value) for r in got.collect()} == want and want
    # a list that is cleared last is empty
    spark.createDataFrame([("a", 1000, "clear", None, None), ("a", 998, "add", "p", "late")], KIND).write.parquet(f"{tmp_path}/log/9")
    assert {(r.scope, r.entry) for r in sessions.folded(feed("*")).collect()} == {k for k in want if k[0] != "a"}
