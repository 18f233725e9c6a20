"""Modules, patches, streams and map filters bound to the tables of a data folder, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmap.operators import search
from quillmap.plans.storage import new_path
from quillmap.queries import query
from quillmap.sources import modules, records
from quillmap.sources.tables import table
from quillmap.streaming import sessions


def _rooms(spark, d):
    k = F.col("p_partkey")
    note = F.when(k % 5 == 0, None).otherwise(F.concat(F.lit("it's "), F.col("p_type")))
    at = F.array((k % 40).cast("double"), F.col("p_size").cast("double") / 4)
    return table(spark, d, "part").select((k % 4).alias("floor"), "p_name", k.alias("id"), at.alias("place"), note.alias("note"))


@query(
    """SELECT (p_partkey % 4)::VARCHAR AS level, (row_number() OVER (PARTITION BY p_partkey % 4 ORDER BY p_name, p_partkey) - 1)::INT AS line, p_partkey AS id, p_name AS name,
       (p_partkey % 40)::DOUBLE AS x, p_size::DOUBLE / 4 AS y, CASE WHEN p_partkey % 5 <> 0 THEN 'it''s ' || p_type END AS note FROM part""".replace("\\'", "'")
)
def level_modules(spark, d):
    """Rooms written as one module for each level, with a second list behind them, and read again as one typed table in the files' order."""
    rooms, path = _rooms(spark, d), new_path(spark, "levels")
    brands = table(spark, d, "part").select((F.col("p_partkey") % 4).alias("floor"), "p_brand").distinct()
    modules.write_levels([modules.section(rooms, "floor", 0, "rooms", ["p_name", "id", "place", "note"], ["p_name", "id"]), modules.section(brands, "floor", 1, "brands", ["p_brand"], ["p_brand"])], path)
    read = modules.level_rows(records.module_rows(spark, path, "rooms"), "name string, id long, place array<double>, note string")
    return read.select("level", "line", "id", "name", F.get("place", F.lit(0)).alias("x"), F.get("place", F.lit(1)).alias("y"), "note")


@query(
    """SELECT p_brand AS floor, count(*) AS patches, sum(p_size % 3)::BIGINT AS lines, sum((p_partkey % 2 + 1) * 2)::BIGINT AS corners, count_if(p_size % 4 = 0) AS guided FROM part GROUP BY p_brand"""
)
def patch_files(spark, d):
    """Patches written as JSON lines, read strictly and counted; a folder without patches adds none."""
    k, size = F.col("p_partkey"), F.col("p_size")
    path = new_path(spark, "patches")
    line = F.array(*[F.lit(v) for v in ("0", "1.5", "2", "3", "a note")])
    area = F.array_repeat(F.array(F.lit(1.0), F.lit(2.0)), (k % 2 + 1).cast("int") * 2)
    guide = F.when(size % 4 == 0, F.create_map(F.lit("g"), F.array_repeat(F.array(F.lit(0.0), F.lit(1.0)), 3)))
    rows = table(spark, d, "part").select(F.col("p_brand").alias("floor"), F.array_repeat(line, (size % 3).cast("int")).alias("lines"), F.create_map(F.lit("a"), area).alias("areas"), guide.alias("guides"))
    rows.write.json(path)
    read = modules.patches(spark, path).unionByName(modules.patches(spark, f"{path}-absent"))
    corners = F.coalesce(F.size(F.get(F.map_values("areas"), F.lit(0))), F.lit(0))
    return read.groupBy("floor").agg(F.count(F.lit(1)).alias("patches"), F.sum(F.coalesce(F.size("lines"), F.lit(0)).cast("long")).alias("lines"), F.sum(corners.cast("long")).alias("corners"), F.count("guides").alias("guided"))


@query(
    """WITH l AS (SELECT event_id, user_id, event_id % 9 AS k, value, CASE WHEN event_id % 97 = 0 THEN 'clear' WHEN event_id % 5 = 0 THEN 'remove' WHEN event_id % 3 = 0 THEN 'edit' ELSE 'add' END AS op FROM events),
       c AS (SELECT user_id, max(event_id) AS cleared FROM l WHERE op = 'clear' GROUP BY user_id),
       r AS (SELECT l.*, row_number() OVER (PARTITION BY l.user_id, k ORDER BY event_id DESC) AS n FROM l LEFT JOIN c USING (user_id) WHERE op <> 'clear' AND (cleared IS NULL OR event_id > cleared))
       SELECT user_id::VARCHAR AS scope, k::VARCHAR AS entry, event_id AS seq, event_type AS value FROM r JOIN events USING (event_id, user_id) WHERE n = 1 AND op <> 'remove'"""
)
def streamed_lists(spark, d):
    """Each user's list, kept by a stateful stream over the events and folded from its change feed."""
    kind = table(spark, d, "events").schema
    events = spark.readStream.schema(kind).parquet(f"{d.rstrip('/')}/events.parquet*")
    i = F.col("event_id")
    op = F.when(i % 97 == 0, "clear").when(i % 5 == 0, "remove").when(i % 3 == 0, "edit").otherwise("add")
    log = events.select(F.col("user_id").alias("scope"), i.alias("seq"), op.alias("op"), (i % 9).alias("entry"), F.col("event_type").alias("value"))
    return sessions.folded(sessions.run_to_end(sessions.list_changes(log), new_path(spark, "lists")))


@query(
    """SELECT 'drawn' AS what, c_custkey FROM customer WHERE c_nationkey % 5 = 2 UNION ALL SELECT 'doors', c_custkey FROM customer WHERE c_nationkey % 5 = 2 AND c_acctbal > 5000
       UNION ALL SELECT 'marks', c_custkey FROM customer WHERE c_nationkey % 5 = 2 AND c_acctbal < 0"""
)
def floor_items(spark, d):
    """What is drawn on one floor: its items, the doors to show, the corrections with a place."""
    rows = table(spark, d, "customer").withColumn("floor_id", F.col("c_nationkey") % 5).withColumn("shown", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") > 5000)).withColumn("at", F.when(F.col("c_acctbal") < 0, F.col("c_acctbal")))
    here = F.lit(2)
    parts = {"drawn": search.on_floor(rows, here), "doors": search.shown_doors(rows, here), "marks": search.marked(rows, here)}
    out = [p.select(F.lit(n).alias("what"), "c_custkey") for n, p in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT c_custkey FROM customer WHERE c_mktsegment <> 'FURNITURE' AND c_custkey % 7 <> 0")
def importable_spaces(spark, d):
    own = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("room-"), F.col("c_custkey"))).otherwise(F.col("c_custkey").cast("string"))
    return table(spark, d, "customer").where(search.importable(F.col("c_mktsegment"), own, "FURNITURE")).select("c_custkey")


@query(
    """WITH l AS (SELECT user_id, arg_max(event_id % 500, event_id) AS picked FROM events WHERE event_id % 500 IN (SELECT c_custkey FROM customer) GROUP BY user_id)
       SELECT user_id, (c_nationkey % 5)::VARCHAR AS floor, picked::VARCHAR AS selected FROM l JOIN customer ON c_custkey = picked"""
)
def picked_places(spark, d):
    """Where each user's map stands after the last pick: the floor and the selected place."""
    places = table(spark, d, "customer").select(F.col("c_custkey").alias("place"), (F.col("c_nationkey") % 5).alias("floor"))
    asked = table(spark, d, "events").select(F.struct("user_id", "event_id").alias("session"), (F.col("event_id") % 500).alias("place"))
    log = search.pick(asked, places, "place", "floor")
    last = [F.max(F.when(F.col("field") == f, F.struct("session.event_id", "value"))).alias(f) for f in ("floor", "selected")]
    return log.groupBy("session.user_id").agg(*last).select("user_id", *[F.col(f"{f}.value").alias(f) for f in ("floor", "selected")])
