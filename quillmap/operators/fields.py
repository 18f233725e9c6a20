"""Exact distances over grid cells, and the cells that lie nearest to each label.

A cell's squared distance to the nearest marked cell is worked out in two passes. Along columns, marked cells are neighbours
in a window, and the cells between two of them are listed with the nearer one. Along lines, each column's distance is a
parabola; the lower envelope of a line's parabolas gives every cell of it, in whole numbers and in time proportional to the
line's length. A task holds one line of one group at a time.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmap.plans.storage import keep
from quillmap.session import workers_see_package


def envelope(places: list[int], heights: list[int], labels: list[int], low: int, high: int) -> list[tuple[int, int]]:
    """For each x from ``low`` to ``high`` the least ``((x - place) ** 2 + height, label)``; places ascend."""
    stack: list[int] = []
    starts: list[tuple[int, int]] = []  # where each parabola of the stack begins to count, as a fraction
    for k, q in enumerate(places):
        start = (0, 0)
        while stack:
            p = places[stack[-1]]
            start = (heights[k] + q * q - heights[stack[-1]] - p * p, 2 * (q - p))
            if len(stack) > 1 and starts[-1][0] * start[1] > start[0] * starts[-1][1]:
                stack.pop()
                starts.pop()
            else:
                break
        stack.append(k)
        starts.append(start)
    out, at = [], 0
    for x in range(low, high + 1):
        while at + 1 < len(stack) and starts[at + 1][0] < x * starts[at + 1][1]:
            at += 1
        best, more = None, at
        while best is None or more < len(stack) and starts[more][0] == x * starts[more][1]:  # those that begin just here tie
            k = stack[more]
            value = ((x - places[k]) ** 2 + heights[k], labels[k])
            best = value if best is None or value < best else best
            more += 1
        out.append(best)
    return out


def nearest_labels(cells: DataFrame, group: str, x: str, y: str, label: str, frame: DataFrame) -> DataFrame:
    """``group, x, y, square, label`` of every cell of each group's frame: the squared distance to the nearest marked cell, and its label.

    ``frame`` has ``group, x0, x1, y0, y1``, bounds included. Of equally near cells the least label counts. Marked cells
    outside the frame count too; a cell marked twice has its least label; rows with a null are left out; groups without
    marked cells give no rows. Labels are whole numbers.
    """
    workers_see_package(cells.sparkSession)
    own = cells.select(F.col(group).alias("g"), F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y"), F.col(label).cast("long").alias("l")).where("g is not null and x is not null and y is not null and l is not null")
    own = own.groupBy("g", "x", "y").agg(F.min("l").alias("l"))
    frames = frame.select(F.col(group).alias("fg"), *[F.col(c).cast("long").alias(c) for c in ("x0", "x1", "y0", "y1")])
    column = W.partitionBy("g", "x").orderBy("y")
    gaps = own.withColumn("ny", F.lead("y").over(column)).withColumn("nl", F.lead("l").over(column)).withColumn("first", F.row_number().over(column) == 1)
    gaps = gaps.join(frames, F.col("g") == F.col("fg"))
    low = F.when(F.col("first"), F.least("y0", "y")).otherwise(F.col("y"))
    line = F.explode(F.sequence(low, F.coalesce(F.col("ny") - 1, F.greatest("y1", "y"))))
    lines = gaps.select("g", "x", "y", "l", "ny", "nl", "x0", "x1", "y0", "y1", line.alias("at")).where("at between y0 and y1")
    one = F.struct(((F.col("at") - F.col("y")) * (F.col("at") - F.col("y"))).alias("h"), F.col("l"))
    two = F.struct(((F.col("ny") - F.col("at")) * (F.col("ny") - F.col("at"))).alias("h"), F.col("nl").alias("l"))
    near = lines.select("g", "x", "at", "x0", "x1", F.when(F.col("ny").isNull(), one).otherwise(F.least(one, two)).alias("n"))
    near = keep(near.select("g", "x", F.col("at").alias("y"), "x0", "x1", "n.h", "n.l"), "columns")
    kind = near.schema["g"].dataType.simpleString()

    def along(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("x")
        low, high = int(rows.x0.iloc[0]), int(rows.x1.iloc[0])
        found = envelope(rows.x.tolist(), rows.h.tolist(), rows.l.tolist(), low, high)
        return pd.DataFrame({"g": rows.g.iloc[0], "x": range(low, high + 1), "y": rows.y.iloc[0], "square": [s for s, _ in found], "label": [k for _, k in found]})

    out = near.groupBy("g", "y").applyInPandas(along, f"g {kind}, x long, y long, square long, label long")
    return out.select(F.col("g").alias(group), F.col("x").alias(x), F.col("y").alias(y), "square", "label")
