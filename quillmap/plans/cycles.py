"""Cycles of a permutation, by pointer doubling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.plans.storage import apart, keep


def cycles(links: DataFrame, node: str = "node", after: str = "after") -> DataFrame:
    """``node, ring, place``: the least node of each node's cycle, and the steps from that node to it.

    ``links`` has one row for each node, and each node is once an ``after``. Every round joins each node with the one its
    pointer reaches and doubles the stretch that it knows the least node of. A node that meets the least node twice knows the
    cycle's length, and so do all nodes of a cycle that is no longer than half a stretch; they are done then. So a cycle of n
    nodes takes about log n rounds, each a written table of the longer cycles only; no cycle is gathered in one task. An empty
    table gives an empty result.
    """
    start = links.select(F.col(node).alias("node"), F.col(after).alias("to"), F.col(node).alias("ring"), F.lit(0).cast("long").alias("off"), F.lit(None).cast("long").alias("n"))
    rest, step, done = apart(keep(start, "cycles")), 1, []
    while True:
        far = rest.select(*[F.col(c).alias(f"__{c}") for c in ("node", "to", "ring", "off", "n")])
        nearer = F.col("__ring") < F.col("ring")  # of equal ones, the nearer place counts
        again = F.when(F.col("__ring") == F.col("ring"), F.coalesce("n", "__n", F.col("__off") + step - F.col("off"))).otherwise(F.col("n"))
        joined = rest.join(far, F.col("to") == F.col("__node"))
        joined = joined.select("node", F.col("__to").alias("to"), F.when(nearer, F.col("__ring")).otherwise(F.col("ring")).alias("ring"), F.when(nearer, F.col("__off") + step).otherwise(F.col("off")).alias("off"), F.when(nearer, F.col("__n")).otherwise(again).alias("n"))
        found = keep(joined, "cycles")
        whole = F.coalesce(F.col("n") <= step, F.lit(False))
        done.append(found.where(whole).select("node", "ring", F.pmod(F.col("n") - F.col("off"), F.col("n")).alias("place")))
        rest, step = apart(found.where(~whole)), 2 * step
        if rest.limit(1).count() == 0:
            return reduce(DataFrame.unionByName, done).hint("merge")
