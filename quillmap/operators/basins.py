"""Basins of cells by height, and what regions of cells they hold.

Every cell belongs to the seed that water rising over the heights brings to it first. That seed is found on the least spanning
forest of neighbouring cells that is rooted in the seeds: in each round every basin without a seed joins the neighbour beyond
its lowest way out, so their number at least halves. Rounds are joins of written tables that shrink; no task holds a basin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmap.plans.storage import apart, keep


def _ends(edges: DataFrame) -> DataFrame:
    """Each edge seen from those of its ends that have no label: ``u, way, v, label`` with the label of ``v``."""
    there = edges.where("a_label is null").select(F.col("a").alias("u"), "way", F.col("b").alias("v"), F.col("b_label").alias("label"))
    back = edges.where("b_label is null").select(F.col("b").alias("u"), "way", F.col("a").alias("v"), F.col("a_label").alias("label"))
    return there.unionByName(back)


def _settled(edges: DataFrame) -> DataFrame:
    """``u, root, label, high`` of every basin without a label: where its lowest way out, and those of the basins beyond, lead to."""
    least = _ends(edges).groupBy("u").agg(F.min(F.struct("way", "v", "label")).alias("m"))
    picks = keep(least.select("u", F.col("m.v").alias("v"), F.col("m.label").alias("label"), F.col("m.way.high").alias("high")), "picks")
    picks = apart(picks)
    other = picks.select(F.col("u").alias("ou"), F.col("v").alias("ov"))
    # Two basins that pick each other do so over one edge; the lesser is the root of what gathers there.
    is_root = F.coalesce((F.col("ov") == F.col("u")) & (F.col("u") < F.col("v")), F.lit(False))
    state = keep(picks.join(other, F.col("v") == F.col("ou"), "left").select("u", F.when(is_root, F.col("u")).otherwise(F.col("v")).alias("root"), "label", "high"), "roots")
    state = apart(state)
    while True:
        step = state.select(F.col("u").alias("su"), F.col("root").alias("sroot"), F.col("label").alias("slabel"))
        found = state.withColumn("moved", F.lit(False))
        for _ in range(2):  # two jumps for each written table
            moved = F.col("moved") | F.coalesce(F.col("sroot") != F.col("root"), F.lit(False))
            joined = found.join(step, F.col("root") == F.col("su"), "left")
            found = joined.select("u", F.coalesce("sroot", "root").alias("root"), F.coalesce("slabel", "label").alias("label"), "high", moved.alias("moved"))
        found = apart(keep(found, "roots"))
        state = found.drop("moved")
        if found.where("moved").limit(1).count() == 0:
            return state


def basins(cells: DataFrame, seeds: DataFrame, group: str, height: str = "height", label: str = "label", x: str = "x", y: str = "y") -> DataFrame:
    """``group, x, y, label, pass``: the seed that each cell belongs to, and the least greatest height on a way to a seed.

    Ways go along sides. Neighbouring cells are joined in the order of the higher height, then the lower one, then the places
    of both, so flat ground and ties have one result. A cell given twice has its least height, a seed given twice its least
    label; seeds off the cells count for nothing. Rows with a null are left out, and so are cells that no seed reaches.
    """
    place = F.struct(F.col(group).alias("g"), F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y"))
    valid = "c.g is not null and c.x is not null and c.y is not null and v is not null"
    ground = cells.select(place.alias("c"), F.col(height).alias("v")).where(valid).groupBy("c").agg(F.min("v").alias("h"))
    marks = seeds.select(place.alias("c"), F.col(label).alias("v")).where(valid).groupBy("c").agg(F.min("v").alias("l"))
    ground = apart(keep(ground.join(marks, "c", "left"), "ground"))
    steps = F.array(*[F.struct(F.col("c.g").alias("g"), (F.col("c.x") + dx).alias("x"), (F.col("c.y") + dy).alias("y")) for dx, dy in ((1, 0), (0, 1))])
    near = ground.select(F.col("c").alias("a"), F.col("h").alias("a_h"), F.col("l").alias("a_label"), F.explode(steps).alias("c"))
    pairs = near.join(ground, "c").select("a", F.col("c").alias("b"), "a_label", F.col("l").alias("b_label"), F.greatest("a_h", "h").alias("high"), F.least("a_h", "h").alias("low"))
    way = F.struct("high", "low", F.col("a").alias("one"), F.col("b").alias("two"))
    edges = keep(pairs.where("a_label is null or b_label is null").select("a", "b", "a_label", "b_label", way.alias("way")), "edges")
    rounds: list[DataFrame] = []
    while edges.limit(1).count():
        told = _settled(edges)
        rounds.append(told)
        for end in ("a", "b"):
            to = told.select(F.col("u").alias("u"), F.col("root").alias("root"), F.col("label").alias("label"))
            rest = [c for c in edges.columns if c not in (end, f"{end}_label")]
            edges = edges.join(to, F.col(end) == F.col("u"), "left").select(*rest, F.coalesce("root", end).alias(end), F.coalesce("label", f"{end}_label").alias(f"{end}_label"))
        open_ = edges.where("a <> b and (a_label is null or b_label is null)")
        # Of several ways between two basins only the lowest can be taken.
        turned = open_.select(F.when(F.col("a") < F.col("b"), F.struct("a", "a_label", "b", "b_label")).otherwise(F.struct(F.col("b").alias("a"), F.col("b_label").alias("a_label"), F.col("a").alias("b"), F.col("a_label").alias("b_label"))).alias("e"), "way")
        edges = keep(turned.groupBy("e").agg(F.min("way").alias("way")).select("e.*", "way"), "edges")
    # From the last round back to the cells: a basin has the label of what it joined, and no pass below its own way out.
    found = None
    for told in reversed(rounds):
        if found is None:
            found = told.select("u", "label", F.col("high").alias("pass"))
        else:
            after = found.select(F.col("u").alias("au"), F.col("label").alias("alabel"), F.col("pass").alias("apass"))
            joined = told.join(after, F.col("root") == F.col("au"), "left")
            found = joined.select("u", F.coalesce("label", "alabel").alias("label"), F.when(F.col("label").isNull(), F.greatest("high", "apass")).otherwise(F.col("high")).alias("pass"))
    told = ground.where("l is not null").select("c", F.col("l").alias("label"), F.col("h").alias("pass"))
    if found is not None:
        told = told.unionByName(found.where("label is not null").select(F.col("u").alias("c"), "label", "pass"))
    return told.select(F.col("c.g").alias(group), F.col("c.x").alias(x), F.col("c.y").alias(y), F.col("label").alias(label), "pass")


def dealt_regions(regions: DataFrame, owners: DataFrame, group: str, share: float = 0.2, least: int = 1, label: str = "label") -> DataFrame:
    """``group, region_x, region_y, label, cells, whole``: how many cells of each region each label gets.

    ``regions`` has the columns of ``grid.regions``, ``owners`` one ``label`` for each cell. Labels with ``least`` cells and the
    given share of a region own it: a sole owner gets it whole, several split it by their own cells, others get nothing of it.
    Where no label has that share, each that has ``least`` cells keeps its own. Cells without a label count for the region's
    size only; a null label is no label.
    """
    told = regions.join(owners.select(group, "x", "y", label), [group, "x", "y"], "left")
    counts = told.groupBy(group, "region_x", "region_y", label).agg(F.count(F.lit(1)).alias("cells"))
    region = W.partitionBy(group, "region_x", "region_y")  # one row for each label that meets the region
    counts = counts.withColumn("size", F.sum("cells").over(region))
    counts = counts.withColumn("owns", F.col(label).isNotNull() & (F.col("cells") >= least) & (F.col("cells") >= share * F.col("size")))
    counts = counts.withColumn("n", F.count_if("owns").over(region))
    held = counts.where(F.col(label).isNotNull() & (F.col("cells") >= least) & (F.col("owns") | (F.col("n") == 0)))
    whole = F.col("owns") & (F.col("n") == 1)
    return held.select(group, "region_x", "region_y", label, F.when(whole, F.col("size")).otherwise(F.col("cells")).alias("cells"), whole.alias("whole"))
