"""Numbering and grid cells: running numbers that no single task counts, regions, claims, closing and growth of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmap.functions import geometry as G
from quillmap.plans.components import components
from quillmap.plans.storage import apart, keep


def numbered(df: DataFrame, group: str, *order: str, name: str = "n") -> DataFrame:
    """``df`` with running numbers from 1 within each group, by ``order`` (which should tell all rows apart).

    Rows are cut into ranges of (group, order), so a hot group is spread over tasks: each task numbers its own stretch, and
    sums over (group, task) give what came before. Nulls come first; an empty table gives an empty result.
    """
    rows = df.repartitionByRange(group, *order).withColumn("__task", F.spark_partition_id())
    rows = keep(rows.withColumn("__at", F.row_number().over(W.partitionBy("__task", group).orderBy(*order))), "numbered")
    tasks = rows.groupBy(F.col(group).alias("__group"), F.col("__task").alias("__of")).agg(F.count(F.lit(1)).alias("__size"))
    before = F.sum("__size").over(W.partitionBy("__group").orderBy("__of")) - F.col("__size")
    tasks = tasks.select("__group", "__of", before.alias("__before"))
    joined = rows.join(tasks, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__task") == F.col("__of")))
    return joined.select(*[F.col(c) for c in df.columns], (F.col("__before") + F.col("__at")).cast("long").alias(name))


def regions(cells: DataFrame, group: str, x: str = "x", y: str = "y", corners: bool = False) -> DataFrame:
    """``group, x, y, region_x, region_y``: each cell with the least cell of the region of touching cells that it lies in.

    Cells touch along sides, with ``corners`` at corners too. Neighbours are found by joins on their places; regions are
    connected components. Repeated cells count once; cells with a null are left out.
    """
    cell = F.struct(F.col(group).alias("g"), F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y"))
    own = apart(keep(cells.select(cell.alias("c")).where("c.g is not null and c.x is not null and c.y is not null").distinct(), "cells"))
    steps = [(1, 0), (0, 1)] + ([(1, 1), (1, -1)] if corners else [])

    def moved(dx: int, dy: int) -> Column:
        return F.struct(F.col("c.g").alias("g"), (F.col("c.x") + dx).alias("x"), (F.col("c.y") + dy).alias("y"))

    near = own.select(F.col("c").alias("a"), F.explode(F.array(*[moved(*s) for s in steps])).alias("c")).join(own, "c")
    found = components(near.select("a", F.col("c").alias("b")))
    label = F.coalesce("label", "c")
    return own.join(found, F.col("c") == F.col("node"), "left").select(F.col("c.g").alias(group), F.col("c.x").alias(x), F.col("c.y").alias(y), label.x.alias("region_x"), label.y.alias("region_y"))


def region_sizes(found: DataFrame, group: str) -> DataFrame:
    """Cells of each region, with the region's box; the largest first."""
    sizes = found.groupBy(group, "region_x", "region_y").agg(F.count(F.lit(1)).alias("cells"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("x", "y") for f in (F.min, F.max)])
    return sizes.orderBy(F.col("cells").desc(), group, "region_x", "region_y")


def rasterised(items: DataFrame, step: float, id_col: str = "id", poly: str = "poly") -> DataFrame:
    """``id, x, y``: the cells of a grid of ``step`` whose middles lie in the straight polygon of each row.

    Each line of cells is cut where edges cross its middle, and only the cells between two cuts are listed.
    """

    def filled(edges: Column, y: Column) -> Column:
        at = (y + 0.5) * step
        crossed = F.filter(edges, lambda e: (e.a.y > at) != (e.b.y > at))
        cuts = F.sort_array(F.transform(crossed, lambda e: (e.b.x - e.a.x) * (at - e.a.y) / (e.b.y - e.a.y) + e.a.x))
        firsts = F.transform(cuts, lambda x: F.ceil(x / step - 0.5).cast("long"))

        def between(v: Column) -> Column:
            pairs = F.filter(F.transform(v, lambda x, i: F.struct(x.alias("low"), (F.get(v, i + 1) - 1).alias("high"), i.alias("i"))), lambda p: (p.i % 2 == 0) & (p.low <= p.high))
            return F.flatten(F.transform(pairs, lambda p: F.sequence(p.low, p.high)))

        return G.named(firsts, between)

    def lines(edges: Column, box: Column) -> Column:
        ys = F.sequence(F.floor(box.y / step).cast("long"), F.floor((box.y + box.height) / step).cast("long"))
        return F.transform(ys, lambda y: F.struct(y.alias("y"), filled(edges, y).alias("xs")))

    drawn = G.named(F.struct(G.edges(F.col(poly)).alias("edges"), G.bbox(F.col(poly)).alias("box")), lambda s: lines(s.edges, s.box))
    return items.select(id_col, F.explode(drawn).alias("line")).select(id_col, F.explode("line.xs").alias("x"), F.col("line.y").alias("y"))


def owned(cells: DataFrame, *order: str, keep_cols: tuple[str, ...] = ("id",), place: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """One row per cell, that of the first claim by ``order``; so shapes that overlap yield to those that go before."""
    first = F.min(F.struct(*order, *[F.col(c).alias(f"__{c}") for c in keep_cols])).alias("s")
    return cells.groupBy(*place).agg(first).select(*place, *[F.col(f"s.__{c}").alias(c) for c in keep_cols])


def dilated(cells: DataFrame, by: int, group: str) -> DataFrame:
    """The cells within ``by`` of a cell, along both sides; first along x, then along y, so each cell is copied 4 ``by`` + 2 times at most."""
    out = cells.select(group, "x", "y")
    for c, other in (("x", "y"), ("y", "x")):
        out = out.select(group, other, F.explode(F.sequence(F.col(c) - by, F.col(c) + by)).alias(c)).distinct()
    return out.select(group, "x", "y")


def eroded(cells: DataFrame, by: int, group: str) -> DataFrame:
    """The cells all of whose neighbours within ``by`` are there as well."""
    out = cells.select(group, "x", "y").distinct()
    for c, other in (("x", "y"), ("y", "x")):
        out = out.select(group, other, F.explode(F.sequence(F.col(c) - by, F.col(c) + by)).alias(c))
        out = out.groupBy(group, other, c).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 2 * by + 1).drop("n")
    return out.select(group, "x", "y")


def closed(cells: DataFrame, by: int, group: str) -> DataFrame:
    """The cells with gaps of up to twice ``by`` filled: dilated, then eroded."""
    return eroded(dilated(cells, by, group), by, group)


def grown(seeds: DataFrame, free: DataFrame, rounds: int, group: str, label: str = "label") -> DataFrame:
    """Labelled cells that spread over the free cells along sides, one step a round, for at most ``rounds`` rounds.

    Of several labels that reach a cell in the same round, the least wins; seeds off the free cells do not spread. Each
    round joins only the cells that were new in the round before, and its result is written to the shared folder.
    """
    cell = [group, "x", "y"]
    open_ = keep(free.select(*cell).dropna().distinct(), "free")
    done = front = keep(seeds.join(open_, cell, "left_semi").groupBy(*cell).agg(F.min(label).alias(label)), "grown")
    for _ in range(rounds):
        moves = F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))])
        near = front.select(group, label, F.explode(moves).alias("m")).select(group, "m.x", "m.y", label).groupBy(*cell).agg(F.min(label).alias(label))
        front = keep(near.join(open_, cell, "left_semi").join(done, cell, "left_anti"), "front")
        if front.limit(1).count() == 0:
            break
        done = keep(done.unionByName(front), "grown")
    return done.select(*cell, label)


def labels_per_region(found: DataFrame, labels: DataFrame, group: str, label: str = "label") -> DataFrame:
    """``group, region_x, region_y, labels``: how many different labels the cells of each region hold, the most first."""
    told = found.join(labels.select(group, "x", "y", label).distinct(), [group, "x", "y"], "left")
    counts = told.groupBy(group, "region_x", "region_y", label).agg(F.lit(1).alias("__one")).groupBy(group, "region_x", "region_y").agg(F.count(label).alias("labels"))
    return counts.orderBy(F.col("labels").desc(), group, "region_x", "region_y")
