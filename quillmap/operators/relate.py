"""Lookup joins, unmatched keys, set operations, validation and grouped listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmap.operators.grid import numbered
from quillmap.plans.storage import keep, small


def assign_lists(left: DataFrame, right: DataFrame, key: str, right_key: str, item: Column, order: Column, into: str) -> DataFrame:
    """``left`` with an array of the matching ``item`` values in order; an empty array where there are none."""
    lists = right.where(F.col(right_key).isNotNull()).groupBy(F.col(right_key).alias("__key")).agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), item.alias("v")))), lambda x: x.v).alias(into))
    return left.join(lists, F.col(key) == F.col("__key"), "left").drop("__key").withColumn(into, F.coalesce(into, F.slice(F.array(F.lit(None).cast(dict(lists.dtypes)[into][6:-1])), 1, 0)))


def tag_members(left: DataFrame, members: DataFrame, key: str, member_key: str, tags: str, tag: str) -> DataFrame:
    """``left`` with ``tag`` appended to its tags where the key is a member, even if the tag is there."""
    found = members.select(F.col(member_key).alias("__key"), F.lit(True).alias("__in")).distinct()
    out = left.join(found, F.col(key) == F.col("__key"), "left")
    return out.withColumn(tags, F.when(F.col("__in"), F.concat(F.col(tags), F.array(F.lit(tag)))).otherwise(F.col(tags))).drop("__key", "__in")


def unmatched(keys: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Rows of ``keys`` whose key is not known; repeats stay."""
    return keys.join(known.select(F.col(known_key).alias("__key")), F.col(key) == F.col("__key"), "left_anti")


def first_match(left: DataFrame, right: DataFrame, on: Column, left_id: str, order: Column, keep: list[str]) -> DataFrame:
    """Each left row with the first right row that matches; the left row alone where none does."""
    best = left.join(right, on).groupBy(left_id).agg(F.min(F.struct(order.alias("o"), *keep)).alias("m"))
    return left.join(best, left_id, "left").select(left["*"], *[F.col(f"m.{c}").alias(c) for c in keep])


def override(base: DataFrame, more: DataFrame, key: str, value: str, last_wins: bool = True) -> DataFrame:
    """The union of two keyed tables; on a shared key the right value wins, or the left."""
    a, b = base.select(key, F.col(value).alias("__a")), more.select(key, F.col(value).alias("__b"))
    one, two = ("__b", "__a") if last_wins else ("__a", "__b")
    return a.join(b, key, "full").select(key, F.coalesce(one, two).alias(value))


def gone_and_added(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys of one table only, and of both: ``key, status``."""
    a, b = old.select(key).distinct().withColumn("__a", F.lit(True)), new.select(key).distinct().withColumn("__b", F.lit(True))
    return a.join(b, key, "full").select(key, F.when(F.col("__b").isNull(), "gone").when(F.col("__a").isNull(), "added").otherwise("kept").alias("status"))


def repeats(df: DataFrame, key: str, order: Column) -> DataFrame:
    """Every occurrence of a key after the first."""
    return df.withColumn("occurrence", F.row_number().over(W.partitionBy(key).orderBy(order))).where("occurrence > 1")


def suffixed(df: DataFrame, key: str, order: list[Column], into: str) -> DataFrame:
    """``key`` made unique: the second occurrence gets ``-2``, the third ``-3``; null keys stay null. A key of any number of rows is spread over tasks."""
    places = [f"__order{k}" for k in range(len(order))]
    n = F.col("__n")
    out = numbered(df.withColumns(dict(zip(places, order, strict=True))), key, *places, name="__n")
    return out.withColumn(into, F.when(n == 1, F.col(key).cast("string")).otherwise(F.concat(F.col(key).cast("string"), F.lit("-"), n.cast("string")))).drop("__n", *places)


def with_dimension(rows: DataFrame, dimension: DataFrame, key: str, dimension_key: str) -> DataFrame:
    """``rows`` with the columns of their dimension; rows without one, and null keys, are left out."""
    side = keep(dimension, "dimension")
    return rows.join(small(side.withColumnRenamed(dimension_key, "__dimension")), F.col(key) == F.col("__dimension")).drop("__dimension")


def problems_in_order(sections: list[DataFrame], text: str = "problem") -> DataFrame:
    """``section, problem`` of all lists, numbered in the order they are given."""
    out = None
    for k, part in enumerate(sections):
        part = part.select(F.lit(k).alias("section"), F.col(text).cast("string").alias("problem"))
        out = part if out is None else out.unionByName(part)
    return out


def problem_summary(problems: DataFrame) -> DataFrame:
    """``n, summary``: one row with their number."""
    n = F.count(F.lit(1))
    return problems.agg(n.alias("n"), F.when(n == 0, "no problems").otherwise(F.concat(n.cast("string"), F.when(n == 1, " problem").otherwise(" problems"))).alias("summary"))


def report(header: str, lines: DataFrame, order: str, line: str) -> DataFrame:
    """``pos, line``: a header with the number of lines at 0, then the lines by ``order``."""
    body = numbered(lines.select(F.lit(0).alias("__all"), F.col(order).alias("__order"), F.col(line).alias("line")), "__all", "__order", name="pos")
    head = lines.agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).cast("long").alias("pos"), F.concat(F.lit(f"{header} ("), F.col("n").cast("string"), F.lit(")")).alias("line"))
    return head.unionByName(body.select("pos", "line"))


def listing(groups: DataFrame, rows: DataFrame, group_key: str, row_key: str) -> DataFrame:
    """``group_key, n, total, n_groups`` for every group, with those without rows; sums are small and made map-side."""
    counts = rows.groupBy(F.col(row_key).alias("__key")).agg(F.count(F.lit(1)).alias("n"))
    out = groups.join(counts, F.col(group_key) == F.col("__key"), "left").select(group_key, F.coalesce("n", F.lit(0)).alias("n"))
    sums = out.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_groups")).withColumn("__one", F.lit(1))
    return out.withColumn("__one", F.lit(1)).join(F.broadcast(sums), "__one").drop("__one")  # one row


def shadings(fills: DataFrame, level: str, name: str, colour: str, shape: str, order: str) -> tuple[DataFrame, DataFrame]:
    """``level, name, shapes`` and ``name, colour``: the shapes of each name on each sheet in order, and each name's first colour on any.

    Rows without a name are left out; a null order comes last, and equal ones go by the colour. The shapes of a name on one sheet
    are one row, as many as the sheet draws of it.
    """
    rows = fills.where(F.col(name).isNotNull())
    place = F.struct(F.col(order).isNull().alias("n"), F.col(order).alias("o"))
    lists = rows.groupBy(level, name).agg(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), F.col(shape).alias("s")))), lambda x: x.s).alias("shapes"))
    firsts = rows.where(F.col(colour).isNotNull()).groupBy(name).agg(F.min(F.struct(place.alias("p"), F.col(colour).alias("c"))).alias("m"))
    return lists, firsts.select(name, F.col("m.c").alias(colour))
