"""Ranked search and facet filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for a term that nothing matches; any such term rejects the row.
REJECT = -1_000_000


def _or_empty(c: Column | None, kind: str = "string") -> Column:
    empty = F.lit("") if kind == "string" else F.array().cast("array<string>")
    return empty if c is None else F.coalesce(c, empty)


def term_score(t: Column, name: Column, id_: Column, people: Column, department: Column, tags: Column, description: Column) -> Column:
    """The first rule that holds for one term; all columns are lower case and not null."""
    return (
        F.when((name == t) | (id_ == t) | F.exists(people, lambda p: p == t), 100)
        .when(F.exists(people, lambda p: F.exists(F.split(p, r"\s+"), lambda w: F.startswith(w, t))), 60)
        .when(F.exists(people, lambda p: F.contains(p, t)), 45)
        .when(F.startswith(name, t), 40)
        .when(F.contains(name, t), 25)
        .when(F.contains(id_, t), 20)
        .when(F.exists(F.split(department, r"[\s,]+"), lambda w: F.startswith(w, t)), 18)
        .when(F.exists(tags, lambda g: F.contains(g, t)), 15)
        .when(F.contains(description, t), 5)
        .otherwise(REJECT)
    )


def ranked_search(df: DataFrame, query: str, *, id_col: str, name: Column, order: Column, people: Column | None = None, department: Column | None = None, tags: Column | None = None, description: Column | None = None, limit: int = 8) -> DataFrame:
    """``df`` with ``score``, best first, at most ``limit`` rows; every term must match somewhere.

    A blank query gives no rows. Ties go by name as dictionaries sort it, then by ``order``. One scan and a top-k per task; nothing is shuffled.
    """
    terms = query.strip().lower().split()
    if not terms:
        return df.withColumn("score", F.lit(0)).limit(0)
    low = [F.lower(_or_empty(name)), F.lower(F.col(id_col).cast("string")), F.transform(_or_empty(people, "array"), F.lower), F.lower(_or_empty(department)), F.transform(_or_empty(tags, "array"), F.lower), F.lower(_or_empty(description))]
    score = F.lit(0)
    for t in terms:
        score = score + term_score(F.lit(t), *low)
    return df.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), F.collate(name, "UNICODE"), order).limit(limit)


def facets(category: Column, wanted: list[str], always: tuple[str, ...] = ()) -> Column:
    """Whether a row passes the category filter; an empty filter passes all, ``always`` passes any."""
    return F.lit(True) if not wanted else category.isin(*wanted, *always)


def listable(category: Column, name: Column, hidden: tuple[str, ...], unnamed: str) -> Column:
    return ~category.isin(*hidden) & (name != unnamed)


def searchable(category: Column, hidden: tuple[str, ...]) -> Column:
    """Rows that a search looks at, unnamed ones too."""
    return ~category.isin(*hidden)


def listed(category: Column, name: Column, hidden: tuple[str, ...], unnamed: str, wanted: list[str]) -> Column:
    """Rows of the list: listable, and of a wanted category if any is wanted; no category passes always."""
    return listable(category, name, hidden, unnamed) & facets(category, wanted)


def navigable(category: Column, on_floor: Column, current: Column, hidden: tuple[str, ...], wanted: list[str], always: tuple[str, ...] = ()) -> Column:
    """Rows that the focus may move to: on the floor, not the current one, not hidden and not filtered out."""
    return on_floor & ~current & ~category.isin(*hidden) & facets(category, wanted, always)


def on_floor(items: DataFrame, floor: Column, floor_id: str = "floor_id") -> DataFrame:
    """What a floor's map draws: the items of that floor; no floor draws nothing."""
    return items.where(F.coalesce(F.col(floor_id) == floor, F.lit(False)))


def shown_doors(doors: DataFrame, floor: Column, floor_id: str = "floor_id", shown: str = "shown") -> DataFrame:
    """The doors of a floor that are marked to be shown; unmarked ones serve directions only."""
    return on_floor(doors, floor, floor_id).where(F.coalesce(F.col(shown), F.lit(False)))


def marked(corrections: DataFrame, floor: Column, at: str = "at", floor_id: str = "floor_id") -> DataFrame:
    """The corrections of a floor that have a place on it."""
    return on_floor(corrections, floor, floor_id).where(F.col(at).isNotNull())


def importable(category: Column, space_id: Column, without: str = "circulation", unnumbered: str = "room-") -> Column:
    """Spaces that a sheet may give a department: those that are no circulation and have an id of their own; null ids have none."""
    return F.coalesce(category != without, F.lit(True)) & F.coalesce(~F.startswith(space_id, F.lit(unnumbered)), F.lit(False))


def pick(found: DataFrame, places: DataFrame, place_id: str, floor: str) -> DataFrame:
    """The changes of the store that picking search results makes: ``session, field, value``, a floor and a selection for each.

    ``found`` has ``session`` and ``place_id``; a place that is not known changes nothing.
    """
    both = found.select("session", F.col(place_id).alias("__id")).join(places.select(F.col(place_id).alias("__place"), F.col(floor).cast("string").alias("__floor")), F.col("__id") == F.col("__place"))
    fields = F.explode(F.array(F.struct(F.lit("floor").alias("field"), F.col("__floor").alias("value")), F.struct(F.lit("selected").alias("field"), F.col("__id").cast("string").alias("value"))))
    return both.select("session", fields.alias("f")).select("session", "f.*")
