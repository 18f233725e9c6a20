"""Texts and choices of lists and detail panels, in Column expressions. Null lists count as empty, null texts are left out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _names(people: Column) -> Column:
    return F.array_join(F.coalesce(people, F.array().cast("array<string>")), ", ")


def _given(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def title(name: Column, people: Column) -> Column:
    """The name with its people behind a middle dot."""
    return F.concat_ws(" · ", name, _given(_names(people)))


def subtitle(people: Column, department: Column) -> Column:
    """People and department; empty where there are neither."""
    return F.concat_ws(" · ", _given(_names(people)), _given(department))


def spoken(name: Column, people: Column) -> Column:
    """The name and its people, for screen readers."""
    return F.concat_ws(", ", name, _given(_names(people)))


def facts(floor: Column, wing: Column, kind: Column, department: Column, people: Column, capacity: Column, tags: Column) -> Column:
    """``ARRAY<STRUCT<label, value>>``: what is known, in this order; a capacity of 0 is not known."""

    def fact(label: Column | str, value: Column) -> Column:
        return F.struct((F.lit(label) if isinstance(label, str) else label).alias("label"), value.cast("string").alias("value"))

    several = F.when(F.size(people) == 1, "Occupant").otherwise("Occupants")
    parts = [
        fact("Floor", floor),
        F.when(_given(wing).isNotNull(), fact("Wing", wing)),
        fact("Type", kind),
        F.when(_given(department).isNotNull(), fact("Department", department)),
        F.when(F.size(people) > 0, fact(several, F.array_join(people, "\n"))),
        F.when(capacity != 0, fact("Capacity", capacity)),
        F.when(F.size(tags) > 0, fact("Tags", F.array_join(tags, " "))),
    ]
    return F.array_compact(F.array(*parts))


def toggled(items: Column, item: Column) -> Column:
    """``items`` without ``item`` where it is in, else with it at the end."""
    return F.when(F.array_contains(items, item), F.array_remove(items, item)).otherwise(F.concat(items, F.array(item)))


def merged_tags(a: Column, b: Column) -> Column:
    """Both lists as one sorted set."""
    empty = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(a, empty), F.coalesce(b, empty)))


def correction_place(space_name: Column, space_id: Column, x: Column, y: Column) -> Column:
    """Where a correction belongs: a named space, a space that is gone, a point, or the floor."""
    return F.when(space_name.isNotNull(), F.format_string("%s (%s)", space_name, space_id)).when(space_id.isNotNull(), space_id).when(x.isNotNull() & y.isNotNull(), F.concat(F.lit("point ("), x.cast("string"), F.lit(", "), y.cast("string"), F.lit(")"))).otherwise("floor")


def report_line(floor: Column, place: Column, name: Column, text: Column) -> Column:
    """A correction as a line of the report."""
    who = _given(F.trim(F.coalesce(name, F.lit(""))))
    note = F.coalesce(_given(F.trim(F.coalesce(text, F.lit("")))), F.lit("(no note)"))
    return F.concat(F.lit("- "), F.concat_ws(" · ", F.concat(F.lit("Floor "), floor), place, F.concat(F.lit("name/occupant: "), who), note))


def is_white(r: Column, g: Column, b: Column) -> Column:
    return (r > 0.97) & (g > 0.97) & (b > 0.97)


def is_black(r: Column, g: Column, b: Column) -> Column:
    return (r < 0.05) & (g < 0.05) & (b < 0.05)


def annotation_kept(font: Column, size: Column, text: Column, prefix: str, largest: float) -> Column:
    """Whether a line of a sheet is an annotation: of the font, small enough, and more than digits and spaces."""
    return F.startswith(font, F.lit(prefix)) & (size <= largest) & ~F.rlike(text, F.lit(r"^[\d\s]*$"))


def next_index(active: Column, step: Column, n: Column) -> Column:
    """The active place of a list after a step, round its ends; null for an empty list."""
    return F.when(n > 0, F.pmod(active + step, n))


def new_id() -> Column:
    """A fresh id: the time in milliseconds and a random number, in digits and letters. Differs from run to run."""
    return F.lower(F.concat(F.conv(F.unix_millis(F.current_timestamp()).cast("string"), 10, 36), F.lpad(F.conv(F.floor(F.rand() * 36**4).cast("string"), 10, 36), 4, "0")))
