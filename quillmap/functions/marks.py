"""What a map shows of a record: its name, tags and label lines, its caption, and the glyph of a door."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmap.functions import geometry as G
from quillmap.functions.text import name_lines, slug, wrap_words

#: Names that tell no more than a category does.
PLAIN_NAMES = ("Office", "Open Office", "Room")


def space(floor: Column, key: Column, category: Column, wing: Column, kinds: dict[str, str], name: Column | None = None, label: Column | None = None, tags: Column | None = None) -> Column:
    """``STRUCT<id, name, label, tags>`` of a room given by its floor and key; what is given goes before what is derived.

    ``kinds`` names categories for rooms without a name, ``Room`` stands for the rest. A key of digits, with a capital before
    or after, is a number: it is the label where none is given, and a tag after the wing.
    """
    nothing = F.lit(None).cast("string")
    name, label = nothing if name is None else name, nothing if label is None else label
    number = F.when(key.rlike(r"^[A-Z]?[0-9]+[A-Z]?$"), key)
    known = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    kind = F.coalesce(F.try_element_at(known, category), F.lit("Room"))
    more = F.array().cast("array<string>") if tags is None else F.coalesce(tags, F.array().cast("array<string>"))
    return F.struct(
        F.concat(floor, F.lit("-"), slug(key)).alias("id"),
        F.coalesce(name, F.concat(kind, F.lit(" "), key)).alias("name"),
        F.coalesce(label, number, name, key).alias("label"),
        F.concat(F.array_compact(F.array(F.lower(wing), number)), more).alias("tags"),
    )


def label_lines(label: Column, name: Column, caption: Column, people: Column, most: int = 22) -> Column:
    """The label's own lines, the wrapped caption, then each person's name on one line or two."""
    none = F.array().cast("array<string>")
    people = F.coalesce(F.flatten(F.transform(people, name_lines)), none)
    return F.concat(F.split(F.coalesce(label, name), "\n"), F.coalesce(wrap_words(caption, most), none), people)


def caption(display: Column, number: Column, poly: Column, least_area: float = 10_000.0, plain: tuple[str, ...] = PLAIN_NAMES) -> Column:
    """The name before its number, for large shapes whose name tells something; else null."""
    base = F.when(display.endswith(number), F.rtrim(F.left(display, F.length(display) - F.length(number))))
    wide = (F.size(poly) >= 3) & (G.area(G.flatten(poly)) >= least_area)
    return F.when(wide & (base != "") & ~base.isin(*plain), base)


def _tenths(v: Column) -> Column:
    t = F.floor(v * 10 + 0.5)
    return F.when(t % 10 == 0, (t / 10).cast("long").cast("string")).otherwise(F.format_string("%.1f", t / 10))


def door_swing(a: Column, b: Column, open_end: Column, leaves: Column, size: float) -> Column:
    """Path text of a door's leaves and their arcs, in a square of ``size`` around the origin; numbers to a tenth.

    One leaf hangs at ``a``, opens to ``open_end`` and strikes ``b``; two hang at both ends and meet in the middle. The mark
    is fitted to the squares that the swings span.
    """

    def leaf(hinge: Column, out: Column, strike: Column) -> Column:
        return F.struct(hinge.alias("h"), out.alias("o"), strike.alias("s"))

    def two(k: Column) -> Column:
        nx, ny = open_end.x - a.x, open_end.y - a.y
        n = F.hypot(nx, ny)
        by = F.hypot(b.x - a.x, b.y - a.y) / 2 / F.when(n == 0, F.lit(1.0)).otherwise(n)
        mid = G.point((a.x + b.x) / 2, (a.y + b.y) / 2)
        return F.array(*[leaf(G.point(p.x, p.y), G.point(p.x + nx * by, p.y + ny * by), mid) for p in (a, b)])

    def corners(x: Column) -> Column:
        return F.array(x.h, x.o, x.s, G.point(x.o.x + x.s.x - x.h.x, x.o.y + x.s.y - x.h.y))

    def drawn(all_: Column) -> Column:
        def path(box: Column) -> Column:
            f = F.lit(size) / F.greatest(box.width, box.height, F.lit(1.0))

            def at(p: Column) -> Column:
                return F.struct(((p.x - box.x - box.width / 2) * f).alias("x"), ((p.y - box.y - box.height / 2) * f).alias("y"))

            def text(x: Column) -> Column:
                r = _tenths(F.hypot(x.o.x - x.h.x, x.o.y - x.h.y))
                side = (x.o.x - x.h.x) * (x.s.y - x.h.y) - (x.o.y - x.h.y) * (x.s.x - x.h.x) > 0
                h, o, s = (F.concat_ws(" ", _tenths(p.x), _tenths(p.y)) for p in (x.h, x.o, x.s))
                return F.concat(F.lit("M"), h, F.lit(" L"), o, F.lit(" A"), r, F.lit(" "), r, F.lit(" 0 0 "), F.when(side, "1").otherwise("0"), F.lit(" "), s)

            return F.array_join(F.transform(F.transform(all_, lambda x: leaf(at(x.h), at(x.o), at(x.s))), text), " ")

        return G.named(G.bbox(F.flatten(F.transform(all_, corners))), path)

    one = F.array(leaf(*[G.point(p.x, p.y) for p in (a, open_end, b)]))
    return G.named(F.when(leaves == 2, two(leaves)).otherwise(one), drawn)


def arrow_head(arrow: Column, past: float = 12.0) -> Column:
    """The point ``past`` the last vertex of a line along its last stretch; the vertex itself where there is no stretch; null for an empty line."""
    head, before = F.get(arrow, F.size(arrow) - 1), F.get(arrow, F.size(arrow) - 2)
    dx, dy = F.coalesce(head.x - before.x, F.lit(0.0)), F.coalesce(head.y - before.y, F.lit(0.0))
    n = F.hypot(dx, dy)
    by = F.lit(past) / F.when(n == 0, F.lit(1.0)).otherwise(n)
    return F.when(F.size(arrow) > 0, G.point(head.x + dx * by, head.y + dy * by))
