"""Names and rooms out of directory pages and annotation blocks, in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap.functions.geometry import named
from quillmap.functions.text import plain_text, tidy_name

# The patterns of rooms, contact lines, notes and name words.
ROOM = r"([A-Z]?\d{3,4}[A-Z]?)"
CONTACT = r"(?is)^(?:<strong>.*?</strong>)?\s*(?:<br\s*/?>)?\s*(.*?)(?=<br\s*/?>\s*<strong>|$)"
SEPARATORS = r"\s*(?:,|;|/|&|\+\s*\d*|\band\b)\s*"
NOTE = r"\([^)]*\)|\[[^\]]*\]|#\S+"
ROOM_NUMBER = r"\b[A-Z]?\d{3,4}[A-Z]?\b|\b\d+-[A-Z]+\b"
NAME_WORD = r"""^(?:[A-Z][A-Za-z'.-]*|"[A-Z][A-Za-z]*"|[a-z]{2,3})$"""


def building_room(line: Column, building: str) -> Column:
    """The room that a contact line gives in a building, before its name or after it, in upper case; null where it gives none."""
    name = rf"\Q{building}\E"

    def room(v: Column) -> Column:
        before = F.regexp_extract(v, rf"(?i)\b{ROOM}\s+{name}\b", 1)
        after = F.regexp_extract(v, rf"(?i)\b{name}(?:\s+Building)?(?:\s*,)?\s*(?:Room|Rm\.?|#)?\s*{ROOM}\b", 1)
        return F.upper(F.coalesce(F.nullif(before, F.lit("")), F.nullif(after, F.lit(""))))

    return named(line, room)


def entries(pages: DataFrame, page_id: str, html: str, link: str, building: str) -> DataFrame:
    """``page_id, pos, name, room`` of every entry: a heading that links to ``link``, then a paragraph with the contact line."""
    pattern = rf'(?is)<h3>.*?<a\s+href="[^"]*\Q{link}\E[^"]*"[^>]*>([^<]+)</a>.*?</h3>\s*<p>(.*?)</p>'
    e = pages.select(page_id, F.posexplode(F.regexp_extract_all(html, F.lit(pattern), F.lit(0))).alias("pos", "entry"))
    contact = plain_text(F.regexp_extract(F.regexp_extract("entry", pattern, 2), CONTACT, 1))
    return e.select(page_id, "pos", tidy_name(plain_text(F.regexp_extract("entry", pattern, 1))).alias("name"), building_room(contact, building).alias("room"))


def people_of_rooms(found: DataFrame, page_id: str) -> DataFrame:
    """``room, names``: the distinct names of each room in the order of the pages. No entries at all stop the run."""
    if found.limit(1).count() == 0:
        raise ValueError("no entries found; the pages may have changed their layout")
    lists = found.where("room is not null and name <> ''").groupBy("room").agg(F.array_sort(F.collect_list(F.struct(page_id, "pos", "name"))).alias("all"))
    return lists.select("room", F.array_distinct(F.col("all.name")).alias("names"))


def stacked(lines: Column, gap: float) -> Column:
    """``ARRAY<ARRAY<STRING>>``: annotation lines (``down, a0, a1, size, text``) of one room as blocks, in reading order.

    A line joins the first earlier block whose last line is at most ``gap`` text sizes above it and overlaps it, with a slack of 2.
    """
    line_type = "struct<down:double,a0:double,a1:double,size:double,text:string>"

    def add(blocks: Column, line: Column) -> Column:
        def takes(b: Column, i: Column) -> Column:
            last = F.element_at(b, -1)
            step = line.down - last.down
            return F.when((step >= 0) & (step <= F.greatest(line["size"], last["size"]) * gap) & (line.a0 <= last.a1 + 2) & (line.a1 >= last.a0 - 2), i)

        first = F.array_min(F.transform(blocks, takes))
        more = F.transform(blocks, lambda b, i: F.when(i == first, F.concat(b, F.array(line))).otherwise(b))
        return F.when(first.isNull(), F.concat(blocks, F.array(F.array(line)))).otherwise(more)

    blocks = F.reduce(F.array_sort(lines.cast(f"array<{line_type}>")), F.array().cast(f"array<array<{line_type}>>"), add)
    ordered = F.array_sort(F.transform(blocks, lambda b, i: F.struct(F.get(b, F.lit(0)).down.alias("d"), F.get(b, F.lit(0)).a0.alias("a"), i.alias("i"), F.transform(b, lambda x: x.text).alias("texts"))))
    return F.transform(ordered, lambda b: b.texts)


_STRINGS = "array<string>"


def block_names(lines: Column, roles: frozenset[str]) -> Column:
    """``STRUCT<names, dropped>`` of an annotation block; ``roles`` are the lower-case words that are no names.

    Notes go; pieces between separators with a room number are dropped; role words at either end of a line go, and lines of
    roles alone; lines of a piece join to names of two to four words. A single word left beside a dropped role is no name.
    """
    titles = F.array(*[F.lit(r) for r in sorted(roles)]) if roles else F.array().cast(_STRINGS)
    none = F.array().cast(_STRINGS)

    def titled(w: Column) -> Column:
        return F.array_contains(titles, F.regexp_replace(F.lower(w), "^[.,]+|[.,]+$", ""))

    def bare(line: Column) -> Column:
        """The line without titles at its ends; null if nothing is left, or titles stand between other words."""

        def cut(k: Column) -> Column:
            def between(own: Column) -> Column:
                first, last, n = F.get(own, F.lit(0)), F.try_element_at(own, F.lit(-1)), F.size(own)
                usable = (n > 0) & (n == last - first + 1) & ~((n == 1) & (last < F.size(k) - 1))
                return F.when(n == F.size(k), line).when(usable, F.array_join(F.slice(k, first + 1, n), " "))

            return named(F.filter(F.transform(k, lambda w, i: F.when(~titled(w), i)), lambda i: i.isNotNull()), between)

        return named(F.split(line, " "), cut)

    def grown(groups: Column, line: Column) -> Column:
        """``groups`` of words with one line more: in the last group while that is short, else in a group of its own."""

        def put(k: Column) -> Column:
            joins = (F.size(groups) > 0) & ((F.size(k.last) < 2) | ((F.size(k.own) == 1) & (F.size(k.last) < 3)))
            return F.when(joins, F.concat(F.slice(groups, 1, F.greatest(F.size(groups) - 1, F.lit(0))), F.array(F.concat(k.last, k.own)))).otherwise(F.concat(groups, F.array(k.own)))

        return named(F.struct(F.split(line, " ").alias("own"), F.try_element_at(groups, F.lit(-1)).alias("last")), put)

    def reads_well(words: Column) -> Column:
        return F.size(words).between(1, 4) & ~F.exists(words, titled) & F.exists(words, lambda w: F.rlike(w, F.lit('^(?:\\p{Lu}|")'))) & F.forall(words, lambda w: F.rlike(w, F.lit(NAME_WORD)))

    def sorted_out(rows: Column) -> Column:
        """``rows`` holds each line with what is left of it."""
        lost = F.exists(rows, lambda r: r.left.isNull())
        groups = F.reduce(F.transform(F.filter(rows, lambda r: r.left.isNotNull()), lambda r: r.left), F.array().cast("array<array<string>>"), grown)
        judged = F.transform(groups, lambda g: F.struct(F.array_join(g, " ").alias("text"), (reads_well(g) & ~(lost & (F.size(g) == 1))).alias("good")))

        def parted(t: Column) -> Column:
            gone = F.transform(F.filter(rows, lambda r: r.left.isNull()), lambda r: r.line)
            return F.struct(F.transform(F.filter(t, lambda x: x.good), lambda x: x.text).alias("names"), F.concat(gone, F.transform(F.filter(t, lambda x: ~x.good), lambda x: x.text)).alias("dropped"))

        def unless_numbered(whole: Column) -> Column:
            return F.when(F.rlike(whole, F.lit(ROOM_NUMBER)), F.struct(none.alias("names"), F.array(whole).alias("dropped"))).otherwise(named(judged, parted))

        return named(F.array_join(F.transform(rows, lambda r: r.line), " "), unless_numbered)

    def piece(text: Column) -> Column:
        tidy = F.filter(F.transform(F.split(text, "\n"), lambda t: F.regexp_replace(F.regexp_replace(t, r"\s+", " "), "^[ ,;:]+|[ ,;:]+$", "")), lambda t: t != "")
        return named(F.transform(tidy, lambda t: F.struct(t.alias("line"), bare(t).alias("left"))), sorted_out)

    text = F.translate(F.regexp_replace(F.array_join(lines, "\n"), NOTE, " "), "’", "'")
    parts = F.transform(F.split(text, SEPARATORS), piece)
    return named(parts, lambda p: F.struct(F.flatten(F.transform(p, lambda x: x.names)).alias("names"), F.flatten(F.transform(p, lambda x: x.dropped)).alias("dropped")))
