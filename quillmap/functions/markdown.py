"""Markdown of dialogs as HTML, in Column expressions: lines are classed, folded into blocks, and each block is marked up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The line patterns and inline marks of the dialect.
HEADING = r"^(#{1,6})\s+(.+?)\s*#*\s*$"
BULLET = r"^\s*[-*+]\s+(.*)$"
NUMBERED = r"^\s*\d+[.)]\s+(.*)$"
RULE = r"^\s*(?:-{3,}|\*{3,}|_{3,})\s*$"
MARKS = (
    (r"\[([^\]]+)\]\(([^)\s]+)\)", '<a href="$2">$1</a>'),
    (r"\*\*(.+?)\*\*", "<strong>$1</strong>"),
    (r"(^|[^\w*])\*([^*\s][^*]*?)\*(?!\w)", "$1<em>$2</em>"),
    (r"(^|[^\w_])_([^_\s][^_]*?)_(?!\w)", "$1<em>$2</em>"),
)
_HOLE = "\u0000"
_BLOCK = "array<struct<kind:string,level:int,parts:array<string>>>"


def inline(text: Column) -> Column:
    """Links, bold and slanted text; code between backticks is kept from all other marks."""
    clean = F.replace(text, F.lit(_HOLE), F.lit(""))
    codes = F.regexp_extract_all(clean, F.lit("`([^`]+)`"), F.lit(1))
    out = F.regexp_replace(clean, "`[^`]+`", _HOLE)
    for pattern, to in MARKS:
        out = F.regexp_replace(out, pattern, to)
    shown = F.transform(codes, lambda c: F.concat(F.lit("<code>"), F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</code>")))
    return F.array_join(F.transform(F.split(out, _HOLE), lambda s, k: F.concat(s, F.coalesce(F.get(shown, k), F.lit("")))), "")


def _block(kind: Column, level: Column, part: Column) -> Column:
    return F.struct(kind.alias("kind"), level.cast("int").alias("level"), F.array(part).alias("parts"))


def _line(raw: Column) -> Column:
    kind = F.when(F.trim(raw) == "", "blank").when(F.rlike(raw, F.lit(HEADING)), "h").when(F.rlike(raw, F.lit(RULE)), "hr").when(F.rlike(raw, F.lit(BULLET)), "ul").when(F.rlike(raw, F.lit(NUMBERED)), "ol").otherwise("p")
    body = F.when(kind == "h", F.regexp_extract(raw, HEADING, 2)).when(kind == "ul", F.regexp_extract(raw, BULLET, 1)).when(kind == "ol", F.regexp_extract(raw, NUMBERED, 1)).otherwise(F.regexp_replace(raw, r"^\s+", ""))
    return _block(kind, F.length(F.regexp_extract(raw, HEADING, 1)), body)


def _fold(have: Column, line: Column) -> Column:
    last = F.element_at(have, -1)
    goes_on = (F.size(have) > 0) & (line.kind == "p") & last.kind.isin("p", "ul", "ol")
    longer = F.struct(last.kind.alias("kind"), last.level.alias("level"), F.concat(last.parts, line.parts).alias("parts"))
    return F.when(goes_on, F.concat(F.slice(have, 1, F.greatest(F.size(have) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(have, F.array(line)))


def rendered(source: Column) -> Column:
    """``STRUCT<title, html>``: the first heading of level 1 is the title, other headings go one level down.

    A plain line goes on the paragraph or list item before it. Null gives null, an empty text no title and empty HTML.
    """
    lines = F.transform(F.split(source, r"\r?\n"), lambda raw: _line(F.regexp_replace(raw, r"\s+$", "")))

    def shaped(blocks: Column) -> Column:
        at = F.array_position(F.transform(blocks, lambda b: (b.kind == "h") & (b.level == 1)), F.lit(True)) - 1
        title = F.get(blocks, F.when(at >= 0, at.cast("int"))).parts

        def kind(i: Column) -> Column:
            return F.coalesce(F.get(blocks, i).kind, F.lit("blank"))

        def html(b: Column, i: Column) -> Column:
            tag = F.concat(F.lit("h"), F.least(b.level + 1, F.lit(6)).cast("string"))
            item = F.array_join(F.transform(b.parts, inline), " ")
            opened = F.when(kind(i - 1) != b.kind, F.concat(F.lit("<"), b.kind, F.lit(">\n"))).otherwise("")
            closed = F.when(kind(i + 1) != b.kind, F.concat(F.lit("\n</"), b.kind, F.lit(">"))).otherwise("")
            heading = F.concat(F.lit("<"), tag, F.lit(">"), item, F.lit("</"), tag, F.lit(">"))
            return (
                F.when(b.kind == "hr", "<hr>").when((b.kind == "h") & (i != at), heading)
                .when(b.kind == "p", F.concat(F.lit("<p>"), inline(F.array_join(b.parts, " ")), F.lit("</p>")))
                .when(b.kind.isin("ul", "ol"), F.concat(opened, F.lit("<li>"), item, F.lit("</li>"), closed))
            )

        return F.struct(F.get(title, F.lit(0)).alias("title"), F.array_join(F.array_compact(F.transform(blocks, html)), "\n").alias("html"))

    return F.when(source.isNotNull(), F.get(F.transform(F.array(F.reduce(lines, F.array().cast(_BLOCK), _fold)), shaped), F.lit(0)))
