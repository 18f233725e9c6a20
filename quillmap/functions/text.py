"""Text functions as Column expressions; none of them runs Python on the workers."""

from __future__ import annotations

import json
import unicodedata
from html import entities

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmap.functions.geometry import named


def _accents() -> tuple[str, str]:
    """Letters that decompose into one ASCII letter and marks, and that letter: by rule, over the Latin blocks."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = [c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)]
        if len(base) == 1 and base[0].isascii() and base[0].isalpha():
            pairs.append((chr(code), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _accents()
#: Named character references without their ampersand, from the standard library's table; old ones stand without a semicolon too.
ENTITIES = {name: text for name, text in entities.html5.items()}
_LONGEST = max(len(n) for n in ENTITIES if not n.endswith(";"))


def name_key(name: Column) -> Column:
    """Letters only, accents off, lower case; letters that do not decompose vanish."""
    return F.lower(F.regexp_replace(F.translate(name, _FROM, _TO), "[^A-Za-z]", ""))


def almost_same(a: Column, b: Column) -> Column:
    """At most one letter added, dropped or changed."""
    return F.levenshtein(a, b, 1) >= 0


def _words(name: Column) -> Column:
    return F.split(F.trim(name), r"\s+")


def same_person(a: Column, b: Column) -> Column:
    """Equal or nearly equal keys; one surname and initial; one first name and surnames that agree in six letters."""
    wa, wb = _words(a), _words(b)
    first_a, first_b = name_key(F.get(wa, F.lit(0))), name_key(F.get(wb, F.lit(0)))
    last_a, last_b = name_key(F.element_at(wa, -1)), name_key(F.element_at(wb, -1))
    parts = (F.size(wa) >= 2) & (F.size(wb) >= 2)
    initial = (last_a == last_b) & (F.substring(first_a, 1, 1) == F.substring(first_b, 1, 1))
    prefix = (first_a == first_b) & (F.length(last_a) >= 6) & (F.substring(last_a, 1, 6) == F.substring(last_b, 1, 6))
    return almost_same(name_key(a), name_key(b)) | (parts & (initial | prefix))


def name_lines(name: Column) -> Column:
    """A name as one or two lines, cut at the last space."""
    cut = F.regexp_extract(name, r"^(.*) ([^ ]*)$", 1)
    return F.when(F.instr(name, " ") > 0, F.array(cut, F.substring_index(name, " ", -1))).otherwise(F.array(name))


def wrap_words(text: Column, most: int) -> Column:
    """Greedy lines of at most ``most`` characters; a longer word stands alone."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    # As many characters as fit before a space or the end, else one word alone: one pass, whatever the length.
    return F.regexp_extract_all(flat, F.lit(r"(?s)(.{1,%d}|[^ ]+)(?: |$)" % most), F.lit(1))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescaped(text: Column) -> Column:
    """Character references resolved: decimal, hexadecimal and named ones, old names without their semicolon too.

    Numbers beyond Unicode and those of surrogates and of NUL become U+FFFD; what is no reference stays.
    """
    # What the numbers 128 to 159 stand for on the web.
    web = bytes(range(128, 160)).decode("cp1252", "replace")
    # One literal, as the optimizer works it out beforehand.
    names = F.from_json(F.lit(json.dumps(ENTITIES)), "map<string,string>")

    def letter(n: Column) -> Column:
        valid = (n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF)
        utf32 = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        own = F.substring(F.lit(web), n.cast("int") - 127, 1)
        return F.when(n.between(128, 159) & (own != "\ufffd"), own).when(valid, utf32).otherwise("\ufffd")

    def resolved(part: Column, names: Column) -> Column:
        def known(name: Column) -> Column:
            return F.try_element_at(names, name)

        dec = F.regexp_extract(part, r"^#0*(\d{1,12})", 1)
        hexa = F.regexp_extract(part, r"^#[xX]0*([0-9a-fA-F]{1,12})", 1)
        rest = F.regexp_replace(part, r"^#(?:[xX][0-9a-fA-F]+|\d+);?", "")
        full = F.regexp_extract(part, r"^([A-Za-z][A-Za-z0-9]*;)", 1)
        short = F.regexp_extract(part, r"^([A-Za-z][A-Za-z0-9]{0,%d})" % (_LONGEST - 1), 1)
        cuts = F.transform(F.sequence(F.length(short), F.lit(1), F.lit(-1)), lambda k: F.substring(short, 1, k))
        old = F.get(F.filter(cuts, lambda c: known(c).isNotNull()), F.lit(0))
        whole = F.concat(known(full), F.substr(part, F.length(full) + 1))
        begun = F.concat(known(old), F.substr(part, F.length(old) + 1))
        named = F.coalesce(F.when(full != "", whole), F.when(F.length(short) > 1, begun), F.concat(F.lit("&"), part))
        return F.when(dec != "", F.concat(letter(dec.cast("long")), rest)).when(hexa != "", F.concat(letter(F.conv(hexa, 16, 10).cast("long")), rest)).otherwise(named)

    parts = F.split(text, "&")
    return named(names, lambda n: F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(resolved(p, n))), ""))


def plain_text(fragment: Column) -> Column:
    """Tags out, entities resolved, white space squeezed."""
    text = F.regexp_replace(fragment, "<[^>]*>", " ")
    text = named(text, lambda t: F.when(F.contains(t, F.lit("&")), unescaped(t)).otherwise(t))
    return F.trim(F.regexp_replace(text, r"[\s\x0b\x1c-\x1f\x85\p{Z}]+", " "))


def tidy_name(name: Column) -> Column:
    """A name written as "Last, First" turned round; other names as they are, trimmed."""

    def turned(v: Column) -> Column:
        last, first = F.trim(F.substring_index(v, ",", 1)), F.trim(F.regexp_extract(v, r"^[^,]*,(.*)$", 1))
        return F.when((last != "") & (first != ""), F.concat_ws(" ", first, last)).otherwise(F.trim(v))

    return named(name, turned)


def slug(text: Column) -> Column:
    """Lower case, with runs of white space and apostrophes as hyphens."""
    return F.regexp_replace(F.lower(text), "[\\s'’]+", "-")


def space_number(space_id: Column) -> Column:
    """The number in an id like ``4-4123b``, in upper case; null where there is none."""
    return F.nullif(F.upper(F.regexp_extract(space_id, r"^[^-]+-([a-z]?\d+[a-z]?)$", 1)), F.lit(""))


def wing(number: Column) -> Column:
    """Northeast for a second digit of 1 or 2, Southwest for 3 or 4; null for short numbers and those of a basement."""
    digit = F.substring(F.regexp_replace(number, "[^0-9]", ""), 2, 1)
    long = (F.length(F.regexp_replace(number, "[^0-9]", "")) >= 4) & ~F.startswith(number, F.lit("B"))
    return F.when(long & digit.isin("1", "2"), "Northeast").when(long & digit.isin("3", "4"), "Southwest")


def half_up(v: Column, digits: int = 1) -> Column:
    """Rounded with halves toward plus infinity."""
    p = float(10**digits)
    return F.floor(v * p + 0.5) / p


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    """``#rrggbb`` of three shares from 0 to 1."""
    return F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(F.round(c * 255).cast("int"))), 2, "0") for c in (r, g, b)])


def correction_line(name: Column, floor: Column, text: Column) -> Column:
    return F.concat_ws(" · ", F.nullif(name, F.lit("")), F.nullif(floor, F.lit("")), F.nullif(text, F.lit("")))
