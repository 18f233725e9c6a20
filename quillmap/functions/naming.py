"""Categories, display names and icons from the words of a plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The category of the first line with a word of the name wins; the words of a tuple must all be there.
CATEGORIES = (
    ("circulation", ("CIRCULATION", "CORRIDOR")),
    ("study", ("PIAZZA",)),
    ("open", ("COLLAB", "PORCH", "FLEXIBLE", "TERRACE", ("OPEN", "OFFICE"))),
    ("lab", ("LAB", "MRI")),
    ("classroom", ("LECTURE", "CLASSROOM", "AUDITORIUM")),
    ("focus", ("FOCUS", "BOOTH", "PHONE")),
    ("meeting", ("HUDDLE", "MEETING", "PROJECT", "CONFERENCE")),
    ("amenity", ("KITCHEN", "LOUNGE", "LACTATION", "MEDITATION", "CAFE", ("GREEN", "ROOM"))),
    ("copy", ("PRINTER", "COPY")),
    ("service", ("HELP", "STORAGE", "SHIPPING", "DAS", "RECEPTION", "MECH", "ELEC", "FACILITY")),
    ("study", ("STUDY", "STUDENT", "HOURS")),
)
OTHERWISE = "office"
# Spellings of display names, and the names that get the word "Room".
ACRONYMS = {"It": "IT", "Hci": "HCI", "Das": "DAS", "Mri": "MRI", "Ta": "TA", "Erso": "ERSO"}
TITLES = {
    "Faculty Office": "Office",
    "Social Kitchen/Working Lounge": "Social Kitchen / Working Lounge",
    "Piazza Informal Collab": "Piazza – Informal Collab",
    "Project Rm.": "Project Room",
    "Phone Rm.": "Phone Room",
    "Group Study Large": "Large Group Study",
    "General Lab Research": "General Research Lab",
}
ROOMS = ("Focus", "Huddle", "Small Meeting", "Medium Meeting", "Large Meeting", "Extra Large Meeting", "Meeting", "Lactation", "Meditation", "Green")


def _lookup(value: Column, names: dict[str, str]) -> Column:
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(known, value), value)


def category(name: Column, number: Column) -> Column:
    """The category of a plan name; numbers with ``CORR`` are circulation, and names without a known word are offices."""
    words = F.split(F.trim(F.translate(F.upper(name), "/-", "  ")), r"\s+")

    def has(group: tuple) -> Column:
        out = F.arrays_overlap(words, F.array(*[F.lit(w) for w in group if isinstance(w, str)]))
        for needed in group:
            if isinstance(needed, tuple):
                out = out | (F.size(F.array_except(F.array(*map(F.lit, needed)), words)) == 0)
        return out

    found = F.when(F.contains(F.upper(number), F.lit("CORR")), F.lit(CATEGORIES[0][0]))
    for kind, group in CATEGORIES:
        found = found.when(has(group), F.lit(kind))
    return found.otherwise(F.lit(OTHERWISE))


def display_name(name: Column, number: Column) -> Column:
    """Runs of letters capitalised, acronyms and titles put right, ``Room`` added where listed, then the number."""
    runs = F.regexp_extract_all(name, F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0))
    title = _lookup(F.array_join(F.transform(runs, lambda r: _lookup(F.initcap(r), ACRONYMS)), ""), TITLES)
    full = F.when(title.isin(*ROOMS), F.concat(title, F.lit(" Room"))).when(title == "", F.lit("Room")).otherwise(title)
    return F.concat_ws(" ", full, number)


def icon(tags: Column, icons: dict[str, str], box: Column, large: tuple[str, ...] = ("stairs", "printer"), width: float = 32.0, height: float = 48.0) -> Column:
    """The icon of the first tag that has one; icons in ``large`` need a box of the size, or there is none."""
    known = F.create_map(*[F.lit(x) for pair in icons.items() for x in pair])
    first = F.get(F.filter(F.transform(tags, lambda t: F.try_element_at(known, t)), lambda t: t.isNotNull()), F.lit(0))
    return F.when(~first.isin(*large) | ((box.width >= width) & (box.height >= height)), first)
