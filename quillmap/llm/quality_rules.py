"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Everything is an expression of the JVM over one row: no shuffle, no Python. Counts of words, symbols, stop words and lines
come first, then each rule of ``RULES`` becomes one integer comparison, and ``kept`` is their conjunction.

Repeated three-word windows are found inside the row. Each window becomes one long: 40 bits of its hash, 24 bits of its
place. A primitive sort brings equal windows together, and neighbours are compared word by word. Where a neighbour with
the same bits has other words, or the text has 2^24 words or more, the row takes the exact path, which sorts the windows
themselves. So the count is exact for every text.

Edge cases: null and empty texts have no words, fail the base and are not kept; a row per input row, repeated or not; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap.llm.runtime import SPACES, narrow

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for was on are as with be this have from or by an not at but which "
    "der die und den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass "
    "le la les de et un une du des est que qui dans en pour pas sur au avec ce il elle plus par ne se "
    "el los las y que en un una por con no su para es al lo como del se mas pero sus"
).split()


@dataclass(frozen=True)
class Rule:
    """``low/1000 <= part / whole <= high/1000``; a whole of 0 passes. Counts compare as integers."""

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None


#: The threshold table.
RULES = (
    Rule("mean word length", "word_chars", "n_words", 2_000, 12_000),
    Rule("symbols to words", "n_symbols", "n_words", None, 300),
    Rule("shouted or barred words", "n_marked_words", "n_words", None, 500),
    Rule("stop words to words", "n_stop_words", "n_words", 20, None),
    Rule("copied lines to lines", "n_dup_lines", "n_lines", None, 300),
    Rule("cut lines to lines", "n_cut_lines", "n_lines", None, 500),
)


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more; ``words`` is an array without nulls."""
    n = F.size(words)
    places = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    mask = (1 << 24) - 1

    def window(i: Column) -> list[Column]:
        return [F.get(words, i + k) for k in range(3)]

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.lit(mask)).cast("int")

    def covered(starts: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))

    keys = F.sort_array(F.transform(places, lambda i: F.xxhash64(*window(i)).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long"))))

    def alike(box: Column, x: Column, j: Column) -> Column:
        return F.coalesce(F.shiftright(x, 24) == F.shiftright(F.get(box, j), 24), F.lit(False))

    def repeated(box: Column) -> Column:
        return F.filter(box, lambda x, j: alike(box, x, j + 1) | alike(box, x, j - 1))

    def fast(hits: Column) -> Column:
        clash = F.exists(
            F.transform(hits, lambda x, j: F.struct(x.alias("x"), F.get(hits, j + 1).alias("y"))),
            lambda p: F.coalesce(
                (F.shiftright(p.x, 24) == F.shiftright(p.y, 24)) & ~F.reduce(F.array(*[F.get(words, place(p.x) + k) == F.get(words, place(p.y) + k) for k in range(3)]), F.lit(True), lambda a, b: a & b),
                F.lit(False),
            ),
        )
        return F.when(clash, slow()).otherwise(covered(F.transform(hits, place)))

    def slow() -> Column:
        rows = F.array_sort(F.transform(places, lambda i: F.struct(*[w.alias(f"w{k}") for k, w in enumerate(window(i))], i.alias("i"))))
        return F.reduce(F.array(rows), F.lit(0), lambda _, box: covered(F.transform(F.filter(box, lambda x, j: _same(x, F.get(box, j + 1)) | _same(x, F.get(box, j - 1))), lambda x: x.i)))

    quick = F.get(F.transform(F.transform(F.array(keys), repeated), fast), F.lit(0))
    return F.when(n < 4, F.lit(0)).when(n <= mask, quick).otherwise(slow()).cast("long")


def _same(x: Column, y: Column) -> Column:
    return F.coalesce((x.w0 == y.w0) & (x.w1 == y.w1) & (x.w2 == y.w2), F.lit(False))


def counts(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    """The counts that rules refer to, as longs; ``lines`` are those with a word."""
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.char_length(F.regexp_replace(text, SPACES, "")).cast("long"),
        "n_symbols": (F.octet_length(text) - F.octet_length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_cut_lines": F.size(F.filter(lines, lambda x: x.endswith("...") | x.endswith("…"))).cast("long"),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long"),
        "n_marked_words": F.size(F.filter(words, lambda w: w.endswith("!!") | (w == "|"))).cast("long"),
    }


def verdict(rules: tuple[Rule, ...]) -> Column:
    """The threshold table as one boolean expression."""
    held = F.lit(True)
    for r in rules:
        part, whole = F.col(r.part) * 1000, F.col(r.whole)
        held = held & (part >= whole * r.low if r.low is not None else F.lit(True)) & (part <= whole * r.high if r.high is not None else F.lit(True))
    return held


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` for every row."""
    text = F.col("text")
    rows = narrow(docs, id_col, text_col).select("doc_id", F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cut = rows.select("doc_id", "text", F.filter(F.split(text, SPACES), lambda w: w != "").alias("words"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    told = cut.select("doc_id", *[c.alias(k) for k, c in counts(text, F.col("words"), F.col("lines")).items()], repeated_words(F.col("words")).alias("n_repeat_words"))
    base = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return told.select("*", base.alias("base_failed"), (~base & verdict(rules)).alias("kept"))
