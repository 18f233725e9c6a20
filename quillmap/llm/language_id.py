"""Language identification: known words first, ever shorter character n-grams for the others.

Fit: of every language a sample of labelled documents, bounded by ``TRAIN_DOCS`` and chosen by a hash of the id, is counted in
Spark (words and character n-grams by language, map-side sums in the workers). All counts of the sample are the model, which is
broadcast; a language with fewer documents than the bound is learnt from all of them, so the rare ones are there too. Score:
each word adds its log frequency by language; a word that the model does not hold adds the mean log frequency of its longest
n-grams that the model holds, of 5 characters down to 1.

Only the text decides: id, source and label are not looked at when a text is scored.

Edge cases: null, empty and letterless texts give ``und`` with score 0; so does everything when no row is labelled; null
labels and null ids are not learnt from; texts are read whole; repeated rows score alike; ties go to the language first in
order; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.llm.runtime import id_crc, prepare, release
from quillmap.plans.storage import keep, small

#: Documents that each language is learnt from, about.
TRAIN_DOCS = 1_500
LONGEST = 5
#: Words that a worker remembers.
CACHE = 200_000
#: Words of evidence at most that the score is sharpened by.
SHARP = 30
_LETTERS = re.compile(r"[^\W\d_]+")


def letters(text: str) -> list[str]:
    """Runs of characters of category L, in lower case."""
    words = _LETTERS.findall(text.lower())
    if all(map(str.isalpha, words)):
        return words
    # the pattern takes superscripts, Roman numerals and other numbers that are no decimal digits too
    return [w for word in words for w in ("".join(c if c.isalpha() else " " for c in word).split() if not word.isalpha() else (word,))]


def grams(word: str, n: int) -> list[str]:
    w = f"\x02{word}\x03"
    return [w[k : k + n] for k in range(len(w) - n + 1)] if n > 1 else list(word)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words: Counter = Counter()
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words.update((lang, w) for w in letters(text or ""))
        parts: Counter = Counter()
        for (lang, w), n in words.items():
            for k in range(1, LONGEST + 1):
                for g in grams(w, k):
                    parts[lang, k, g] += n
        rows = [(lang, 0, w, n) for (lang, w), n in words.items()] + [(*key, n) for key, n in parts.items()]
        lang, size, item, n = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(size, pa.int32()), pa.array(item, pa.string()), pa.array(n, pa.int64())], names=["lang", "size", "item", "n"])


class Model:
    """Log frequencies of words and n-grams by language."""

    def __init__(self, rows: list[tuple[str, int, str, int]]):
        self.langs = sorted({r[0] for r in rows})
        at = {x: k for k, x in enumerate(self.langs)}
        self.rows, self.logs = [{} for _ in range(LONGEST + 1)], []
        for _, size, item, _ in rows:
            self.rows[size].setdefault(item, len(self.rows[size]))
        for known in self.rows:
            self.logs.append(np.full((len(known), len(self.langs)), 0.3))
        for lang, size, item, n in rows:
            self.logs[size][self.rows[size][item], at[lang]] += n
        self.logs = [np.log(t / t.sum(axis=0)) for t in self.logs]

    def lists(self) -> list[dict[str, list[float]]]:
        """The tables as Python lists, which are faster for single words than arrays."""
        return [dict(zip(rows, logs.tolist(), strict=True)) for rows, logs in zip(self.rows, self.logs, strict=True)]


def of(tables: list[dict[str, list[float]]], word: str, langs: int) -> list[float]:
    """The word's log frequencies; of an unseen word, the mean over its longest n-grams that are known."""
    v = tables[0].get(word)
    if v is not None:
        return v
    marked, n = f"\x02{word}\x03", LONGEST
    while n:
        text, known = marked if n > 1 else word, tables[n]
        found = [x for k in range(len(text) - n + 1) if (x := known.get(text[k : k + n])) is not None]
        if found:
            return [sum(x) / len(found) for x in zip(*found, strict=True)]
        n -= 1
    return [0.0] * langs


class Scorer:
    def __init__(self, model: Model):
        self.model, self.tables, self.at, self.rows = model, model.lists(), {}, np.zeros((1024, len(model.langs)))

    def total(self, words: list[str]) -> np.ndarray:
        if len(self.at) > CACHE:
            self.at.clear()
        out = np.zeros(len(self.model.langs))
        for k in range(0, len(words), 50_000):
            some = words[k : k + 50_000]
            new = [w for w in set(some) if w not in self.at]
            if new:
                n = len(self.at)
                while n + len(new) > len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                found = np.array([of(self.tables, w, len(out)) for w in new])
                self.rows[n : n + len(new)] = found - found.max(axis=1, keepdims=True)
                self.at.update(zip(new, range(n, n + len(new)), strict=True))
            out += self.rows[np.fromiter(map(self.at.__getitem__, some), np.int64, len(some))].sum(axis=0)
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        words = letters(text or "")
        if not words or not self.model.langs:
            return "und", 0.0
        total = self.total(words)
        mean = total * (min(len(words), SHARP) / len(words))
        p = np.exp(mean - mean.max())
        best = int(np.argmax(total))
        return self.model.langs[best], float(p[best] / p.sum())


def fit(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = TRAIN_DOCS) -> Model:
    """A model from at most about ``most`` of each language's rows for which ``learn`` (a condition) holds."""
    prepare(docs.sparkSession)
    lang = F.col(lang_col).cast("string")
    rows = docs.where(learn & lang.isNotNull() & F.col(id_col).isNotNull())
    parts = rows.groupBy(lang.alias("lang")).agg(F.ceil(F.count(F.lit(1)) / most).alias("parts"))
    parts = keep(parts, "languages")
    rows = rows.select(lang.alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col).cast("long"), F.lit(11)).alias("h"))
    taken = rows.join(small(parts), "lang").where(F.pmod("h", "parts") == 0)
    counts = taken.select("lang", "text").mapInArrow(_count, "lang string, size int, item string, n long")
    counts = counts.groupBy("lang", "size", "item").agg(F.sum("n").alias("n"))
    found = counts.toArrow()  # counts of a sample that is bounded for each language
    return Model(list(zip(*(found.column(c).to_pylist() for c in ("lang", "size", "item", "n")), strict=True)))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *more) -> DataFrame:
    """``doc_id``, the columns ``more``, ``lang_pred`` and ``score`` for every row."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the words and n-grams of TRAIN_DOCS documents of each language
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *more, F.col(text_col).cast("string").alias("text"))
    schema = rows.drop("text").schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            found = [scorer.predict(t) for t in b.column(b.num_columns - 1).to_pylist()]
            cols = [*b.columns[:-1], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)
        del scorer
        release()

    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: fit on three quarters of the labelled rows, predicted for all."""
    out = F.coalesce(id_crc(F.col(id_col)) % 4 == 2, F.lit(False))
    model = fit(docs, ~out, id_col, text_col, lang_col)
    return predict(docs, model, id_col, text_col, out.alias("held_out"))
