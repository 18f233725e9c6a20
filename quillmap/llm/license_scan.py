"""License scans by template-markup matching.

A template is wording with marks: ``[[...]]`` is an optional region (it may hold marks again), ``{{a-b}}`` a replaceable
region of a to b words. A template compiles into an automaton over words: a step takes the next word or, in a replaceable
region, any word. A text is accepted where all mandatory wording stands consecutively, word for word, with nothing between
but what the regions allow. The automaton becomes deterministic while it reads (sets of states are numbered when they first
come up), so a text is read once, whatever the regions allow; a reversed automaton reads back from an end to the first word.

Beside templates, fixed phrases are looked up word by word; they give the base labels.

Everything happens inside one pass over the rows: no shuffle, nothing is broadcast but the templates. Words are a-z (A-Z
lower-cased), digits and all characters beyond ASCII; a text without a template's longest mandatory run is not read by its
automaton.

Edge cases: null and empty texts have no words and no labels, score 0; texts are read whole, of any length; repeated rows
give equal results; bytes that are no UTF-8 are word characters; a null id stays null; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.llm.runtime import prepare

# The base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Wording of public licenses and of the notices that name them: label, template.
TEMPLATES = (
    ("apache-2.0", "licensed under [[the terms of]] the apache license version 2 0"),
    ("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by {{1-12}} as is"),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution [[3]] neither the name of {{1-20}} nor the names of {{0-2}} contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("cc-by-4.0", "licensed under [[a]] [[creative commons]] [[attribution]] cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under [[a]] [[creative commons]] cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under [[a]] [[creative commons]] cc by sa 4 0"),
    ("gpl-2.0", "[[this {{1-6}} is]] licensed under the gnu general public license version 2"),
    ("gpl-2.0", "under the terms of the gnu general public license as published by the free software foundation [[either]] version 2 of the license"),
    ("gpl-3.0", "[[this {{1-6}} is]] licensed under the gnu general public license version 3"),
    ("gpl-3.0", "under the terms of the gnu general public license as published by the free software foundation [[either]] version 3 of the license"),
    ("isc", "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[the software]] to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the {{1-4}} be held liable for any damages arising from the use of this software"),
)

#: Scores: an accepted template, only a base phrase, neither.
SCORES = (1.0, 0.5, 0.0)
#: Numbered sets of states of an automaton; beyond them numbering starts anew.
MOST_SETS = 20_000

_MARK = re.compile(r"\[\[|\]\]|\{\{(\d+)-(\d+)\}\}|[^\s\[\]{}]+")
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_PLAIN).split()


def parsed(template: str) -> list:
    """A list of words (bytes), pairs (least, most) of replaceable regions and lists (optional regions)."""
    stack: list[list] = [[]]
    for m in _MARK.finditer(template):
        if m[0] == "[[":
            stack.append([])
        elif m[0] == "]]":
            if len(stack) < 2:
                raise ValueError("]] without [[")
            inner = stack.pop()
            stack[-1].append(inner)
        elif m[1] is not None:
            stack[-1].append((int(m[1]), int(m[2])))
        else:
            stack[-1] += words_of(m[0].encode())
    if len(stack) > 1:
        raise ValueError("[[ without ]]")
    return stack[0]


def longest_run(parts: list) -> bytes:
    """The longest run of words that every accepted text holds."""
    runs: list[list[bytes]] = [[]]
    for p in parts:
        runs[-1].append(p) if isinstance(p, bytes) else runs.append([])
    return b" " + b" ".join(max(runs, key=lambda r: sum(map(len, r)))) + b" "


def mirrored(parts: list) -> list:
    return [mirrored(p) if isinstance(p, list) else p for p in reversed(parts)]


@dataclass
class Automaton:
    """States 0 .. n - 1; state 0 starts. ``anywhere`` lets a match begin at every word."""

    parts: list
    anywhere: bool
    on_word: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    on_any: list[int | None] = field(default_factory=lambda: [None])
    free: list[list[int]] = field(default_factory=lambda: [[]])

    def __post_init__(self):
        self.last = self._build(self.parts, 0)
        self.known = {w for moves in self.on_word for w in moves}
        self._forget()

    def _state(self) -> int:
        self.on_word.append({})
        self.on_any.append(None)
        self.free.append([])
        return len(self.free) - 1

    def _build(self, parts: list, at: int) -> int:
        for p in parts:
            if isinstance(p, bytes):
                after = self._state()
                self.on_word[at][p] = after
            elif isinstance(p, tuple):
                after = self._state()
                for k in range(p[1]):
                    if k >= p[0]:
                        self.free[at].append(after)
                    step = self._state()
                    self.on_any[at] = step
                    at = step
                self.free[at].append(after)
            else:
                inner, after = self._state(), self._state()
                self.free[at] += [inner, after]
                self.free[self._build(p, inner)].append(after)
            at = after
        return at

    def _closed(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def _forget(self) -> None:
        """Set 0 is always the one that reading starts from."""
        self.sets: list[frozenset[int]] = []
        self.number: dict[frozenset[int], int] = {}
        self.moves: list[dict[bytes | None, int]] = []
        self.accepts: list[bool] = []
        self._named(self._closed({0}))

    def _named(self, states: frozenset[int]) -> int:
        if states not in self.number:
            self.number[states] = len(self.sets)
            self.sets.append(states)
            self.moves.append({})
            self.accepts.append(self.last in states)
        return self.number[states]

    def step(self, at: int, word: bytes) -> int:
        """The number of the set of states after ``word``."""
        key = word if word in self.known else None
        after = self.moves[at].get(key)
        if after is None:
            states = {self.on_word[s][key] for s in self.sets[at] if key in self.on_word[s]}
            states |= {self.on_any[s] for s in self.sets[at] if self.on_any[s] is not None}
            found = self._closed(states | {0} if self.anywhere else states)
            if len(self.sets) >= MOST_SETS and found not in self.number:
                self._forget()
                return self._named(found)
            after = self.moves[at][key] = self._named(found)
        return after


class Template:
    """A label and the automata of its wording, forwards from any word and backwards from an end."""

    def __init__(self, label: str, wording: str):
        self.label, parts = label, parsed(wording)
        self.run = longest_run(parts)
        if not self.run.strip():
            raise ValueError(f"template without mandatory wording: {label}")
        self.ahead, self.back = Automaton(parts, True), Automaton(mirrored(parts), False)

    def spans(self, words: list[bytes]) -> list[tuple[int, int]]:
        """First and last word of each match, from left to right: each ends as early as it can, begins as early as it can after the one before."""
        found, at, begin, auto = [], 0, 0, self.ahead
        for k, word in enumerate(words):
            at = auto.step(at, word)
            if auto.accepts[at]:
                found.append((self._first(words, begin, k), k))
                begin = k + 1
                at = 0
        return found

    def _first(self, words: list[bytes], begin: int, end: int) -> int:
        at, first, auto = 0, end, self.back
        for k in range(end, begin - 1, -1):
            at = auto.step(at, words[k])
            if not auto.sets[at]:
                break
            if auto.accepts[at]:
                first = k
        return first


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which ``phrase`` starts; both are words joined by single spaces, with one before and after."""
    out, at, word, seen = [], joined.find(phrase), 0, 0
    while at >= 0:
        word += joined.count(b" ", seen, at)
        seen = at
        out.append(word)
        at = joined.find(phrase, at + 1)
    return out


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...], phrases: dict[str, str]):
        self.templates = [Template(*t) for t in templates]
        self.phrases = [(b" " + b" ".join(words_of(p.encode())) + b" ", label) for p, label in phrases.items()]

    def scan(self, text: bytes | None) -> tuple:
        words = words_of(text)
        joined = b" " + b" ".join(words) + b" "
        base = [(places(joined, p), label) for p, label in self.phrases]
        starts = [k for found, _ in base for k in found]
        matches = [{"label": t.label, "first": a, "last": b} for t in self.templates if t.run in joined for a, b in t.spans(words)]
        own, others = {label for found, label in base if found}, {m["label"] for m in matches}
        score = SCORES[0] if matches else SCORES[1] if starts else SCORES[2]
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | others)), score, matches


_KIND = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,first:long,last:long>>"
_ARROW = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())])))
_NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """One row for each row: counts and places of phrases, labels, score, and ``matches``, the spans that templates accept."""
    Scanner(templates, phrases)  # a faulty template is told here, not in a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        for b in batches:
            found = list(zip(*[scanner.scan(t.as_py()) for t in b.column(1)], strict=True)) or [()] * len(_ARROW)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(found, _ARROW, strict=True)]], names=_NAMES)

    prepare(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, _KIND)
