"""License scans against a plain reading of templates as regular expressions."""

import random
import re

import pytest

from quillmap.llm import license_scan as L

SCHEMA = "doc_id long, text string, labels string, words string, score string, matches string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NOTICE = "This Work is licensed under the GNU General Public License, version 3."
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
ENDORSE = "\n3. Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def as_regex(parts):
    out = ""
    for p in parts:
        out += re.escape(p.decode()) + " " if isinstance(p, bytes) else f"(?:[^ ]+ ){{{p[0]},{p[1]}}}" if isinstance(p, tuple) else f"(?:{as_regex(p)})?"
    return out


def brute(text):
    w = words(text)
    joined = " " + " ".join(w) + " "
    at = [(i, label) for p, label in L.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    more = {label for label, t in L.TEMPLATES if re.search(" " + as_regex(L.parsed(t)), joined)}
    base = {label for _, label in at}
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if more else 0.5 if at else 0.0


TEXTS = [
    None, "", " \n", "cc by", "CC-BY cc by by cc by", "Licensed under CC BY-NC 4.0.", "licensed under a Creative Commons CC BY 4.0", "ccby cc x by", "the mit license", "Released under the MIT License.",
    NOTICE, NOTICE + " Apache License", "Licensed under the terms of the Apache License, Version 2.0", "Licensed under the Apache License, Version 1.1", BSD, BSD + ENDORSE.format("the Example Co"),
    BSD + ENDORSE.format(" ".join("abcdefghijklmnopqrstuvwxyz")), BSD + " This software is provided by the authors \"AS IS\"", BSD.replace("retain", "keep") + ENDORSE.format("x"), "ÉCC BY é cc by ÀMIT LICENSE",
    "word " * 50_000 + NOTICE + " word" * 50_000,
]


def test_scan_equals_regular_expressions(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, NOTICE), (3, "cc by")]
    docs = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA).repartition(3)
    found = L.scan(docs)
    got = sorted((str(r.doc_id), tuple(r)[1:8]) for r in found.collect())
    assert got == sorted((str(i), brute(t)) for i, t in rows)
    assert L.scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_table_equals_regular_expressions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted(tuple(r)[:8] for r in L.scan(docs).collect()) == sorted((r.doc_id, *brute(r.text)) for r in docs.collect())


def test_spans():
    t = L.Template("x", "[[the]] a {{0-2}} b [[c [[d]]]] e")
    assert t.spans(b"the a b e a x y b c d e z a x y w b e".split()) == [(0, 3), (4, 10)]
    assert t.spans(b"a a a b e".split()) == [(0, 4)]
    for bad in ("a [[ b", "a ]] b", "{{1-2}}", "[[a]]"):
        with pytest.raises(ValueError):
            L.Template("x", bad)


def test_numbering_may_start_anew(monkeypatch):
    monkeypatch.setattr(L, "MOST_SETS", 6)
    rng = random.Random(4)
    parts = "a {{0-3}} b [[a]] c"
    for _ in range(300):
        w = rng.choices("abcd", k=30)
        found = L.Template("x", parts).spans([x.encode() for x in w])
        assert bool(found) == bool(re.search(" " + as_regex(L.parsed(parts)), " " + " ".join(w) + " "))
        assert all(re.fullmatch(as_regex(L.parsed(parts)), " ".join(w[a : b + 1]) + " ") for a, b in found)
