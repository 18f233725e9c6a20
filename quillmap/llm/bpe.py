"""BPE encoding and decoding with forced-boundary splitting.

A table of 256 x 256 byte pairs marks which pairs occur inside some vocabulary token. Where two neighbouring bytes of a
text form a pair that never does, no merge can reach across: a certain cut. White space is such a place throughout. Texts
are split at white space, then into the tokenizer's words, then at the table's cuts; the fragments are encoded on their
own, each at most once while a worker remembers it, and the results are concatenated. A fragment that does not end a word
is encoded without the word-end mark; for that the vocabulary's marked tokens are renamed so that the mark is part of the
last byte.

Kept as the tokenizers library has it: its own normalisers compose characters and lower their case and its own splitter finds
the words, so both sides read one Unicode table; only text of ASCII and of those Latin letters for which Python has been
asked and says the same goes the faster way through Python. Special tokens are found in the raw text; decoding is by the vocabulary's own rule (tokens joined by one space
where it names no decoder). Vocabularies of other rules, added tokens among them, are refused.

Edge cases: null counts as empty and gives no ids; texts of any length are encoded whole; rows are independent, so repeats
and ties need no rule; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.llm.runtime import prepare, release

#: White-space pieces, and words, that a worker remembers before it starts anew.
CACHE = 120_000
_SPLIT = re.compile("[\t-\r \x85\xa0  -     　]+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")


def byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + rest.index(b)) for b in range(256)]


class ForcedBoundaryBpe:
    """An encoder and decoder for a tokenizers file of this kind: byte-level BPE with word-end marks."""

    def __init__(self, spec: str, special_as_text: bool = False, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

        spec = json.loads(spec)
        model, self.mark = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        parts = {p["type"]: p for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [spec["pre_tokenizer"] or {}]) if p}
        norms = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [spec["normalizer"]] if spec.get("normalizer") else [])]
        if model["type"] != "BPE" or "ByteLevel" not in parts or "Split" not in parts or set(norms) - {"NFC", "Replace", "Lowercase"} or spec.get("decoder") or spec.get("post_processor") or not self.mark:
            raise ValueError("not a vocabulary of the supported kind")
        if any(t.get(flag) for t in spec["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens are found as they stand in the raw text, with no other rule")
        pattern = "\\n|" + parts["Split"]["pattern"]["Regex"]
        self.easy_words, self.splitter = regex.compile(pattern), pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        kinds = {"NFC": normalizers.NFC, "Lowercase": normalizers.Lowercase}
        self.lower = "Lowercase" in norms
        self.normaliser = normalizers.Sequence([kinds[n]() for n in norms if n in kinds])
        lower = str.lower if self.lower else str
        same = [c for c in map(chr, range(0x80, 0x250)) if len(lower(c)) == 1 and self.normaliser.normalize_str(c) == lower(c) and self.easy_words.findall(f"a{c}1") == [w for w, _ in self.splitter.pre_tokenize_str(f"a{c}1")]]
        self.beyond = re.compile("[^\\x00-\\x7f" + "".join(map(re.escape, same)) + "]")
        chars = byte_chars()
        byte_of = {c: b for b, c in enumerate(chars)}
        marked = [chr(0xE000 + b) for b in range(256)]

        def renamed(token: str) -> str:
            end = self.mark and token.endswith(self.mark) and len(token) > len(self.mark)
            if not end:
                return token
            body = token[: -len(self.mark)]
            return body[:-1] + marked[byte_of[body[-1]]]

        self.inside = np.zeros((256, 256), bool)
        for token in model["vocab"]:
            raw = [byte_of[c] for c in (token[: -len(self.mark)] if self.mark and token.endswith(self.mark) else token) if c in byte_of]
            self.inside[raw[:-1], raw[1:]] = True
        self.special = {} if special_as_text else {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in model["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.core = Tokenizer(models.BPE({renamed(t): i for t, i in model["vocab"].items()}, [tuple(map(renamed, m)) for m in merges]))
        self.plain, self.ending = {b: c for b, c in enumerate(chars)}, dict(enumerate(marked))
        self.core.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        ends = {i for t, i in model["vocab"].items() if t.endswith(self.mark) and t != self.mark}
        self.number_or_end = {i: f"{i}\n" if i in ends else str(i) for i in self.tokens}
        self.token_or_end = {i: f"{t}\n" if i in ends else t for i, t in self.tokens.items()}
        self.cache, self.known, self.most = {}, {}, cache

    def split(self, text: str) -> list[str]:
        """White-space pieces, with special tokens as pieces of their own."""
        cut = _SPLIT.split if _ODD_SPACE.search(text) else str.split
        if any(t in text for t in self.special):
            return [p for k, part in enumerate(self.special_split.split(text)) for p in ([part] if k % 2 else cut(part)) if p]
        return [p for p in cut(text) if p] if cut is not str.split else text.split()

    def cuts(self, word: str) -> list[bytes]:
        """The fragments between the forced boundaries of one word; the last ends the word."""
        raw, at, out = word.encode("utf-8", "replace"), 0, []
        for k in range(1, len(raw)):
            if not self.inside[raw[k - 1], raw[k]]:
                out.append(raw[at:k])
                at = k
        return [*out, raw[at:]]

    def other_words(self, joined: str) -> list[str]:
        """The words of text, and the line ends between them, by the library."""
        return [w for w, _ in self.splitter.pre_tokenize_str(self.normaliser.normalize_str(joined))]

    def learn(self, pieces: set[str]) -> None:
        """Encode the white-space pieces not yet known and remember each one's ids and tokens, as text."""
        if len(self.cache) + len(pieces) > self.most:  # what this run holds stays, so frequent pieces outlive rare ones
            self.cache = {p: self.cache[p] for p in pieces if p in self.cache}
        new = [p for p in pieces if p not in self.cache]
        for p in self.special.keys() & set(new):
            self.cache[p] = (str(self.special[p]), p)
        new = [p for p in new if p not in self.special]
        if not new:
            return
        plain = {p: p.isascii() or not self.beyond.search(p) for p in new}
        new = sorted(new, key=plain.__getitem__)
        found = []
        for easy, some in itertools.groupby(new, plain.__getitem__):  # no word, no cut and no character of NFC reaches across the line ends
            joined = "\n".join(some)
            found += ["\n"] if found else []
            found += self.easy_words.findall(joined.lower() if self.lower else joined) if easy else self.other_words(joined)
        words = set(found)
        if len(self.known) + len(words) > self.most:
            self.known = {w: self.known[w] for w in words if w in self.known}
        self.known["\n"] = ("\n", "\n")
        self._learn_words([w for w in words if w not in self.known])
        got = [self.known[w] for w in found]
        ids, tokens = (" ".join([x[k] for x in got]).split(" \n ") for k in (0, 1))
        self.cache.update(zip(new, zip(ids, tokens, strict=True), strict=True))

    def _learn_words(self, words: list[str]) -> None:
        for at in range(0, len(words), 20_000):
            some = words[at : at + 20_000]
            raw = np.frombuffer("\n".join(some).encode("utf-8", "replace"), np.uint8)
            ends = raw == 10
            forced = ~self.inside[raw[:-1], raw[1:]] & ~ends[:-1] & ~ends[1:]
            split = set((np.cumsum(ends)[:-1][forced]).tolist()) if forced.any() else ()
            fragments = []
            for k, w in enumerate(some):
                if k in split:
                    parts = self.cuts(w)
                    fragments += [self._symbols(x, False) for x in parts[:-1]] + [self._symbols(parts[-1], True)]
                else:
                    fragments.append(w[:-1] + self.ending[ord(w[-1])] if w.isascii() and w.isprintable() else self._symbols(w.encode("utf-8", "replace"), True))
            # The library gets fragments apart by spaces, which its splitter drops; a token that ends a word ends an entry.
            runs = [" ".join(fragments[k : k + 1000]) for k in range(0, len(fragments), 1000)]
            ids = [i for e in self.core.encode_batch_fast(runs, add_special_tokens=False) for i in e.ids]
            numbers, tokens = (" ".join([t[i] for i in ids]).split("\n ") for t in (self.number_or_end, self.token_or_end))
            numbers[-1], tokens[-1] = numbers[-1][:-1], tokens[-1][:-1]
            self.known.update(zip(some, zip(numbers, tokens, strict=True), strict=True))

    def _symbols(self, raw: bytes, ends: bool) -> str:
        text = raw.decode("latin-1")
        return text[:-1].translate(self.plain) + self.ending[raw[-1]] if ends else text.translate(self.plain)

    def forget(self) -> None:
        """Free what has been learnt; workers outlive their tasks, and other operators need the memory."""
        self.cache, self.known = {}, {}
        release()

    def numbers(self, pieces: list[str]) -> np.ndarray:
        """The ids of learnt pieces."""
        text = " ".join([self.cache[p][0] for p in pieces])
        return np.fromstring(text, np.int32, sep=" ") if text else np.zeros(0, np.int32)

    def encode(self, text: str) -> list[int]:
        pieces = self.split(text)
        self.learn(set(pieces))
        return self.numbers(pieces).tolist()

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.tokens[i] for i in ids)


_coders: dict[tuple[str, bool], ForcedBoundaryBpe] = {}


def coder(spec: str, special_as_text: bool = False) -> ForcedBoundaryBpe:
    """One coder per worker process and vocabulary."""
    key = (hashlib.sha256(spec.encode()).hexdigest(), special_as_text)
    if key not in _coders:
        _coders[key] = ForcedBoundaryBpe(spec, special_as_text)
    return _coders[key]


def vocabulary(path: str) -> str:
    """The text of a tokenizers file."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def text_runs(texts: list[str | None], chars: int = 1_500_000) -> Iterator[list[str]]:
    """The texts in runs of about ``chars`` characters, so that what is learnt at once stays bounded."""
    run, n = [], 0
    for t in texts:
        run.append(t or "")
        n += len(run[-1])
        if n >= chars:
            yield run
            run, n = [], 0
    if run:
        yield run


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))  # the vocabulary file, under 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(shared.value)
        for b in batches:
            n, a, d = [], [], []
            for texts in text_runs(b.column(1).to_pylist()):
                pieces = [bpe.split(t) for t in texts]
                bpe.learn(set().union(*pieces))
                get = bpe.cache.__getitem__
                for p in pieces:
                    got = list(map(get, p))
                    ids = " ".join([x[0] for x in got])
                    n.append(ids.count(" ") + 1 if ids else 0)
                    a.append(hashlib.sha256(ids.encode()).hexdigest())
                    d.append(hashlib.sha256(" ".join([x[1] for x in got]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.forget()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids`` (an array of ints) for every row."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(shared.value, special_as_text)
        for b in batches:
            at, out = [0], []
            for texts in text_runs(b.column(1).to_pylist()):
                pieces = [bpe.split(t) for t in texts]
                bpe.learn(set().union(*pieces))
                for p in pieces:
                    ids = bpe.numbers(p)
                    out.append(ids)
                    at.append(at[-1] + len(ids))
            values = np.concatenate(out) if out else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at), pa.int64()), lists], names=["doc_id", "n_tokens", "ids"])
        bpe.forget()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decoded(rows: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``rows`` with a column ``decoded``: the text that the ids stand for; a column of that name is replaced.

    A null list gives null; null ids and ids beyond the vocabulary stand for nothing, as in the library.
    """
    prepare(rows.sparkSession)
    spec = json.loads(vocabulary(path))
    tokens = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    table = [tokens.get(i) for i in range(max(tokens) + 1)]
    shared = rows.sparkSession.sparkContext.broadcast(table)  # one entry for each id of the vocabulary

    @F.pandas_udf("string")
    def text(ids):
        known, out = shared.value, []
        for x in ids:
            out.append(None if x is None else " ".join([t for i in x if i == i and i is not None and 0 <= i < len(known) and (t := known[int(i)]) is not None]))
        return pd.Series(out, dtype=object)

    return rows.withColumn("decoded", text(F.col(ids_col)))
