"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE_WORDS`` words, the whole text over. Each passage is described by shares of byte
classes, word lengths and repetition, and encoded by a small network. Gated attention weighs the passages; the weighted mean
of their codes is the document's representation, which a logistic layer scores. Only document labels are learnt from.

The fit takes a bounded sample of labelled documents (``TRAIN_DOCS``, by a hash of the id; of longer ones than
``TRAIN_PASSAGES`` passages so many, evenly spaced from the first to the last) and runs on the driver in a few seconds; scoring is one pass over the texts in Arrow batches.

Edge cases: null and empty texts are one passage of zeros and get a score; labels that are null, or whose id is null, are
not learnt from, and of repeated labels the largest counts; without labels of both kinds every score is the share of label 1
(0.5 if there is none); repeated rows score alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.llm.runtime import id_crc, prepare, release

PASSAGE_WORDS = 100
TRAIN_DOCS = 2_000
TRAIN_PASSAGES = 400
STEPS = 150
CODE = 16
#: A score from here on predicts label 1.
CUT = 0.3

# Byte classes 1 to 9; all other bytes are class 0.
_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&<>@^~=+\\/{}[]", ".,;:'\"()-", "!?", "|", "_", "\n")
_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate(_CLASSES, 1):
    _CLASS[list(_chars.encode())] = _k
_CLASS[128:] = 10
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
N_CLASSES = 11
WIDTH = N_CLASSES + 6


def passages(text: str | None) -> np.ndarray:
    """A row of features for each passage."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return np.zeros((1, WIDTH), np.float32)
    n = max(1, len(words) // PASSAGE_WORDS)
    data = np.frombuffer(raw, np.uint8)
    gap = _SPACE[data]
    starts = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    edges = np.concatenate([[0], starts[PASSAGE_WORDS : n * PASSAGE_WORDS : PASSAGE_WORDS], [len(data)]]) if n > 1 else np.array([0, len(data)])
    out = np.empty((n, WIDTH), np.float32)
    for at in range(0, n, 2000):
        some = edges[at : at + 2001]
        k = len(some) - 1
        owner = np.repeat(np.arange(k), np.diff(some))
        hist = np.bincount(owner * N_CLASSES + _CLASS[data[some[0] : some[-1]]], minlength=k * N_CLASSES).reshape(k, N_CLASSES)
        out[at : at + k, :N_CLASSES] = hist / np.maximum(1, np.diff(some))[:, None]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    copied = 1 - len(set(lines)) / len(lines)
    for k in range(n):
        own = words[k * PASSAGE_WORDS : (k + 1) * PASSAGE_WORDS] if k < n - 1 else words[k * PASSAGE_WORDS :]
        kinds = set(own)
        out[k, N_CLASSES:] = (len(kinds) / len(own), sum(map(len, kinds)) / len(kinds) / 10, len(own) / PASSAGE_WORDS, math.log1p(len(words)) / 10, copied, len(own) / (1 + len(lines)) / 20)
    return out


def spaced(rows: np.ndarray, most: int = TRAIN_PASSAGES) -> np.ndarray:
    """``rows``, or ``most`` of them at even distances, the first and the last among them."""
    return rows if len(rows) <= most else rows[np.linspace(0, len(rows) - 1, most).round().astype(np.int64)]


class Bags:
    """Passages of many documents in one array, with the first row of each."""

    def __init__(self, docs: list[np.ndarray]):
        self.x = np.concatenate(docs) if docs else np.zeros((0, WIDTH), np.float32)
        self.first = np.cumsum([0, *map(len, docs)])[:-1]
        self.owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])

    def sums(self, v: np.ndarray) -> np.ndarray:
        return np.add.reduceat(v, self.first, axis=0)


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -40, 40)))


class Model:
    """Encoder, gated attention and logistic layer."""

    def __init__(self, prior: float):
        self.prior, self.p = prior, None

    def forward(self, bags: Bags):
        p = self.p
        x = (bags.x - p["mean"]) / p["scale"]
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        top = np.maximum.reduceat(e, bags.first)
        a = np.exp(e - top[bags.owner])
        a = a / bags.sums(a)[bags.owner]
        z = bags.sums(a[:, None] * h)
        return x, h, t, g, a, z, _sigmoid(z @ p["c"] + p["d"])

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        if self.p is None:
            return np.full(len(docs), self.prior)
        return self.forward(Bags(docs))[-1] if docs else np.zeros(0)

    def fit(self, docs: list[np.ndarray], y: np.ndarray, steps: int = STEPS, rate: float = 0.02) -> Model:
        bags, rng = Bags(docs), np.random.default_rng(3)
        self.p = {"mean": bags.x.mean(axis=0), "scale": bags.x.std(axis=0) + 1e-3, "d": np.array(math.log(self.prior / (1 - self.prior)))}
        shapes = {"W": (WIDTH, CODE), "b": (CODE,), "V": (CODE, CODE), "U": (CODE, CODE), "w": (CODE,), "c": (CODE,)}
        self.p |= {k: rng.normal(0, 0.3, s) if k != "b" else np.zeros(s) for k, s in shapes.items()}
        names = [*shapes, "d"]
        m, v = ({k: np.zeros_like(self.p[k]) for k in names} for _ in range(2))
        for step in range(1, steps + 1):
            x, h, t, g, a, z, s = self.forward(bags)
            ds = (s - y) / len(y)
            grad = {"c": z.T @ ds, "d": ds.sum()}
            dz = ds[:, None] * self.p["c"]
            dzr = dz[bags.owner]
            da = (dzr * h).sum(axis=1)
            dh = a[:, None] * dzr
            de = a * (da - bags.sums(a * da)[bags.owner])
            grad["w"] = (t * g).T @ de
            dtg = de[:, None] * self.p["w"]
            dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
            grad["V"], grad["U"] = h.T @ dt, h.T @ dg
            dh = (dh + dt @ self.p["V"].T + dg @ self.p["U"].T) * (1 - h * h)
            grad["W"], grad["b"] = x.T @ dh, dh.sum(axis=0)
            for k in names:
                g_ = grad[k] + (1e-4 * self.p[k] if k not in ("b", "d") else 0)
                m[k] = 0.9 * m[k] + 0.1 * g_
                v[k] = 0.99 * v[k] + 0.01 * g_ * g_
                self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self


def fit(docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_DOCS) -> Model:
    """A model from at most about ``most`` labelled documents; ``learn`` is a condition on ``doc_id``."""
    prepare(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y is not null").where(learn)
    parts = max(1, math.ceil(known.count() / most))
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(parts)) == 0).groupBy("doc_id").agg(F.max("y").alias("y"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(F.broadcast(known), "doc_id").select("doc_id", "y", "text")  # about ``most`` ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, y, spaced(passages(t)).tobytes()) for i, y, t in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            i, y, f = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(y, pa.int32()), pa.array(f, pa.binary())], names=["doc_id", "y", "f"])

    got = sorted((r["doc_id"], r["y"], bytes(r["f"])) for r in rows.mapInArrow(run, "doc_id long, y int, f binary").collect())
    y = np.array([float(r[1] >= 1) for r in got])
    model = Model(float(y.mean()) if len(y) else 0.5)
    if len(y) == 0 or y.min() == y.max():
        return model
    return model.fit([np.frombuffer(r[2], np.float32).reshape(-1, WIDTH).astype(np.float64) for r in got], y)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every row."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shared.value.score([passages(t).astype(np.float64) for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])
        release()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def held_out():
    """Rows whose labels are not learnt from; a null id is learnt from by none and held out by none."""
    return F.coalesce(id_crc(F.col("doc_id")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    found = score(docs, fit(docs, labels, ~held_out(), id_col, text_col), id_col, text_col)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the classifier rejects; all columns stay. Scored in place, so nothing is shuffled."""
    model = fit(docs, labels, ~held_out(), id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shared.value.score([passages(t).astype(np.float64) for t in b.column(text_col).to_pylist()])
            yield b.filter(pa.array(s >= CUT))
        release()

    return docs.mapInArrow(run, schema)
