"""Vector code compression: product codes by annular norm pruning.

Vectors of whole numbers are cut into equal consecutive parts; each part is replaced by the index of its nearest codebook
entry. Entries are sorted by norm. As ``|norm(part) - norm(entry)|`` never exceeds their distance, a part whose best distance
so far is d needs only the entries with norms from ``norm(part) - d`` to ``norm(part) + d``, bounds included: binary searches
give that interval, which shrinks while d does. Distances inside it are exact whole numbers.

Shape of the plan
-----------------
1. The quantised vectors are written once to the shared folder; each round reads them.
2. A round is one pass over the vectors: tasks assign parts and send a sum and a count for each (part, entry), so at most
   parts x entries rows a task are shuffled, whatever entry is hot. The driver gets one row for each (part, entry).
3. The last pass writes codes and errors; label sums meet the rows behind a checked broadcast or a plain shuffle join, so a
   label with a third of all rows is never gathered.

The codebook (parts x entries x part length numbers) goes to the tasks inside the function; its size depends on parameters
and the vectors' length only.

Edge cases: rows that ``vectors.quantised`` drops go. The vectors' length is the commonest one that the parts divide (ties:
the shorter); vectors of other lengths, and those with numbers beyond its limit, stay as rows with a null code and error, and
no round sees them. With fewer vectors than entries the codebook has an entry for each vector. Repeated ids are rows of their own; in the choice of first
entries equal ids go by their numbers, null ids come last. Null labels are one group. An empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.llm.vectors import EXACT, EXACT_WIDTH, lists, matrix, quantised
from quillmap.plans.storage import keep, small
from quillmap.session import workers_see_package

PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Parts that are looked up together, neighbours by norm, and the entries that a first look takes.
BLOCK = 512
FIRST = 32


class Ring:
    """Codebook entries of one part position, in order of their norms."""

    def __init__(self, entries: np.ndarray):
        squares = (entries * entries).sum(1)
        self.order = np.argsort(squares, kind="stable")
        self.entries = entries[self.order]
        self.squares = squares[self.order]
        self.norms = np.sqrt(self.squares.astype(np.float64))
        self.small = not len(entries) or int(np.abs(entries).max()) <= EXACT

    def _distances(self, parts: np.ndarray, squares: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Exact squared distances of all ``parts`` from entries lo .. hi - 1."""
        if self.small and int(np.abs(parts).max(initial=0)) <= EXACT and parts.shape[1] <= EXACT_WIDTH:
            products = parts.astype(np.float64) @ self.entries[lo:hi].T.astype(np.float64)
            return squares[:, None] + self.squares[None, lo:hi] - 2 * products.astype(np.int64)
        out = np.empty((len(parts), hi - lo), np.int64)
        for k in range(lo, hi):
            gap = parts - self.entries[k]
            out[:, k - lo] = (gap * gap).sum(1)
        return out

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (ties: the lower index) and the squared distance, for each row of ``parts``."""
        index, best = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        squares = (parts * parts).sum(1)
        by_norm = np.argsort(squares, kind="stable")
        for at in range(0, len(parts), BLOCK):
            rows = by_norm[at : at + BLOCK]
            index[rows], best[rows] = self._block(parts[rows], squares[rows])
        return index, best

    def _block(self, parts: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        norms, n = np.sqrt(squares.astype(np.float64)), len(self.norms)
        best, index = np.full(len(parts), np.iinfo(np.int64).max), np.full(len(parts), n)
        middle = int(np.searchsorted(self.norms, norms[len(norms) // 2]))
        lo = max(0, min(middle - FIRST // 2, n - FIRST))
        done_lo = done_hi = lo
        hi = min(n, lo + FIRST)
        while True:
            for a, b in ((lo, done_lo), (done_hi, hi)):
                if a < b:
                    self._update(parts, squares, a, b, best, index)
            done_lo, done_hi = lo, hi
            reach = np.sqrt(best.astype(np.float64))
            slack = 1e-9 * (norms + reach + 1)  # more than the square roots can be off
            need_lo = int(np.searchsorted(self.norms, (norms - reach - slack).min(), "left"))
            need_hi = int(np.searchsorted(self.norms, (norms + reach + slack).max(), "right"))
            if need_lo >= done_lo and need_hi <= done_hi:
                return index, best
            # outwards by as much as has been looked at, as a nearer entry may close the ring before its rim
            step = done_hi - done_lo
            lo, hi = min(done_lo, max(need_lo, done_lo - step)), max(done_hi, min(need_hi, done_hi + step))

    def _update(self, parts: np.ndarray, squares: np.ndarray, a: int, b: int, best: np.ndarray, index: np.ndarray) -> None:
        found = self._distances(parts, squares, a, b)
        least = found.min(1)
        names = np.where(found == least[:, None], self.order[None, a:b], len(self.order)).min(1)
        nearer = (least < best) | ((least == best) & (names < index))
        best[nearer], index[nearer] = least[nearer], names[nearer]


def _coded(batch: pa.RecordBatch, books: np.ndarray, rings: list[Ring]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = matrix(batch.column("q"), books.shape[0] * books.shape[2]).reshape(-1, books.shape[0], books.shape[2])
    found = [ring.nearest(rows[:, p]) for p, ring in enumerate(rings)]
    return rows, np.stack([i for i, _ in found], 1), np.stack([d for _, d in found], 1)


def _sums(books: np.ndarray):
    """Tasks' part of a round: count and sum of the parts that chose each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rings = [Ring(book) for book in books]
        counts, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            rows, index, _ = _coded(batch, books, rings)
            for p in range(len(books)):
                counts[p] += np.bincount(index[:, p], minlength=books.shape[1])
                np.add.at(sums[p], index[:, p], rows[:, p])
        p, e = np.nonzero(counts)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(counts[p, e]), lists(sums[p, e])], names=["p", "e", "n", "s"])

    return run


def _codes(books: np.ndarray, names: list[str]):
    """The last pass: code and error of each vector beside its other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rings = [Ring(book) for book in books]
        digits = np.array([f"{k:02x}" for k in range(books.shape[1])])
        for batch in batches:
            _, index, error = _coded(batch, books, rings)
            code = ["".join(row) for row in digits[index]]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(code, pa.string()), pa.array(error.sum(1))], names=[*names, "code", "error"])

    return run


def _length(rows: DataFrame, parts: int) -> int | None:
    """The commonest length that ``parts`` divides."""
    sizes = rows.where("q is not null").groupBy(F.size("q").alias("n")).count().where(F.col("n") % parts == 0)
    found = sizes.where("n > 0").orderBy(F.desc("count"), "n").first()
    return found.n if found else None


def trained(fit: DataFrame, parts: int, width: int, entries: int, rounds: int) -> np.ndarray:
    """Codebooks (parts, entries, width) of ``fit``, a kept table of vectors of one length."""
    first = fit.select("vec_id", "q").orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).collect()
    books = np.array([r.q for r in first], np.int64).reshape(-1, parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        sums = fit.select("q").mapInArrow(_sums(books), "p long, e long, n long, s array<long>")
        sums = sums.groupBy("p", "e").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[k]) for k in range(width)]).alias("s"))
        after = books.copy()
        for r in sums.collect():
            after[r.p, r.e] = np.array(r.s, np.int64) // r.n
        if (after == books).all():
            break
        books = after
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Kept rows ``(vec_id, label, code, error)`` and the codebooks; at most 256 entries, so that an index has two digits."""
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256")
    spark = df.sparkSession
    workers_see_package(spark)
    rows = keep(quantised(df, id_col, vec_col, label=label_col), "vectors")
    length = _length(rows, parts)
    fits = F.coalesce(F.size("q") == F.lit(length), F.lit(False))
    others = rows.where(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if not length:
        return others, np.zeros((parts, 0, 0), np.int64)
    fit = rows.where(fits)
    books = trained(fit, parts, length // parts, entries, rounds)
    kind = rows.schema["label"].dataType.simpleString()
    coded = fit.mapInArrow(_codes(books, ["vec_id", "label"]), f"vec_id long, label {kind}, code string, error long")
    return keep(coded.unionByName(others), "codes"), books


def vector_codes(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every vector that stays."""
    coded, books = compress(df, id_col, vec_col, label_col, parts, entries, rounds)
    sums = keep(coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "of"), "labels")
    joined = coded.join(small(sums), F.col("label").eqNullSafe(F.col("of")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def decoded(books: np.ndarray, code: str) -> list[int]:
    """The numbers that a code stands for."""
    return [int(x) for p in range(len(books)) for x in books[p, int(code[2 * p : 2 * p + 2], 16)]]
