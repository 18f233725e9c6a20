"""Token counts by a separator scan over flat, unindexed token files.

A file is nothing but 2-byte token ids, big end first, one document after the other, each closed by the end-of-document id.
``write_token_files`` makes such files with Spark's own text writer, whose line end is the separator's two bytes; so they
land on any file system that Spark writes to. As a flat file names no documents, each one starts with six tokens below 2^15
that hold its id.

``scan`` reads a file in blocks, each a task's own: Spark's text reader cuts a file of any size at the first line feed after
every ``spark.sql.files.maxPartitionBytes``, on every file system that it knows. To a token file a line feed is one byte
among others, so a block starts at any byte, and whether on a token's first or second one only the sum of all bytes before
tells. So a task looks for the separator, in one vectorised comparison for each Arrow batch, and counts the pieces between
its hits for both cases apart. A prefix scan over the blocks' bytes then says which case holds for each block, another over
their separators numbers the documents of a file, and pieces of one number from several blocks are added up; a document may
end anywhere and span any number of blocks. A separator never straddles two blocks, as it holds no line feed. A task holds
one batch at a time, whatever the sizes of files and blocks; only a stretch without a line feed is read at once.

Edge cases: null and empty texts have no tokens and count 0; a null id comes back as null; a file without a final separator
ends in an open document, which counts; half a token at the end of a file is dropped; empty files and an empty table give no
rows; repeated rows each have their own count; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmap.llm.bpe import coder, text_runs, vocabulary
from quillmap.llm.runtime import prepare
from quillmap.plans.storage import keep, shared_folder, small

#: The separator is the two bytes of this character in UTF-8: id 49792, beyond the vocabulary and below 2^16.
SEPARATOR = "\u0080"
END = int.from_bytes(SEPARATOR.encode(), "big")
#: Tokens in front of each document that hold its id: one for a null id, five of 15 bits.
HEAD = 6


def head(doc_id: int | None) -> np.ndarray:
    bits = (doc_id or 0) & ((1 << 64) - 1)
    return np.array([int(doc_id is None), *[(bits >> s) & 0x7FFF for s in (60, 45, 30, 15, 0)]], ">u2")


def write_token_files(docs: DataFrame, path: str, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The documents' ids, with special tokens as ordinary text, as flat files below ``path``."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(shared.value, True)
        if max(bpe.tokens) >= END:
            raise ValueError("the vocabulary reaches the separator's id")
        for b in batches:
            out, ids = [], iter(b.column(0).to_pylist())
            for texts in text_runs(b.column(1).to_pylist()):
                pieces = [bpe.split(t) for t in texts]
                bpe.learn(set().union(*pieces))
                out += [head(next(ids)).tobytes() + bpe.numbers(p).astype(">u2").tobytes() for p in pieces]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
        bpe.forget()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(path)


class Block:
    """The pieces of one block, as its bytes come in; for even (0) and odd (1) places of a token's first byte in the block."""

    def __init__(self, end: bytes, heads: int):
        self.end, self.heads = end, 2 * heads
        self.size = 0
        self.separators, self.begun, self.first = [0, 0], [0, 0], [b"", b""]

    def add(self, data: bytes) -> Iterator[tuple[int, int, int, bytes, bool]]:
        """``case, number, bytes, first bytes, closed`` of the pieces that end in ``data``."""
        raw = np.frombuffer(data, np.uint8)
        hits = np.flatnonzero((raw[:-1] == self.end[0]) & (raw[1:] == self.end[1])) + self.size
        for case in (0, 1):
            for at in hits[hits % 2 == case].tolist():
                yield case, self.separators[case], at - self.begun[case], self._head(case, data, at), True
                self.separators[case] += 1
                self.begun[case], self.first[case] = at + 2, b""
            self.first[case] = self._head(case, data, self.size + len(data))
        self.size += len(data)

    def _head(self, case: int, data: bytes, upto: int) -> bytes:
        """The first bytes of the piece that is open, as far as ``upto``."""
        got = self.first[case]
        if len(got) >= self.heads:
            return got
        begin = max(self.begun[case] - self.size, 0)
        return got + data[begin : max(begin, min(upto - self.size, begin + self.heads - len(got)))]

    def rest(self) -> Iterator[tuple[int, int, int, bytes, bool]]:
        for case in (0, 1):
            yield case, self.separators[case], self.size - self.begun[case], self.first[case], False


_FOUND = {"file": "string", "block": "long", "size": "long", "length": "long", "case": "int", "at": "long", "n": "long", "first": "binary", "closed": "boolean"}


def _scan(end: bytes, heads: int, feed: bytes):
    def told(key, block: Block, rows: list, last: bool) -> pa.RecordBatch:
        case, at, n, first, closed = zip(*rows, strict=True)
        k = len(rows)
        cols = [pa.array([key[0]] * k, pa.string()), pa.array([key[1]] * k, pa.int64()), pa.array([block.size if last else None] * k, pa.int64()), pa.array([key[2]] * k, pa.int64())]
        cols += [pa.array(case, pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(first, pa.binary()), pa.array(closed, pa.bool_())]
        return pa.RecordBatch.from_arrays(cols, names=list(_FOUND))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, None
        for b in batches:
            keys = list(zip(*(b.column(k).to_pylist() for k in ("file", "block", "length")), strict=True))
            lines, at = b.column("value").to_pylist(), 0
            for key, same in itertools.groupby(keys):
                upto = at + len(list(same))
                if key != now:
                    if block:
                        yield told(now, block, list(block.rest()), True)
                    now, block = key, Block(end, heads)
                rows = list(block.add(feed.join(lines[at:upto]) + feed))
                if rows:
                    yield told(now, block, rows, False)
                at = upto
        if block:
            yield told(now, block, list(block.rest()), True)

    return run


def scan(spark: SparkSession, path: str, end: int = END, heads: int = HEAD) -> DataFrame:
    """``file, ordinal, n_tokens, first``: tokens of every document of every file, its first ``heads`` tokens not counted.

    ``first`` are the bytes of those. A file may not begin with the three bytes of a text file's byte order mark.
    """
    prepare(spark)
    mark = end.to_bytes(2, "big")
    feed = next(c for c in (b"\n", b"\r", b" ") if c not in mark)
    lines = spark.read.option("lineSep", feed.decode()).option("recursiveFileLookup", "true").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("length"), F.col("value").cast("binary").alias("value"))
    found = keep(lines.mapInArrow(_scan(mark, heads, feed), ", ".join(f"{k} {t}" for k, t in _FOUND.items())), "pieces")
    # The rows that end a block carry its size, one for each case with the separators that it has found.
    ends = found.where("size is not null").groupBy("file", "block").agg(F.max("size").alias("size"), F.max("length").alias("length"), *[F.max(F.when(F.col("case") == c, F.col("at"))).alias(f"n{c}") for c in (0, 1)])
    order = W.partitionBy("file").orderBy("block")
    blocks = ends.withColumn("case", F.pmod(F.sum("size").over(order) - F.col("size"), F.lit(2)).cast("int"))
    blocks = blocks.withColumn("separators", F.when(F.col("case") == 0, F.col("n0")).otherwise(F.col("n1")))
    blocks = keep(blocks.withColumn("before", F.sum("separators").over(order) - F.col("separators")), "blocks")
    # A file without a line feed at its end seems one byte longer than it is.
    files = blocks.groupBy("file").agg(F.sum("separators").alias("all"), (F.sum("size") - F.max("length")).alias("over"))
    files = files.withColumn("over", F.when(F.col("over").isin(0, 1), F.col("over")).otherwise(F.raise_error(F.lit("bytes of a token file were not read")).cast("long")))
    placed = found.join(small(blocks.select("file", "block", "case", "before")), ["file", "block", "case"])
    placed = placed.select("file", (F.col("before") + F.col("at")).alias("ordinal"), "block", "n", "first", ((F.col("at") > 0) & F.col("closed")).alias("whole"))
    whole = placed.where("whole").select("file", "ordinal", "n", "first")
    parts = placed.where("not whole").groupBy("file", "ordinal").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("block", "first"))).alias("parts"))
    heads_of = F.aggregate("parts", F.lit(b""), lambda got, p: F.concat(got, p["first"]))
    parts = parts.select("file", "ordinal", "n", F.substring(heads_of, 1, 2 * heads).alias("first"))
    rows = whole.unionByName(parts).join(small(keep(files, "files")), "file")
    # What follows a file's last separator is no document unless it holds something; empty documents in between do count.
    rows = rows.withColumn("n", F.when(F.col("ordinal") == F.col("all"), F.col("n") - F.col("over")).otherwise(F.col("n")))
    rows = rows.where("ordinal < all or n > 1")
    return rows.select("file", "ordinal", (F.floor(F.col("n") / 2) - heads).cast("long").alias("n_tokens"), "first")


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens`` for every row, by way of flat token files in the shared folder."""
    path = f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, vocabulary_path, id_col, text_col)
    counts = scan(docs.sparkSession, path)

    def token(k: int):
        return F.conv(F.hex(F.substring("first", 2 * k + 1, 2)), 16, 10).cast("long")

    number = F.lit(0).cast("long")
    for k, s in enumerate((60, 45, 30, 15, 0), 1):
        number = number.bitwiseOR(F.shiftleft(token(k), s))
    return counts.select(F.when(token(0) == 0, number).alias("doc_id"), "n_tokens")
