"""Mixing sources to target weights.

1. Every source's words, in the order of a hash bucket, the id and a hash of the row, form one stream, packed into blocks of
   ``BLOCK_WORDS``. A document's place in its stream is a prefix sum in two levels: sums per (source, bucket), offsets over
   runs of buckets, then a window inside one bucket. Rows that are alike in all that matters are one row with a count until
   their places are known. Buckets are about a thousand rows, so a hot source or id is spread over tasks like any other.
2. A source owes the number of blocks that makes up its target to the word: the last of them is cut to what is missing
   then. These blocks are dealt evenly to groups of about ``GROUP_SHARDS`` output shards, by one division per source and
   group. Inside a group every shard of up to ``SHARD_SLOTS`` slots draws how many of them each source gets: a multinomial
   draw whose weights are what the group still owes each source; what a draw gives a source beyond its due is drawn again
   among the others. So single shards follow chance, and sources of any size, those below a block too, meet their targets.
   Groups are drawn apart, in tasks of their own, and need nothing of each other.
3. The draws of a source are numbered over groups by the same division and go through its blocks: draw ``j`` of a source of
   ``n`` blocks is pass ``j div n`` at ``j mod n``; a Feistel permutation of ``0 .. n-1``, keyed by source and pass, names the
   block. So no block comes more often than once in a pass, nor more than three times in all. Inside its shard every slot has
   a pseudorandom place. Numbers of shards have gaps between groups.
4. Blocks join the documents they hold by source and block index.

Everything is keyed by ids, texts and a seed, so reruns agree whatever the partitioning. One row for each source passes
through the driver, and a task that draws holds four numbers for each source; nothing else is collected.

Edge cases: null and empty texts have size 0 and are never taken; a null source is one source, last in order; null ids and
repeated ids are told apart by their texts; repeated rows each have their own place; a table without words has targets of 0;
an empty table gives an empty result; extra columns are ignored by ``mix`` and replaced by those of documents in
``mixed_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmap.llm.runtime import WORD, prepare, release
from quillmap.plans.storage import keep, small

#: Words in a block, slots in an output shard, shards in a group, rows in a bucket, passes that a source may give at most.
BLOCK_WORDS = 64
SHARD_SLOTS = 256
GROUP_SHARDS = 64
BUCKET_ROWS = 1000
MOST_PASSES = 3
WEIGHTS = (1.0, 2.0, 3.0)
#: Buckets, or groups, in one run of the two-level prefix sums; groups drawn by one task.
RUN = 1000
TASK_GROUPS = 4


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, most: int = MOST_PASSES) -> dict[str | None, float]:
    """Words that each source shall give: shares of all sizes by weight, capped, the excess shared out again."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[k % len(weights)] for k, (s, _) in enumerate(order)}
    size, free, fixed = dict(order), dict(order), {}
    left = float(sum(size.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * size[s]]
        if not over:
            return fixed | {s: left * weight[s] / total for s in free}
        for s in over:
            fixed[s] = float(most * size[s])
            del free[s]
        left = float(sum(size.values())) - sum(fixed.values())
    return fixed


def draw_group(owed: np.ndarray, seed: list[int], shard_slots: int = SHARD_SLOTS) -> np.ndarray:
    """Slots per (shard, source) of one group of shards that gives each source what it is owed."""
    left, rows, rng = int(owed.sum()), [], np.random.default_rng(seed)
    shards = -(-left // shard_slots)
    sizes = np.diff(left * np.arange(shards + 1) // max(1, shards))
    owed = owed.copy()
    for n in sizes.tolist():
        row = np.zeros(len(owed), np.int64)
        while n:
            drawn = np.minimum(rng.multinomial(n, owed / owed.sum()), owed)
            row, owed, n = row + drawn, owed - drawn, n - int(drawn.sum())
        rows.append(row)
    return np.array(rows, dtype=np.int64).reshape(len(rows), len(owed))


def _keyed(right: np.ndarray, key: np.ndarray, turn: int, mask: np.ndarray) -> np.ndarray:
    f = (right + key + np.uint64(turn + 1)) * np.uint64(0x9E3779B97F4A7C15)
    f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (f ^ (f >> np.uint64(32))) & mask


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of ``0 .. n-1`` at ``index``: a four-round Feistel network, walked until inside. ``back`` inverts it."""
    n = n.astype(np.uint64)
    half = np.ceil(np.log2(np.maximum(n, 2).astype(np.float64)) / 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64).copy(), np.arange(len(index))
    while len(todo):
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = x >> h, x & m
        for r in range(4):
            if back:
                left, right = right ^ _keyed(left, k, 3 - r, m), left
            else:
                left, right = right, left ^ _keyed(right, k, r, m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def block_keys(source_no: np.ndarray, turn: np.ndarray, seed: int) -> np.ndarray:
    """The key of a source's permutation for each pass."""
    return (source_no.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)) ^ (turn.astype(np.uint64) * np.uint64(0x94D049BB133111EB)) ^ np.uint64(seed)


def due(source_no: np.ndarray, sizes: np.ndarray, words: np.ndarray, block_words: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``blocks, draws, cut`` of each source: its blocks, the draws that give ``words``, and the words of the last draw (0: all of it)."""
    blocks = -(-sizes // block_words)
    some = np.maximum(sizes, 1)
    passes, rest = words // some, words % some
    short = sizes - block_words * (blocks - 1)  # the words of a source's last block
    place = permute(np.maximum(blocks - 1, 0), np.maximum(blocks, 1), block_keys(source_no, passes, seed), back=True)
    draws = -(-rest // block_words)
    draws = np.where((rest > 0) & (place < draws), -(-(rest + block_words - short) // block_words), draws)
    earlier = block_words * (draws - 1) - np.where(place < draws - 1, block_words - short, 0)
    last = np.where(place == draws - 1, short, block_words)
    cut = np.where((rest > 0) & (rest - earlier < last), rest - earlier, 0)
    return blocks, np.where(sizes > 0, passes * blocks + draws, 0), cut


def before(rows: DataFrame, group: str, order: str, value: str, run: int = RUN) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` over smaller ``order`` of the same ``group``, which it tells apart.

    Sums over runs of ``run`` orders first, then a window inside each run, so that no task sees more of a group.
    """
    rows = rows.withColumn("__run", F.expr(f"{order} div {run}"))
    far = rows.groupBy(group, "__run").agg(F.sum(value).alias("__sum"))
    far = far.select(group, "__run", (F.sum("__sum").over(W.partitionBy(group).orderBy("__run")) - F.col("__sum")).alias("__far"))
    near = F.sum(value).over(W.partitionBy(group, "__run").orderBy(order)) - F.col(value)
    return rows.withColumn("__near", near).join(far, [group, "__run"]).withColumn("before", F.col("__near") + F.col("__far")).drop("__run", "__near", "__far")


class Mix:
    """The parts of one mix: ``placed`` documents, ``slots`` of the output and the ``summary`` per source."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, block_words: int = BLOCK_WORDS, weights: tuple[float, ...] = WEIGHTS, carry: tuple[str, ...] = (), shard_slots: int = SHARD_SLOTS, group_shards: int = GROUP_SHARDS):
        self.spark, self.seed, self.block_words, self.shard_slots, self.group_shards = docs.sparkSession, seed, block_words, shard_slots, group_shards
        prepare(self.spark)
        text = F.col(text_col).cast("string")
        row_hash = F.xxhash64(F.col(id_col).cast("long"), text.isNull(), text, *[F.col(c) for c in carry])
        keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), row_hash.alias("row_hash"), F.xxhash64(F.lit(1), text).alias("text_hash"), text.alias("text"), *[F.col(c) for c in carry if c not in (id_col, source_col, text_col)])
        self.texts = keyed
        size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
        rows = keep(keyed.select("doc_id", "source", "row_hash", "text_hash", size.alias("size")), "mix-sizes")
        totals = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()  # one row for each source
        totals = sorted(((r["source"], r["size"], r["n"]) for r in totals), key=lambda x: (x[0] is None, x[0] or ""))
        want = targets([(s, n) for s, n, _ in totals], weights)
        numbers, sizes = np.arange(len(totals)), np.array([n for _, n, _ in totals], np.int64)
        words = np.array([min(MOST_PASSES * n, int(want[s] + 0.5)) for s, n, _ in totals], np.int64)
        self.due = due(numbers, sizes, words, block_words, seed)
        self.summary = [(k, s, n, want[s]) for k, (s, n, _) in enumerate(totals)]
        schema = "source_no long, source string, source_size long, target double"
        known = self.spark.createDataFrame(self.summary, schema) if self.summary else self.spark.createDataFrame([], schema)
        known = small(known.select("source_no", "source", "source_size", "target"))
        buckets = max(1, -(-sum(n for *_, n in totals) // BUCKET_ROWS))
        rows = rows.join(known, rows["source"].eqNullSafe(known["source"])).drop(known["source"])
        rows = rows.groupBy("source_no", "doc_id", "row_hash", "text_hash", "size").agg(F.count(F.lit(1)).alias("copies"), F.first("source").alias("source"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
        rows = rows.withColumn("bucket", F.pmod("row_hash", F.lit(buckets)))
        inside = W.partitionBy("source_no", "bucket").orderBy("doc_id", "row_hash", "text_hash", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
        rows = keep(rows.withColumn("upto", F.sum(F.col("size") * F.col("copies")).over(inside)), "mix-buckets")
        sums = rows.groupBy("source_no", "bucket").agg(F.max("upto").alias("bucket_size"))
        offsets = keep(before(sums, "source_no", "bucket", "bucket_size").select("source_no", "bucket", "before"), "mix-offsets")
        placed = rows.join(small(offsets), ["source_no", "bucket"]).withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)")))
        start = F.col("before") + F.col("upto") - (F.col("copies") - F.col("copy")) * F.col("size")
        self.placed = keep(placed.withColumn("start", start).drop("bucket", "before", "upto", "copy"), "placed")
        self.slots = self._slots()

    def _slots(self) -> DataFrame:
        """``shard, slot, source_no, draw, block, cut``: one row for each block of the output; ``cut`` is its words if it is cut, else 0."""
        schema = "shard long, slot long, source_no long, draw long, block long, cut long"
        blocks, draws, cut = self.due
        n_slots = int(draws.sum())
        if n_slots == 0:
            return self.spark.createDataFrame([], schema)
        seed, shard_slots = self.seed, self.shard_slots
        groups = -(-n_slots // (shard_slots * self.group_shards))
        stride = self.group_shards + -(-len(draws) // shard_slots) + 1  # a group has a slot more for each source at most
        shift = np.random.default_rng([seed, 2]).integers(0, groups, len(draws))
        plan = self.spark.sparkContext.broadcast((blocks, draws, cut, shift))  # four numbers for each source

        def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks, draws, cut, shift = plan.value
            for b in batches:
                for g in b.column(0).to_pylist():
                    first = (draws * g + shift) // groups
                    drawn = draw_group((draws * (g + 1) + shift) // groups - first, [seed, g], shard_slots)
                    first = first + np.cumsum(drawn, axis=0) - drawn
                    shard, source = (np.repeat(x.ravel(), drawn.ravel()) for x in np.indices(drawn.shape))
                    run = np.cumsum(drawn.ravel()) - drawn.ravel()
                    draw = np.repeat(first.ravel() - run, drawn.ravel()) + np.arange(len(shard))
                    rng = np.random.default_rng([seed, g, 1])
                    slot = np.concatenate([np.zeros(0, np.int64), *[rng.permutation(n) for n in drawn.sum(axis=1)]])
                    turn = draw // blocks[source]
                    block = permute(draw % blocks[source], blocks[source], block_keys(source, turn, seed))
                    short = np.where(draw == draws[source] - 1, cut[source], 0)
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (shard + g * stride, slot, source, draw, block, short)], names=["shard", "slot", "source_no", "draw", "block", "cut"])

        return self.spark.range(0, groups, 1, -(-groups // TASK_GROUPS)).mapInArrow(slots, schema)

    def blocks(self) -> DataFrame:
        """``source_no, block, times, cut, place``: how often the output holds each block whole, the words of it that it holds once more, and where first."""
        whole, cut = F.count(F.when(F.col("cut") == 0, 1)).alias("times"), F.max("cut").alias("cut")
        return self.slots.groupBy("source_no", "block").agg(whole, cut, F.min(F.struct("shard", "slot")).alias("place"), F.min(F.when(F.col("cut") == 0, F.struct("shard", "slot"))).alias("whole_place"))

    def parts(self) -> DataFrame:
        """``source_no, start, block, first, upto, times, place`` for every piece of a document in one block; words ``first .. upto-1``."""
        b = self.block_words
        spans = self.placed.where("size > 0").select("source_no", "start", "size", F.explode(F.expr(f"sequence(start div {b}, (start + size - 1) div {b})")).alias("block"))
        spans = spans.withColumn("first", F.greatest(F.col("start"), F.col("block") * b) - F.col("start"))
        spans = spans.withColumn("upto", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b) - F.col("start"))
        spans = spans.join(self.blocks().hint("merge"), ["source_no", "block"])
        edge = F.greatest("first", F.least("upto", F.col("block") * b + F.col("cut") - F.col("start")))  # words in front of it come once more
        front = F.struct(F.col("first"), edge.alias("upto"), (F.col("times") + (F.col("cut") > 0).cast("long")).alias("times"), F.col("place"))
        back = F.struct(edge.alias("first"), F.col("upto"), F.col("times"), F.col("whole_place").alias("place"))
        pieces = spans.select("source_no", "start", "block", F.explode(F.array(front, back)).alias("p")).select("source_no", "start", "block", "p.*")
        return pieces.where("first < upto and times > 0")

    def with_texts(self, rows: DataFrame) -> DataFrame:
        """``rows``, which hold the columns that tell documents apart, with the text and the carried columns of each."""
        keys = ["doc_id", "source", "row_hash", "text_hash"]
        texts = self.texts
        repeated = keep(self.placed.where("copies > 1").select(*keys).distinct(), "mix-repeated")
        if repeated.limit(1).count():
            twice = repeated.select(*[F.col(k).alias(f"__{k}") for k in keys])
            same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
            texts = texts.join(small(twice), same, "left_anti").unionByName(texts.join(small(twice), same, "left_semi").dropDuplicates(keys))
        texts = texts.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in texts.columns if c not in keys])
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) if k in ("doc_id", "source") else F.col(k) == F.col(f"__{k}") for k in keys]
        return rows.join(texts, same).drop(*[f"__{k}" for k in keys])


def mix(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, shard, slot`` for every row of ``docs``.

    ``shard`` and ``slot`` are the first place in the output that holds words of the row, null if none does.
    """
    m = Mix(docs, **options)
    taken = m.parts().groupBy("source_no", "start").agg(F.sum((F.col("upto") - F.col("first")) * F.col("times")).alias("taken"), F.min("place").alias("place"))
    taken = taken.withColumn("some", F.lit(True))
    placed = m.placed.withColumn("some", F.col("size") > 0)  # a row without words shares its start with the next one
    out = placed.join(taken, ["source_no", "start", "some"], "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "place.shard", "place.slot")


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of documents for each pass that takes words of a document."""
    for b in batches:
        out = {k: [] for k in ("doc_id", "text", "lang", "source", "n_chars")}
        for r in b.to_pylist():
            pieces = sorted((p["first"], p["upto"], p["times"]) for p in r["pieces"] or ())
            words = None
            for k in range(max((t for *_, t in pieces), default=0)):
                got = [p for p in pieces if p[2] > k]
                if sum(upto - first for first, upto, _ in got) == r["size"]:
                    text = r["text"]
                else:
                    words = words if words is not None else r["text"].encode("utf-8", "surrogatepass").split()
                    text = b" ".join(b" ".join(words[first:upto]) for first, upto, _ in got).decode("utf-8", "surrogatepass")
                for name, v in (("doc_id", r["doc_id"]), ("text", text), ("lang", r["lang"]), ("source", r["source"]), ("n_chars", len(text))):
                    out[name].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), pa.array(out["text"], pa.string()), pa.array(out["lang"], pa.string()), pa.array(out["source"], pa.string()), pa.array(out["n_chars"], pa.int64())], names=list(out))
    release()


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of documents: for each pass, a document with the words that the pass takes of it.

    A document wholly taken keeps its text as it is; of one partly taken, the taken words are joined by spaces. A document
    comes up to three times and drops out only where the mix takes none of its words.
    """
    m = Mix(docs, carry=("lang",), **options)
    pieces = m.parts().groupBy("source_no", "start").agg(F.collect_list(F.struct("first", "upto", "times")).alias("pieces"))
    rows = m.placed.where("size > 0").join(pieces, ["source_no", "start"]).select("doc_id", "source", "row_hash", "text_hash", "size", "pieces")
    rows = m.with_texts(rows).select("doc_id", "text", F.col("lang").cast("string").alias("lang"), "source", "size", "pieces")
    return rows.mapInArrow(_written, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]))


def mixed_blocks(docs: DataFrame, **options) -> DataFrame:
    """The output itself: ``shard, slot, source_no, block, text`` with each block's words, documents in stream order."""
    m = Mix(docs, **options)
    parts = m.parts().select("source_no", "start", "block", "first", "upto").join(m.placed.where("size > 0"), ["source_no", "start"])
    words = m.with_texts(parts.select("source_no", "start", "block", "first", "upto", "doc_id", "source", "row_hash", "text_hash"))
    own = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), (F.col("first") + 1).cast("int"), (F.col("upto") - F.col("first")).cast("int"))
    words = words.select("source_no", "block", "start", "first", own.alias("words"))
    texts = words.groupBy("source_no", "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "first", "words"))), lambda x: x.words)).alias("words"))
    held = F.when(F.col("cut") > 0, F.slice("words", F.lit(1), F.greatest("cut", F.lit(1)).cast("int"))).otherwise(F.col("words"))
    return m.slots.join(texts, ["source_no", "block"]).select("shard", "slot", "source_no", "block", F.array_join(held, " ").alias("text"))
