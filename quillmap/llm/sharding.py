"""Sharding by extendible hashing: a directory indexed by hash-prefix bits; only oversized buckets split on.

Every document has a 60-bit hash of its id. The directory starts with one bucket of no bits. A bucket over the byte limit
splits on the next bit, its halves again, until each fits or holds one document. Sixteen bits are settled at a time: sums
per 16-bit prefix are built with map-side sums, their parent prefixes are added up from them, and a prefix takes the
shortest parent that fits. Only documents of prefixes still too large enter the next round, so small corpora take one
round and 100 TB takes two; there are four at most.

Rows that agree in all 60 bits are repeats of one id. If together they exceed the limit, they are numbered (per input
task, with offsets from a sum over tasks, so no task sees them all) and packed into sub-shards by number.

Edge cases: a null text has 0 bytes, a null id hashes as an empty text; a single document over the limit is a shard of its
own; repeated rows are placed one by one; an empty table gives an empty result; extra columns are ignored. No Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmap.llm.runtime import free_name, narrow, packed
from quillmap.plans.storage import keep, small

HASH_BITS = 60
ROUND_BITS = 16
#: Bytes of text that a shard may hold.
SHARD_BYTES = 16 << 20


def id_hash(doc_id: Column) -> Column:
    """The first 60 bits of the MD5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _shards(rows: DataFrame, done: int, limit: int) -> DataFrame:
    """For each prefix of ``done + ROUND_BITS`` bits (``fine``): its bucket, which is the shortest that fits."""
    bits = min(HASH_BITS, done + ROUND_BITS)
    fine = rows.groupBy(F.shiftright("h", HASH_BITS - bits).alias("fine")).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n"))
    fine = keep(fine, "prefixes")
    levels = fine.select("fine", "b", "n", F.explode(F.sequence(F.lit(done), F.lit(bits))).alias("depth"))
    levels = levels.withColumn("prefix", F.expr(f"shiftright(fine, {bits} - depth)"))
    sums = levels.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
    fits = sums.where((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1))
    found = levels.select("fine", "depth", "prefix").join(fits, ["depth", "prefix"])
    found = found.groupBy("fine").agg(F.min(F.struct("depth", "prefix", "shard_bytes", "shard_docs")).alias("s"))
    return keep(fine.select("fine").join(found, "fine", "left").select("fine", "s.*"), "directory")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """``doc_id, n_bytes, shard, depth, shard_bytes, shard_docs`` for every row; ``shard`` is the bucket's prefix in bits.

    A shard of no bits is called ``-``; sub-shards of one repeated id end in ``.0``, ``.1`` and so on.
    """
    rows = narrow(docs, id_col, text_col).select("doc_id", F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), id_hash(F.col("doc_id")).alias("h"))
    rows, done, parts = keep(rows, "sizes"), 0, []
    while done < HASH_BITS:
        bits = min(HASH_BITS, done + ROUND_BITS)
        directory = _shards(rows, done, limit)
        near = rows.withColumn("fine", F.shiftright("h", HASH_BITS - bits)).join(small(directory), "fine")
        parts.append(near.where("depth is not null"))
        done = bits
        if directory.where("depth is null").limit(1).count() == 0:
            break
        rows = near.where("depth is null").select("doc_id", "n_bytes", "h")
    else:
        parts.append(_packed(rows, limit))
    name = F.when(F.col("depth") == 0, F.lit("-")).otherwise(F.expr("lpad(conv(prefix, 10, 2), depth, '0')"))
    out = None
    for p in parts:
        label = F.concat_ws(".", name, F.col("sub").cast("string")) if "sub" in p.columns else name
        p = p.select("doc_id", "n_bytes", label.alias("shard"), F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_docs")
        out = p if out is None else out.unionByName(p)
    return out


def _packed(rows: DataFrame, limit: int) -> DataFrame:
    """Repeats of one id that together exceed the limit, numbered and cut where the running bytes pass it.

    A sub-shard is numbered by whole multiples of the count of the largest of its rows that fit, so none is over the limit
    unless a single row is.
    """
    rows = keep(rows.withColumn("task", F.spark_partition_id()), "repeats")
    most = rows.groupBy("h").agg(F.max("n_bytes").alias("largest"))
    tasks = rows.groupBy("h", "task").agg(F.count(F.lit(1)).alias("n"))
    before = tasks.select("h", "task", (F.sum("n").over(W.partitionBy("h").orderBy("task")) - F.col("n")).alias("before"))
    numbered = rows.withColumn("at", F.row_number().over(W.partitionBy("h", "task").orderBy("n_bytes")))
    numbered = numbered.join(before, ["h", "task"]).join(most, "h")
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("largest"), F.lit(1)))).cast("long")
    subs = numbered.withColumn("sub", F.floor((F.col("before") + F.col("at") - 1) / each).cast("long"))
    subs = keep(subs.select("doc_id", "n_bytes", "h", "sub"), "subs")
    sums = subs.groupBy("h", "sub").agg(F.sum("n_bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_docs"))
    return subs.join(sums, ["h", "sub"]).select("doc_id", "n_bytes", "sub", F.lit(HASH_BITS).alias("depth"), F.col("h").alias("prefix"), "shard_bytes", "shard_docs")


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = SHARD_BYTES) -> None:
    """``docs`` written with one folder and one file per shard; as a shard fits the limit, one task writes it. Ids are taken as unique.

    Folders are named by a column ``shard``; where ``docs`` has one, by ``shard_``.
    """
    name = free_name("shard", docs)
    where = shard(docs, id_col, text_col, limit).select(F.col("doc_id").alias("__id"), F.col("shard").alias("__shard")).distinct()
    rows = packed(docs, id_col).join(where, F.col("__own").eqNullSafe(F.col("__id"))).select("__row.*", F.col("__shard").alias(name))
    rows.repartition(name).write.partitionBy(name).parquet(path)
