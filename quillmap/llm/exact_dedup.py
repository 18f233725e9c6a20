"""Exact deduplication: group by a 128-bit content hash, compare bytes inside groups, keep the smallest id.

Shape of the plan
-----------------
1. One narrow row per document (id, row number, MD5, SHA-256 of the normalised text) is written to the shared folder.
2. Groups form by MD5 with map-side sums, so a text that makes up a third of all rows costs one row per task.
3. Texts whose hash occurs more than once, and only those, are shuffled once by (MD5, text). Grouping on the text itself
   compares bytes, and copies collapse on the map side. A hash shared by different bytes falls into several variants,
   told apart by their SHA-256.
4. The narrow rows join their variant on one key; Spark splits a hot key at run time, as both sides are plain shuffles.

Edge cases: a null text counts as empty; empty texts are copies of each other; of rows that repeat id and text one stays
(the first written); a null id sorts before all others; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap.llm.runtime import SPACES, narrow, packed, unpacked
from quillmap.plans.storage import keep, small


def md5_bytes(norm: Column) -> Column:
    return F.unhex(F.md5(norm.cast("binary")))


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, content_hash: Callable[[Column], Column]) -> DataFrame:
    rows = narrow(docs, id_col, text_col).select("doc_id", F.monotonically_increasing_id().alias("row"), normalised(F.col(text_col)).alias("norm"))
    return keep(rows.select("doc_id", "row", content_hash(F.col("norm")).alias("h"), F.sha2(F.col("norm").cast("binary"), 256).alias("sha")), "fingerprints")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash: Callable[[Column], Column] = md5_bytes) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row; ``content_hash`` is replaceable for tests."""
    prints = fingerprints(docs, id_col, text_col, content_hash)
    groups = prints.groupBy("h", "sha").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("group_size"))
    groups = keep(groups, "groups")
    shared = keep(groups.groupBy("h").agg(F.sum("group_size").alias("n")).where("n > 1").select("h"), "shared")
    texts = docs.select(normalised(F.col(text_col)).alias("norm")).select(content_hash(F.col("norm")).alias("h"), "norm")
    texts = texts.join(small(shared), "h", "left_semi")
    variants = texts.groupBy("h", "norm").agg(F.count(F.lit(1)).alias("n")).select("h", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), "n")
    # Bytes that differ while both hashes agree can't be told apart further on: then the job stops.
    proven = variants.groupBy("h", "sha").agg(F.sum("n").alias("proven"), F.count(F.lit(1)).alias("texts"))
    proven = proven.select("h", "sha", F.when(F.col("texts") == 1, F.col("proven")).otherwise(F.raise_error(F.lit("two texts share both hashes")).cast("long")).alias("proven"))
    key = F.concat(F.col("h"), F.unhex("sha")).alias("key")
    keepers = groups.select(key, "first", F.col("group_size"), "h", "sha").join(proven, ["h", "sha"], "left")
    # group_size is what the comparison of bytes has counted; a hash that occurs once needs none.
    keepers = keep(keepers.select("key", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), F.coalesce("proven", "group_size").alias("group_size")), "keepers")
    rows = prints.select("doc_id", "row", key, F.col("sha").alias("text_sha256"))
    return rows.join(keepers, "key").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` drops; all columns stay.

    Rows go by their id, so that only ids are joined and no text is hashed again. Ids that hold rows of both kinds, and null
    ids, are told apart by the text's hash; of rows that repeat an id and its text one stays.
    """
    found = keep(exact_dedup(docs, id_col, text_col).select("doc_id", "kept", "text_sha256"), "verdicts")
    marks = found.where("doc_id is not null").groupBy("doc_id").agg(F.min("kept").alias("all"), F.max("kept").alias("some"))
    marks = keep(marks.where("not all").select(F.col("doc_id").alias("__id"), F.col("some").alias("mixed")), "dropped")
    own, rows = F.col("__own"), packed(docs, id_col)
    stay = rows.where(own.isNotNull()).join(small(marks.select("__id")), own == F.col("__id"), "left_anti")
    mixed = small(marks.where("mixed").select("__id"))
    unclear = rows.where(own.isNotNull()).join(mixed, own == F.col("__id"), "left_semi").unionByName(rows.where(own.isNull()))
    unclear = unclear.withColumn("__sha", F.sha2(normalised(F.col("__row")[text_col]).cast("binary"), 256))
    kept = found.where("kept").join(mixed.withColumnRenamed("__id", "__mixed"), F.col("doc_id") == F.col("__mixed"), "left_semi").unionByName(found.where("kept and doc_id is null"))
    kept = small(keep(kept.select(F.col("doc_id").alias("__kept"), F.col("text_sha256").alias("__of")), "kept-of-unclear"))
    once = unclear.join(kept, own.eqNullSafe(F.col("__kept")) & (F.col("__sha") == F.col("__of")), "left_semi")
    return unpacked(stay.unionByName(once.dropDuplicates(["__own", "__sha"]).drop("__sha")))
