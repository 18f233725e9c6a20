"""N-gram Jaccard self-join by MinHash banding, with exact verification.

1. One pass over the texts gives each document a 128-bit key of its n-gram set and one hash per band. Documents with equal
   sets form a class; from here on a class is one row, so copies cost nothing more.
2. Band hashes are shuffled: classes that share a (band, hash) form a bucket. Buckets with the same members are kept once,
   the one of the lowest band.
3. The n-gram sets of bucket members only are computed again and written. Each bucket is cut into blocks of bounded size,
   by member hash, and every two blocks meet in one task, which compares all pairs between them on full n-gram sets. Blocks
   grow with their bucket, so a set is shuffled at most ``SHIPPED`` times until the bounds of a block hold. A pair
   (n-grams as 64-bit hashes) counts in the first band that it shares and in no other, so nothing is counted twice and no
   pair leaves the task: what
   leaves is, per member, a number of links and the smallest member it hangs together with.
4. Groups are the connected components of those edges.

Bands and rows are the fewest hashes that find a pair at the threshold with probability ``recall``, among row counts
that keep pairs of half the threshold apart.

Edge cases: null and empty texts have no n-grams, no links, and each is a group of its own; a text of fewer words than n is
one n-gram; repeated rows are copies of each other; null ids are never a class's smallest; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap.llm.runtime import WORD, narrow, packed, prepare, release, unpacked
from quillmap.llm.shingles import many_ngrams, mixed
from quillmap.plans.components import components
from quillmap.plans.storage import keep, small

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
#: Members of a block of a small bucket, about, and how many times that a block of a large one may have; two blocks meet in one task.
BLOCK_MEMBERS = 400
BLOCK_GROWTH = 10
#: N-grams in a block, about.
BLOCK_GRAMS = 2_000_000
#: Blocks that a bucket is cut into before its blocks grow.
SHIPPED = 8
#: Rows of a comparison worked on at a time.
STRIP = 500
#: Stands for a null id in joins.
NO_ID = -(2**63)


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, stray: float = 0.3) -> tuple[int, int]:
    """Bands and rows: fewest hashes with the recall at the threshold and at most ``stray`` at half of it."""
    best = None
    for rows in range(1, 33):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - hit))
        if 1 - (1 - (threshold / 2) ** rows) ** bands <= stray and (best is None or bands * rows < best[0] * best[1]):
            best = (bands, rows)
    return best or (bands, rows)


def signature(grams: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """One hash per band for each set; sets are not empty. Rows of the same number share a permutation seed."""
    keys = mixed(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    salt = mixed(keys)
    out = np.empty((len(grams), bands), np.uint64)
    at = 0
    while at < len(grams):
        end, size = at, 0
        while end < len(grams) and (end == at or size + len(grams[end]) <= 32_768):
            size += len(grams[end])
            end += 1
        flat = np.concatenate(grams[at:end])
        first = np.cumsum([0, *map(len, grams[at : end - 1])])
        room = np.empty_like(flat)
        for b in range(bands):
            h = np.full(end - at, np.uint64(b + 1))
            for r in range(rows):
                np.bitwise_xor(flat, salt[b * rows + r], out=room)
                np.multiply(room, keys[b * rows + r], out=room)
                h = mixed(h ^ np.minimum.reduceat(room, first)) + np.uint64(r)
            out[at:end, b] = h
        at = end
    return out


def _key(grams: bytes) -> bytes | None:
    """128 bits that stand for a sorted set; none for the empty set."""
    return hashlib.blake2b(grams, digest_size=16).digest() if grams else None


def _sketches(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sets = b.column(0), [np.unique(g) for g in many_ngrams(b.column(1).to_pylist(), words)]
            has = np.array([len(s) > 0 for s in sets], bool)
            full = [s for s in sets if len(s)]
            values = signature(full, bands, rows).view(np.int64).ravel() if full else np.zeros(0, np.int64)
            offsets = np.concatenate([[0], np.cumsum(has * bands)]).astype(np.int32)
            keys = [_key(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays([ids, pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["doc_id", "set_key", "n_grams", "bands"])
        release()

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = [np.unique(g).tobytes() for g in many_ngrams(b.column(0).to_pylist(), words)]
            yield pa.RecordBatch.from_arrays([pa.array(map(_key, grams), pa.binary()), pa.array(grams, pa.binary())], names=["rep", "grams"])
        release()

    return run


def n_blocks(members: Column, grams: Column, block_members: int = BLOCK_MEMBERS, block_grams: int = BLOCK_GRAMS) -> Column:
    """How many blocks a bucket is cut into: of ``block_members``, more members where that makes over ``SHIPPED`` blocks."""
    size = F.least(F.lit(float(block_members * BLOCK_GROWTH)), F.greatest(F.lit(float(block_members)), members / SHIPPED))
    return F.greatest(F.ceil(members / size), F.ceil(grams / block_grams)).cast("int")


def overlaps(sets: list[np.ndarray], first: int = 0) -> np.ndarray:
    """Sizes of the intersections of sorted sets: of the first ``first`` with the others, or of all pairs (above the diagonal)."""
    m, top = len(sets), first or len(sets)
    if m == 2:
        n = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[n]] if first else [[0, n], [0, 0]], np.float32)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m, dtype=np.int32), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column, counts = np.cumsum(new, dtype=np.int32) - 1, np.diff(np.concatenate([np.flatnonzero(new), [len(flat)]]))
    held = counts[column]
    out = np.zeros((top, m - first), np.float32)
    # N-grams that few sets hold add to single cells, the others are columns of a product.
    rare = (held > 1) & (held * 16 <= m)
    o, c, away = owner[rare], column[rare], 1
    while len(same := np.flatnonzero(c[away:] == c[:-away])):
        i, j = o[same], o[same + away]
        if first:
            across = (i < first) & (j >= first)
            i, j = i[across], j[across] - first
        np.add.at(out, (i, j), 1)
        away += 1
    common = (held > 1) & ~rare
    owner, column = owner[common], np.unique(column[common], return_inverse=True)[1]
    step = max(1024, 4_000_000 // m)
    for at in range(0, int(column.max()) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, [at, at + step])
        block = np.zeros((m, step), np.float32)
        block[owner[a:b], column[a:b] - at] = 1
        out += block[:top] @ block[first:].T
    return out


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``label`` after the components of each ``i`` and ``j`` have become one, that of the smaller label."""
    root = np.arange(len(label))
    a, b = label[i], label[j]
    while (a != b).any():
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
    return root[label]


def block_links(band: int, first: int, reps: list[bytes], copies: np.ndarray, bands: np.ndarray, sets: list[np.ndarray], threshold: float) -> list[tuple[bytes, int, bytes]]:
    """``(rep, links, root)`` of the members with a link that counts here.

    Links lie between the first ``first`` members and the others, or with 0 between any two.
    """
    m = len(reps)
    both = overlaps(sets, first)
    size = np.array([len(s) for s in sets])
    links, label = np.zeros(m), np.empty(m, np.int64)
    order = sorted(range(m), key=reps.__getitem__)
    label[order] = np.arange(m)
    for at in range(0, len(both), STRIP):
        part = both[at : at + STRIP]
        own = slice(at, at + len(part))
        near = part >= threshold * (size[own, None] + size[None, first:] - part) - 1e-9
        if not first:
            near = np.triu(near, at + 1)
        for k in range(band if near.any() else 0):
            near &= bands[own, k, None] != bands[None, first:, k]
        i, j = np.nonzero(near)
        if len(i):
            i, j = i + at, j + first
            links += np.bincount(i, copies[j], m) + np.bincount(j, copies[i], m)
            label = _joined(label, i, j)
    return [(reps[k], int(links[k]), reps[order[label[k]]]) for k in np.flatnonzero(links)]


def _verified(threshold: float):
    names = ("band", "key", "lo", "hi")

    def group(key, rows):
        band, _, lo, hi = key
        first = 0
        if lo != hi:
            first = sum(r[1] == lo for r in rows)
            if first in (0, len(rows)):
                return []
            rows.sort(key=lambda r: r[1])
        if len(rows) < 2:
            return []
        reps, _, copies, bands, sets = zip(*rows, strict=True)
        return block_links(band, first, list(reps), np.array(copies, np.float64), np.array(bands, np.int64), [np.frombuffer(s, np.uint64) for s in sets], threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []

        def batch():
            rep, links, root = zip(*out, strict=True) if out else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(rep, pa.binary()), pa.array(links, pa.int64()), pa.array(root, pa.binary())], names=["rep", "links", "root"])

        for b in batches:
            keys = list(zip(*(b.column(n).to_pylist() for n in names), strict=True))
            values = list(zip(*(b.column(n).to_pylist() for n in ("rep", "block", "copies", "bands", "grams")), strict=True))
            for k, v in zip(keys, values, strict=True):
                if k != now:
                    if rows:
                        out += group(now, rows)
                    now, rows = k, []
                rows.append(v)
            if out:
                yield batch()
                out = []
        if rows:
            out += group(now, rows)
        yield batch()
        release()

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id, class_id, set_id, n_links`` for every row; ``options`` are those of ``classes``.

    ``class_id`` is the smallest id of the group of linked documents, ``set_id`` the smallest id with the same n-gram set,
    ``n_links`` the number of other rows at the threshold or above.
    """
    return classes(docs, id_col, text_col, **options).select("doc_id", "class_id", "set_id", "n_links")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, block_members: int = BLOCK_MEMBERS, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """As ``near_duplicates``, with ``set_key`` (the key of a row's n-gram set, null for texts without words) and ``leads``.

    ``leads`` is true for the rows of one set of each group: that of the smallest id, of equal ids the one of the smallest key.
    """
    prepare(docs.sparkSession)
    n_bands, n_rows = choose_bands(threshold, recall)
    texts = narrow(docs, id_col, text_col).select("doc_id", F.col(text_col).alias("text"))
    sketches = keep(texts.mapInArrow(_sketches(words, n_bands, n_rows), "doc_id long, set_key binary, n_grams long, bands array<long>"), "sketches")
    own = sketches.where("set_key is not null")
    sets = keep(own.groupBy(F.col("set_key").alias("rep")).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands")), "sets")
    spread = sets.select("rep", "n_grams", F.posexplode("bands").alias("band", "key"))
    prints = F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("f1"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("f2")
    buckets = spread.groupBy("band", "key").agg(F.count(F.lit(1)).alias("m"), F.sum("n_grams").alias("grams"), *prints).where("m > 1")
    once = buckets.groupBy("m", "f1", "f2").agg(F.min(F.struct("band", "key")).alias("b"), F.first("grams").alias("grams"))
    once = keep(once.select("b.band", "b.key", n_blocks(F.col("m"), F.col("grams"), block_members, block_grams).alias("n_blocks")), "buckets")
    members = spread.select("rep", "band", "key").join(once, ["band", "key"])
    members = keep(members.select("band", "key", "n_blocks", "rep", F.pmod(F.xxhash64("rep", F.lit(2)), F.col("n_blocks")).cast("int").alias("block")), "members")
    # The texts of one document of each wanted set; a repeated id may bring other texts along, which the join on the set drops.
    wanted = sets.join(members.select("rep").distinct(), "rep", "left_semi").select(F.coalesce("first_id", F.lit(NO_ID)).alias("id"))
    grams = texts.join(wanted, F.coalesce("doc_id", F.lit(NO_ID)) == F.col("id"), "left_semi").select("text").mapInArrow(_sets(words), "rep binary, grams binary")
    grams = keep(grams.dropDuplicates(["rep"]).join(sets.select("rep", "copies", "bands"), "rep"), "grams")
    meets = members.select("band", "key", "rep", "block", F.explode(F.expr("sequence(0, n_blocks - 1)")).alias("other"))
    meets = meets.select("band", "key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "rep", "block")
    told = meets.join(grams, "rep").repartition("band", "key", "lo", "hi").sortWithinPartitions("band", "key", "lo", "hi")
    told = told.select("band", "key", "lo", "hi", "rep", "block", "copies", "bands", "grams")
    links = keep(told.mapInArrow(_verified(threshold), "rep binary, links long, root binary"), "links")
    linked = links.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(links.where("rep <> root"), "rep", "root").withColumnRenamed("node", "rep")
    named = sets.select("rep", "first_id", "copies").join(linked, "rep", "left").join(groups, "rep", "left")
    named = keep(named.select("rep", "first_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("label", "rep").alias("label")), "linked")
    order = F.struct(F.col("first_id").isNull(), "first_id", "rep")
    least = named.groupBy("label").agg(F.min("first_id").alias("class_id"), F.min_by("rep", order).alias("lead"))
    named = named.join(least, "label").select(F.col("rep").alias("set_key"), F.col("first_id").alias("set_id"), "n_links", "class_id", (F.col("rep") == F.col("lead")).alias("leads"))
    named = keep(named, "classes")
    out = sketches.select("doc_id", "set_key").join(named, "set_key", "left")
    alone = F.col("set_key").isNull()
    ids = [F.when(alone, F.col("doc_id")).otherwise(F.col(c)).alias(c) for c in ("class_id", "set_id")]
    return out.select("doc_id", *ids, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "set_key", F.coalesce("leads", F.lit(True)).alias("leads"))


def _keys(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [_key(np.unique(g).tobytes()) for g in many_ngrams(b.column(2).to_pylist(), words)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.binary())], names=["__key_id", "__key_sha", "__set"])
        release()

    return run


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, **options) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id. All columns stay.

    Rows without an id and texts without words stay. Rows go by their id, so that only ids are joined. The rows of an id that
    repeats, of which some stay, are told apart by their n-gram sets; of those with one id and one set one stays, that of the
    smallest text hash.
    """
    found = classes(docs, id_col, text_col, words=words, **options).where("doc_id is not null")
    found = found.select("doc_id", "set_key", (F.col("set_key").isNull() | (F.col("leads") & (F.col("doc_id") == F.col("class_id")))).alias("stays"))
    found = keep(found, "verdicts")
    marks = keep(found.groupBy(F.col("doc_id").alias("__id")).agg(F.max("stays").alias("some"), F.count(F.lit(1)).alias("n")).where("not some or n > 1"), "marks")
    own, text, rows = F.col("__own"), F.col("__row")[text_col], packed(docs, id_col)
    if marks.where("some").limit(1).count() == 0:
        return unpacked(rows.join(marks.select("__id"), own == F.col("__id"), "left_anti"))
    clear = rows.join(small(marks.select("__id")), own == F.col("__id"), "left_anti")
    repeated = rows.join(small(marks.where("some").select("__id")), own == F.col("__id"), "left_semi")
    has_words = F.coalesce(text.rlike(WORD), F.lit(False))
    told = repeated.where(has_words).withColumn("__sha", F.sha2(text.cast("binary"), 256)).dropDuplicates(["__own", "__sha"])
    keys = told.select("__own", "__sha", text.alias("text")).mapInArrow(_keys(words), "__key_id long, __key_sha string, __set binary")
    leading = found.where("stays and set_key is not null").select(F.col("doc_id").alias("__key_id"), F.col("set_key").alias("__set")).distinct()
    chosen = keys.join(leading, ["__key_id", "__set"]).groupBy("__key_id", "__set").agg(F.min("__key_sha").alias("__key_sha")).drop("__set")
    once = told.join(chosen, (own == F.col("__key_id")) & (F.col("__sha") == F.col("__key_sha")), "left_semi").drop("__sha")
    return unpacked(clear.unionByName(repeated.where(~has_words)).unionByName(once))
