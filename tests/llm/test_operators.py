"""Small fixtures with nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""

import hashlib
import json
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmap.llm import bpe, exact_dedup, html_extract, jaccard_join, language_id, mixing, quality_classifier, quality_rules, sharding, shingles, token_counts
from quillmap.llm.queries import VOCABULARY

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, rep long, size string, band int, words string, row string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{k % 977}x{k % 13}" for k in range(30_000))
TEXTS = [
    (1, "the cat sat on the mat\nthe cat sat on the mat\n\n and more"),
    (2, "the  cat sat\ton the mat\nthe cat sat on the mat\n\n and more"),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, LONG),
    (7, LONG + " end"),
    (8, "a b c d e f g h i j k l m n o p q r s t u v w x y z"),
    (9, "a b c d e f g h i j k l m n o p q r s t u v w x y Z"),
    (10, "one two"),
    (10, "one two"),
    (11, "one two"),
    (None, "a text without an id"),
    (12, "x!! y!! | ### $$ z<|endoftext|>w É ẞ Σ don't"),
    (-5, "the cat sat on the mat\nthe cat sat on the mat\n\n and more"),
]


def rows_of(texts):
    return [(i, t, "en" if k % 2 else None, ("b", "a", None)[k % 3], None, "x", 1, "y", 2, "z", "q") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(TEXTS), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def table(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


# exact dedup


def brute_dedup(rows):
    low, count = {}, Counter()
    for i, t in rows:
        k = norm(t)
        count[k] += 1
        order = (i is not None, i or 0)
        low[k] = min(low.get(k, order), order)
    return Counter((i, low[norm(t)][1] if low[norm(t)][0] else None, count[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows), len(low)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(docs, weak):
    weak_hash = lambda c: F.unhex(F.substring(F.md5(c.cast("binary")), 1, 1))
    got = exact_dedup.exact_dedup(docs, **({"content_hash": weak_hash} if weak else {})).collect()
    want, groups = brute_dedup(TEXTS)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == groups
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_dedup_empty_and_drop(docs, none):
    assert exact_dedup.exact_dedup(none).count() == 0
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert len({norm(r.text) for r in kept.collect()}) == kept.count() == brute_dedup(TEXTS)[1]
    # an id with a copy of another's text, a text of its own, and that one twice; null ids with and without copies
    odd = TEXTS + [(8, "one two"), (8, "own text"), (8, "own text"), (None, "one two"), (None, "null's own"), (None, "null's own"), (20, "null's own")]
    kept = exact_dedup.drop_copies(docs.sparkSession.createDataFrame(rows_of(odd), SCHEMA).repartition(3)).collect()
    first = {}
    for i, t in odd:
        first[norm(t)] = min(first.get(norm(t), (True, 1 << 60)), (i is not None, i or 0))
    assert Counter((r.doc_id, norm(r.text)) for r in kept) == Counter((i if known else None, t) for t, (known, i) in first.items())


# n-gram Jaccard join


def grams(t):
    w = WORD.findall(t or "")
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_near(rows):
    sets = [grams(t) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) * 10 >= 8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(find(k), []).append(i)
    return Counter((rows[k][0], min((i for i in ids[find(k)] if i is not None), default=None), links[k]) for k in range(len(rows)))


def near_copies(n=60):
    rng = np.random.default_rng(1)
    base = [f"t{x}" for x in rng.integers(0, 5000, 120)]
    out = []
    for k in range(n):
        w = list(base)
        for x in rng.integers(0, len(w), rng.integers(1, 5)):
            w[x] = f"n{k}-{x}"
        out.append((100 + k, " ".join(w)))
    return out


@pytest.mark.parametrize("members", [400, 8])
def test_near_duplicates(spark, members):
    rows = TEXTS + near_copies()
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows_of(rows), SCHEMA).repartition(3), block_members=members).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == brute_near(rows)


def test_near_duplicates_table(table):
    rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    got = jaccard_join.near_duplicates(table).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == brute_near(rows)


def test_near_duplicates_empty(docs, none):
    assert jaccard_join.near_duplicates(none).count() == 0
    assert jaccard_join.one_of_each(docs).columns == docs.columns
    assert {r.doc_id for r in jaccard_join.one_of_each(docs).collect()} >= {None, -5, 3, 4, 5, 6, 8, 10}


def test_one_of_each_tells_rows_of_a_repeated_id_apart(spark):
    near, other = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(1, near), (2, near + " end"), (2, other), (2, other), (2, "  " + other), (3, other + " end"), (4, near + " end"), (4, near), (5, ""), (5, None), (5, near), (None, near), (6, "alone in this table"), (7, other.replace("b1 ", "c1 "))]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, rep string")
    for table in (docs, docs.withColumn("set_key", F.lit(1)).repartition(5)):
        got = jaccard_join.one_of_each(table).select("doc_id", F.trim("text").alias("text")).collect()
        assert sorted(got, key=str) == sorted([(1, near), (2, other), (5, ""), (5, None), (None, near), (6, "alone in this table")], key=str)


@pytest.mark.parametrize("m", [2, 3, 40, 700])
def test_overlaps_and_links_of_blocks(m):
    rng = np.random.default_rng(m)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    # Some n-grams are in nearly all sets, some in a few, some in one.
    sets = [np.unique(np.concatenate([base[rng.random(60) < 0.95], rng.integers(0, 4 * m, 6).astype(np.uint64), rng.integers(0, 2**63, 2).astype(np.uint64)])) for _ in range(m)]
    plain = [set(s.tolist()) for s in sets]
    bands = rng.integers(0, 3, (m, 4))
    copies, reps = rng.integers(1, 4, m).astype(float), [rng.bytes(16) for _ in range(m)]
    for first in (0, 1, m // 2):
        pairs = [(i, j) for i in range(first or m) for j in range(first or i + 1, m)]
        got = jaccard_join.overlaps(sets, first)
        assert all(got[i, j - first] == len(plain[i] & plain[j]) for i, j in pairs)
        links, root = Counter(), {r: {r} for r in reps}
        for i, j in pairs:
            if len(plain[i] & plain[j]) >= 0.8 * len(plain[i] | plain[j]) and not (bands[i, :2] == bands[j, :2]).any():
                links[reps[i]] += int(copies[j])
                links[reps[j]] += int(copies[i])
                if root[reps[i]] is not root[reps[j]]:
                    both = root[reps[i]] | root[reps[j]]
                    root.update(dict.fromkeys(both, both))
        want = sorted((r, n, min(root[r])) for r, n in links.items())
        assert sorted(jaccard_join.block_links(2, first, reps, copies, bands, sets, 0.8)) == want


def test_blocks_of_large_buckets_grow(spark):
    sizes = spark.createDataFrame([(2, 400), (400, 80_000), (900, 90_000), (5_000, 1_500_000), (30_000, 3_000_000), (10, 9_000_000)], "m long, grams long")
    got = [r.n for r in sizes.select(jaccard_join.n_blocks(F.col("m"), F.col("grams")).alias("n")).collect()]
    assert got == [1, 1, 3, 8, 8, 5]


def test_bands_and_ngrams():
    bands, rows = jaccard_join.choose_bands()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999
    a, b = shingles.many_ngrams(["x y z", LONG], 5)
    assert len(a) == 1 and len(b) == 30_000 - 4 and len(np.unique(b)) == len(grams(LONG))
    old, shingles.SLICE = shingles.SLICE, 64
    try:
        assert (next(shingles.many_ngrams([LONG], 5)) == b).all()
    finally:
        shingles.SLICE = old


# BPE


def test_bpe_like_the_library(docs, none, table):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    odd = ["'’s don't we'LL éx é x y 漢字かな 😀 123 <|startoftext|><|endoftext|>", "a" * 3000, "\x00\x1f\x85 \x1c", "ǅ ŉ ß ẞ", "x̣́ 가각 ½²", "qzx jqv", "ΣΑΣ İ", "!!!'s"]
    texts = [(i, x) for i, x in TEXTS if i is not None] + [(1000 + k, x) for k, x in enumerate(odd)]
    frame = docs.sparkSession.createDataFrame(rows_of(texts), SCHEMA).unionByName(table.limit(50), allowMissingColumns=True)
    want = {}
    for r in frame.select("doc_id", "text").collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        want.setdefault(r.doc_id, set()).add((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    got = {}
    for r in bpe.digests(frame, VOCABULARY).collect():
        got.setdefault(r.doc_id, set()).add((r.n_tokens, r.ids_sha256, r.decoded_sha256))
    assert got == want
    assert bpe.digests(none, VOCABULARY).count() == 0


def test_bpe_every_character():
    from tokenizers import Tokenizer

    t, b = Tokenizer.from_file(VOCABULARY), bpe.ForcedBoundaryBpe(bpe.vocabulary(VOCABULARY))
    chars = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    for text in ([f"a{c}B" for c in chars], [f"{c} {c}{c}" for c in chars]):
        for at in range(0, len(text), 20_000):
            some = text[at : at + 20_000]
            got = [b.split(x) for x in some]
            b.learn(set().union(*got))
            want = t.encode_batch(some, add_special_tokens=False)
            assert [x for x, p, e in zip(some, got, want, strict=True) if b.numbers(p).tolist() != e.ids] == []


def test_bpe_refuses_other_rules():
    spec = json.loads(bpe.vocabulary(VOCABULARY))
    for flag in ("lstrip", "rstrip", "single_word", "normalized"):
        spec["added_tokens"][0][flag] = True
        with pytest.raises(ValueError):
            bpe.ForcedBoundaryBpe(json.dumps(spec))
        spec["added_tokens"][0][flag] = False
    spec["added_tokens"].append(spec["added_tokens"][0] | {"content": "[END]", "id": 49408})
    assert 49408 in bpe.ForcedBoundaryBpe(json.dumps(spec)).encode("x[END]y")


def test_bpe_round_trip(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    got = bpe.decoded(bpe.encoded(docs, VOCABULARY), VOCABULARY).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert r.n_tokens == len(r.ids) and r.decoded == t.decode(r.ids, skip_special_tokens=False)
    odd = docs.sparkSession.createDataFrame([(1, [5, 99_999, 7]), (2, None), (3, []), (4, [5, None, 7]), (5, [-1])], "k int, ids array<int>")
    back = {r.k: r.decoded for r in bpe.decoded(odd, VOCABULARY).collect()}
    assert back == {1: t.decode([5, 99_999, 7]), 2: None, 3: "", 4: t.decode([5, 7]), 5: ""}


def test_forced_cuts_are_certain():
    b = bpe.ForcedBoundaryBpe(bpe.vocabulary(VOCABULARY))
    spec = json.loads(bpe.vocabulary(VOCABULARY))
    chars = {c: k for k, c in enumerate(bpe.byte_chars())}
    for token in list(spec["model"]["vocab"])[::97]:
        raw = [chars[c] for c in token.removesuffix("</w>")]
        assert all(b.inside[x, y] for x, y in zip(raw, raw[1:], strict=False))
    assert b.cuts("qzxjqv") != [b"qzxjqv"]


# token counts


@pytest.fixture
def blocks_of(spark):
    """Sets the reader's block size for a test."""
    names = {"spark.sql.files.maxPartitionBytes": None, "spark.sql.files.openCostInBytes": "0"}
    was = {k: spark.conf.get(k) for k in names}

    def use(n):
        for k, v in names.items():
            spark.conf.set(k, v or f"{n}b")

    yield use
    for k, v in was.items():
        spark.conf.set(k, v)


def test_token_counts(docs, none, blocks_of):
    want = Counter((r.doc_id, r.n_tokens) for r in bpe.encoded(docs, VOCABULARY, special_as_text=True).collect())
    for block in (50_001, 1 << 27):
        blocks_of(block)
        got = token_counts.token_counts(docs, VOCABULARY).collect()
        assert Counter((r.doc_id, r.n_tokens) for r in got) == want
    assert token_counts.token_counts(none, VOCABULARY).count() == 0


def test_scan_without_heads(spark, tmp_path, blocks_of):
    """Files with line feeds at every place of a token, the separator's bytes across tokens, and open ends."""
    rng = np.random.default_rng(2)
    want, end = Counter(), token_counts.END
    for f in range(6):
        ids = rng.choice([5, 0x0A0A, 0x0A05, 0x050A, 0x05C2, 0x8005, end], 4000 + f)
        if f == 3:
            ids[-1] = 0x050A
        (tmp_path / f"f{f}.bin").write_bytes(ids.astype(">u2").tobytes() + (b"x" if f == 4 else b""))
        run = []
        for part in "".join("|" if x == end else "t" for x in ids).split("|"):
            run.append(len(part))
        if run[-1] == 0:
            run.pop()
        want.update((f"f{f}.bin", k, n) for k, n in enumerate(run))
    (tmp_path / "empty.bin").write_bytes(b"")
    for block in (1999, 1 << 27):
        blocks_of(block)
        got = token_counts.scan(spark, str(tmp_path), heads=0).collect()
        assert Counter((r.file.rsplit("/", 1)[-1], r.ordinal, r.n_tokens) for r in got) == want
    lines = spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions()
    blocks_of(1999)
    assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() >= 4 * lines


def test_scan_refuses_lost_bytes(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"\xef\xbb\xbf\x05" + token_counts.END.to_bytes(2, "big"))
    with pytest.raises(Exception, match="not read"):
        token_counts.scan(spark, str(tmp_path), heads=0).collect()


# quality rules


def brute_rules(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    hit = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w))


def test_quality_rules(docs, none, table):
    frame = docs.unionByName(table, allowMissingColumns=True).select("doc_id", "text").withColumn("words", F.lit(1))
    texts = Counter((r.doc_id, *brute_rules(r.text)) for r in frame.collect())
    got = quality_rules.quality_rules(frame).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == texts
    assert not any(r.kept for r in got if r.base_failed) and any(r.kept for r in got)
    assert quality_rules.quality_rules(none).count() == 0
    plan = quality_rules.quality_rules(table)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# sharding


def test_sharding(docs, none, table):
    rows = [(r.doc_id, len((r.text or "").encode())) for r in table.collect()]
    got = {r.doc_id: r for r in sharding.shard(table, limit=20_000).collect()}
    assert len(got) == len(rows)
    sums, members = Counter(), Counter()
    for i, n in rows:
        bits = bin(int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16))[2:].zfill(60)
        assert got[i].n_bytes == n and (got[i].shard == "-" or bits.startswith(got[i].shard)) and got[i].depth == len(got[i].shard.strip("-"))
        sums[got[i].shard] += n
        members[got[i].shard] += 1
    for r in got.values():
        assert r.shard_bytes == sums[r.shard] and r.shard_docs == members[r.shard] and (r.shard_bytes <= 20_000 or r.shard_docs == 1)
        if r.depth:  # the parent did not fit
            assert sum(n for s, n in sums.items() if s.startswith(r.shard[:-1])) > 20_000
    assert sharding.shard(none).count() == 0
    assert sharding.shard(docs).count() == len(TEXTS)


def test_written_shards(spark, tmp_path):
    rows = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), (F.col("id") % 40).cast("int")).alias("text"), F.lit(1).alias("depth"))
    rows = rows.unionByName(spark.createDataFrame([(None, "no id", 2), (900, None, 3)], "doc_id long, text string, depth int")).repartition(6)
    sharding.write_shards(rows, str(tmp_path / "out"), limit=4_000)
    back = spark.read.parquet(str(tmp_path / "out")).select("doc_id", "text", "depth")
    assert back.exceptAll(rows).count() == 0 and rows.exceptAll(back).count() == 0
    folders = list((tmp_path / "out").glob("shard=*"))
    assert len(folders) > 5 and all(len(list(f.glob("*.parquet"))) == 1 for f in folders)


def test_sharding_of_one_repeated_id(spark):
    rows = spark.range(90).select(F.lit(7).cast("long").alias("doc_id"), F.repeat(F.lit("x"), 10 + (F.col("id") % 3).cast("int")).alias("text")).repartition(5)
    got = sharding.shard(rows, limit=100).collect()
    assert len(got) == 90 and all(r.shard_bytes <= 100 for r in got) and len({r.shard for r in got}) > 9


# mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    done = {}
    while True:
        free = [s for s in order if s not in done]
        left = sum(sizes.values()) - sum(done.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: 3.0 * sizes[s] for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return done | share
        done |= over


def brute_taken(m):
    """Words taken of each placed row, block by block and word by word, from the slots."""
    owner = {}
    for k, r in enumerate(m.placed.collect()):
        for w in range(r.start, r.start + r.size):
            assert (r.source_no, w) not in owner
            owner[r.source_no, w] = (k, r.doc_id, r.size)
    sizes = {x[0]: x[2] for x in m.summary}
    assert Counter(s for s, _ in owner) == Counter({s: n for s, n in sizes.items() if n})
    taken = Counter()
    for r in m.slots.collect():
        for w in range(r.block * m.block_words, min(r.block * m.block_words + (r.cut or m.block_words), sizes[r.source_no])):
            taken[owner[r.source_no, w]] += 1
    return Counter((i, n, t) for (_, i, n), t in taken.items())


def test_mixing(docs, none, table):
    repeated = docs.unionByName(docs.where("doc_id is null or doc_id = 8")).unionByName(docs.where("doc_id = 10").withColumn("text", F.lit("other words here")))
    for frame in (table, repeated):
        got = mixing.mix(frame).collect()
        sizes, taken = Counter(), Counter()
        for r in frame.select("doc_id", "source", "text").collect():
            sizes[r.source] += len(WORD.findall(r.text or ""))
        want = brute_targets(sizes)
        assert Counter((r.doc_id, r.source) for r in got) == Counter((r.doc_id, r.source) for r in frame.collect())
        for r in got:
            taken[r.source] += r.taken
            assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size and (r.shard is None) == (r.taken == 0)
        assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
        assert sorted(map(str, got)) == sorted(map(str, mixing.mix(frame.repartition(7)).collect()))
        assert Counter((r.doc_id, r.size, r.taken) for r in got if r.taken) == brute_taken(mixing.Mix(frame))
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0 and mixing.mixed_blocks(none).count() == 0


def test_mixing_many_groups(spark):
    """Small shards and groups, so that draws, prefix sums and passes go over several tasks."""
    rows = [(k % 50 if k % 7 else None, f"w{k} " * (k % 90), None, ("s", "t", None, "u")[k % 4], 0) for k in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    options = {"block_words": 8, "shard_slots": 16, "group_shards": 4}
    got = mixing.mix(frame, **options).collect()
    m = mixing.Mix(frame, **options)
    assert Counter((r.doc_id, r.size, r.taken) for r in got if r.taken) == brute_taken(m)
    slots = m.slots.collect()
    assert len({r.shard for r in slots}) > 100 and len({(r.shard, r.slot) for r in slots}) == len(slots) and all(r.slot < 16 for r in slots)
    for s, n in enumerate(m.due[0].tolist()):
        draws = sorted((r.draw, r.block) for r in slots if r.source_no == s)
        assert [d for d, _ in draws] == list(range(len(draws))) and len(draws) <= 3 * n
        for k in range(0, len(draws), n):
            assert len({b for _, b in draws[k : k + n]}) == len(draws[k : k + n])
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(frame.repartition(3), **options).collect()))


def test_shards_follow_the_draw(table):
    """Another seed draws otherwise, shard by shard; what a source gives in all is its target."""
    shards = []
    for seed in (1, 2):
        m = mixing.Mix(table, seed=seed, shard_slots=32, group_shards=8)
        slots = m.slots.collect()
        shards.append(Counter((r.shard, r.source_no) for r in slots))
        assert Counter(r.source_no for r in slots) == Counter({k: int(n) for k, n in enumerate(m.due[1]) if n})
    assert shards[0] != shards[1] and len(set(shards[0].values())) > 5


def test_mixing_meets_small_sources(spark):
    """997 sources of about a dozen words, and three of one row: each comes within a word of its target."""
    rows = [(k, "w " * (5 + k % 15), None, f"s{k % 997:03}", 0) for k in range(1200)]
    for some in (rows, [(1, "a b c", None, "x", 0), (2, "a b", None, "y", 0), (3, "a", None, None, 0), (4, "", None, "z", 0)]):
        frame = spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        want, taken = {}, Counter()
        got = mixing.mix(frame).collect()
        for r in got:
            want[r.source] = r.target
            taken[r.source] += r.taken
            assert r.taken <= 3 * r.size
        assert all(abs(taken[s] - t) <= 0.5 for s, t in want.items())
        words = Counter()
        for r in mixing.mixed_documents(frame).collect():
            words[r.source] += len(WORD.findall(r.text))
        assert words == +taken
        assert sum(len(WORD.findall(r.text)) for r in mixing.mixed_blocks(frame).collect()) == sum(taken.values())


def test_mixed_documents_and_blocks(table, docs):
    for frame in (table, docs.unionByName(docs.where("doc_id is null or doc_id = 6"))):
        taken = Counter()
        for r in mixing.mix(frame, carry=("lang",)).collect():
            taken[r.doc_id] += r.taken
        words, times = Counter(), Counter()
        for r in mixing.mixed_documents(frame).collect():
            words[r.doc_id] += len(WORD.findall(r.text))
            times[r.doc_id] += 1
            assert r.n_chars == len(r.text)
        assert words == Counter({i: n for i, n in taken.items() if n})
        blocks = mixing.mixed_blocks(frame).collect()
        assert sum(len(WORD.findall(b.text)) for b in blocks) == sum(words.values())
        assert len({(b.shard, b.slot) for b in blocks}) == len(blocks)
        texts = " ".join(r.text for r in frame.where("text is not null").collect())
        held = set(WORD.findall(texts))
        assert all(set(b.text.split(" ")) <= held and len(b.text.split(" ")) <= mixing.BLOCK_WORDS for b in blocks)


def test_permutation_and_draws():
    for n in (1, 2, 3, 17, 1000):
        out = mixing.permute(np.arange(n), np.full(n, n), np.full(n, 99))
        assert sorted(out.tolist()) == list(range(n))
        assert (mixing.permute(out, np.full(n, n), np.full(n, 99), back=True) == np.arange(n)).all()
    owed = np.array([0, 25, 160, 71, 1])
    drawn = [mixing.draw_group(owed, [1, g], 32) for g in range(200)]
    assert all((d.sum(axis=0) == owed).all() and (d.sum(axis=1) <= 32).all() and d.shape == (9, 5) for d in drawn) and (drawn[0] != drawn[1]).any()
    far = np.abs(np.array([d[0] for d in drawn]) - owed / 9).mean(axis=0)
    assert (far[1:4] <= 1.2 * np.sqrt(owed[1:4] / 9)).all() and mixing.draw_group(owed * 0, [1], 32).shape == (0, 5)


def test_due_gives_the_words():
    """The draws' blocks, the last one cut, add up to the words that are due."""
    rng = np.random.default_rng(3)
    for block_words in (1, 4, 64):
        sizes = rng.integers(0, 400, 200)
        words = np.minimum(3 * sizes, (sizes * rng.random(200) * 3).round().astype(np.int64))
        numbers = np.arange(200)
        blocks, draws, cut = mixing.due(numbers, sizes, words, block_words, 5)
        for k in range(200):
            n, got = int(blocks[k]), 0
            for j in range(int(draws[k])):
                at = int(mixing.permute(np.array([j % n]), np.array([n]), mixing.block_keys(np.array([k]), np.array([j // n]), 5))[0])
                got += int(cut[k]) if j == draws[k] - 1 and cut[k] else min(block_words, int(sizes[k]) - at * block_words)
            assert got == words[k] and draws[k] <= 3 * n


# HTML


ARTICLE = "<article><h1>Head &amp; line</h1><p>First <b>para</b>graph of&nbsp;the text, long enough.<p>Second\n  one<br>goes on.<ul><li>item</ul></article>"
WANT = "Head & line\nFirst paragraph of the text, long enough.\nSecond one goes on.\nitem"
NOISE = ["<nav><ul><li><a href=/x>menu</a></ul></nav>", "<header>site</header>", "<aside>side</aside>", "<div class='cookie-notice'><p>We use cookies, a lot of them, really.</p></div>", "<div id=ad-1><p>Buy now</p></div>", "<script>var a='</p>';</script>", "<style>p{}</style>", "<form><p>Your name</p></form>", "<section class=comments><article class=comment><p>" + "I disagree. " * 40 + "</p></article></section>", "<footer>&copy; x</footer>", "<!-- <p>no</p> -->"]


def page(before, after, wrap="{}"):
    return "<!DOCTYPE html><html><head><title>T</title></head><body class='has-sidebar'>" + "".join(before) + wrap.format(ARTICLE) + "".join(after)


def test_html(spark):
    pages = [(k, f"https://u@Host{k % 2}.example:80/p?{k}", page(NOISE[:k], NOISE[k:], "<main><div class='post-%d'>{}</div></main>" % k)) for k in range(len(NOISE))]
    more = [(100, None, None), (101, "", ""), (102, "not a url", "just text"), (103, "http://host0.example/", "<p>only this"), (104, "http://host0.example/", "<div><p>a<div class=ad>x</div>"), (104, "http://host0.example/", "<div><p>a<div class=ad>x</div>"), (105, "http://h/", "<div>" * 500 + "deep")]
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in pages + more], "page_id long, url string, html string, host string, path string")
    got = {}
    for r in html_extract.extract(frame).collect():
        got[r.page_id] = r
        assert r.n_chars == len(r.text)
    assert all(got[k].text == WANT for k in range(len(NOISE)))
    assert (got[100].text, got[101].text, got[102].text, got[103].text, got[104].text, got[105].text) == ("", "", "just text", "only this", "a", "deep")
    assert html_extract.extract(frame.limit(0)).count() == 0


SENTENCES = "A long sentence of the text, and more of it. " * 8


@pytest.mark.parametrize(
    "body",
    [
        f"<article><h1>Head</h1><p>Lead.</p><section><p>{SENTENCES}</p></section><section><p>{SENTENCES}</p></section></article>",
        f"<article><h1>Head</h1><div class=content><p>Lead.</p><div><p>{SENTENCES}</p><p>{SENTENCES}</p></div></div></article>",
        f"<article><h1>Head</h1><p>Lead.</p><ul><li>{SENTENCES}</li><li>{SENTENCES}</li></ul></article>",
        f"<article><h1>Head</h1><p>Lead.</p><table><tr><td>{SENTENCES}<td>{SENTENCES}</table></article>",
        f"<main><div><h1>Head</h1><p>Lead.</p></div><div class=content><p>{SENTENCES}</p><p>{SENTENCES}</p></div></main>",
        f"<div class=page><h1>Head</h1><p>Lead.</p><div class=content><p>{SENTENCES}</p><p>{SENTENCES}</p></div></div>",
        f"<h1>Head</h1><p>Lead.</p><section><p>{SENTENCES}</p></section><section><p>{SENTENCES}</p></section>",
        f"<h1>Head</h1><p>Lead.</p><ol><li>{SENTENCES}</li><li>{SENTENCES}</li></ol>",
    ],
)
def test_html_takes_the_whole_container(body):
    source = f"<html><body><nav><a href=/>menu</a></nav>{body}<div class=ad>Buy</div><footer>x</footer></body></html>"
    want = "\n".join(["Head", "Lead.", SENTENCES.strip(), SENTENCES.strip()])
    path = html_extract.votes(source)[0][0]
    assert html_extract.main_text(source, path) == html_extract.main_text(source, None) == want


@pytest.mark.parametrize("name", ["page-with-sidebar", "layout-sidebar wide", "site menu-left", "page-promo"])
def test_html_keeps_wrappers_named_by_words(name):
    inner = f"<article><div class='entry-header'><h1>Head</h1><p>by line</p></div><p>{SENTENCES}</p></article><aside><p>{SENTENCES * 3}</p></aside><div class=related><p>{SENTENCES}</p></div>"
    assert html_extract.main_text(f"<body><div class='{name}'>{inner}</div><div class=cookie-notice><p>We use cookies.</p></div>", None) == f"Head\n{SENTENCES.strip()}"
    if "promo" not in name:
        plain = f"<body><div class='{name}'><h1>Head</h1><p>{SENTENCES}</p><div class=sidebar><p>side</p></div></div><div class=sidebar><p>{SENTENCES}</p></div>"
        assert html_extract.main_text(plain, None) == f"Head\n{SENTENCES.strip()}"


def test_html_drops_by_words():
    for name in ("sidebar", "comments", "cookie-notice", "related"):
        for body in (f"<article><h1>Head</h1><p>{SENTENCES}</p></article>", f"<div><h1>Head</h1><p>{SENTENCES}</p></div>"):
            assert html_extract.main_text(f"<body>{body}<div class={name}><p>{SENTENCES * 5}</p></div>", None) == f"Head\n{SENTENCES.strip()}"


def test_html_fourth_path_wins_its_host(spark):
    def at(page):  # the common container comes fourth, after three blocks of the page's own
        return "<body>" + "".join(f"<article class='own-{c}{'abc'[k]}'><div><p>{'x' * n}</p></div></article>" for k, (c, n) in enumerate(((page, 43), (page, 42), (page, 41)))) + "<article class=text><div><p>" + "y" * 40 + "</p></div></article></body>"

    pages = [("h", at(c)) for c in "pqrstu"]
    assert all([p for p, _ in html_extract.votes(s)].index("body>article.text") >= 3 for _, s in pages)
    assert html_extract.host_paths(spark.createDataFrame(pages, "host string, html string")).collect()[0].path == "body>article.text"


LEAD, NEXT = "The lead of it.", "More of the same text, and a bit more. " * 6


@pytest.mark.parametrize(
    "body",
    [
        "<article><div class=sec1>{a}</div><div class=other>{b}</div></article>",
        "<article><p>The lead of it.</p><div class=wp-block-group>{a}{b}</div></article>",
        "<div class=wrap><div class=sec1>{a}</div><div class=other>{b}</div></div>",
        "<div class=sec1>{a}</div><div class=other>{b}</div>",
        "<div class=elementor-widget-container><h1>Head</h1>{a}{b}</div>",
        "<div class=content-sidebar-wrap>{a}{b}</div>",
        "<div class='blog-post share-enabled'><h1>Head</h1>{a}{b}</div>",
        "<div class='blog-post share-enabled'>{a}{b}</div>",
        "<form id=aspnetForm><div><h1>Head</h1>{a}{b}</div></form>",
        "<div class=title><h1>Head</h1></div><div class=text>{a}{b}</div>",
    ],
)
def test_html_loses_no_part(body):
    a, b = f"<p>{SENTENCES}</p>" * 5, f"<p>{NEXT}</p>" * 3
    got = html_extract.main_text(f"<body><nav><a href=/>menu</a></nav>{body.format(a=a, b=b)}<footer>x</footer>", None)
    assert got == "\n".join([t for t in ("Head", LEAD) if t in body] + [SENTENCES.strip()] * 5 + [NEXT.strip()] * 3)


def test_html_is_linear():
    import time

    deep = "<div>" * 100_000 + "deep" + "</i>" * 100_000
    cases = {"<a " * 350_000: "", "<!-- " * 200_000: "", "<script " * 100_000: "", "<p x='" * 100_000: "", deep: "deep", "<font>x" * 50_000: "x" * 50_000, "<p>x" * 50_000: "\n".join("x" * 50_000)}
    for source, want in cases.items():
        began = time.time()
        assert html_extract.main_text(source, None) == want
        assert time.time() - began < 20
    assert all(len(p) <= html_extract.PATH_CHARS for p in html_extract.Page(deep).path)


def test_html_vote_changes_a_page(spark):
    story, other = "<div class=story><p>{}</p></div>", "<div class=latest><p>{}</p></div>"
    pages = [(k, "http://h.example/", "<body>" + story.format(SENTENCES * 3) + other.format(NEXT[:100])) for k in range(5)]
    odd = "<body>" + story.format("Short.") + other.format(SENTENCES * 2)
    frame = spark.createDataFrame([*pages, (9, "http://h.example/x", odd), (10, "http://else.example/", odd)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(frame).collect()}
    assert got[9] == "Short." and got[10] == (SENTENCES * 2).strip() and got[0] == (SENTENCES * 3).strip()


def test_html_leaves_what_lies_beside_the_container():
    beside = "<div class=x><p>Another text.</p></div>"
    for body in (f"<article><p>{SENTENCES}</p></article>", f"<div id=post><h2>Head</h2><p>{SENTENCES}</p></div>"):
        assert "Another" not in html_extract.main_text(f"<body><p>Site</p>{beside}{body}{beside}", None)


def test_html_table(spark, sf):
    frame = spark.read.parquet(f"{sf}/pages.parquet")
    import html as entities

    for r in html_extract.extract(frame).join(frame.select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(p for p in parts if p)


# language


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


def test_language(spark, docs, none):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in frame.collect()}
    got = language_id.identify(frame).collect()
    assert len(got) == len(lang) and all(r.held_out == (crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)
    held = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out and r.lang_pred != "und"]
    assert sum(held) >= 0.97 * len(held)
    model = language_id.fit(frame, F.col("doc_id") % 2 == 0)
    assert {r.doc_id: r.lang_pred for r in language_id.predict(docs, model).collect()}[3] == "und"
    assert language_id.identify(none).count() == 0 and {r.lang_pred for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_backs_off():
    m = language_id.Model([("a", 0, "hello", 9), ("b", 0, "salut", 9), ("a", 2, "he", 5), ("b", 2, "sa", 5), ("a", 1, "h", 5), ("b", 1, "s", 5)])
    best = {w: np.argmax(language_id.of(m.lists(), w, 2)) for w in ("hello", "sahh", "zzs")}
    assert best == {"hello": 0, "sahh": 1, "zzs": 1} and language_id.of(m.lists(), "z", 2) == [0.0, 0.0]


def test_language_rare(spark):
    rng = np.random.default_rng(4)
    words = {x: ["".join(rng.choice(list(abc), rng.integers(2, 9))) for _ in range(300)] for x, abc in (("aa", "abcdefgh"), ("bb", "ghijklmn"), ("cc", "mnopqrst"), ("rare", "rstuvwxy"))}
    lang = ["rare" if k % 1000 == 7 else ("aa", "bb", "cc")[k % 3] for k in range(8000)]
    rows = [(k, " ".join(rng.choice(words[x], 12)), x) for k, x in enumerate(lang)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language_id.fit(frame, F.col("doc_id") % 2000 != 7, most=500)
    assert model.langs == ["aa", "bb", "cc", "rare"]
    got = language_id.predict(frame, model).collect()
    assert all(r.lang_pred == lang[r.doc_id] for r in got)


def test_language_like_brute_force(spark, sf):
    """Scores by a plain reading of the rule: no caches, no arrays."""
    import math

    frame = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [r for r in frame.collect() if r.doc_id is not None]
    known = {}
    for r in rows:
        if r.lang is not None and r.doc_id % 2:
            for w in re.findall(r"[^\W\d_]+", (r.text or "").lower()):
                known.setdefault((0, w), Counter())[r.lang] += 1
                for n in range(1, 6):
                    x = f"\x02{w}\x03" if n > 1 else w
                    for k in range(len(x) - n + 1):
                        known.setdefault((n, x[k : k + n]), Counter())[r.lang] += 1
    langs = sorted({r.lang for r in rows if r.lang is not None and r.doc_id % 2})
    mass = {(n, x): sum(c[x] + 0.3 for (m, _), c in known.items() if m == n) for n in range(6) for x in langs}

    def logs(n, item):
        return [math.log((known[n, item][x] + 0.3) / mass[n, x]) for x in langs]

    def word(w):
        if (0, w) in known:
            return logs(0, w)
        for n in range(5, 0, -1):
            x = f"\x02{w}\x03" if n > 1 else w
            found = [logs(n, x[k : k + n]) for k in range(len(x) - n + 1) if (n, x[k : k + n]) in known]
            if found:
                return [sum(v) / len(found) for v in zip(*found, strict=True)]
        return [0.0] * len(langs)

    got = {r.doc_id: r for r in language_id.predict(frame, language_id.fit(frame, F.col("doc_id") % 2 == 1)).collect()}
    for r in rows[:60]:
        words = re.findall(r"[^\W\d_]+", (r.text or "").lower())
        if not words:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        total = [sum(v) for v in zip(*map(word, words), strict=True)]
        best = max(range(len(langs)), key=total.__getitem__)
        p = [math.exp((t - total[best]) * min(len(words), 30) / len(words)) for t in total]
        assert got[r.doc_id].lang_pred == langs[best] and got[r.doc_id].score == pytest.approx(1 / sum(p), rel=1e-6)


# quality classifier


def test_classifier(spark, docs, none):
    frame, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    y = {r.doc_id: r.quality for r in labels.collect()}
    got = {r.doc_id: r for r in quality_classifier.classify(frame, labels).collect()}
    assert all(r.held_out == (crc(i, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    held = [got[i].predicted == q for i, q in y.items() if got[i].held_out]
    assert sum(held) >= 0.95 * len(held)
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 0), (1, None, 0), (1, 1, 1)], labels.schema))
    assert quality_classifier.classify(docs, odd).count() == len(TEXTS)
    assert quality_classifier.classify(none, labels).count() == 0 and quality_classifier.classify(docs, labels.limit(0)).where("score = 0.5").count() == len(TEXTS)
    assert quality_classifier.accepted(docs, labels).columns == docs.columns


def test_classifier_learns_from_long_documents(spark):
    n = quality_classifier.PASSAGE_WORDS * (quality_classifier.TRAIN_PASSAGES + 50)
    frame = spark.createDataFrame([(1, "plain words " * (n // 2)), (2, "## || " * (n // 2))], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    model = quality_classifier.fit(frame, labels, F.lit(True))
    good, bad = (r.score for r in quality_classifier.score(frame, model).orderBy("doc_id").collect())
    assert good > 0.5 > bad
    rows = np.arange(1001)[:, None]
    assert quality_classifier.spaced(rows, 11)[:, 0].tolist() == list(range(0, 1001, 100)) and quality_classifier.spaced(rows, 1001) is rows


def test_attention_gradient():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(n, quality_classifier.WIDTH)) for n in (1, 3, 2, 4)]
    y = np.array([0.0, 1, 1, 0])
    m = quality_classifier.Model(0.5).fit(bags, y, steps=150)
    assert ((m.score(bags) > 0.5) == y).all()


INNER = [
    '<section id=discussion><p>{t}</p></section>', '<h2 id="the-search-for-life">{t}</h2>', '<h2 id="related-work">{t}</h2>', '<h2 class="section-header">{t}</h2>', '<h1 class="page-header">{t}</h1>',
    '<p class="social-history">{t}</p>', '<p>a <code class="search">{t}</code></p>', '<p>a <span class="ad-hoc">{t}</span></p>', '<ul class=notices-of-war><li id=comments>{t}</li></ul>', '<section class="related-work"><p>{t}</p></section>',
]


@pytest.mark.parametrize("inner", INNER)
def test_html_words_drop_nothing_of_an_article(inner):
    for outer in ("<article><h1>T</h1><p>Long text of it.</p>{}<p>More.</p></article>", "<main><h1>T</h1><p>Long text.</p>{}</main>"):
        assert "Planted words" in html_extract.main_text(f"<body><nav>m</nav>{outer.format(inner.format(t='Planted words'))}<footer>f</footer>", None)


@pytest.mark.parametrize("inner", ["<section class=comments>{}</section>", "<div id=comment-list>{}</div>", "<div class='ad-slot'>{}</div>", "<p class=advert>{}</p>", "<div class='related-posts'>{}</div>", "<div class='newsletter-box'>{}</div>", "<ul class='share-buttons'><li>{}</ul>"])
def test_html_boilerplate_inside_an_article_goes(inner):
    page = f"<body><article><h1>T</h1><p>Long text of it.</p>{inner.format('Planted words')}<p>More.</p></article>"
    assert html_extract.main_text(page, None) == "T\nLong text of it.\nMore."


def test_html_articles_of_links_and_beside_long_divisions():
    links = "".join(f"<li><a href=/{k}>Linked item number {k}</a></li>" for k in range(5))
    want = "\n".join(["T", "Short intro text.", *[f"Linked item number {k}" for k in range(5)]])
    page = f"<body><article><h1>T</h1><p>Short intro text.</p><ul>{links}</ul></article></body>"
    assert html_extract.main_text(page, None) == want
    assert html_extract.main_text(page, html_extract.votes(page)[0][0]) == want
    assert html_extract.main_text(f"<body><nav>menu</nav><ul>{links}</ul></body>", None) == "\n".join(want.split("\n")[2:])
    long = f"<div><p>{SENTENCES * 9}</p></div>"
    for own in ("<article><p>Only this.</p></article>", "<article><h1>H</h1><p>Only this.</p></article>", "<main><p>Only this.</p></main>"):
        for page in (f"<body>{own}{long}</body>", f"<body>{long}{own}</body>"):
            for path in (None, "body>div"):
                assert html_extract.main_text(page, path).endswith("Only this.") and SENTENCES[:20] not in html_extract.main_text(page, path)


def test_only_letters_are_letters():
    import sys
    import unicodedata

    for k in range(sys.maxunicode + 1):
        c = chr(k)
        if unicodedata.category(c)[0] != "L" and language_id.letters(c):
            assert any(unicodedata.category(x)[0] == "L" for x in c.lower()), hex(k)
        elif unicodedata.category(c)[0] == "L":
            assert language_id.letters(c), hex(k)
    scorer = language_id.Scorer(language_id.Model([("aa", 0, "ab", 3), ("bb", 0, "cd", 3), ("aa", 1, "a", 3), ("bb", 1, "c", 3)]))
    assert all(scorer.predict(t) == ("und", 0.0) for t in ("\u00b2", "\u2167", "\u00bd \u2460", None, "", "12 _ !"))


def test_clashing_names_of_joins(spark, tmp_path):
    """Columns named like those that joins use on their way pass through."""
    kind = "doc_id long, text string, __id long, __own string, __sha string, __row int, __kept long, __key_id long, shard string, source string"
    words = " ".join(f"word{k}" for k in range(40))
    rows = [(k, t, 7, "o", "s", 1, 2, 3, "x", "z") for k, t in ((1, words), (2, words), (3, words + " end"), (4, "other"), (4, words), (5, None), (None, words), (None, "other"))]
    docs = spark.createDataFrame(rows, kind).repartition(2)
    for got in (exact_dedup.drop_copies(docs), jaccard_join.one_of_each(docs.where("doc_id <> 4 or text = 'other'"))):
        assert got.columns == docs.columns and all(tuple(r)[2:] == rows[0][2:] for r in got.collect())
    assert sorted(r.doc_id for r in jaccard_join.one_of_each(docs).where("doc_id is not null").collect()) == [1, 4, 5]
    sharding.write_shards(docs.where("doc_id < 4"), str(tmp_path / "s"), limit=500)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 3 and set(back.columns) == {*docs.columns, "shard_"} and back.where("shard <> 'x'").count() == 0
