"""The queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillmap.llm import bpe, centroid_clusters, exact_dedup, html_extract, jaccard_join, language_id, license_scan, mixing, quality_classifier, quality_rules, sharding, token_counts, vector_codes
from quillmap.sources.tables import table

#: The vocabulary file of the BPE queries.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shard", "slot")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), VOCABULARY)


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), VOCABULARY)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.centroid_clusters(table(spark, sf_dir, "embeddings"))


_ALL = (
    (op1_mixing, op2_bpe, op3_html, op4_quality_rules, op5_jaccard_join, op6_language_id, op7_exact_dedup, op8_token_counts)
    + (op9_quality_classifier, op10_sharding, op11_license_scan, op12_vector_codes, op13_centroid_clusters)
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_SPACE = r"[\x20\x09-\x0D]"
_STOPS = """'the','of','and','to','in','is','that','it','for','was','on','are','as','with','be','this','have','from','or','by','an','not','at','but','which',
      'der','die','und','den','von','zu','das','mit','sich','des','auf','ist','im','dem','nicht','ein','eine','als','auch','es','werden','aus','er','hat','dass',
      'le','la','les','de','et','un','une','du','est','que','qui','dans','en','pour','pas','sur','au','avec','ce','il','elle','plus','par','ne','se',
      'el','los','las','y','una','con','no','su','para','al','lo','como','del','mas','pero','sus'"""

_OP4 = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
places AS (SELECT r, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 4),
windows AS (SELECT p.r, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM places p JOIN w USING (r)),
often AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM windows),
hit AS (SELECT DISTINCT r, unnest([i, i + 1, i + 2]) AS place FROM often WHERE n > 1),
hits AS (SELECT r, count(*) AS n_repeat_words FROM hit GROUP BY r),
c AS (SELECT doc_id, len(words)::BIGINT AS n_words,
      length(regexp_replace(text, '{_SPACE}', '', 'g'))::BIGINT AS word_chars,
      (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
      len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
      len(list_filter(lines, lambda x: ends_with(x, '...') OR ends_with(x, '…')))::BIGINT AS n_cut_lines,
      len(list_filter(words, lambda x: lower(x) IN ({_STOPS})))::BIGINT AS n_stop_words,
      len(list_filter(words, lambda x: ends_with(x, '!!') OR x = '|'))::BIGINT AS n_marked_words,
      coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN hits USING (r)),
f AS (SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars >= 2 * n_words AND word_chars <= 12 * n_words AND 10 * n_symbols <= 3 * n_words AND 2 * n_marked_words <= n_words
       AND 50 * n_stop_words >= n_words AND 10 * n_dup_lines <= 3 * n_lines AND 2 * n_cut_lines <= n_lines AS kept FROM f
"""

_OP7 = f"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SPACE}+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256 FROM n
"""

_OP10 = f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
           ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
levels AS (SELECT unnest(range(0, {sharding.HASH_BITS + 1})) AS depth),
sums AS (SELECT depth, h >> ({sharding.HASH_BITS} - depth) AS prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs
         FROM d, levels GROUP BY ALL HAVING sum(n_bytes) <= {sharding.SHARD_BYTES} OR count(*) = 1),
best AS (SELECT doc_id, n_bytes, h, min(depth) AS depth FROM d JOIN sums ON prefix = h >> ({sharding.HASH_BITS} - depth) GROUP BY ALL)
SELECT doc_id, n_bytes, CASE WHEN b.depth = 0 THEN '-' ELSE right(repeat('0', 60) || to_base(prefix, 2), b.depth::INT) END AS shard,
       b.depth::INT AS depth, shard_bytes, shard_docs
FROM best b JOIN sums s ON s.depth = b.depth AND s.prefix = b.h >> ({sharding.HASH_BITS} - b.depth)
"""

_ALIKE = "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer (2 )?redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_GRANT = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met (1 )?"
#: Each license as a regular expression over words with a space in front and behind.
_LICENSES = {
    "apache-2.0": ["licensed under (the terms of )?the apache license version 2 0"],
    "bsd-2-clause": [f"{_GRANT}{_ALIKE} this software is provided by ([^ ]+ ){{1,12}}as is"],
    "bsd-3-clause": [f"{_GRANT}{_ALIKE} (3 )?neither the name of ([^ ]+ ){{1,20}}nor the names of ([^ ]+ ){{0,2}}contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "cc-by-4.0": ["licensed under (a )?(creative commons )?(attribution )?cc by 4 0"],
    "cc-by-nc-4.0": ["licensed under (a )?(creative commons )?cc by nc 4 0"],
    "cc-by-sa-4.0": ["licensed under (a )?(creative commons )?cc by sa 4 0"],
    "gpl-2.0": ["licensed under the gnu general public license version 2", "under the terms of the gnu general public license as published by the free software foundation (either )?version 2 of the license"],
    "gpl-3.0": ["licensed under the gnu general public license version 3", "under the terms of the gnu general public license as published by the free software foundation (either )?version 3 of the license"],
    "isc": ["permission to use copy modify and (or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "mit": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files (the software )?to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mpl-2.0": ["subject to the terms of the mozilla public license v 2 0"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "zlib": ["this software is provided as is without any express or implied warranty in no event will the ([^ ]+ ){1,4}be held liable for any damages arising from the use of this software"],
}
_FOUND = " UNION ALL ".join(f"SELECT r, '{label}' AS label FROM w WHERE regexp_matches(joined, ' {rule} ')" for label, rules in _LICENSES.items() for rule in rules)
_OP11 = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS MATERIALIZED (SELECT r, doc_id, words, ' ' || array_to_string(words, ' ') || ' ' AS joined
      FROM (SELECT r, doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM t)),
phrases(phrase, label) AS (VALUES ('gnu general public license', 'gpl'), ('apache license', 'apache'), ('cc by', 'cc-by'), ('mit license', 'mit')),
near AS (SELECT r, words, label, string_split(phrase, ' ') AS p FROM w JOIN phrases ON contains(joined, ' ' || phrase || ' ')),
spots AS (SELECT r, label, unnest(list_filter(range(len(words)), lambda i: words[i + 1 : i + len(p)] = p)) AS i FROM near),
base AS (SELECT r, count(*) AS n, min(i) AS a, max(i) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM spots GROUP BY r),
more AS MATERIALIZED ({_FOUND}),
every AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM spots UNION ALL FROM more) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN r IN (SELECT r FROM more) THEN 1.0 WHEN n IS NOT NULL THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN every USING (r)
"""

_KEPT = """kept AS MATERIALIZED (
  SELECT *, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""


def _op12() -> str:
    """Four parts of 16 numbers, 256 entries: every distance, with the index in the last digits of what is compared."""
    steps = []
    for k in range(5):
        steps.append(f"""near{k} AS MATERIALIZED (
  SELECT r, part, any_value(v) AS v, min((list_inner_product(v, v) + list_inner_product(c, c) - 2 * list_inner_product(v, c))::BIGINT * 256 + entry) AS best
  FROM parts JOIN book{k} USING (part) GROUP BY r, part)""")
        if k < 4:
            steps.append(f"""means{k} AS (SELECT part, best % 256 AS entry, i, floor(sum(v[i]) / count(*)) AS m FROM near{k}, range(1, 17) AS t(i) GROUP BY ALL),
rows{k} AS (SELECT part, entry, list(m ORDER BY i) AS c FROM means{k} GROUP BY ALL),
book{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(n.c, b.c) AS c FROM book{k} b LEFT JOIN rows{k} n USING (part, entry))""")
    return f"""WITH {_KEPT},
numbered AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, q) AS r, vec_id, label, q FROM kept),
parts AS MATERIALIZED (SELECT r, p AS part, q[16 * p + 1 : 16 * p + 16] AS v FROM numbered, range(4) AS t(p)),
book0 AS MATERIALIZED (SELECT part, r - 1 AS entry, v AS c FROM parts WHERE r <= 256),
{", ".join(steps)},
found AS (SELECT r, string_agg(printf('%02x', best % 256), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error FROM near4 GROUP BY r),
digest AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book4)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM numbered JOIN found USING (r), digest"""


def _op13() -> str:
    """Eight centroids: every distance, with the number in the last digit of what is compared."""
    steps = []
    for k in range(11):
        steps.append(f"""near{k} AS MATERIALIZED (
  SELECT r, any_value(q) AS q, min((list_inner_product(q, q) + list_inner_product(c, c) - 2 * list_inner_product(q, c))::BIGINT * 8 + n) AS best
  FROM numbered, cent{k} GROUP BY r)""")
        if k < 10:
            steps.append(f"""means{k} AS (SELECT best % 8 AS n, i, floor(sum(q[i]) / count(*)) AS m FROM near{k}, range(1, 65) AS t(i) GROUP BY ALL),
rows{k} AS (SELECT n, list(m ORDER BY i) AS c FROM means{k} GROUP BY ALL),
cent{k + 1} AS MATERIALIZED (SELECT o.n, coalesce(u.c, o.c) AS c FROM cent{k} o LEFT JOIN rows{k} u USING (n))""")
    return f"""WITH {_KEPT},
numbered AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), q) AS r, vec_id, q FROM kept WHERE len(embedding) = 64),
cent0 AS MATERIALIZED (SELECT r - 1 AS n, q AS c FROM numbered WHERE r <= 8),
{", ".join(steps)}
SELECT vec_id, n::INT AS cluster, (best // 8)::BIGINT AS distance, sum(best // 8) OVER (PARTITION BY n)::BIGINT AS cluster_inertia,
       sum(best // 8) OVER ()::BIGINT AS inertia, sha256(array_to_string(list_transform(c, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM near10 JOIN numbered USING (r) JOIN cent10 ON n = best % 8"""


ORACLES: dict[str, str] = {
    "op4_quality_rules": _OP4, "op7_exact_dedup": _OP7, "op10_sharding": _OP10, "op11_license_scan": _OP11,
    "op12_vector_codes": _op12(), "op13_centroid_clusters": _op13(),
}
