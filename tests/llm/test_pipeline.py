"""Each stage on what its predecessor kept."""

import re
from collections import Counter

import corpus_pipeline as P
from quillmap.llm import quality_classifier

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs]
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, kept[-1], sf).write.parquet(f"{tmp_path}/{k}")
        kept.append(spark.read.parquet(f"{tmp_path}/{k}"))
    assert all(d.columns == docs.columns for d in kept[:-1])
    rows = [{r.doc_id: r for r in d.collect()} for d in kept]
    verdict = {r.doc_id: r.predicted for r in quality_classifier.classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert rows[1].keys() == {i for i, v in verdict.items() if v}
    first = {}
    for i in sorted(rows[1]):
        first.setdefault(norm(rows[1][i].text), i)
    assert rows[2].keys() == set(first.values())
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := WORD.findall(r.text or "")) else set() for i, r in rows[2].items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) * 10 >= 8 * len(sets[a] | sets[b]) > 0:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert rows[3].keys() == {find(i) for i in sets}
    words = Counter()
    for r in kept[4].collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    assert all(n <= 3 * len(WORD.findall(rows[3][i].text)) for i, n in words.items())
    assert abs(sum(words.values()) - sum(len(WORD.findall(r.text or "")) for r in rows[3].values())) <= len({r.source for r in rows[3].values()})
    assert kept[5].count() == kept[4].count() and kept[5].where("n_tokens <> size(ids)").count() == 0
