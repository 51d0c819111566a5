"""Every stage against a plain version of its decision, on the small tables."""

from collections import Counter

import pytest

import corpus_pipeline as P
from flowguard.llm import toxicity
from test_decontam import brute as leaks
from test_decontam import words
from test_jaccard_join import brute as components

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs.collect()]
    for name, stage in P.STAGES:
        docs = P.written(stage(spark, docs, FOLDER), f"test-{name}")
        out.append(docs.collect())
    return out


def test_toxic_documents_go(spark, stages):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(docs, toxicity.training_labels(spark.read.parquet(f"{FOLDER}/labels.parquet")))
    score = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert {r.doc_id for r in stages[1]} == {d for d, s in score.items() if s < 0.3}
    assert stages[1][0].asDict().keys() == stages[0][0].asDict().keys()


def test_one_document_of_each_component_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[1]]
    assert sorted(r.doc_id for r in stages[2]) == sorted({c for _, _, c in components(rows)})


def test_leaking_documents_go(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    held = {d for d, _ in leaks([(r.doc_id, r.text) for r in stages[2]], items)}
    assert sorted(r.doc_id for r in stages[3]) == sorted(r.doc_id for r in stages[2] if r.doc_id not in held)


def test_sources_meet_their_targets_in_whole_documents(stages):
    size = {r.doc_id: len(words(r.text)) for r in stages[3]}
    of = {r.doc_id: r.source for r in stages[3]}
    total = Counter()
    for d, s in of.items():
        total[s] += size[d]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(total))}
    target, rest, open_ = {}, 1.5 * sum(total.values()), set(total)
    while True:
        level = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if level[s] > 2 * total[s]}
        if not over:
            target |= level
            break
        for s in over:
            target[s] = 2 * total[s]
            rest -= target[s]
        open_ -= over
    copies = Counter(r.doc_id for r in stages[4])
    assert set(copies) <= set(of) and max(copies.values()) <= 2
    for s in total:
        taken = sum(n * size[d] for d, n in copies.items() if of[d] == s)
        assert abs(taken - target[s]) <= max(size[d] for d in of if of[d] == s) / 2 + 1


def test_shards_hold_the_mix(stages):
    assert sorted(r.doc_id for r in stages[5]) == sorted(r.doc_id for r in stages[4])
    counts = Counter(r.shard for r in stages[5])
    assert max(counts.values()) - min(counts.get(k, 0) for k in range(24)) <= 1
    for k in counts:
        assert sorted(r.slot for r in stages[5] if r.shard == k) == list(range(counts[k]))


def test_empty_documents(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
