"""Targets, exact quotas, the tree's distribution, odd rows."""

from collections import Counter

from flowguard.llm import mixing as M
from flowguard.llm.tables import F


def test_targets_are_filled_up_to_the_cap(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 300), ("d", 0), (None, 50)]
    got = {r.source: r.target for r in M.source_targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    weight = {"a": 3, "b": 1, "c": 2, "d": 3, None: 1}
    size, target, rest, free = dict(sizes), {}, 1.5 * 1360, {s for s, _ in sizes}
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * size[s]}
        if not over:
            break
        target |= {s: 2.0 * size[s] for s in over}
        rest -= sum(2 * size[s] for s in over)
        free -= over
    target |= share
    assert all(abs(got[s] - target[s]) < 1e-6 for s in size)


def test_tree_splits_quotas_exactly_and_evenly(spark):
    quotas = spark.createDataFrame([("a", 1000), ("b", 37), (None, 401), ("z", 0)], "source string, draws long")
    rows = M.split_quotas(quotas, 8).collect()
    total, shard = Counter(), Counter()
    for r in rows:
        total[r.source] += r.draws
        shard[r.shard] += r.draws
    assert total == {"a": 1000, "b": 37, None: 401, "z": 0}
    assert max(shard.values()) - min(shard.values()) <= 3
    seeds = spark.range(300).select(F.col("id").alias("i"), M._uniform(F.lit("t"), F.col("id")).alias("u"))
    draws = [r.x for r in seeds.select(M._hypergeometric(F.lit(100), F.lit(30), F.lit(50), F.col("u")).alias("x")).collect()]
    assert 14.4 < sum(draws) / 300 < 15.6 and 1.6 < (sum((x - 15) ** 2 for x in draws) / 300) ** 0.5 < 3.1


def test_draws_are_disjoint_and_odd_rows_count(spark):
    given = [(i, "w " * (i % 200), "abc"[i % 3]) for i in range(90)] + [(None, None, None), (500, "", "a"), (7, "x y", "c"), (7, "x y", "c")]
    df = spark.createDataFrame([(s, t, i, 1) for i, t, s in given], "source string, text string, doc_id long, size int")
    mixed = M.mix(M.document_blocks(df), 4).collect()
    assert sorted(Counter(r.shard for r in mixed)) == [0, 1, 2, 3]
    for k in range(4):
        assert sorted(r.slot for r in mixed if r.shard == k) == list(range(sum(r.shard == k for r in mixed)))
    once = Counter((r.source, r.block_key, r["pass"]) for r in mixed if r.doc_id != 7)
    assert max(once.values()) == 1
    rows = M.document_shares(df).collect()
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows) and sum(r["size"] for r in rows) == sum(len((t or "").split()) for _, t, _ in given)
    taken = Counter()
    for r in rows:
        taken[r.target] += r.taken
    assert all(abs(n - t) <= M.BLOCK_WORDS for t, n in taken.items())
    assert rows and sorted(map(tuple, rows), key=str) == sorted(map(tuple, M.document_shares(df).collect()), key=str)
    assert M.document_shares(df.limit(0)).count() == 0
