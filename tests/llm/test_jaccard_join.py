"""The join against all pairs, with rare and with frequent tokens."""

import random

import numpy as np
import pytest

from flowguard.llm import jaccard_join as J
from test_decontam import words


def sets(text):
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i: i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def brute(rows):
    own = [sets(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(own[i] & own[j])
            if both and 100 * both >= 80 * len(own[i] | own[j]):
                label[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        known = [x for x in (least.get(root(i)), doc) if x is not None]
        least[root(i)] = min(known, default=None)
    return sorted(((d, len(own[i]), least[root(i)]) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed):
    rng = random.Random(seed)
    make = lambda n, v=400: [f"w{rng.randrange(v)}" for _ in range(n)]
    rows, passage, number = [], make(60), iter(range(10, 9999, 3))
    for n in (2, 4, 5, 6, 9, 30, 80, 200):
        base = make(n)
        for _ in range(6):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, n // 40])):
                w[rng.randrange(len(w))] = rng.choice(["new", "W1", "w2"])
            rows.append((next(number), " ".join(w)))
        rows.append((next(number), "\t".join(base).upper()))
    for _ in range(25):
        rows.append((next(number), " ".join(make(rng.choice([3, 20])) + passage + make(rng.choice([2, 30])))))
    # A chain whose ends are not linked with each other.
    chain = make(120)
    for i in range(8):
        rows.append((next(number), " ".join(chain[4 * i: 4 * i + 80])))
    return rows + [(1, None), (2, ""), (3, " \n "), (None, rows[0][1]), (None, "alone without id x y z"), (rows[5][0], "same id other text a b c")]


@pytest.mark.parametrize("seed, frequent_from", [(1, 64), (1, 1), (2, 3)])
def test_components_against_all_pairs(spark, seed, frequent_from):
    rows = corpus(seed)
    df = spark.createDataFrame([(t, i, "x", 1) for i, t in rows], "text string, doc_id long, node string, n int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.near_duplicates(df, frequent_from=frequent_from).collect()), key=str)
    assert got == brute(rows)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert J.near_duplicates(empty).count() == 0 and J.drop_near_duplicates(empty).count() == 0


@pytest.mark.parametrize("frequent_from", [1, 20, 64])
def test_linked_sets_share_a_signature(frequent_from):
    """Random linked pairs, with any mix of rare and frequent tokens, always meet."""
    rng = np.random.default_rng(5)
    count = {}
    for _ in range(400):
        n = int(rng.integers(1, 300))
        base = rng.integers(1, 2**62, n).astype(np.uint64)
        for t in base.tolist():
            count[t] = int(rng.choice([0, 5, 30, 100, 1000]))
        other = base.copy()
        swap = rng.choice(n, int(n * rng.uniform(0, 0.12)), replace=False)
        other[swap] = rng.integers(1, 2**62, len(swap)).astype(np.uint64)
        x, y = np.unique(base), np.unique(other)
        both = len(np.intersect1d(x, y))
        if both and 100 * both >= 80 * (len(x) + len(y) - both):
            sig = [set(J.signatures(s, np.array([count.get(int(v), 0) for v in s]), frequent_from).tolist()) for s in (x, y)]
            assert sig[0] & sig[1]
            assert len(sig[0]) <= 2.5 * len(x) + 4


def test_shingles_count_for_themselves_not_for_their_words(spark):
    """A shingle that occurs once is indexed singly, however frequent its words are."""
    words_of = [f"w{i}" for i in range(12)]
    rng = random.Random(4)
    texts = [" ".join(rng.choice(words_of) for _ in range(40)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "doc_id long, text string")
    counted = J.shingle_counts(docs)
    assert counted.sum() == 60 * 36 and counted.dtype == np.int32
    powers = J.Powers()
    tokens = [J.Words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), powers).shingle_sets(5)[0] for t in texts]
    every = np.concatenate(tokens)
    least = np.bincount(J.bucket_of(every), minlength=J.COUNT_BUCKETS)
    assert (counted[J.bucket_of(every)] >= least[J.bucket_of(every)]).all()
    index = J.postings(docs).filter("sig is not null").select("sig").toPandas()["sig"].to_numpy().view(np.uint64)
    assert np.isin(index, every).all()


@pytest.mark.parametrize("few, tile", [(100, 7), (4, 7), (1, 1000)])
def test_what_is_apart_meets_once_in_tasks(spark, few, tile):
    """Every pair of one signature and two components that fits, whichever way its signature is dealt."""
    rng = np.random.default_rng(6)
    bound = rng.poisson(1.0, (50, J.BOUND_BUCKETS)).astype(np.uint8)
    bound[20:40] = np.maximum(bound[20], bound[20:40] // 3)
    bound[45, 3] = 255
    n = np.maximum(bound.sum(axis=1, dtype=np.int64), 1)
    component = rng.integers(0, 9, 50)
    members = {s: rng.choice(50, size, replace=False) for s, size in enumerate((2, 3, 20, 45, 50))}
    rows = [(s, int(v) - 25, int(component[v]), len(m)) for s, m in members.items() for v in m]
    nodes = spark.createDataFrame([(v - 25, int(n[v]), bytearray(bound[v].tobytes())) for v in range(50)], "node long, n int, bound binary")
    found = J._apart(spark.createDataFrame(rows, "sig long, node long, component long, size long"), nodes, few, tile).collect()
    want = set()
    for m in members.values():
        for x in m:
            for y in m:
                both, total = int(np.minimum(bound[x], bound[y]).sum()), int(n[x] + n[y])
                fits = min(n[x], n[y]) * 100 >= max(n[x], n[y]) * 80 and (100 * both >= 80 * (total - both) or 45 in (x, y))
                if x < y and component[x] != component[y] and fits:
                    want.add((int(x) - 25, int(y) - 25))
    assert want and sorted((r.a, r.b) for r in found) == sorted(want)


@pytest.mark.parametrize("tile, tokens", [(1000, 1 << 20), (7, 1 << 20), (1000, 400)])
def test_large_signatures_give_links_not_pairs(spark, monkeypatch, tile, tokens):
    """What is close in large signatures is joined by few rows, though each pair shares many signatures."""
    monkeypatch.setattr(J, "TILE_TOKENS", tokens)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(80)]
    texts = {}
    for _ in range(40):
        w = list(base)
        w[0], w[-1] = f"x{rng.randrange(4)}", f"x{rng.randrange(4)}"
        for _ in range(rng.choice([0, 0, 1, 4])):
            w[rng.randrange(80)] = f"x{rng.randrange(4)}"
        texts[" ".join(w)] = sets(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, "another text of the same id")], "doc_id long, text string")
    index = J.postings(docs)
    nodes = index.filter("sig is null").select("node", "doc_id", "n", "bound").cache()
    node_of = {r.doc_id: r.node for r in nodes.filter("n > 1 and (doc_id > 0 or n > 30)").collect()}
    nodes = nodes.filter(nodes.node.isin(list(node_of.values())))
    rows = [(s, v, v, len(node_of)) for s in range(25) for v in node_of.values()]
    rows = spark.createDataFrame(rows, "sig long, node long, component long, size long")
    got = [(r.a, r.b) for r in J._close(rows, nodes, docs, tile).collect()]
    own = [(node_of[i], s) for i, s in enumerate(texts.values())]
    linked = {(min(a, b), max(a, b)) for a, x in own for b, y in own if a != b and 100 * len(x & y) >= 80 * len(x | y)}

    def joined(pairs):
        label = {v: v for v, _ in own}
        for a, b in pairs:
            label = {v: label[a] if c == label[b] else c for v, c in label.items()}
        return {frozenset(v for v in label if label[v] == c) for c in label.values()}

    assert set(got) <= linked and joined(got) == joined(linked) and len(joined(linked)) < len(own)
    if tile == 1000 and tokens > 400:
        assert len(got) < len(own) < len(linked)


@pytest.mark.parametrize("seed, frequent_from", [(1, 1), (3, 3)])
def test_components_with_all_signatures_decided_in_tasks(spark, monkeypatch, seed, frequent_from):
    monkeypatch.setattr(J, "SOME_SETS", 0)
    rows = corpus(seed)
    df = spark.createDataFrame([(t, i) for i, t in rows], "text string, doc_id long")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.near_duplicates(df, frequent_from=frequent_from).collect()), key=str)
    assert got == brute(rows)


def test_a_pair_leaves_the_tasks_once(spark):
    """A pair of many large signatures is made by the smallest of them only."""
    bound = bytearray(np.full(J.BOUND_BUCKETS, 1, np.uint8).tobytes())
    nodes = spark.createDataFrame([(v, 256, bound) for v in range(30)], "node long, n int, bound binary")
    rows = spark.createDataFrame([(s, v, v, 30) for s in (-5, 0, 7, 2**62) for v in range(30)], "sig long, node long, component long, size long")
    made = [len(p) for sets in J._groups(J._dealt(rows, nodes, 1000).toArrow().sort_by("sig").to_batches()) for p, _ in J._meet(sets)]
    assert sum(made) == 30 * 29 // 2


def test_texts_go_to_python_in_small_batches(spark, monkeypatch):
    """While the join writes its tables; the session's own setting comes back, also after an error."""
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(key)
    counts = J.shingle_counts

    def looked(docs):
        seen.append(int(spark.conf.get(key)))
        return counts(docs)

    monkeypatch.setattr(J, "shingle_counts", looked)
    assert J.near_duplicates(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).count() == 1
    assert seen == [J.small_batches.__wrapped__.__defaults__[0]] and spark.conf.get(key) == before
    with pytest.raises(ValueError), J.small_batches(spark, 5):
        raise ValueError(spark.conf.get(key))
    assert spark.conf.get(key) == before
