"""Leak search against a plain search over every window, and the guarantees of its parts."""

import random

import numpy as np
import pytest

from flowguard.llm import decontam as D
from flowguard.llm.tables import table


def words(text):
    out, cur = [], ""
    for ch in (text or "").translate({i: i + 32 for i in range(65, 91)}):
        if ch in " \t\n\x0b\x0c\r":
            out += [cur] if cur else []
            cur = ""
        else:
            cur += ch
    return out + ([cur] if cur else [])


def similarity(a, b, k):
    def counts(ws):
        out = {}
        for i in range(len(ws) - k + 1):
            out[tuple(ws[i: i + k])] = out.get(tuple(ws[i: i + k]), 0) + 1
        return out

    x, y = counts(a), counts(b)
    weigh = lambda s: min(1023, sum(len(w.encode()) for w in s))
    part = sum(weigh(s) * min(x.get(s, 0), y.get(s, 0)) for s in {*x, *y})
    whole = sum(weigh(s) * max(x.get(s, 0), y.get(s, 0)) for s in {*x, *y})
    return part / whole if whole else 0.0


def brute(docs, items):
    found = {}
    for d, text in docs:
        ws = words(text)
        for i, item in items:
            it = words(item)
            if not it:
                continue
            k = min(5, len(it))
            grams = {tuple(it[p: p + k]) for p in range(len(it) - k + 1)}
            if not any(tuple(ws[p: p + k]) in grams for p in range(len(ws) - k + 1)):
                continue
            best = max((similarity(ws[p: p + len(it)], it, k) for p in range(max(1, len(ws) - k + 1))), default=0)
            if best >= 0.8:
                found[d, i] = best
    return found


def test_finds_all_verbatim_items(spark):
    folder = "/root/testdata/sf0.001"
    docs, bench = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    got = {(r.doc_id, r.item_id): r.similarity for r in D.find_leaks(docs, bench).collect()}
    held = {}
    for r in docs.collect():
        text = " " + " ".join(words(r.text)) + " "
        for b in bench.collect():
            if words(b.text) and f" {' '.join(words(b.text))} " in text:
                held[r.doc_id, b.item_id] = 1.0
    assert {k: v for k, v in got.items() if v == 1.0} == held and held
    assert {r.doc_id for r in docs.collect()} - {d for d, _ in got} == {r.doc_id for r in D.drop_leaks(docs, bench).collect()}


def test_planted_and_edited_items_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(make(n))) for i, n in enumerate([3, 5, 7, 15, 30, 60, 61, 150])] + [(50, None), (51, " \n"), (52, "one")]
    docs = [(100, None), (101, ""), (102, " ".join(make(400)))]
    for i, t in items[:8]:
        w = t.split()
        docs.append((200 + i, " ".join(make(50) + w + make(33))))
        docs.append((300 + i, " ".join([x.upper() for x in w])))
        docs.append((400 + i, "\t".join(make(20) + w[: len(w) - len(w) // 20] + make(20))))
        docs.append((500 + i, " ".join(make(20) + w[: len(w) // 2] + make(20))))
    d = spark.createDataFrame([(t, "x", i) for i, t in docs], "text string, item_id string, doc_id long")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in D.find_leaks(d, b).collect()}
    want = brute(docs, items)
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k]) for k in got)
    small = {(r.doc_id, r.item_id) for r in D.find_leaks(d, b, block_bytes=200).collect()}
    assert small == set(want)
    assert D.find_leaks(d, b.limit(0)).count() == 0 and D.find_leaks(d.limit(0), b).count() == 0
    assert D.drop_leaks(d.union(d), b).count() == 2 * (len(docs) - len({k[0] for k in want}))


def test_index_finds_every_fingerprint_in_the_radius():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2**63, 60).astype(np.uint64)
    queries = np.concatenate([
        [p ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, n, replace=False))) for n in range(12)] for p in prints])
    q, e = D.BlockIndex(prints).search(queries)
    want = {(i, j) for i in range(len(queries)) for j in range(60) if bin(int(queries[i] ^ prints[j])).count("1") <= D.RADIUS}
    assert {*zip(q.tolist(), e.tolist())} == want


def test_fingerprint_is_the_sign_of_the_sums():
    rng = np.random.default_rng(2)
    h, w = rng.integers(0, 2**63, 40).astype(np.uint64), rng.integers(1, 90, 40).astype(np.int32)
    got = D.fingerprints(h, w, [(7, 3)])[0]
    for j, p in enumerate(range(0, 34, 3)):
        want = 0
        for b in range(64):
            want |= (sum(int(w[i]) * (1 if int(h[i]) >> b & 1 else -1) for i in range(p, p + 7)) > 0) << b
        assert int(got[j]) == want


@pytest.mark.parametrize("n", [20, 50, 60, 80, 100, 150, 300])
def test_edited_items_are_candidates(n):
    rng = random.Random(n)
    make = lambda m: [f"w{rng.randrange(4000)}" for _ in range(m)]
    items, docs = [(i, make(n)) for i in range(3)], []
    for i, item in items:
        for edits in (0, 1, 2, 3):
            for kind in ("replace", "insert", "delete"):
                ws = list(item)
                # 0 stands for the last word alone.
                for at in sorted(rng.sample(range(1, n - 1), edits) or [n - 1], reverse=True):
                    ws[at: at + (kind != "insert")] = [] if kind == "delete" else make(1)
                docs.append((len(docs), " ".join(make(rng.randrange(40)) + ws + make(rng.randrange(40)))))
    items = [(i, " ".join(t)) for i, t in items]
    index, data = D.ItemIndex(items), D.pa.RecordBatch.from_pydict({"text": [t for _, t in docs]})
    got = {}
    for a, _, raw, offsets in D.pieces(data, "text"):
        for d, i, _, part, whole in index.matches(D.Words(raw, offsets, D.Powers()), len(offsets) - 1):
            got[a + d, i] = part / whole
    want = brute(docs, items)
    # A window cut at the start of a document may reach the threshold where no whole one does.
    assert not set(want) - set(got) and want
    assert all(got[k] >= want[k] - 1e-12 for k in want)
    texts = dict(items)
    for d, i in set(got) - set(want):
        ws, it = words(docs[d][1]), words(texts[i])
        assert max(similarity(ws[: m], it, 5) for m in range(5, n)) >= 0.8
