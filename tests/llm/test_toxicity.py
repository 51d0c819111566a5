"""The index is exact, unseen documents are told apart, odd rows get a score."""

import numpy as np

from flowguard.llm import toxicity as T
from flowguard.llm.queries import QUERIES


def test_block_max_search_is_exact():
    rng = np.random.default_rng(3)
    examples = []
    for _ in range(500):
        t = np.sort(rng.choice(40, rng.integers(1, 8), replace=False))
        w = rng.random(len(t))
        examples.append((t, w / np.sqrt((w * w).sum())))
    index = T.BlockMaxIndex(examples, 40)
    dense = np.zeros((500, 40))
    for e, (t, w) in enumerate(examples):
        dense[e, t] = w
    for q, (t, w) in enumerate(examples[:80]):
        score = dense @ dense[q]
        s, e = index.nearest(t, w, 7)
        assert np.allclose(s, np.sort(score)[::-1][:7])
        out_s, out_e = index.nearest(t, w, 7, leave_out=q)
        assert q not in out_e and np.allclose(out_s, np.sort(np.delete(score, q))[::-1][:7])


def test_common_and_rare_terms_together_are_exact():
    """Terms of falling frequency, so that some have dense rows and others only blocks; many blocks."""
    rng = np.random.default_rng(8)
    share = 1 / (1 + np.arange(300))
    examples = []
    for _ in range(1500):
        t = np.flatnonzero(rng.random(300) < share)
        t = t if len(t) else np.array([7])
        w = rng.random(len(t)) + 0.01
        examples.append((t, w / np.sqrt((w * w).sum())))
    examples[40] = examples[900]
    index = T.BlockMaxIndex(examples, 300)
    assert 0 < index.n_common < 300 and index.blocks > 4
    dense = np.zeros((1500, 300))
    for e, (t, w) in enumerate(examples):
        dense[e, t] = w
    products = index.products(examples[:60])
    for q, (t, w) in enumerate(examples[:60]):
        score = np.round(dense @ dense[q], 12)
        want = np.lexsort((np.arange(1500), -score))
        s, e = index.nearest(t, w, 9, product=products[q])
        assert np.allclose(s, score[want[:9]]) and set(e[s > s[-1] + 1e-9]) == set(want[:9][score[want[:9]] > s[-1] + 1e-9])
        assert q not in index.nearest(t, w, 9, leave_out=q, product=products[q])[1]
    assert list(index.nearest(*examples[900], 2)[1]) == [40, 900]


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    got = QUERIES["op6_toxicity_votes"](spark, folder).filter("held_out")
    rows = got.join(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic"), "doc_id").collect()
    bad = [r.score for r in rows if r.toxic == 1]
    good = [r.score for r in rows if r.toxic == 0]
    assert sum(x > y for x in bad for y in good) > 0.9 * len(bad) * len(good)
    assert sum(x >= 0.3 for x in bad) > 0.8 * len(bad) and sum(x >= 0.3 for x in good) < 0.03 * len(good)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "12 !"), (None, "abc def"), (4, "abc def"), (5, "bad " * 50000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in T.score(docs, T.fit(docs, none)).collect()} == {0.0}
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1), (4, 1), (4, 0), (5, 1)], "doc_id long, toxic int")
    rows = T.score(docs, T.fit(docs, labels)).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    model = T.fit(docs.limit(0), none)
    assert T.score(docs.limit(0), model).count() == 0 and T.drop_toxic(docs, model).count() == 6


def small_corpus():
    """Clean and toxic examples; ``zorgle`` and its kin stand in two toxic examples only."""
    rng = np.random.default_rng(4)
    common = [f"w{chr(97 + i)}{chr(97 + j)}ord" for i in range(10) for j in range(10)]
    docs, labels = [], []
    for i in range(240):
        words = list(rng.choice(common, 30))
        if i % 6 == 0:
            words[3:6] = ["vile", "scum", "idiot"] if i >= 12 else ["zorgle", "blarfing", "quentix"]
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 6 == 0)))
    docs += [(1000, "the green river flows gently " + " ".join(common[:6])), (1001, "xylophone zebra waltz " + " ".join(common[50:56])),
             (1002, "zorgle blarfing quentix zorgle blarfing quentix " + common[7]), (1003, "vile scum " + common[9])]
    return docs, labels


def test_unlike_texts_have_their_own_evidence_and_rare_toxic_words_count(spark):
    docs, labels = small_corpus()
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    model = T.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in T.score(docs, model).collect()}
    evidence = {d: [e.doc_id for e in got[d].evidence] for d in got}
    assert evidence[1000] != evidence[1001] and got[1000].evidence[0].similarity < 0.99
    assert set(evidence[1002][:2]) == {0, 6} and got[1002].score >= T.CUTOFF and got[1003].score >= T.CUTOFF
    assert got[1000].score < T.CUTOFF and got[1001].score < T.CUTOFF


def test_scores_are_those_of_plain_cosines(spark):
    """Words without byte runs of telling length, counted, weighted and compared one by one."""
    import math
    from collections import Counter

    docs, labels = small_corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = T.fit(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    grams = lambda w: [w[i: i + 6] for i in range(len(w) - 5)]
    bags = {d: (Counter(t.split()), Counter(g for w in t.split() for g in grams(w))) for d, t in docs}
    toxic = dict(labels)
    n_pos, n_neg = sum(toxic.values()), len(toxic) - sum(toxic.values())

    def chi(kind, term):
        a = max(sum(term in bags[d][kind] for d in toxic if toxic[d]) - 1, 0)
        b = sum(term in bags[d][kind] for d in toxic if not toxic[d])
        cross = a * (n_neg - b) - b * (n_pos - a)
        x = (n_pos + n_neg) * cross ** 2 / max((a + b) * (n_pos + n_neg - a - b) * n_pos * n_neg, 1) if cross > 0 else 0
        return x / (x + 13) if x >= 13 else 0.0

    weight = {}
    for kind in (0, 1):
        for term in set().union(*(bags[d][kind] for d in bags)):
            df = sum(term in bags[d][kind] for d in bags)
            known = any(term in bags[d][kind] for d in toxic)
            if kind == 0:
                weight[kind, term] = (math.log((len(docs) + 1) / (df + 1)) + 1) * (0.1 + 0.9 * chi(0, term)) if known else (math.log(len(docs) + 1) + 1) * 0.1
            else:
                weight[kind, term] = (math.log((len(docs) + 1) / (df + 1)) + 1) * chi(1, term)
    vec = {}
    for d in bags:
        v = {(k, t): (1 + math.log(c)) * weight[k, t] for k in (0, 1) for t, c in bags[d][k].items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vec[d] = {t: x / norm for t, x in v.items()}
    got = {r.doc_id: r for r in T.score(frame, model).collect()}
    for d in (1000, 1001, 1002, 1003, 5, 6):
        sims = sorted(((sum(x * vec[e].get(t, 0.0) for t, x in vec[d].items()), e) for e in toxic), key=lambda p: -p[0])[:T.NEIGHBOURS]
        votes = [(1 / (1 - min(s, 1) + T.SOFT), toxic[e]) for s, e in sims]
        vote = sum(w * y for w, y in votes) / sum(w for w, _ in votes)
        assert abs(got[d].score - 1 / (1 + math.exp(-(model.a * vote + model.b)))) < 1e-6
        assert np.allclose([e.similarity for e in got[d].evidence], [s for s, _ in sims[:3]])


def test_sample_is_bounded_in_rows_and_bytes(spark):
    rows = [(1, f"text {i}") for i in range(500)] + [(2, "x" * 400), (3, "abc"), (None, "abc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = T.sample_examples(docs, [(1, 1), (2, 0), (3, 0)], most_bytes=100).collect()
    assert sorted(r.doc_id for r in got) == [1, 3]


def test_votes_on_examples_are_made_in_tasks(spark, monkeypatch):
    """The dense rows of the common terms never stand in the driver's memory."""
    def refuse(*_):
        raise AssertionError("multiplied in the driver")

    monkeypatch.setattr(T.BlockMaxIndex, "products", refuse)
    rows = [(i, "calm words here " * (1 + i % 3) + ("vile slur " if i % 4 == 0 else "kind talk ") + f"w{i}") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = T.fit(docs, labels)
    assert model.a > 0 and np.isfinite(model.b)
