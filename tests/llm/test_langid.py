"""The network's gradients, its accuracy on documents it has not seen, odd rows."""

import numpy as np

from flowguard.llm import langid as L
from flowguard.llm.queries import QUERIES


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    net = L.ByteGru(3, hidden=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    symbols, labels = rng.integers(90, 110, (L.CORE + 2 * L.CONTEXT, 3)), np.array([0, 1, 2])
    symbols[-40:, 1] = L.PAD
    _, grad = net.gradients(symbols, labels)
    for name, value in net.p.items():
        at = tuple(rng.integers(0, n) for n in value.shape) if not name.startswith("x") else (95, int(rng.integers(0, value.shape[1])))
        old = value[at]
        value[at] = old + 1e-3
        up, _ = net.gradients(symbols, labels)
        value[at] = old - 1e-3
        down, _ = net.gradients(symbols, labels)
        value[at] = old
        assert abs((up - down) / 2e-3 - grad[name][at]) < 2e-5 + 0.02 * abs(grad[name][at]), name


def test_every_byte_is_in_one_core():
    texts = [b"", b"a" * 95, b"b" * 96, b"c" * 97, b"d" * 500]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])]
    symbols, text, size = L.cut_windows(data, offsets)
    assert np.bincount(text, weights=size, minlength=5).tolist() == [0, 95, 96, 97, 500]
    for row, t, n in zip(symbols, text, size):
        core = row[L.CONTEXT: L.CONTEXT + n]
        assert set(core.tolist()) == {texts[t][0]}
        assert set(row.tolist()) <= {texts[t][0], L.PAD}


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op1_byte_language"](spark, folder)
    known = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = got.join(known, "doc_id").collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) > 0.97 * len(held) > 200


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, "en"), (2, "", None), (3, "12 !!", "en"), (None, "abc", "x"), (4, "abc", "x"), (5, "Zoë " * 9000, None)],
        "doc_id long, text string, lang string").withColumn("score", L.F.lit("clash"))
    net, languages = L.fit(docs)
    rows = {(r.doc_id, r.lang_pred) for r in L.predict(docs, net, languages).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= rows and len(rows) == 6
    net, languages = L.fit(docs.limit(0))
    assert {r.lang_pred for r in L.predict(docs, net, languages).collect()} == {"und"}
    assert L.predict(docs.limit(0), net, languages).count() == 0
