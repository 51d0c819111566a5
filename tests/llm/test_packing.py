"""Packing is lossless, close to full, and best fit."""

import random

import numpy as np
import pytest
import tiktoken
from pyspark import cloudpickle

from flowguard.llm.packing import RoomTree, WordCachedEncoder, best_fit_decreasing, default_ranks, pack_documents
from flowguard.llm.tables import table

SCHEMA = "text string, doc_id long, pack_id string, n_tokens string"


@pytest.fixture(scope="module")
def encoder():
    return WordCachedEncoder(default_ranks())


def unpack(rows, encoder, row_tokens):
    parts = {}
    for r in rows:
        assert len(r.input_ids) == len(r.position_ids) == 2 * row_tokens
        ids, pos = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= row_tokens
        for a, b, doc, n, start in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.doc_rows, r.doc_starts):
            assert pos[a:b].tolist() == list(range(b - a))
            parts.setdefault((doc, n), []).append((start, ids[a:b].tolist()))
    out = []
    for (doc, _), segs in parts.items():
        segs.sort()
        ids = []
        for start, seg in segs:
            assert start == len(ids)
            ids += seg
        out.append((doc, encoder.encoding.decode(ids)))
    return out


def test_round_trip_of_the_table(spark, folder, encoder):
    docs = table(spark, folder, "documents")
    rows = pack_documents(docs).collect()
    got = sorted(unpack(rows, encoder, 2048))
    assert got == sorted((r.doc_id, r.text) for r in docs.collect())
    assert sum(r.n_tokens for r in rows) > 0.95 * 2048 * len(rows)


def test_odd_rows(spark, encoder):
    given = [(None, 1, "x", "y"), ("", 2, None, None), ("a b  c\n d\t", 3, "", ""), (" lead", None, "", ""),
             ("x y", 4, "", ""), ("x y", 4, "", ""), ("long word " * 3000, 5, "", ""), ("\n", 6, "", "")]
    rows = pack_documents(spark.createDataFrame(given, SCHEMA), row_tokens=64).collect()
    key = lambda x: (str(x[0]), x[1])
    assert sorted(unpack(rows, encoder, 64), key=key) == sorted([(i, t or "") for t, i, _, _ in given], key=key)
    assert pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_encoder_equals_plain_encoding(encoder):
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice(["a", "the", " ", " ", "\n", "é", "1", "!", " ", "'s", "  "]) for _ in range(30))
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == encoder.encoding.encode_ordinary(text)


def test_best_fit_against_a_plain_search():
    rng = random.Random(5)
    for _ in range(30):
        lengths = [rng.randint(0, 40) for _ in range(120)]
        room, want = [], []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fit = [r for r in room if r >= lengths[i]]
            room.remove(min(fit)) if fit else None
            room.append((min(fit) if fit else 40) - lengths[i])
            want.append(0)
        rows = best_fit_decreasing(lengths, 40)
        assert sorted(i for r in rows for i in r) == list(range(120))
        assert sorted(40 - sum(lengths[i] for i in r) for r in rows) == sorted(room)
    assert RoomTree(8).take(3) is None


def test_unknown_words_of_a_text_are_encoded_in_one_go(monkeypatch):
    encoder, asked = WordCachedEncoder(default_ranks()), []
    numbers = encoder._numbers
    monkeypatch.setattr(encoder, "_numbers", lambda text: asked.append(text) or numbers(text))
    text = "One tödd\nx 12345 don't! один 二 三 a'b zzqqxx one tödd\nx"
    assert encoder.encode(text) == np.array(encoder.encoding.encode_ordinary(text), "<u2").tobytes()
    assert len(asked) == 2
    encoder.encode(text)
    assert asked[2:] == ["One"]


def test_an_encoder_forgets_and_travels_without_changing_ids(monkeypatch):
    monkeypatch.setattr("flowguard.llm.packing.CACHE_WORDS", 5)
    encoder, lot = cloudpickle.loads(cloudpickle.dumps(WordCachedEncoder(default_ranks()))), random.Random(4)
    for _ in range(200):
        text = " ".join(lot.choice(["", "a", "bb", "c\nd", "e\t", "é", "ff,", "1234567", "'s", "  "]) for _ in range(lot.randrange(12)))
        assert encoder.encode(text) == np.array(encoder.encoding.encode_ordinary(text), "<u2").tobytes()
