"""Winnowing against a plain version of it, and the edited texts against Python."""

import hashlib
import random

import pytest

from flowguard.llm import winnow as W
from flowguard.llm.tables import F


def plain(values, window):
    """Positions (from 0) of the rightmost smallest value of each window."""
    out = set()
    for s in range(max(1, len(values) - window + 1)):
        part = values[s: s + window]
        out.add(s + max(i for i, v in enumerate(part) if v == min(part)))
    return sorted(out)


def test_kept_hashes_against_a_plain_scan(spark):
    rng = random.Random(1)
    texts = ["", None, "a", "abc" * 3, "x" * 5000, "é" * 50, "ab" * 400]
    texts += ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (11, 12, 13, 43, 44, 100, 2100, 4300)]
    df = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, hashes string")
    got = {r.doc_id: r for r in W.fingerprints(df).collect()}
    for i, text in enumerate(texts):
        data = (text or "").encode()
        grams = [data[p: p + W.GRAM] for p in range(max(1, len(data) - W.GRAM + 1))] if data else []
        if not grams:
            assert got[i].hashes == got[i].positions == []
            continue
        rows = spark.createDataFrame([(p, bytearray(g)) for p, g in enumerate(grams)], "p long, g binary")
        value = {r.p: r.h for r in rows.select("p", F.shiftright(F.xxhash64("g"), 32).bitwiseAND(F.lit(0x7FFFFFFF)).alias("h")).collect()}
        want = plain([value[p] for p in range(len(grams))], W.WINDOW)
        assert [p - 1 for p in got[i].positions] == want
        assert got[i].hashes == [value[p] for p in want]


def test_edited_texts_and_likeness(spark):
    rng = random.Random(2)
    rows = [(i * rng.choice([1, 700]), "".join(rng.choice("abcdefgh é") for _ in range(rng.choice([0, 1, 7, 300, 900])))) for i in range(60)]
    rows += [(5, None), (rows[3][0], "again"), (None, "no id"), (-40, "negative id " * 9)]
    df = spark.createDataFrame([(t, i, "z") for i, t in rows], "text string, doc_id long, fingerprint string")
    got = W.edited_likeness(df).collect()
    assert len(got) == len(rows)
    order = sorted([(i is not None, i or 0, t or "") for i, t in rows])
    want = []
    for at, (some, i, text) in enumerate(order):
        after = order[(at + 1) % len(order)][2]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        want.append((i if some else None, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    key = lambda r: (str(r[0]), r[1], r[2])
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in got], key=key) == sorted(want, key=key)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    long = [r for r in got if r.n_chars >= 300]
    assert sum(r.near_edited for r in long) / len(long) > 0.25 > sum(r.near_next for r in long) / len(long)
    assert W.edited_likeness(df.limit(0)).count() == 0
    alone = W.edited_likeness(df.limit(1)).collect()
    assert alone[0].near_next == 1.0


def test_equal_texts_have_equal_fingerprints(spark, folder):
    rows = W.edited_likeness(spark.read.parquet(f"{folder}/documents.parquet")).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    by = {}
    for r in rows:
        assert by.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint
    assert len({r.fingerprint for r in rows}) == pytest.approx(len(set(text.values())), abs=2)


def test_spliced_equals_the_whole(spark):
    rng = random.Random(6)
    rows = []
    for i in range(150):
        a, b = ("".join(rng.choice(rng.choice(["ab", "abcdé fgh"])) for _ in range(rng.choice([0, 1, 20, 42, 43, 44, 90, 700]))) for _ in range(2))
        rows.append((i, a, b, a[: rng.randint(0, len(a))], b[: rng.randint(0, len(b))]))
    df = spark.createDataFrame(rows, "i int, a string, b string, x string, y string").withColumn("ka", W.selected(F.col("a"))).withColumn("kb", W.selected(F.col("b")))
    got = df.select("i", W.spliced(F.col("x"), F.col("y"), F.col("ka"), F.col("kb")).alias("s"), W.selected(F.concat("x", "y")).alias("w")).collect()
    assert [r.i for r in got if r.s != r.w] == [] and len(got) == 150
