"""Removal of repeated strings against a plain count of all strings."""

import hashlib
import random

import numpy as np
import pytest

from flowguard.llm import repeats as R
from flowguard.llm.textbytes import Powers


def brute(rows):
    seen = {}
    texts = [(t or "").encode() for _, t in rows]
    for t in texts:
        for i in range(len(t) - R.LENGTH + 1):
            s = t[i: i + R.LENGTH]
            seen[s] = seen.get(s, 0) + 1
    out = []
    for (doc, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - R.LENGTH + 1):
            if seen[t[i: i + R.LENGTH]] > 1:
                gone[i: i + R.LENGTH] = b"\1" * R.LENGTH
        kept = bytes(c for c, g in zip(t, gone) if not g)
        count = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(t), sum(gone), count, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(3)
    make = lambda n, a="abcdefgh é": "".join(rng.choice(a) for _ in range(n))
    passages = [make(n) for n in (150, 199, 200, 201, 260, 700)]
    rows = [(i, make(rng.choice([0, 5, 199, 300])) + rng.choice(passages) + make(rng.choice([1, 80, 400]))) for i in range(60)]
    base = make(1500)
    for i in range(20):
        at = rng.randrange(1400)
        rows.append((100 + i, base[:at] + rng.choice(["", "X", "YZ"]) + base[at + rng.choice([0, 1, 9]):]))
    rows += [(200, "a" * 900), (201, "ab" * 350), (202, make(30) * 30), (203, base), (204, base), (205, make(400) * 2)]
    return rows + [(206, None), (207, ""), (None, base[:450]), (None, make(700)), (rows[0][0], rows[0][1])]


@pytest.mark.parametrize("block_contexts", [2048, 3])
def test_against_all_strings(spark, block_contexts):
    rows = corpus()
    df = spark.createDataFrame([(t, i, "k") for i, t in rows], "text string, doc_id long, anchor string")
    got = R.remove_repeats(df, block_contexts=block_contexts).drop("kept").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_small_table_and_no_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = R.remove_repeats(docs).drop("kept").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert R.remove_repeats(docs.limit(0)).count() == 0


def test_run_length_index_gives_suffix_neighbours():
    rng = random.Random(9)
    strings = ["".join(rng.choice("ab") for _ in range(n)).encode() for n in (1, 5, 30, 30, 40)] + [b"abab" * 9] * 3
    groups = np.array([0, 0, 0, 1, 1, 1, 2, 2])
    index = R.RunLengthIndex(strings, groups)
    at = [(int(groups[k]), strings[k][i:], k, int(index.first[k]) + i) for k in range(8) for i in range(len(strings[k]) + 1)]
    order = [p for *_, p in sorted(at, key=lambda x: (x[0], x[1], x[2]))]
    up, down = index.neighbours(np.array(order))
    assert up.tolist()[1:] == order[:-1] and down.tolist()[:-1] == order[1:]
    assert index.runs < len(order)
    flags = index.repeats(12, Powers())
    for g, s, k, p in at:
        want = len(s) >= 12 and sum(x[0] == g and x[1][:12] == s[:12] and len(x[1]) >= 12 for x in at) > 1
        assert bool(flags[p]) == want


def test_contexts_that_share_only_their_anchor_reach_no_index():
    rng = random.Random(4)
    make = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    gram, left, right = make(R.GRAM), make(84), make(84)
    row = lambda anchor, a, b, parts=1: (anchor, 0, parts, rng.random(), len(a), a + gram + b)
    rows = [row(1, make(168), make(168)), row(1, make(84) + left, make(168)), row(1, left, make(20)), row(1, make(30), right + make(84)),
            row(1, make(9), right), row(2, make(84) + left, make(168)), row(1, make(40), make(83)), row(3, make(168), make(168), 2)]
    assert R.hopeful(rows, Powers()).tolist() == [False, True, True, True, True, False, False, True]


def test_contexts_keep_what_they_share_with_another_one():
    rng = random.Random(5)
    make = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    gram, left, right = make(R.GRAM), make(100), make(90)
    row = lambda anchor, a, b, parts=1: (anchor, 0, parts, rng.random(), len(a), a + gram + b)
    rows = [row(1, make(67) + b"x" + left, right + b"x" + make(20)), row(1, make(30) + b"y" + left, make(168)), row(1, make(9), right + b"y"),
            row(2, make(168), make(168)), row(2, make(168), b"q" + right), row(3, make(168), make(168), 2), row(4, left, right), row(5, left, right)]
    first, end = R.shared_parts(rows, Powers())
    assert (end - first).tolist()[:1] == [222] and first[0] == 68
    assert (first == end).tolist() == [False, True, True, True, True, False, True, True]
    assert (first[5], end[5]) == (0, 368)


def test_known_symbols_are_tripled():
    """Suffix order is the same however many symbols the first key holds."""
    rng = random.Random(2)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.choice([1, 40, 300]))) for _ in range(40)] + [b"ab" * 150] * 3
    for many in (1, 10**6, 10**9):
        groups = np.repeat([0, many], [20, 23])
        index = R.RunLengthIndex(strings, groups)
        at = sorted((int(groups[k]), strings[k][i:], k, int(index.first[k]) + i) for k in range(43) for i in range(len(strings[k]) + 1))
        order = [p for *_, p in at]
        up, down = index.neighbours(np.array(order))
        assert up.tolist()[1:] == order[:-1] and down.tolist()[:-1] == order[1:]


def test_anchors_are_the_last_of_the_smallest_runs():
    rng = random.Random(8)
    table = Powers()
    for text in (b"a" * 700, b"abc" * 300, bytes(rng.choice(b"ab") for _ in range(900)), bytes(rng.choice(b"abcdefgh") for _ in range(500)) * 2):
        sums, down = R.byte_sums(np.frombuffer(text, np.uint8), table)
        value = R.run_hash(sums, down, np.arange(len(text) - R.GRAM + 1), R.GRAM).tolist()
        want = {max(range(w, w + R.REACH + 1), key=lambda p: (-value[p], p)) for w in range(len(text) - R.LENGTH + 1)}
        assert R.anchors(sums, down, 0, len(text))[0].tolist() == sorted(want)
