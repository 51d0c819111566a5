"""Fill-in-the-middle against a plain version, the trees against counting, and exact round trips."""

import hashlib
import random
import re

import numpy as np
import pytest

from flowguard.llm import middle as M
from flowguard.llm.tables import F

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_version(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i: 8 * i + 8], 16) for i in range(4))
    units = UNIT.findall(text)
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def some_texts():
    rng = random.Random(4)
    texts = ["", None, " ", "a", " a", "a ", "\t\n", "x" * 700, "é" * 600, "has <P> a mark", "<M>", "half <S", " " * 900 + "w", "w" + " " * 900,
             " no break space\u0085", "word " * 60_000, "\0 nul \0", "ends in <", "😀 " * 300]
    texts += ["".join(rng.choice("ab é\t\n😀 ") for _ in range(rng.choice([5, 255, 256, 257, 1024, 3000]))) for _ in range(150)]
    return texts


def test_whole_texts_against_a_plain_version(spark):
    rows = [(i * 7 - 20, t, "x", 5) for i, t in enumerate(some_texts())] + [(None, "no id " * 9, "x", 5), (8, "again and again", "x", 5), (8, "again and again", "x", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, n int")
    out = M.transform(df)
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect()), key=repr)
    assert got == sorted(((i, *plain_version(i, t)) for i, t, *_ in rows), key=repr)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}
    again = M.digests(out).collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted(r.restored_sha256 for r in again) == sorted(sha(t) for _, t, *_ in rows)
    assert sorted(r.output_sha256 for r in again) == sorted(sha(plain_version(i, t)[4]) for i, t, *_ in rows)
    assert M.digests(M.transform(df.limit(0))).count() == 0


def test_rates_are_parameters(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"))
    assert {r.form for r in M.transform(df, rate=100, suffix_first=0).collect()} == {"psm"}
    assert {r.form for r in M.transform(df, rate=0).collect()} == {"plain"}
    shares = {r.form: r["count"] for r in M.transform(df).groupBy("form").count().collect()}
    assert shares["plain"] == pytest.approx(200, abs=50) and shares["spm"] > 2 * shares["psm"]


@pytest.mark.parametrize("text", ["a b c", "word " * 1000, "é" * 3000 + " ü" * 500, " \n" * 400 + "end", "x" * 256 + " " + "y" * 255])
def test_tree_finds_every_boundary(text):
    data = np.frombuffer(text.encode(), np.uint8)
    offsets = np.array([0, len(data)])
    ends, starts = M.unit_ends(data, offsets), (data & 0xC0) != 0x80
    begin, _ = M.block_layout(offsets)
    tree = M.TextTree(ends, starts, np.add.reduceat(ends, begin, dtype=int), np.add.reduceat(starts, begin, dtype=int))
    units, size, points = UNIT.findall(text), 0, 0
    assert tree.after(0) == (0, 0) and int(ends.sum()) == len(units)
    for k, unit in enumerate(units, 1):
        size, points = size + len(unit.encode()), points + len(unit)
        assert tree.after(k) == (size, points)
