"""The manifest against a plain version that builds and folds every tree in Python."""

import hashlib
import random
import zlib

from flowguard.llm import merkle as K

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, leaf string, path int, _s string, _i int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha("".join(map(part, (doc_id, source, lang, n_chars, text))))


def climb(nodes):
    """``(top, siblings)`` with the left and right siblings of each node on its way."""
    ways, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // 3 * 3: i // 3 * 3 + 3]
            ways[k].append(("".join(run[: i % 3]), "".join(run[i % 3 + 1:])))
        level = [sha("".join(level[j: j + 3])) for j in range(0, len(level), 3)]
        at = [i // 3 for i in at]
    return level[0], ways


def plain_version(rows):
    """Rows ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``."""
    by = {}
    for doc_id, text, lang, source, n_chars in rows:
        forged = text
        if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
            forged = text.replace("\n", "")
        by.setdefault(source, []).append(
            (doc_id is not None, doc_id or 0, leaf_of(doc_id, source, lang, n_chars, text), doc_id, leaf_of(doc_id, source, lang, n_chars, forged)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (sorted(by[s], key=lambda x: x[:3]),) for s in order}
    trees = {s: (docs, *climb([d[2] for d in docs])) for s, (docs,) in trees.items()}
    root, ways = climb([trees[s][1] for s in order])
    out = []
    for s, upper in zip(order, ways):
        docs, subroot, lower = trees[s]
        for (_, _, leaf, doc_id, forged), way in zip(docs, lower):
            acc = forged
            for left, right in way + upper:
                acc = sha(left + acc + right)
            out.append((doc_id, leaf, subroot, root, sha("".join(a + b for a, b in way + upper)), acc, acc == root))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA)
    got = [tuple(r) for r in K.verify(K.manifest(df)).collect()]
    assert sorted(got, key=repr) == sorted(plain_version(rows), key=repr)
    return got


def test_sources_of_every_size(spark):
    rng = random.Random(5)
    rows, doc_id = [], -30
    for source, n in (("big", 95), (None, 7), ("", 1), ("é", 3), ("Z", 9), ("z", 4), ("a", 10), ("b", 27), ("c", 28)):
        for _ in range(n):
            doc_id += rng.choice([1, 1, 5, 900])
            rows.append((doc_id, rng.choice(["one\ntwo", "plain", "", None, "é\n\n" * 50, "3:a-"]), rng.choice(["en", None]), source, rng.choice([0, None, 12])))
    rng.shuffle(rows)
    got = check(spark, rows)
    assert {r[6] for r in got} == {True, False}


def test_null_and_repeated_ids(spark):
    rows = [(None, f"t{i % 4}\n", "en", "s", i % 4) for i in range(9)] + [(5, f"same id {i % 3}\n", None, "s", None) for i in range(8)]
    check(spark, rows + [(7, "long\n" * 100_000, "en", "s", 1)])


def test_small_tables(spark):
    check(spark, [(1, "only\n", "en", None, 3)])
    check(spark, [(1, "a", "en", "x", 3), (2, "b", "en", "x", 3)])
    check(spark, [(i, "a\n", "en", f"s{i}", 3) for i in range(5)])
    empty = spark.createDataFrame([], SCHEMA)
    assert K.verify(K.manifest(empty)).collect() == []


def test_proof_of_a_tampered_field_fails(spark):
    df = spark.createDataFrame([(i, f"text {i}", "en", "s", i, "x", 1, "y", 2) for i in range(30)], SCHEMA)
    whole = K.manifest(df)
    assert {r.verified for r in K.verify(whole).collect()} == {True}
    forged = whole.withColumn("forged", K.leaf_digest([K.F.col("doc_id"), K.F.lit("s"), K.F.lit("en"), K.F.lit(0), K.F.lit("text")]))
    assert {r.verified for r in K.verify(forged).collect()} == {False}
