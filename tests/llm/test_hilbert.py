"""The curve is a Hilbert curve, shards are even, odd rows keep a place."""

import zlib

from flowguard.llm import hilbert as H
from flowguard.llm.tables import F


def test_curve_visits_every_cell_by_single_steps(spark):
    n = 1 << H.BITS
    axes = [(F.floor(F.col("id") / n ** i) % n).cast("int") for i in range(3)]
    rows = spark.range(n ** 3).select(*[a.alias(f"x{i}") for i, a in enumerate(axes)]).withColumn(
        "d", H.hilbert_index([F.col(f"x{i}") for i in range(3)])).orderBy("d").collect()
    assert [r.d for r in rows] == list(range(n ** 3))
    assert all(sum(abs(a[i] - b[i]) for i in range(3)) == 1 for a, b in zip(rows, rows[1:]))


def test_odd_rows(spark):
    given = [(i, "t" * (i % 9), "s", "en") for i in range(50)] + [(None, None, None, None), (3, "é", "", "x"), (3, "é", "", "x"), (7, "q" * 10**6, "z", None)]
    df = spark.createDataFrame(given, "doc_id long, text string, source string, lang string").withColumn("curve", F.lit("clash"))
    got = H.shard_documents(df, 24).collect()
    assert len(got) == len(given)
    by = {k: sorted(r.slot for r in got if r.shard == k) for k in range(24)}
    assert all(v == list(range(len(v))) for v in by.values()) and {len(v) for v in by.values()} <= {2, 3}
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t, _, _ in given)
    assert H.shard_documents(df.limit(0)).count() == 0
    assert H.manifest(H.shard_documents(df)).count() == 24
