"""Archives are valid WARC, revisits resolve, odd rows come back."""

import base64
import gzip
import hashlib
from collections import Counter
from pathlib import Path

from flowguard.llm import warc as W


def rows(spark):
    given = [(1, "http://a", "same"), (5, "http://b", "same"), (9, "http://c", "same"), (2, None, None), (3, "", ""), (4, "x\r\ny", "one\r\n\r\ntwo"),
             (6, "http://d", "WARC/1.1\r\n\r\n"), (7, "http://e", "é" * 9000), (None, "http://n", "alone"), (8, "http://s", "tiny")]
    return given, spark.createDataFrame([(u, i, h, "k") for i, u, h in given], "url string, page_id long, html string, payload_digest string")


def test_round_trip_and_revisits(spark):
    given, df = rows(spark)
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in W.archive_round_trip(spark, df).collect()}
    want = set()
    for i, _, h in given:
        data = (h or "").encode()
        best = max((j for j, _, g in given if (g or "") == (h or "") and j is not None), default=None)
        revisit = i != best
        want.add((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", best if revisit else None))
    assert got == want
    large = {(r.page_id, r.record_type) for r in W.archive_round_trip(spark, df, min_bytes=5).collect()}
    assert large == {(i, "response") for i, _, _ in given}
    assert W.archive_round_trip(spark, df.limit(0)).count() == 0


def test_files_follow_the_format(spark, tmp_path):
    _, df = rows(spark)
    W.write_archives(df, f"{tmp_path}/warc", file_bytes=2000)
    n = 0
    for f in Path(f"{tmp_path}/warc").glob("*.gz"):
        data = gzip.decompress(f.read_bytes())
        at = 0
        while at < len(data):
            head = data[at: data.index(b"\r\n\r\n", at)]
            assert head.startswith(b"WARC/1.1\r\nWARC-Type: ")
            size = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
            at += len(head) + 4 + size
            assert data[at: at + 4] == b"\r\n\r\n"
            at += 4
            n += 1
    assert n == 10


def test_repeated_and_null_ids_keep_their_payloads(spark):
    given = [(1, "A"), (1, "B"), (2, "A"), (2, "C"), (5, "B"), (5, "C2"), (6, "C2"), (6, "A"), (3, "D"), (3, "D")]
    given += [(None, h) for h in ["A", "B", "lone", "lone", None] for _ in range(20)] + [(None, f"text {i}") for i in range(200)]
    df = spark.createDataFrame([("u", i, h) for i, h in given], "url string, page_id long, html string")
    got = Counter(tuple(r) for r in W.archive_round_trip(spark, df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    want = Counter()
    for i, h in given:
        data = (h or "").encode()
        best = max((j for j, g in given if (g or "") == (h or "") and j is not None), default=None)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want[i, len(data), digest, *(("response", None) if i == best else ("revisit", best))] += 1
    assert got == want


def test_null_ids_are_dealt_to_many_archives(spark, tmp_path):
    df = spark.createDataFrame([("u", None, f"text {i}" * 50) for i in range(200)], "url string, page_id long, html string")
    W.write_archives(df, f"{tmp_path}/warc", file_bytes=20_000)
    assert len([f for f in Path(f"{tmp_path}/warc").glob("*.gz") if gzip.decompress(f.read_bytes())]) > 3
