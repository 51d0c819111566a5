"""WARC archives whose repeated payloads are revisit records.

Only headers (id, digest, length) are shuffled by payload digest. Among records with one digest the
largest id stays the response, the others become revisits that refer to it. The archives are written
by Spark's text writer: a record is one line and the line separator is the two blank lines that end a
WARC record. Reading back splits the files by ``Content-Length`` and joins each revisit record to its
response, whose payload it stands for.

Defined cases: null html is an empty payload; null url is written as an empty target; payloads below
``min_bytes`` stay responses; a null id takes part as the smallest one and comes back as null; rows
that share an id share a record id and are told apart by their digest, and equal rows with the largest
id are all responses. No rows give no archives. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.llm.tables import written
from flowguard.session import work_folder

#: Payload bytes that one archive file holds at about; a file is read back in one task.
FILE_BYTES = 16 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Time of capture that is written where the source has none.
DATE = "1970-01-01T00:00:00Z"
END = "\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1: five hex digits are four base32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def resolve_revisits(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, payload_bytes, payload_digest`` plus ``record_type`` and ``refers_to``.

    Counts and largest ids are combined before the shuffle, so a hot digest is one row per task; the
    join back has a plain shuffle on both sides, which adaptive execution can split.
    """
    fit = headers.filter(F.col("payload_bytes") >= min_bytes)
    first = written(
        fit.groupBy(F.col("payload_digest").alias("_digest")).agg(
            F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "warc-originals")
    joined = headers.join(first, (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") >= min_bytes), "left")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return joined.select(
        *headers.columns, F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_first")).alias("refers_to"))


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def records(pages: DataFrame) -> DataFrame:
    """One string per record, without the blank lines at its end."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    is_revisit = F.col("record_type") == "revisit"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    target = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]", " ")
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", _record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)), line("WARC-Target-URI", target),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(is_revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _record_id(F.col("refers_to")))))
        .otherwise(F.lit("")),
        line("Content-Length", F.when(is_revisit, 0).otherwise(F.col("payload_bytes")).cast("string")), F.lit("\r\n"))
    return pages.select(F.concat(head, F.when(is_revisit, F.lit("")).otherwise(payload)).alias("value"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Write ``pages`` (``page_id, url, html``) as gzip-compressed WARC files in the folder ``path``."""
    html = F.coalesce(F.col("html"), F.lit(""))
    full = pages.select(
        "page_id", "url", "html", F.octet_length(html).cast("long").alias("payload_bytes"),
        base32_sha1(html.cast("binary")).alias("payload_digest"))
    headers = written(full.select("page_id", "payload_bytes", "payload_digest"), "warc-headers")
    total = headers.agg(F.sum("payload_bytes"), F.count(F.lit(1))).first()
    files = max(1, -(-((total[0] or 0) + 500 * total[1]) // file_bytes))
    # Payloads move once: dealt to the files by id and payload, which is also how the revisit marks are joined.
    key = F.coalesce(F.col("page_id").cast("string"), F.lit("null")).alias("_key")
    by = ["_key", "payload_digest", "payload_bytes"]
    marks = resolve_revisits(headers, min_bytes).filter("record_type = 'revisit'").select(
        key, *by[1:], "refers_to", "record_type").distinct()
    dealt = full.select("*", key).repartition(files, *by)
    joined = dealt.join(marks, by, "left").withColumn(
        "record_type", F.when(F.col("payload_bytes") >= min_bytes, F.coalesce("record_type", F.lit("response"))).otherwise("response"))
    records(joined).write.option("lineSep", END).option("compression", "gzip").text(path)


def _parse(data: bytes):
    """Headers and payload of each record of one uncompressed archive."""
    at, end = 0, len(data)
    while at < end:
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        length = int(fields["Content-Length"])
        yield fields, data[stop + 4: stop + 4 + length]
        at = stop + 4 + length + 4


RECORD_SCHEMA = ("record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload binary")


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zlib

    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    for batch in batches:
        for content in batch.column("content"):
            rows, size = [], 0
            data = zlib.decompress(content.as_py(), 31) if len(content.as_py()) else b""
            for f, payload in _parse(data):
                rows.append((f["WARC-Record-ID"], f["WARC-Type"], f.get("WARC-Target-URI", ""),
                             f["WARC-Payload-Digest"].removeprefix("sha1:"), f.get("WARC-Refers-To"), payload))
                size += len(payload)
                if size > 4 << 20:
                    yield _batch(rows, names)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, names)


def _batch(rows, names):
    kinds = [pa.string()] * 5 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives in the folder ``path``, one row each."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_read_batches, RECORD_SCHEMA)


def resolved_records(spark: SparkSession, path: str) -> DataFrame:
    """Every page of the archives with the length and digest of its full payload."""
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    # Lengths and digests are taken from the payloads read, not from the headers.
    rows = written(read_archives(spark, path).select(
        "record_id", "record_type", "refers_to", F.col("payload_digest").alias("_said"), F.octet_length("payload").cast("long").alias("_bytes"),
        base32_sha1(F.col("payload")).alias("_digest")), "warc-read")
    originals = rows.filter("record_type = 'response'").join(
        rows.filter("record_type = 'revisit'").select(F.col("refers_to").alias("record_id"), F.col("_said").alias("_digest")).distinct(),
        ["record_id", "_digest"], "left_semi"
    ).select(F.col("record_id").alias("_of"), F.col("_bytes").alias("_obytes"), F.col("_digest").alias("_odigest")).distinct()
    joined = rows.join(written(originals, "warc-responses"), (F.col("refers_to") == F.col("_of")) & (F.col("_said") == F.col("_odigest")), "left")
    return joined.select(
        page(F.col("record_id")).alias("page_id"), F.coalesce("_obytes", "_bytes").alias("payload_bytes"),
        F.coalesce("_odigest", "_digest").alias("payload_digest"), "record_type", page(F.col("refers_to")).alias("refers_to"))


def archive_round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and return what reading them back gives."""
    path = work_folder(spark, "llm-warc")
    write_archives(pages, path, min_bytes)
    return resolved_records(spark, path)
