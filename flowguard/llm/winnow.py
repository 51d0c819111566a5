"""Document fingerprints by winnowing, with DataFrame functions only.

Every run of ``GRAM`` bytes of a text's UTF-8 form is hashed; of every ``WINDOW`` neighbouring hashes the
smallest is kept, the rightmost one among equals, together with its position. Two texts that share
``GRAM + WINDOW - 1`` bytes in a row thus share a fingerprint at the places of that run.

A kept hash is one long: 31 bits of the hash, then the position counted downwards, so the plain minimum
is the rightmost smallest one. A scan carries the current minimum; a smaller hash replaces it, and when
it leaves the window the window is searched anew. Long texts are scanned in blocks of ``BLOCK`` windows.

Defined cases: null counts as empty; an empty text has no fingerprint and equals another empty one
(likeness 1), but nothing else (0); a text shorter than a run is one run; a text with fewer runs than a
window is one window. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowguard.llm.tables import written

GRAM, WINDOW = 12, 32
BLOCK = 256
#: Ids of one bucket of the successor search; each bucket holds at most so many different ids.
BUCKET_IDS = 2048
#: So many values are put in order by one task; the numbers of the buckets reach it after at most five divisions.
TOP_VALUES = 4096
#: Bucket borders up to this count are broadcast, more of them are joined by a shuffle.
BROADCAST_BORDERS = 100_000

_LOW = 0xFFFFFFFF


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def selected(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """Kept hashes of ``text`` in order of position, as longs for ``hash_of`` and ``position_of``."""
    text = F.coalesce(text, F.lit(""))
    return _selected(text.cast("binary"), F.octet_length(text), gram, window)


def _selected(data: Column, size: Column, gram: int, window: int) -> Column:
    grams = F.when(size == 0, F.lit(0)).otherwise(F.greatest(size - (gram - 1), F.lit(1)))
    windows = F.when(size == 0, F.lit(0)).otherwise(F.greatest(grams - (window - 1), F.lit(1)))

    def block(b, data):
        """Kept hashes of the windows ``b * BLOCK + 1 .. (b + 1) * BLOCK``."""
        first = b * BLOCK + 1
        last = F.least(grams, (b + 1) * BLOCK + window - 1)
        high = F.lit(0x7FFFFFFF << 32)
        keys = F.transform(F.sequence(first, last), lambda i: F.xxhash64(F.substring(data, i, F.lit(gram))).bitwiseAND(high) - i)

        def scan(keys):
            def step(acc, x):
                low = acc["low"]
                outside = (low - x).bitwiseAND(F.lit(_LOW)) >= window
                put = lambda v: F.struct(v.alias("low"), F.array_append(acc["kept"], v).alias("kept"))
                # The window that ends at x, whose place in this block follows from its low bits.
                ends = (F.lit(0) - x).bitwiseAND(F.lit(_LOW)).cast("int") - first + 1
                return F.when(x < low, put(x)).when(
                    outside, put(F.array_min(F.slice(keys, ends - (window - 1), F.lit(window))))).otherwise(acc)

            start = F.array_min(F.slice(keys, F.lit(1), F.lit(window)))
            rest = F.slice(keys, F.lit(window + 1), F.greatest(F.size(keys) - window, F.lit(0)))
            return _let(start, lambda low: F.aggregate(
                rest, F.struct(low.alias("low"), F.array(low).alias("kept")), step, lambda acc: acc["kept"]))

        return _let(keys, scan)

    blocks = F.when(windows > 0, F.sequence(F.lit(0), F.floor((windows - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    return _let(data, lambda d: F.array_distinct(F.flatten(F.transform(blocks, lambda b: block(b, d)))))


def spliced(head: Column, tail: Column, kept_head: Column, kept_tail: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """``selected`` of ``head`` followed by ``tail``, from the kept hashes of two texts that start with them.

    Windows inside one part are windows of its text, and later windows never keep an earlier place, so
    they kept a leading part of what that text keeps: up to the place that their last window keeps. Only
    the windows across the seam are hashed anew.
    """
    reach = gram + window - 1
    h, t = head.cast("binary"), tail.cast("binary")
    n, m = F.octet_length(head), F.octet_length(tail)
    side = lambda size: F.least(size, F.lit(reach - 1))
    last = lambda data, size: position_of(F.get(_selected(F.substring(data, size - (reach - 1), F.lit(reach)), F.lit(reach), gram, window), F.lit(0))) + size - reach
    none = F.array().cast("array<bigint>")
    across = F.concat(F.substring(h, n - side(n) + 1, side(n)), F.substring(t, F.lit(1), side(m)))
    seam = F.when((n > 0) & (m > 0), _selected(across, side(n) + side(m), gram, window)).otherwise(none)
    # A longer distance from the start lowers the long by as much.
    moved = lambda kept, by: F.transform(kept, lambda x: x - by)

    def join(x):
        first = F.filter(kept_head, lambda k: position_of(k) <= x["head"])
        middle = F.filter(moved(seam, n - side(n)), lambda k: position_of(k) > x["head"])
        return _let(F.concat(first, middle), lambda front: F.concat(front, F.filter(
            moved(F.filter(kept_tail, lambda k: position_of(k) <= x["tail"]), n),
            lambda k: position_of(k) > F.coalesce(position_of(F.get(front, F.size(front) - 1)), F.lit(0)))))

    ends = F.struct(F.when(n >= reach, last(h, n)).otherwise(0).cast("long").alias("head"),
                    F.when(m >= reach, last(t, m)).otherwise(0).cast("long").alias("tail"))
    return F.when(n + m < reach, _selected(F.concat(h, t), n + m, gram, window)).otherwise(_let(ends, join))


def position_of(kept: Column) -> Column:
    """Byte position from 1."""
    return (F.lit(0) - kept).bitwiseAND(F.lit(_LOW))


def hash_of(kept: Column) -> Column:
    return F.shiftright(kept + position_of(kept), 32)


def hashes(kept: Column) -> Column:
    return F.transform(kept, hash_of)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two fingerprints' hashes."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either).cast("double")


def as_string(hashed: Column) -> Column:
    """Hashes as eight hex digits each, in order of position."""
    return F.array_join(F.transform(hashed, lambda h: F.lpad(F.hex(h.bitwiseAND(F.lit(_LOW))), 8, "0")), " ")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, hashes, positions`` of every row."""
    kept = docs.select(F.col(id_col).alias("doc_id"), selected(F.col(text_col)).alias("_k"))
    return kept.select("doc_id", hashes(F.col("_k")).alias("hashes"), F.transform("_k", position_of).alias("positions"))


def next_ids(ids: DataFrame) -> DataFrame:
    """Each distinct value of the long column ``id`` with the next larger one (null at the last).

    Values are looked up inside buckets of neighbouring values; the borders between buckets are the same
    question about the bucket numbers, of which there are far fewer.
    """
    bucketed = ids.distinct().withColumn("_b", F.floor(F.col("id") / BUCKET_IDS).cast("long"))
    firsts = written(bucketed.groupBy("_b").agg(F.min("id").alias("_first")), "winnow-firsts")
    inside = bucketed.withColumn("next", F.lead("id").over(Window.partitionBy("_b").orderBy("id")))
    numbers = firsts.select(F.col("_b").alias("id"))
    if firsts.count() <= TOP_VALUES:
        after = numbers.withColumn("next", F.lead("id").over(Window.partitionBy(F.lit(0)).orderBy("id")))
    else:
        after = next_ids(numbers)
    after = after.select(F.col("id").alias("_b"), F.col("next").alias("_nb"))
    border = after.join(firsts.select(F.col("_b").alias("_nb"), F.col("_first")), "_nb").select("_b", "_first")
    return inside.join(border, "_b", "left").select("id", F.coalesce("next", "_first").alias("next"))


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are.

    The edited text has its last half, in code points, replaced by as many first ones of the next text in
    order of the ids (rows that share an id in order of their texts, null ids first), the last row's next
    text being the first row's. Rows meet only within buckets of neighbouring ids; the first texts of the
    buckets reach the row before them by a join.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn(
        "_b", F.floor(F.col("doc_id") / BUCKET_IDS).cast("long"))
    buckets = written(rows.select("_b").distinct(), "winnow-buckets")
    order = written(next_ids(buckets.filter("_b is not null").select(F.col("_b").alias("id"))), "winnow-order")
    lowest = order.agg(F.min("id")).first()[0]
    has_null = not buckets.filter("_b is null").isEmpty()
    # The bucket after each one; the last is followed by the null bucket, if there is one, or the first.
    after = order.select(F.col("id").alias("_b"), F.coalesce("next", F.lit(None if has_null else lowest).cast("long")).alias("_nb"))
    if has_null:
        after = after.unionByName(docs.sparkSession.createDataFrame([(None, lowest)], "_b long, _nb long"))
    # The first text of a bucket is that of its smallest id and text.
    heads = rows.groupBy("_b").agg(F.min("doc_id").alias("_first")).select(F.col("_b").alias("_hb"), "_first")
    heads = written(heads, "winnow-heads")
    heads = F.broadcast(heads) if heads.count() <= BROADCAST_BORDERS else heads
    first = rows.join(heads, F.col("_b").eqNullSafe(F.col("_hb")) & F.col("doc_id").eqNullSafe(F.col("_first"))).groupBy(
        F.col("_hb").alias("_nb")).agg(F.min("text").alias("_border"))
    border = written(after.join(first.withColumnRenamed("_nb", "_fb"), F.col("_nb").eqNullSafe(F.col("_fb"))).select(
        F.col("_b").alias("_of"), "_border"), "winnow-borders")
    w = Window.partitionBy("_b").orderBy(F.col("doc_id"), F.col("text"))
    seen = rows.withColumn("_next", F.lead("text").over(w)).withColumn("_kept", selected(F.col("text"))).withColumn(
        "_next_kept", F.lead("_kept").over(w))
    last = seen.filter("_next is null").join(border, F.col("_b").eqNullSafe(F.col("_of")))
    full = seen.filter("_next is not null").unionByName(last.select(
        "doc_id", "text", "_b", F.coalesce("_border", "text").alias("_next"), "_kept",
        selected(F.coalesce(F.col("_border"), F.col("text"))).alias("_next_kept")))
    half = F.floor(F.length("text") / 2).cast("int")
    parts = full.withColumn("_head", F.substring("text", F.lit(1), F.length("text") - half)).withColumn(
        "_tail", F.substring("_next", F.lit(1), half))
    edited = parts.withColumn("_edited_kept", spliced(F.col("_head"), F.col("_tail"), F.col("_kept"), F.col("_next_kept")))
    both = edited.select(
        "doc_id", "text", F.concat("_head", "_tail").alias("_edited"), hashes(F.col("_kept")).alias("_kept"),
        hashes(F.col("_next_kept")).alias("_next_kept"), hashes(F.col("_edited_kept")).alias("_edited_kept"))
    return both.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        as_string(F.col("_kept")).alias("fingerprint"), as_string(F.col("_edited_kept")).alias("edited_fingerprint"),
        likeness(F.col("_kept"), F.col("_edited_kept")).alias("near_edited"), likeness(F.col("_kept"), F.col("_next_kept")).alias("near_next"))
