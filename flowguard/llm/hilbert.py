"""Sharding along a Hilbert curve over several metadata dimensions.

Each document becomes a cell: source, language and the binary logarithm of its size, each in
``2 ** BITS`` steps. Cells are numbered along the Hilbert curve through that grid, documents are put
in the order of the numbers, and the order is cut into runs of equal row counts. Neighbours on the
curve differ in one dimension by one step, so a run covers a small box and readers can skip shards by
the ranges in ``manifest``. Ties inside a cell are ordered by a hash of the id, then the id and the
text checksum, so a hot cell is ranked in many tasks.

Defined cases: null text counts as empty (size 8); null source or language is step 0 like the empty
string; null ids sort first among ties; repeated rows take neighbouring slots; fewer rows than shards
leave the last shards empty; no rows give no rows. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowguard.llm.ranks import hash_bucket, running_position
from flowguard.llm.tables import written

SHARDS = 24
BITS = 4
#: Bytes that a document takes in a shard besides its text.
HEADER_BYTES = 8


def hash_step(value: Column, bits: int = BITS) -> Column:
    """Step of a name: the leading bits of the MD5 of its text, so equality on it prunes shards."""
    return (F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit(""))), 1, 2), 16, 10).cast("int")
            % (1 << bits))


def log_step(value: Column, bits: int = BITS) -> Column:
    """Step of a positive number: one step for each doubling above 8, the last one open."""
    grown = F.floor(F.log2(F.greatest(value, F.lit(1)).cast("double"))).cast("int") - 3
    return F.greatest(F.lit(0), F.least(F.lit((1 << bits) - 1), grown))


def hilbert_index(axes: list[Column], bits: int = BITS) -> Column:
    """Number of a cell on the Hilbert curve through ``len(axes)`` dimensions of ``bits`` bits.

    Works on the coordinates bit by bit from the top: a set bit inverts the lower bits of the first
    axis, a clear one swaps them with the first axis; Gray decoding then makes the transposed index,
    whose bits are interleaved.
    """
    n = len(axes)
    steps = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(i + 1).alias("i")) for q in (1 << b for b in range(bits - 1, 0, -1)) for i in range(n)])

    def turn(x, s):
        low, own, first = s["q"] - 1, F.element_at(x, s["i"]), F.element_at(x, 1)
        swap = first.bitwiseXOR(own).bitwiseAND(low)
        is_set = own.bitwiseAND(s["q"]) != 0
        return F.transform(x, lambda v, j: F.when(
            j == 0, v.bitwiseXOR(F.when(is_set, low).otherwise(F.when(s["i"] == 1, 0).otherwise(swap)))
        ).when((j + 1 == s["i"]) & ~is_set, v.bitwiseXOR(swap)).otherwise(v))

    turned = F.aggregate(steps, F.array(*[a.cast("int") for a in axes]), turn)
    gray = F.transform(turned, lambda _, j: F.aggregate(F.slice(turned, F.lit(1), j + 1), F.lit(0), lambda a, v: a.bitwiseXOR(v)))
    flips = F.aggregate(
        F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]), F.lit(0),
        lambda t, q: t.bitwiseXOR(F.when(F.element_at(gray, n).bitwiseAND(q) != 0, q - 1).otherwise(0)))
    places = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i + 1).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
    bit = lambda p: F.floor(F.element_at(gray, p["i"]).bitwiseXOR(flips) / F.pow(F.lit(2), p["b"])).cast("int") % 2
    return F.aggregate(places, F.lit(0), lambda acc, p: acc * 2 + bit(p))


def cells(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", lang_col="lang") -> DataFrame:
    """Id, size, checksum and the three steps of each document, without its text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + HEADER_BYTES).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        hash_step(F.col(source_col)).alias("source_step"), hash_step(F.col(lang_col)).alias("lang_step"))
    return sized.withColumn("size_step", log_step(F.col("size")))


def on_curve(stepped: DataFrame) -> DataFrame:
    """Add ``curve``. The index is computed once for each cell that occurs, at most ``2 ** (3 * BITS)``."""
    steps = ["source_step", "lang_step", "size_step"]
    curve = stepped.select(*steps).distinct().withColumn("curve", hilbert_index([F.col(c) for c in steps]))
    return stepped.join(F.broadcast(curve), steps)


def assign(placed: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Add ``shard`` and ``slot``: runs along the curve whose row counts differ by at most one.

    ``placed`` is read more than once: pass a written table. The starts of the cells are at most
    ``2 ** (3 * BITS)`` rows, which is what the two unpartitioned windows and the broadcast see.
    """
    inside = running_position(
        placed.withColumn("_bucket", hash_bucket(F.col("doc_id"), buckets=256)), ["curve"], "_bucket",
        [F.col("doc_id").asc_nulls_first(), "text_crc32", "size"])
    every = Window.orderBy("_cell")
    starts = placed.groupBy(F.col("curve").alias("_cell")).agg(F.count(F.lit(1)).alias("_n")).select(
        "_cell", (F.sum("_n").over(every) - F.col("_n")).alias("_start"),
        F.sum("_n").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_rows"))
    at = F.col("_start") + F.col("position")
    return inside.join(F.broadcast(starts), F.col("curve") == F.col("_cell")).withColumn("position", at).withColumn(
        "shard", F.expr(f"(position * {shards}) div _rows").cast("int")
    ).withColumn(
        "slot", F.col("position") - F.expr(f"(shard * _rows + {shards - 1}) div {shards}")
    ).drop("_bucket", "_cell", "_start", "_rows", "position")


def manifest(sharded: DataFrame) -> DataFrame:
    """Ranges by shard that a reader compares its filter with."""
    ranges = [f(c).alias(f"{f.__name__}_{c}") for c in ("source_step", "lang_step", "size_step", "size") for f in (F.min, F.max)]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), *ranges)


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Cells, shards and slots of ``docs``, read from a written table without the texts."""
    return assign(written(on_curve(written(cells(docs), "hilbert-cells")), "hilbert-curve"), shards)
