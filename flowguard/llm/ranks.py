"""Exact positions in a global order, without one task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hash buckets that a group is dealt to before it is ranked.
BUCKETS = 4096


def hash_bucket(*cols: Column, buckets: int = BUCKETS) -> Column:
    """Bucket from the first three hex digits of the MD5 of the values, joined by ``:``."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, 3), 16, 10).cast("int") % buckets


def running_position(
    df: DataFrame, group: list[str], bucket: str, order: list[str | Column], weight: str | None = None
) -> DataFrame:
    """Add ``position`` (from 0) and, with ``weight``, ``weight_before`` inside each ``group``.

    The order is ``bucket`` first, then ``order``. Buckets are counted and added up on their own, so
    only the rows of one (group, bucket) meet in a task; a hot group is spread over its buckets.
    """
    keys = [*group, bucket]
    sums = [F.count(F.lit(1)).alias("_n")] + ([F.sum(weight).alias("_w")] if weight else [])
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*keys).agg(*sums).select(
        *keys,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        *([F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_w0")] if weight else []),
    )
    inside = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_r", F.row_number().over(inside) - 1)
    if weight:
        ranked = ranked.withColumn(
            "_b", F.coalesce(F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    right = starts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_n0", *(["_w0"] if weight else []))
    match = None
    for i, k in enumerate(keys):
        one = F.col(k).eqNullSafe(F.col(f"_k{i}"))
        match = one if match is None else match & one
    out = ranked.join(right, match).withColumn("position", F.col("_n0") + F.col("_r"))
    if weight:
        out = out.withColumn("weight_before", F.col("_w0") + F.col("_b"))
    return out.drop("_n0", "_w0", "_r", "_b", *[f"_k{i}" for i in range(len(keys))])
