"""Oversampling by interpolation between neighbours of the same class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.functions.numbers import scatter
from flowguard.operators.neighbours import BLOCK_ROWS, nearest_neighbours
from flowguard.operators.ordered import first_in_order


def oversample(
    df: DataFrame,
    label: str,
    id_col: str,
    features: list[str],
    k: int = 5,
    seed: int = 42,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Raise every class to the size of the largest: original rows plus synthetic ones.

    A synthetic row lies on the segment from a member to one of its k nearest members of the same
    class. Every member of a class gets the same number of them, the first members in a
    pseudo-random order one more, so class sizes come out exactly. Neighbour and position on the
    segment follow from id and copy number: re-runs and re-tried tasks agree.

    Result: ``id, copy, label, features``; ``copy`` is null on original rows.
    """
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}  # one row per class
    most = max(counts.values())
    short = {c: n for c, n in counts.items() if n < most}
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), label, *[F.col(f).cast("double").alias(f) for f in features])
    originals = rows.select(F.col("id").alias(id_col), F.lit(None).cast("int").alias("copy"), label, *features)
    if not short:
        return originals
    if min(short.values()) < 2:
        raise ValueError("a class of one row has no neighbours to interpolate with")
    k = max(1, min(k, min(counts.values()) - 1))
    each, extra = F.lit(0), F.lit(0)
    for c, n in short.items():
        each = F.when(F.col(label) == c, F.lit((most - n) // n)).otherwise(each)
        extra = F.when(F.col(label) == c, F.lit((most - n) % n)).otherwise(extra)
    members = rows.where(F.col(label).isin(list(short)))
    lucky = first_in_order(members.select(label, "id"), [label], scatter("id", seed), ["id"], extra)
    counted = members.join(lucky.select("id", F.lit(1).alias("_more")), "id", "left").withColumn(
        "_n", each + F.coalesce("_more", F.lit(0))
    )
    copies = counted.where("_n > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_n").cast("int") - 1)))
    tagged = copies.select(
        "id", "copy", label, *features,
        (F.pmod(scatter(F.col("id") + F.col("copy") * 7919, seed + 1), F.lit(k)) + 1).cast("int").alias("rank"),
        (scatter(F.col("id") * 31 + F.col("copy"), seed + 2) / F.lit(4294967296.0)).alias("_u"),
    )
    near = nearest_neighbours(members, "id", features, k, by=label, block_rows=block_rows).select("id", "rank", "neighbour")
    other = members.select(F.col("id").alias("neighbour"), *[F.col(f).alias(f"_o_{f}") for f in features])
    paired = tagged.join(near, ["id", "rank"]).join(other, "neighbour")
    new = paired.select(
        F.col("id").alias(id_col), "copy", label,
        *[(F.col(f) + F.col("_u") * (F.col(f"_o_{f}") - F.col(f))).alias(f) for f in features],
    )
    return originals.unionByName(new)
