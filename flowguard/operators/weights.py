"""Class weights and neighbour counts for unbalanced labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.session import sized_side


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``label, n_rows, weight`` with weight n / (k · n_class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n_rows"))
    totals = counts.agg(F.struct(F.sum("n_rows").alias("n"), F.count("*").alias("k")).alias("t")).scalar()
    return counts.select(label, "n_rows", (totals["n"] / (totals["k"] * F.col("n_rows"))).alias("weight"))


def with_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Weight of its class beside every row; no shuffle while the class list is small."""
    weights = class_weights(df, label).select(label, F.col("weight").alias(name))
    return df.join(sized_side(weights), label, "left")


def neighbour_count(df: DataFrame, label: str, most: int = 5) -> DataFrame:
    """Smallest class size and the neighbour count it allows."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    least = F.min("n")
    return counts.agg(
        least.alias("smallest"),
        F.greatest(F.lit(1), F.least(F.lit(most), least - 1)).cast("int").alias("neighbours"),
    )
