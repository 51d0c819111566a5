"""Representative rows per class and their check against scored decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowguard.functions.numbers import sum_of
from flowguard.operators.ordered import order_quantiles
from flowguard.operators.policy import expected_action
from flowguard.session import sized_side


def class_medians(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """Median vector per class, one column per feature."""
    long = order_quantiles(df, features, [0.5], by=[label])
    return long.groupBy(label).agg(*[F.max(F.when(F.col("feature") == f, F.col("value"))).alias(f) for f in features])


def representative_rows(
    df: DataFrame,
    label: str,
    id_col: str,
    features: list[str],
    k: int = 5,
    classes: list[str] | None = None,
) -> DataFrame:
    """The k rows nearest to the class median, ties by id; absent classes give no rows.

    The distance is a column over the joined median; the rank limit is applied on every input
    partition before the shuffle, so a dominant class sends k rows per partition, not all rows.
    """
    rows = df if classes is None else df.where(F.col(label).isin(classes))
    mid = class_medians(rows, label, features)
    mid = sized_side(mid.select(label, *[F.col(f).alias(f"_m{i}") for i, f in enumerate(features)]))
    gap = [(F.col(f) - F.col(f"_m{i}")) * (F.col(f) - F.col(f"_m{i}")) for i, f in enumerate(features)]
    near = rows.join(mid, label).withColumn("distance", F.sqrt(sum_of(gap)))
    w = W.partitionBy(label).orderBy("distance", id_col)
    best = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select(id_col, label, "rank", "distance", expected_action(label).alias("expected_action"), *features)


def matched_scenarios(candidates: DataFrame, decisions: DataFrame, id_col: str, label: str) -> DataFrame:
    """First candidate of each class whose decision agrees with the label.

    Benign must be allowed; an attack must be named as its own class and be held or blocked.
    """
    both = candidates.select(id_col, label, "distance").join(
        decisions.select(id_col, "action", "attack_type", "confidence"), id_col
    )
    good = F.when(F.col(label) == "BENIGN", F.col("action") == "ALLOW").otherwise(
        F.coalesce(F.lower("attack_type") == F.lower(label), F.lit(False)) & F.col("action").isin("QUARANTINE", "DENY")
    )
    w = W.partitionBy(label).orderBy("distance", id_col)
    return both.where(good).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
