"""Behaviour reports: out-of-range indicators, group fingerprints, percentile lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.constants import BEHAVIOUR_GROUPS
from flowguard.functions.numbers import sum_of
from flowguard.operators.ordered import order_quantiles
from flowguard.operators.scale import fit_scaler


def percentile_lookup(df: DataFrame, cols: list[str], percents: list[float]) -> DataFrame:
    """``feature, p, value``: feature value at each slider position 0-100."""
    q = order_quantiles(df, cols, [p / 100 for p in percents])
    return q.select("feature", F.round(F.col("p") * 100, 6).alias("p"), "value")


def anomaly_indicators(df: DataFrame, baseline: DataFrame, cols: list[str], most: int = 5) -> DataFrame:
    """Add ``indicators``: features outside the baseline's p5/p95, in column order, at most five."""
    rows = order_quantiles(baseline, cols, [0.05, 0.95]).collect()  # two rows per feature
    edge = {(r["feature"], r["p"]): r["value"] for r in rows}
    marks = [
        F.when(F.col(c) > edge[c, 0.95], F.lit(f"{c}>p95")).when(F.col(c) < edge[c, 0.05], F.lit(f"{c}<p05"))
        for c in cols
    ]
    return df.withColumn("indicators", F.slice(F.array_compact(F.array(*marks)), 1, most))


def fingerprint(
    df: DataFrame, baseline: DataFrame, groups: dict[str, list[str]] | None = None, keep: list[str] | None = None
) -> DataFrame:
    """Mean z-score per behaviour group against the baseline rows; six groups of flow features by default."""
    groups, keep = groups or BEHAVIOUR_GROUPS, keep or []
    scaler = fit_scaler(baseline, [f for fs in groups.values() for f in fs])
    return df.select(*keep, *[
        F.round(sum_of([scaler.z(f) for f in fs]) / len(fs), 6).alias(name) for name, fs in groups.items()
    ])
