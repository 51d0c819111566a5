"""Report tables over decisions, policies, logs and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowguard.constants import ACTIONS
from flowguard.functions.numbers import as_col
from flowguard.operators.ordered import order_quantiles


def action_mix(decisions: DataFrame, action: str = "action") -> DataFrame:
    """Count and share of each action; actions that never occur stay with 0."""
    spark = decisions.sparkSession
    counts = decisions.groupBy(action).agg(F.count("*").alias("_n"))
    domain = spark.createDataFrame([(a,) for a in ACTIONS], f"{action} string")
    full = domain.join(counts, action, "left").select(action, F.coalesce("_n", F.lit(0)).alias("n_flows"))
    total = counts.agg(F.sum("_n").alias("t")).scalar()  # at most one row per action below
    return full.select(
        action, "n_flows",
        F.coalesce(total, F.lit(0)).alias("total"),
        F.round(F.try_divide(F.col("n_flows"), total), 6).alias("share"),
    )


def class_counts(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"))


def split_sizes(df: DataFrame, split: str = "split") -> DataFrame:
    counts = df.groupBy(split).agg(F.count("*").alias("n_rows"))
    total = counts.agg(F.sum("n_rows").alias("t")).scalar()
    return counts.select(split, "n_rows", F.round(F.col("n_rows") / total, 6).alias("fraction"))


def distinct_classes(df: DataFrame, label: str, approximate: bool = False) -> DataFrame:
    n = F.approx_count_distinct(label) if approximate else F.count_distinct(label)
    return df.agg(n.alias("n_classes"))


def service_summary(log: DataFrame, level: str, latency: str, status: str, ts: str, usage: list[str]) -> DataFrame:
    """Per load level: request rate, latency percentiles, error share, mean resource use.

    The upper percentiles follow the exclusive rule (position p·(n+1)); the middle one the
    inclusive rule.
    """
    span = F.timestamp_diff("MICROSECOND", F.min(ts), F.max(ts)) / F.lit(1e6)
    base = log.groupBy(level).agg(
        F.count("*").alias("requests"),
        F.round(F.try_divide(F.count("*"), span), 6).alias("throughput"),
        F.round(F.count_if(F.col(status) != 200) / F.count("*") * 100, 2).alias("error_pct"),
        *[F.round(F.avg(u), 6).alias(f"{u}_mean") for u in usage],
    )
    mid = order_quantiles(log, [latency], [0.5], by=[level]).select(level, F.round("value", 2).alias("p50"))
    high = order_quantiles(log, [latency], [0.95, 0.99], by=[level], rule="exclusive")
    high = high.groupBy(level).agg(
        F.round(F.max(F.when(F.col("p") == 0.95, F.col("value"))), 2).alias("p95"),
        F.round(F.max(F.when(F.col("p") == 0.99, F.col("value"))), 2).alias("p99"),
    )
    return base.join(mid, level).join(high, level)


def growth(samples: DataFrame, ts: str, order: str, measures: list[str]) -> DataFrame:
    """First, last, last − first and mean of each measure in time order."""
    at = F.struct(ts, order)
    cells = [
        F.struct(
            F.lit(m).alias("measure"),
            F.min_by(m, at).alias("initial"),
            F.max_by(m, at).alias("final"),
            F.avg(m).alias("mean"),
        ).alias(m)
        for m in measures
    ]
    wide = samples.agg(*cells)
    return wide.select(F.explode(F.array(*measures)).alias("r")).select(
        "r.measure", "r.initial", "r.final",
        (F.col("r.final") - F.col("r.initial")).alias("growth"),
        F.round("r.mean", 6).alias("mean"),
    )


def column_summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles, max per column, as rows."""
    cells = [
        F.struct(
            F.lit(c).alias("feature"), F.count(c).alias("n"), F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"),
        ).alias(f"s{i}")
        for i, c in enumerate(cols)
    ]
    base = df.agg(*cells).select(F.explode(F.array(*[f"s{i}" for i in range(len(cols))])).alias("s")).select("s.*")
    q = order_quantiles(df, cols, [0.25, 0.5, 0.75])
    quart = q.groupBy("feature").agg(
        *[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
    )
    return base.join(quart, "feature")


def neutral_payload(df: DataFrame, features: list[str]) -> DataFrame:
    """Per-feature mean as a stand-in payload; 0.0 where there is nothing to average."""
    row = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.coalesce(F.avg(f), F.lit(0.0)).alias("value")) for f in features
    ])
    return df.agg(row.alias("r")).select(F.explode("r").alias("r")).select("r.feature", "r.value")


def first_rows(df: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    return df.orderBy(*order).limit(n)


def health_score(binary_accuracy: Column | str, multiclass_accuracy: Column | str) -> Column:
    return F.lit(0.4) * as_col(binary_accuracy) + F.lit(0.6) * as_col(multiclass_accuracy)


def macro_grade(f1_macro: Column | str) -> Column:
    f = as_col(f1_macro)
    return (
        F.when(f < 0.85, F.lit("Action Required"))
        .when(f < 0.90, F.lit("Optimization Recommended"))
        .otherwise(F.lit("Production Ready"))
    )


def separation_grade(auc: Column | str) -> Column:
    a = as_col(auc)
    return F.when(a >= 0.95, F.lit("Strong")).when(a >= 0.80, F.lit("Adequate")).when(a > 0, F.lit("Weak"))


def imbalance_flag(f1_weighted: Column | str, f1_macro: Column | str) -> Column:
    """True where the weighted F1 hides weak small classes; null without any macro F1."""
    w, m = as_col(f1_weighted), as_col(f1_macro)
    return F.when(m > 0, (w - m) > 0.10)
