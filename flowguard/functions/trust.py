"""Trust score of a decision: confidence, class margin and how unusual the flow looks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowguard.functions.numbers import as_col, clip, is_infinite, sum_of

# fixed values: weights, limits and cut points of the trust score
W_CONFIDENCE, W_MARGIN, W_NORMALITY = 0.5, 0.3, 0.2
ANOMALY_LIMIT = 10.0
INFINITE_DEVIATION = 5.0
LOW_RISK_FROM, MEDIUM_RISK_FROM = 0.7, 0.4
FALLBACK_TRUST, FALLBACK_RISK, FALLBACK_ANOMALY = 0.5, "MEDIUM", 0.0


def deviation(z: Column | str) -> Column:
    """|z| with missing values taken as 0 and infinite ones as 5."""
    z = as_col(z)
    return (
        F.when(z.isNull() | F.isnan(z), F.lit(0.0))
        .when(is_infinite(z), F.lit(INFINITE_DEVIATION))
        .otherwise(F.abs(z))
    )


def anomaly_score(z_cols: list[Column | str]) -> Column:
    """Mean |z| over the scaled features, at most 10. Stays in generated code."""
    mean = sum_of([deviation(z) for z in z_cols]) / F.lit(float(len(z_cols)))
    return F.least(mean, F.lit(ANOMALY_LIMIT))


def anomaly_component(score: Column | str) -> Column:
    return F.exp(-as_col(score))


def raw_trust(confidence: Column | str, margin: Column | str, anomaly: Column | str) -> Column:
    """Weighted trust before rounding; null if any input is null."""
    total = (
        F.lit(W_CONFIDENCE) * clip(confidence, 0.0, 1.0)
        + F.lit(W_MARGIN) * clip(margin, 0.0, 1.0)
        + F.lit(W_NORMALITY) * anomaly_component(anomaly)
    )
    return clip(total, 0.0, 1.0)


def trust_risk(trust: Column | str) -> Column:
    """Risk band of an unrounded trust value. NaN is no evidence of trust, so HIGH."""
    trust = as_col(trust)
    return (
        F.when(trust.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(trust), F.lit("HIGH"))
        .when(trust >= LOW_RISK_FROM, F.lit("LOW"))
        .when(trust >= MEDIUM_RISK_FROM, F.lit("MEDIUM"))
        .otherwise(F.lit("HIGH"))
    )


def trust_struct(confidence: Column | str, margin: Column | str, anomaly: Column | str) -> Column:
    """``trust_score, risk_level, confidence, anomaly_score``; neutral values on missing input."""
    confidence, margin, anomaly = as_col(confidence), as_col(margin), as_col(anomaly)
    value = raw_trust(confidence, margin, anomaly)
    usable = value.isNotNull()
    return F.struct(
        F.when(usable, F.round(value, 4)).otherwise(F.lit(FALLBACK_TRUST)).alias("trust_score"),
        F.when(usable, trust_risk(value)).otherwise(F.lit(FALLBACK_RISK)).alias("risk_level"),
        F.when(usable, clip(confidence, 0.0, 1.0)).otherwise(confidence).alias("confidence"),
        F.when(usable, F.round(anomaly, 4)).otherwise(F.lit(FALLBACK_ANOMALY)).alias("anomaly_score"),
    )


def inverse_attack_trust(p_attack: Column | str) -> Column:
    """Trust read straight off the calibrated attack probability."""
    return F.lit(1.0) - clip(p_attack, 0.0, 1.0)
