"""Decision columns: predicted class, confidence, served action and risk."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowguard.functions.numbers import as_col, clip


def binary_prediction(p_attack: Column | str, threshold: float = 0.5) -> Column:
    return (as_col(p_attack) >= F.lit(threshold)).cast("int")


def prediction_label(binary_pred: Column | str) -> Column:
    return F.when(as_col(binary_pred) == 1, F.lit("Attack")).otherwise(F.lit("Normal"))


def class_name_of_binary(binary: Column | str) -> Column:
    return F.when(as_col(binary) == 0, F.lit("Benign")).otherwise(F.lit("Attack"))


def binary_confidence(binary_pred: Column | str, p_attack: Column | str) -> Column:
    """Probability of the class that was predicted."""
    p = clip(p_attack, 0.0, 1.0)
    return F.when(as_col(binary_pred) == 1, p).otherwise(F.lit(1.0) - p)


def served_action(binary_pred: Column | str, confidence: Column | str) -> Column:
    """Action by confidence; NaN confidence counts as low."""
    attack, conf = as_col(binary_pred) == 1, F.nanvl(as_col(confidence), F.lit(0.0))
    return (
        F.when(attack & (conf >= 0.85), F.lit("DENY"))
        .when(~attack & (conf >= 0.8), F.lit("ALLOW"))
        .otherwise(F.lit("QUARANTINE"))
    )


def served_risk(binary_pred: Column | str, confidence: Column | str) -> Column:
    attack, conf = as_col(binary_pred) == 1, F.nanvl(as_col(confidence), F.lit(0.0))
    return (
        F.when(attack & (conf >= 0.6), F.lit("HIGH"))
        .when(~attack & (conf >= 0.8), F.lit("LOW"))
        .otherwise(F.lit("MEDIUM"))
    )


def risk_driven_action(attack_type: Column | str, risk: Column | str) -> Column:
    """Action by risk level alone; low-risk flows of a named attack are watched, not blocked."""
    attack_type, risk = as_col(attack_type), as_col(risk)
    named = F.coalesce((attack_type != "") & (F.upper(attack_type) != "BENIGN"), F.lit(False))
    return (
        F.when(risk == "HIGH", F.lit("DENY"))
        .when(risk == "MEDIUM", F.lit("QUARANTINE"))
        .when((risk == "LOW") & named, F.lit("MONITOR"))
        .otherwise(F.lit("ALLOW"))
    )


def certainty_band(margin: Column | str) -> Column:
    margin = as_col(margin)
    return F.when(margin > 0.5, F.lit("HIGH")).when(margin > 0.2, F.lit("MODERATE")).otherwise(F.lit("LOW"))


def decision_certainty(confidence: Column | str, top_probability: Column | str) -> Column:
    """Geometric mean of the binary confidence and the best class probability."""
    return F.sqrt(as_col(confidence) * as_col(top_probability))


def next_step(action: Column | str, confidence: Column | str) -> Column:
    """Playbook line for an action at a confidence."""
    action, conf = as_col(action), as_col(confidence)
    # fixed values: wording of the playbook
    return (
        F.when((action == "DENY") & (conf > 0.95), F.lit("No analyst review needed. Automated block applied."))
        .when(action == "DENY", F.lit("Automated block applied. Recommend analyst spot-check."))
        .when(action == "QUARANTINE", F.lit("Flow isolated. Analyst review required within SLA."))
        .when((action == "ALLOW") & (conf > 0.95), F.lit("Normal traffic. No action required."))
        .when((action == "ALLOW") & (conf <= 0.70), F.lit("Permitted, but borderline. Flag for retrospective analysis."))
        .when(action == "ALLOW", F.lit("Permitted."))
        .otherwise(F.lit(None).cast("string"))
    )


def severity(action: Column | str, risk: Column | str) -> Column:
    return F.when(as_col(action) == "ALLOW", F.lit("LOW")).otherwise(as_col(risk))
