"""Texts that go with a decision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowguard.functions.numbers import as_col


def percent(x: Column | str) -> Column:
    # Decimal arithmetic: the binary product of e.g. 0.5385 and 100 would fall on the other side.
    return F.concat(F.round(as_col(x).cast("decimal(18,6)") * 100, 1).cast("string"), F.lit("%"))


def incident_id(ts: Column | str, id_col: Column | str) -> Column:
    """``ZT-<date>-<time>-<4 hex>``; the suffix comes from the id, so re-runs agree."""
    tail = F.upper(F.substring(F.md5(as_col(id_col).cast("string")), 1, 4))
    return F.concat_ws("-", F.lit("ZT"), F.date_format(as_col(ts), "yyyyMMdd-HHmmss"), tail)


def short_reason(action: Column | str, attack_type: Column | str) -> Column:
    action = as_col(action)
    named = F.coalesce(as_col(attack_type), F.lit("Unknown Attack"))
    # fixed values: wording
    return (
        F.when(action == "ALLOW", F.lit("Verified as within safe behavioral bounds."))
        .when(action == "QUARANTINE", F.concat(F.lit("Anomaly detected ("), named, F.lit(") → isolated per policy.")))
        .when(action == "DENY", F.concat(F.lit("Critical threat identified ("), named, F.lit(") → blocked.")))
        .otherwise(F.lit("Unknown classification."))
    )


def threat_brief(action: Column | str, attack_type: Column | str, confidence: Column | str, incident: Column | str) -> Column:
    """The one-paragraph summary of a decision."""
    action, shown = as_col(action), percent(confidence)
    named = F.coalesce(as_col(attack_type), F.lit("Suspicious activity"))
    # fixed values: wording
    allowed = F.concat_ws(
        " | ",
        F.concat(F.lit("INCIDENT: "), as_col(incident)),
        F.lit("Network flow matches normal behavioral patterns."),
        F.lit("All monitored signals fall within expected operating thresholds."),
        F.lit("Traffic allowed without escalation."),
        F.concat(shown, F.lit(" — high certainty benign classification.")),
    )
    flagged = F.concat_ws(
        " | ",
        F.concat(F.lit("INCIDENT: "), as_col(incident)),
        F.concat(F.lit("The system detected behavior consistent with "), named, F.lit(".")),
        F.lit("Multiple telemetry signals deviated from normal traffic patterns."),
        F.concat(F.lit("Action applied: "), action),
        F.concat(shown, F.lit(" — model strongly supports this classification.")),
        F.lit("Monitor source activity and validate upstream protections."),
    )
    return F.when(action == "ALLOW", allowed).otherwise(flagged)
