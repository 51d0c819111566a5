"""Values at, just below and just above each cut of the decision rules."""

import math

import pytest
from pyspark.sql import functions as F

from flowguard.functions import decision as D
from flowguard.functions import narrative as N
from flowguard.functions import proba as P
from flowguard.functions import trust as T
from flowguard.operators.policy import policy_strategy, policy_table, with_policy
from flowguard.operators.report import imbalance_flag, macro_grade, separation_grade

NAN, INF = float("nan"), float("inf")


def values(spark, expr, xs, schema="x double"):
    df = spark.createDataFrame([(x,) if not isinstance(x, tuple) else x for x in xs], schema)
    return [r[0] for r in df.coalesce(1).select(expr).collect()]


def test_trust_risk_cuts(spark):
    got = values(spark, T.trust_risk("x"), [0.7, 0.6999, 0.4, 0.3999, NAN, None])
    assert got == ["LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", None]


def test_trust_is_compared_before_rounding(spark):
    t = values(spark, T.trust_struct(F.lit(1.0), F.col("x"), F.lit(50.0)), [0.6666, 0.66661])
    assert [round(r.trust_score, 4) for r in t] == [0.7, 0.7]
    assert [r.risk_level for r in t] == ["MEDIUM", "MEDIUM"]


def test_anomaly_of_faulty_values(spark):
    got = values(spark, T.anomaly_score(["x"]), [NAN, INF, -INF, None, -3.0, 40.0])
    assert got == [0.0, 5.0, 5.0, 0.0, 3.0, 10.0]


def test_trust_fallback(spark):
    row = values(spark, T.trust_struct("x", F.lit(0.1), F.lit(0.2)), [None])[0]
    assert (row.trust_score, row.risk_level, row.confidence, row.anomaly_score) == (0.5, "MEDIUM", None, 0.0)


def test_served_action_cuts(spark):
    xs = [(1, 0.85), (1, 0.8499), (1, 0.6), (1, 0.5999), (0, 0.8), (0, 0.7999), (1, NAN), (0, NAN)]
    schema = "b int, c double"
    assert values(spark, D.served_action("b", "c"), xs, schema) == [
        "DENY", "QUARANTINE", "QUARANTINE", "QUARANTINE", "ALLOW", "QUARANTINE", "QUARANTINE", "QUARANTINE"]
    assert values(spark, D.served_risk("b", "c"), xs, schema) == [
        "HIGH", "HIGH", "HIGH", "MEDIUM", "LOW", "MEDIUM", "MEDIUM", "MEDIUM"]


def test_certainty_band_cuts(spark):
    assert values(spark, D.certainty_band("x"), [0.5, 0.5001, 0.2, 0.2001]) == ["MODERATE", "HIGH", "LOW", "MODERATE"]


def test_risk_driven_action(spark):
    xs = [("DDoS", "HIGH"), (None, "MEDIUM"), ("Bot", "LOW"), ("benign", "LOW"), (None, "LOW"), ("", "LOW")]
    got = values(spark, D.risk_driven_action("a", "r"), xs, "a string, r string")
    assert got == ["DENY", "QUARANTINE", "MONITOR", "ALLOW", "ALLOW", "ALLOW"]


def test_threshold_is_inclusive(spark):
    assert values(spark, D.binary_prediction("x", 0.3), [0.3, 0.2999]) == [1, 0]


def test_spectrum_cut_and_order(spark):
    m = F.create_map(F.lit("b"), F.lit(0.001), F.lit("a"), F.lit(0.5), F.lit("c"), F.lit(0.5), F.lit("d"), F.lit(1.2))
    row = spark.range(1).select(P.spectrum(m).alias("s"), P.best_class(m).alias("b"), P.top_margin(m).alias("m")).first()
    assert [(e.name, e.value) for e in row.s] == [("d", 1.0), ("a", 0.5), ("c", 0.5)]
    assert row.b == "d" and row.m == pytest.approx(0.7)


def test_single_class_margin(spark):
    m = F.create_map(F.lit("a"), F.lit(0.4))
    assert spark.range(1).select(P.top_margin(m)).first()[0] == 0.4


def test_zero_vector(spark):
    got = values(spark, P.all_zero(F.array("x", F.lit(0.0))), [1e-9, 9e-10, -1.0])
    assert got == [False, True, False]


def test_policy_cases(spark):
    cases = [
        (0, 0, 0.99, None, "ALLOW"), (1, 1, 0.95, "DDoS", "DENY"), (2, 1, 0.88, "Heartbleed", "QUARANTINE"),
        (3, 1, 0.76, "Web Attack – XSS", "QUARANTINE"), (4, 1, 0.82, "Bot", "DENY"),
        (5, 1, 0.71, "UnknownAttack", "QUARANTINE"), (6, 1, 0.7, None, "QUARANTINE"),
    ]
    df = spark.createDataFrame(cases, "id int, b int, c double, kind string, want string")
    rows = with_policy(df, "b", "kind").collect()
    assert all(r.policy_action == r.want for r in rows)
    reasons = {r.id: r.policy_reason for r in rows}
    assert reasons[3].startswith("Low-risk attack type: Web Attack – XSS")
    assert "not in policy lists" in reasons[5] and "unavailable" in reasons[6]


def test_default_action_is_a_parameter(spark):
    df = spark.createDataFrame([(1, "Strange")], "b int, kind string")
    assert with_policy(df, "b", "kind", default="DENY").first().policy_action == "DENY"


def test_report_grades(spark):
    assert values(spark, macro_grade("x"), [0.8499, 0.85, 0.8999, 0.9]) == [
        "Action Required", "Optimization Recommended", "Optimization Recommended", "Production Ready"]
    assert values(spark, separation_grade("x"), [0.95, 0.8, 0.1, 0.0]) == ["Strong", "Adequate", "Weak", None]
    assert values(spark, imbalance_flag("w", "m"), [(0.9, 0.7), (0.9, 0.85), (0.9, 0.0)], "w double, m double") == [True, False, None]


def test_percent_text(spark):
    assert values(spark, N.percent("x"), [0.5385, 1.0, 0.0004]) == ["53.9%", "100.0%", "0.0%"]


def test_confidence_is_probability_of_the_called_class(spark):
    got = values(spark, D.binary_confidence("b", "p"), [(1, 0.8), (0, 0.8), (1, 1.7), (0, -1.0)], "b int, p double")
    assert got == pytest.approx([0.8, 0.2, 1.0, 1.0])
    assert math.isnan(values(spark, D.binary_confidence("b", "p"), [(1, NAN)], "b int, p double")[0])


def test_policy_strategy(spark):
    def name(**lists):
        return policy_strategy(policy_table(spark, **lists)).first().strategy

    assert name() == "Aggressive Blocking"
    assert name(deny=["a"]) == "Limited high-risk coverage"
    assert name(deny=["a", "b"], quarantine=["c", "d", "e"]) == "Conservative Strategy"
