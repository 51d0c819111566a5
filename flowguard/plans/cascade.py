"""The scoring plan: validate → scale → attack score → attack class → trust → action."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.functions import decision as D
from flowguard.functions import proba as P
from flowguard.functions.trust import trust_struct
from flowguard.operators.calibrate import IsotonicCalibrator
from flowguard.operators.clean import require_columns, split_valid
from flowguard.operators.scale import Scaler
from flowguard.operators.stages import AttackScore, Decision, Standardise

DECISION_COLUMNS = [
    "action", "confidence", "attack_type", "prediction", "binary_pred", "trust", "trust_risk",
    "attack_proba", "margin",
]


def decide(
    df: DataFrame,
    keep: list[str],
    binary_pred: str = "binary_pred",
    p_attack: str = "p_attack",
    attack_proba: str = "attack_proba",
    attack_type: str = "attack_type",
    anomaly: str = "anomaly",
) -> DataFrame:
    """Decision columns from model outputs; everything is a column expression.

    Class outputs count only where the binary model says attack. ``trust.risk_level`` is the
    served risk; ``trust_risk`` the one the trust value alone would give.
    """
    is_attack = F.col(binary_pred) == 1
    kind = F.when(is_attack, F.col(attack_type))
    proba = F.when(is_attack, P.rounded(attack_proba))
    margin = F.when(is_attack, P.top_margin(attack_proba)).otherwise(F.lit(0.0))
    base = df.select(
        *keep,
        F.col(binary_pred).alias("binary_pred"),
        D.binary_confidence(binary_pred, p_attack).alias("confidence"),
        kind.alias("attack_type"),
        proba.alias("attack_proba"),
        F.coalesce(margin, F.lit(0.0)).alias("margin"),
        F.col(anomaly).alias("_anomaly"),
    )
    judged = base.withColumn("_trust", trust_struct("confidence", "margin", "_anomaly"))
    return judged.select(
        *keep,
        D.served_action("binary_pred", "confidence").alias("action"),
        "confidence", "attack_type",
        D.prediction_label("binary_pred").alias("prediction"),
        "binary_pred",
        F.struct(
            F.col("_trust.trust_score").alias("trust_score"),
            D.served_risk("binary_pred", "confidence").alias("risk_level"),
        ).alias("trust"),
        F.col("_trust.risk_level").alias("trust_risk"),
        "attack_proba", "margin",
    )


class Cascade:
    """Fitted scoring chain: one ``PipelineModel``, which ``save`` writes and ``load`` reads in any session.

    ``transform`` is lazy: one plan from raw rows to decisions, on a batch or a stream.
    """

    def __init__(self, scaler: Scaler, binary, calibrator, multiclass, classes: list[str], threshold: float = 0.5):
        if not classes:
            raise ValueError("no attack classes")
        features = list(scaler.features)
        isotonic = calibrator.model.copy().setFeaturesCol("_score").setPredictionCol("_cal")
        self._take(PipelineModel([
            Standardise(features=features, mean=list(scaler.mean), scale=list(scaler.scale), constant=sorted(scaler.constant)),
            VectorAssembler(inputCols=features, outputCol="_x"),
            binary.copy().setFeaturesCol("_x"),
            AttackScore(threshold=threshold, digits=calibrator.digits),
            isotonic,
            multiclass.copy().setFeaturesCol("_x"),
            Decision(classes=list(classes), features=features),
        ]))

    def _take(self, model: PipelineModel) -> None:
        self.model = model
        standardise, _, self.binary, score, isotonic, self.multiclass, decision = model.stages
        self.scaler, self.classes = standardise.scaler(), list(decision.getOrDefault(decision.classes))
        self.threshold = score.getOrDefault(score.threshold)
        self.calibrator = IsotonicCalibrator(isotonic, score.getOrDefault(score.digits))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> Cascade:
        out = cls.__new__(cls)
        out._take(PipelineModel.load(path))
        return out

    def transform(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """One decision per valid row; see ``rejected`` for the others."""
        features = self.scaler.features
        require_columns(df, features, named=5)
        valid, _ = split_valid(df, features)
        kept = {f"kept{i}": c for i, c in enumerate(keep)}  # may have any name, a feature's too
        rows = valid.select(*[F.col(c).alias(k) for k, c in kept.items()], *features)
        return self.model.transform(rows).withColumnsRenamed(kept)

    def rejected(self, df: DataFrame, keep: list[str]) -> DataFrame:
        _, bad = split_valid(df, self.scaler.features)
        return bad.select(*keep, "reject_feature")


def flat_decisions(decisions: DataFrame, keep: list[str]) -> DataFrame:
    """Tabular form for CSV sinks: no nested columns, no probability map."""
    return decisions.select(
        *keep, "action", "binary_pred", "confidence", "attack_type", "prediction", "margin",
        F.col("trust.trust_score").alias("trust_score"),
        F.col("trust.risk_level").alias("risk_level"),
    )
