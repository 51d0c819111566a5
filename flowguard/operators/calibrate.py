"""Monotone calibration of attack probabilities."""

from __future__ import annotations

from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class IsotonicCalibrator:
    """Non-decreasing map from raw to calibrated probability, constant outside the fitted range."""

    def __init__(self, model: IsotonicRegressionModel, digits: int):
        self.model, self.digits = model, digits

    def transform(self, df: DataFrame, raw: str, out: str) -> DataFrame:
        binned = df.withColumn("_score", F.round(raw, self.digits))
        model = self.model.copy().setFeaturesCol("_score").setPredictionCol("_cal")
        return (
            model.transform(binned)
            .withColumn(out, F.greatest(F.least(F.col("_cal"), F.lit(1.0)), F.lit(0.0)))
            .drop("_score", "_cal")
        )


def fit_isotonic(df: DataFrame, raw: str, label: str, digits: int = 6) -> IsotonicCalibrator:
    """Fit on validation rows, first reduced to one weighted row per distinct score.

    Scores are rounded to ``digits``, so the fit sees at most 10^digits rows however many were
    scored.
    """
    binned = df.groupBy(F.round(raw, digits).alias("features")).agg(
        F.avg(F.col(label).cast("double")).alias("label"), F.count("*").cast("double").alias("weight")
    )
    return IsotonicCalibrator(IsotonicRegression(weightCol="weight").fit(binned), digits)
