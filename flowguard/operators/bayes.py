"""Gaussian naive Bayes in closed form."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowguard.functions.numbers import sum_of

SMOOTHING = 1e-9


class GaussianBayes:
    """Per-class priors, means and variances; scoring is plain column arithmetic."""

    def __init__(self, features: list[str], classes: list, priors: list[float], means: list, variances: list):
        self.features, self.classes, self.priors = features, classes, priors
        self.means, self.variances = means, variances

    def log_likelihood(self, k: int) -> Column:
        const = math.log(self.priors[k]) - 0.5 * sum(math.log(2.0 * math.pi * v) for v in self.variances[k])
        terms = [
            (F.col(f) - F.lit(m)) * (F.col(f) - F.lit(m)) / F.lit(v)
            for f, m, v in zip(self.features, self.means[k], self.variances[k])
        ]
        return F.lit(const) - F.lit(0.5) * sum_of(terms)

    def transform(self, df: DataFrame, prediction: str = "predicted", best: str = "log_likelihood") -> DataFrame:
        scored = df.withColumns({f"_ll{k}": self.log_likelihood(k) for k in range(len(self.classes))})
        cols = [F.col(f"_ll{k}") for k in range(len(self.classes))]
        top = F.greatest(*cols) if len(cols) > 1 else cols[0]
        name = F.when(cols[0] == top, F.lit(self.classes[0]))
        for c, ll in zip(self.classes[1:], cols[1:]):
            name = name.when(ll == top, F.lit(c))
        return scored.withColumns({prediction: name, best: top}).drop(*[f"_ll{k}" for k in range(len(self.classes))])


def fit_gaussian_bayes(df: DataFrame, features: list[str], label: str) -> GaussianBayes:
    """Two aggregates: overall variances for the smoothing term, moments per class."""
    overall = df.agg(*[F.var_pop(f) for f in features]).first()
    eps = SMOOTHING * max(v or 0.0 for v in overall)
    cells = [c for i, f in enumerate(features) for c in (F.avg(f).alias(f"m{i}"), F.var_pop(f).alias(f"v{i}"))]
    rows = df.groupBy(label).agg(F.count("*").alias("n"), *cells).orderBy(label).collect()  # one row per class
    total = sum(r["n"] for r in rows)
    return GaussianBayes(
        features, [r[label] for r in rows], [r["n"] / total for r in rows],
        [[r[f"m{i}"] for i in range(len(features))] for r in rows],
        [[r[f"v{i}"] + eps for i in range(len(features))] for r in rows],
    )
