"""The steps around the two forests as ML stages, so that a fitted cascade is one ``PipelineModel`` that saves and loads.

Parameters are plain values in the stage's metadata; the forests and the isotonic map are Spark's own stages. Columns
that a stage adds for the next ones start with ``_``; ``Decision`` drops them.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.functions import decision as D
from flowguard.functions.trust import anomaly_score
from flowguard.operators.scale import Scaler


class Standardise(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Standardised features in place of the raw ones, and the anomaly score ``_anomaly`` of the row."""

    features = Param(Params._dummy(), "features", "feature columns in order", TypeConverters.toListString)
    mean = Param(Params._dummy(), "mean", "means", TypeConverters.toListFloat)
    scale = Param(Params._dummy(), "scale", "population deviations, 1 for a constant", TypeConverters.toListFloat)
    constant = Param(Params._dummy(), "constant", "features without deviation", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, features=None, mean=None, scale=None, constant=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def scaler(self) -> Scaler:
        get = self.getOrDefault
        return Scaler(get(self.features), get(self.mean), get(self.scale), frozenset(get(self.constant)))

    def _transform(self, df: DataFrame) -> DataFrame:
        scaler = self.scaler()
        return scaler.transform(df).withColumn("_anomaly", anomaly_score(scaler.features))


class AttackScore(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """The raw attack probability, the attack label at ``threshold``, and the rounded score for calibration."""

    threshold = Param(Params._dummy(), "threshold", "attack from here on", TypeConverters.toFloat)
    digits = Param(Params._dummy(), "digits", "digits of the score that is calibrated", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, threshold=None, digits=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        scored = df.withColumn("_p_raw", vector_to_array("probability")[1]).drop("raw", "probability", "index")
        return scored.withColumns({
            "_binary_pred": D.binary_prediction("_p_raw", self.getOrDefault(self.threshold)),
            "_score": F.round("_p_raw", self.getOrDefault(self.digits))})


class Decision(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Decision columns next to the columns that are no features.

    The class forest's probability is used inside one conditional only. The optimiser puts the forest's function
    there, so the forest runs on rows that were called attacks and on no others, in one pass over the rows.
    """

    classes = Param(Params._dummy(), "classes", "attack classes in the order of their index", TypeConverters.toListString)
    features = Param(Params._dummy(), "features", "feature columns", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, classes=None, features=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        from flowguard.plans.cascade import decide

        classes, features = self.getOrDefault(self.classes), self.getOrDefault(self.features)
        inner = {"raw", "probability", "index", "class_raw", "class_probability", "class_index"}
        keep = [c for c in df.columns if c not in features and c not in inner and not c.startswith("_")]
        attack = F.when(F.col("_binary_pred") == 1, vector_to_array("class_probability"))
        called = df.select(
            *keep, "_anomaly", "_binary_pred", attack.alias("_proba"),
            F.greatest(F.least(F.col("_cal"), F.lit(1.0)), F.lit(0.0)).alias("_p_attack"))
        names = F.array(*map(F.lit, classes))
        # The first of the largest probabilities, as the forest itself decides.
        best = F.element_at(names, F.array_position("_proba", F.array_max("_proba")).cast("int"))
        named = called.select(
            *keep, "_anomaly", "_binary_pred", "_p_attack", F.map_from_arrays(names, "_proba").alias("_attack_proba"), best.alias("_attack_type"))
        return decide(named, keep, "_binary_pred", "_p_attack", "_attack_proba", "_attack_type", "_anomaly")
