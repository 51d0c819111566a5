"""Forests, trees, PCA chains and their comparison, on Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.constants import FOREST_DEFAULTS
from flowguard.operators import metrics as M
from flowguard.operators.joins import encode_labels, with_class_index
from flowguard.operators.scale import fit_scaler
from flowguard.operators.selection import keep_k_best
from flowguard.operators.weights import with_weights
from flowguard.session import write_through

DEPTH = 12  # trees are grown level by level over the whole table; 30 is the hard limit


def assemble(df: DataFrame, features: list[str], keep: list[str], out: str = "_x") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=out).transform(df).select(*keep, out)


def fit_forest(
    df: DataFrame,
    features: list[str],
    label: str,
    weight: str | None = None,
    num_trees: int = FOREST_DEFAULTS["num_trees"],
    depth: int = DEPTH,
    min_leaf: int = FOREST_DEFAULTS["min_leaf"],
    seed: int = FOREST_DEFAULTS["random_state"],
    prefix: str = "",
):
    """Forest with √features per split; output columns may carry a prefix to chain two models."""
    keep = [F.col(label).cast("double").alias("_y"), *([F.col(weight).alias("_w")] if weight else [])]
    vec = assemble(df, features, keep)
    forest = RandomForestClassifier(
        featuresCol="_x", labelCol="_y", numTrees=num_trees, maxDepth=depth, minInstancesPerNode=min_leaf,
        featureSubsetStrategy=FOREST_DEFAULTS["max_features"], seed=seed,
        rawPredictionCol=f"{prefix}raw", probabilityCol=f"{prefix}probability", predictionCol=f"{prefix}index",
    )
    if weight:
        forest = forest.setWeightCol("_w")
    return forest.fit(vec)


def importances(model, features: list[str], n: int = 20) -> list[tuple[str, float]]:
    """The n most important features, 8 digits."""
    ranked = sorted(((f, float(model.featureImportances[i])) for i, f in enumerate(features)), key=lambda t: -t[1])
    return [(f, round(v, 8)) for f, v in ranked[:n]]


def fit_attack_classes(df: DataFrame, features: list[str], label: str, **forest):
    """(model, class names): class-weighted forest over attack rows, labels encoded in name order."""
    encoding = encode_labels(df, label)
    names = [r[label] for r in encoding.orderBy("class_index").collect()]  # one row per class
    rows = with_weights(with_class_index(df, label, encoding), label, "_weight")
    return fit_forest(rows, features, "class_index", "_weight", prefix="class_", **forest), names


def components_for(model, share: float) -> int:
    """Smallest number of components explaining ``share`` of the variance."""
    total = 0.0
    for i, v in enumerate(model.explainedVariance.toArray()):
        total += float(v)
        if total >= share - 1e-12:
            return i + 1
    return len(model.explainedVariance)


def fit_pca(df: DataFrame, vector: str, k: int, out: str = "_pca"):
    return PCA(k=k, inputCol=vector, outputCol=out).fit(df)


class Chain:
    """K-best → scale → PCA → classifier, or scale → K-best → PCA by variance share."""

    def __init__(self, features, scaler, tail):
        self.features, self.scaler, self.tail = features, scaler, tail

    def transform(self, df: DataFrame, keep: list[str]) -> DataFrame:
        scaled = self.scaler.transform(df.select(*keep, *self.features))
        return self.tail.transform(assemble(scaled, self.features, keep))


def fit_chain(
    df: DataFrame,
    features: list[str],
    label: str,
    classifier,
    k_best: int = 25,
    components: int | float = 12,
) -> Chain:
    """``components`` as a whole number, or as a share of variance to explain.

    F scores do not change under scaling, so choosing before or after it keeps the same features.
    """
    kept, _ = keep_k_best(df, features, label, min(k_best, len(features)))
    scaler = fit_scaler(df, kept)
    vec = assemble(scaler.transform(df.select(label, *kept)), kept, [F.col(label).cast("double").alias("_y")])
    if isinstance(components, float):
        full = fit_pca(vec, "_x", len(kept))
        k = components_for(full, components)
    else:
        k = min(components, len(kept))
    stages = [PCA(k=k, inputCol="_x", outputCol="_pca"), classifier.copy().setFeaturesCol("_pca").setLabelCol("_y")]
    return Chain(kept, scaler, Pipeline(stages=stages).fit(vec))


def tree_classifier(depth: int = DEPTH, seed: int = 42) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(maxDepth=depth, seed=seed)


def bayes_classifier() -> NaiveBayes:
    return NaiveBayes(modelType="gaussian")


def compare(chains: dict[str, Chain], test: DataFrame, label: str) -> DataFrame:
    """Weighted F1 and accuracy per model over the same test rows."""
    out = None
    for name, chain in chains.items():
        pred = chain.transform(test, [label])
        row = M.summary_metrics(M.confusion(pred, label, "prediction")).select(
            F.lit(name).alias("model"), "f1_weighted", "accuracy"
        )
        out = row if out is None else out.unionByName(row)
    return out


def compare_reports(chains: dict[str, Chain], test: DataFrame, label: str) -> DataFrame:
    """Report and matrix per model: ``model, class, precision, recall, f1, support, called``.

    ``called`` maps each predicted class to its rows of the actual ``class``; it is empty for a class that
    is predicted but never true. Each model scores the test rows once; its pair counts are written.
    """
    out = None
    for name, chain in chains.items():
        pred = chain.transform(test, [label]).withColumn("_y", F.col(label).cast("double"))
        pairs = write_through(M.confusion(pred, "_y", "prediction"), "model-pairs")
        cells = F.map_from_entries(F.array_sort(F.collect_list(F.struct("predicted", "n_rows"))))
        matrix = pairs.groupBy(F.col("actual").alias("class")).agg(cells.alias("called"))
        none = F.create_map().cast("map<double,bigint>")
        part = M.class_report(pairs).join(matrix, "class", "left").select(
            F.lit(name).alias("model"), "class", "precision", "recall", "f1", "support", F.coalesce("called", none).alias("called"))
        out = part if out is None else out.unionByName(part)
    return out


def score_binary(model, df: DataFrame, features: list[str], keep: list[str], out: str = "p_raw") -> DataFrame:
    scored = model.transform(assemble(df, features, keep))
    return scored.select(*keep, vector_to_array("probability")[1].alias(out))
