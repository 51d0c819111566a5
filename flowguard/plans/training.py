"""The training run: select → split → scale → fit → calibrate → evaluate."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.functions.decision import binary_prediction
from flowguard.operators.balance import oversample
from flowguard.operators.calibrate import fit_isotonic
from flowguard.operators.clean import attacks_only, fill_with, nullify_infinite
from flowguard.operators.models import assemble, fit_attack_classes, fit_forest, score_binary
from flowguard.operators.ordered import medians
from flowguard.operators.scale import Scaler, fit_scaler
from flowguard.operators.selection import TREE_SAMPLE_ROWS, select_features
from flowguard.operators.split import stratified_split
from flowguard.operators.weights import with_weights
from flowguard.plans.cascade import Cascade
from flowguard.plans.evaluation import evaluate_split
from flowguard.session import write_through
from flowguard.sources.files import load_split, write_splits

STAGES = ("select", "split", "train", "evaluate")


@dataclass
class Prepared:
    """Scaled rows with a ``split`` column, and what was fitted on the training part."""

    rows: DataFrame
    features: list[str]
    scaler: Scaler

    def part(self, split: str) -> DataFrame:
        return self.rows.where(F.col("split") == split).drop("split")


def prepare(
    df: DataFrame,
    features: list[str],
    id_col: str,
    strata: list[str] | None = None,
    fit_on: str = "all",
    test: float = 0.15,
    val: float = 0.15,
    seed: int = 42,
) -> Prepared:
    """Repair, exact stratified split, scaling fitted on the training rows.

    ``fit_on="all"`` imputes with medians of the whole table, ``"train"`` with those of the training
    rows only.
    """
    nulled = nullify_infinite(df.select(id_col, *features, "binary", "label"), features)
    parts = stratified_split(nulled, strata or ["binary"], [id_col], test=test, val=val, seed=seed)
    # The medians of all rows need no split.
    base = parts.where("split = 'train'") if fit_on == "train" else nulled
    filled = fill_with(parts, medians(base, features))
    # Fitted and read several times from here on: written once, read column-pruned.
    stored = write_through(filled, "prepared", ["split"])
    scaler = fit_scaler(stored.where("split = 'train'"), features)
    return Prepared(scaler.transform(stored), features, scaler)


def train_cascade(p: Prepared, id_col: str, use_oversampling: bool = True, threshold: float = 0.5, **forest) -> Cascade:
    """Binary forest, calibrated on validation rows, and the attack-class forest."""
    train, val = p.part("train"), p.part("val")
    if use_oversampling:
        balanced = write_through(oversample(train, "binary", id_col, p.features), "balanced")
        binary = fit_forest(balanced, p.features, "binary", **forest)
    else:
        binary = fit_forest(with_weights(train, "binary", "_weight"), p.features, "binary", "_weight", **forest)
    val_scores = score_binary(binary, val, p.features, [id_col, "binary"])
    calibrator = fit_isotonic(val_scores, "p_raw", "binary")
    attacks = attacks_only(train)
    multiclass, names = fit_attack_classes(attacks, p.features, "label", **forest)
    return Cascade(p.scaler, binary, calibrator, multiclass, names, threshold)


def scored_rows(cascade: Cascade, part: DataFrame) -> DataFrame:
    """``y, pred, p, class_true, class_pred, proba`` of scaled rows, both models on every row, written once.

    The attack class counts for all attack rows here, found or not, so both models are judged on their own.
    """
    features = cascade.scaler.features
    vec = assemble(part, features, [F.col("binary").alias("y"), F.col("label").alias("class_true")])
    raw = cascade.binary.transform(vec).select("y", "class_true", "_x", vector_to_array("probability")[1].alias("p_raw"))
    classed = cascade.multiclass.transform(cascade.calibrator.transform(raw, "p_raw", "p"))
    names = F.array(*map(F.lit, cascade.classes))
    out = classed.select(
        "y", binary_prediction("p").alias("pred"), "p", "class_true",
        F.element_at(names, F.col("class_index").cast("int") + 1).alias("class_pred"),
        F.map_from_arrays(names, vector_to_array("class_probability")).alias("proba"))
    return write_through(out, "scored")


def evaluate_parts(spark: SparkSession, cascade: Cascade, parts: dict[str, DataFrame]) -> DataFrame:
    """The whole evaluation (``evaluation.evaluate_split``) of each split, one table."""
    known = spark.createDataFrame([(c,) for c in cascade.classes], "class string")
    return reduce(DataFrame.unionByName, [evaluate_split(scored_rows(cascade, part), split, known) for split, part in parts.items()])


def run(
    spark: SparkSession,
    df: DataFrame,
    features: list[str],
    id_col: str,
    stages: tuple[str, ...] = STAGES,
    split_path: str | None = None,
    cascade: Cascade | None = None,
    selection: dict | None = None,
    trees: int = 100,
    cascade_path: str | None = None,
    evaluate_on: tuple[str, ...] = ("val", "test"),
    sample_rows: int = TREE_SAMPLE_ROWS,
    **forest,
) -> dict:
    """The chosen stages in order; leave out ``train`` to evaluate an existing cascade.

    ``cascade_path`` is where ``train`` saves the cascade, and where it is loaded from without ``train``; with
    ``split_path`` too, a later session evaluates from what is stored. ``sample_rows`` bounds the tree sample.
    """
    unknown = set(stages) - set(STAGES)
    if unknown:
        raise ValueError(f"unknown stages {sorted(unknown)}")
    out: dict = {"features": list(features), "cascade": cascade}
    if "select" in stages:
        out["features"], out["audit"], out["scores"] = select_features(
            df, features, "binary", id_col, selection, trees=trees, sample_rows=sample_rows,
            **({"depth": forest["depth"]} if "depth" in forest else {})
        )
    if "split" in stages:
        out["prepared"] = prepare(df, out["features"], id_col)
        if split_path:
            write_splits(out["prepared"].rows, split_path)
    if "train" in stages:
        out["cascade"] = train_cascade(out["prepared"], id_col, **forest)
        if cascade_path:
            out["cascade"].save(cascade_path)
    if "evaluate" in stages:
        if out["cascade"] is None and cascade_path:
            out["cascade"] = Cascade.load(cascade_path)
        if out["cascade"] is None:
            raise ValueError("nothing to evaluate: no stage trained a model and none was given")
        parts = {s: load_split(spark, split_path, s) if split_path else out["prepared"].part(s) for s in evaluate_on}
        out["metrics"] = evaluate_parts(spark, out["cascade"], parts)
    return out
