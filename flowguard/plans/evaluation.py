"""Evaluation of scored rows: binary and multi-class results in one long metric table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.functions.labels import lookup_key
from flowguard.operators import metrics as M
from flowguard.operators.joins import known_classes
from flowguard.operators.policy import policy_table
from flowguard.operators.report import health_score, imbalance_flag, macro_grade, separation_grade
from flowguard.session import write_through

BINARY_METRICS = ["accuracy", "f1_weighted", "f1_macro"]
CLASS_METRICS = ["accuracy", "f1_weighted", "f1_macro", "precision_weighted", "recall_weighted"]


def evaluate_scored(
    df: DataFrame,
    split: str,
    truth: str = "y",
    predicted: str = "pred",
    score: str = "p",
    class_truth: str = "class_true",
    class_predicted: str = "class_pred",
    proba: str = "proba",
) -> DataFrame:
    """``run, split, class, metric, value`` for both models over one scored table."""
    binary = M.summary_metrics(M.confusion(df, truth, predicted))
    ranks = M.rank_metrics(M.score_table(df, score, truth))
    classes = M.summary_metrics(M.confusion(df, class_truth, class_predicted))
    per_class = M.per_class_rank_metrics(df, class_truth, proba)
    cells = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("roc_auc", "average_precision")
    ])
    per = per_class.select("class", F.explode(cells).alias("m")).select(
        F.lit("multiclass").alias("run"), F.lit(split).alias("split"), "class", "m.metric", "m.value"
    )
    return (
        M.long_metrics(binary, "binary", split, BINARY_METRICS)
        .unionByName(M.long_metrics(ranks, "binary", split, ["roc_auc", "average_precision"]))
        .unionByName(M.long_metrics(classes, "multiclass", split, CLASS_METRICS))
        .unionByName(per)
    )


def _held(small: DataFrame) -> DataFrame:
    """A table of a few rows per class, computed once."""
    return small.sparkSession.createDataFrame(small.collect(), small.schema)


def _matrix_and_report(conf: DataFrame, classes: DataFrame, run: str, split: str) -> DataFrame:
    """The cells of the confusion matrix (``predicted:<class>`` by actual class) and the report per class."""
    cells = M.dense_confusion(conf, _held(M.labels_seen(conf))).select(
        F.col("actual").alias("class"), F.concat(F.lit("predicted:"), "predicted").alias("metric"), F.col("n_rows").cast("double").alias("value"))
    columns = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.round(F.col(m).cast("double"), 6).alias("value")) for m in ("precision", "recall", "f1", "support")
    ])
    report = M.class_report(conf, classes).select("class", F.explode(columns).alias("m")).select("class", "m.metric", "m.value")
    return cells.unionByName(report).select(F.lit(run).alias("run"), F.lit(split).alias("split"), "class", "metric", "value")


def evaluate_split(
    df: DataFrame,
    split: str,
    classes: DataFrame,
    truth: str = "y",
    predicted: str = "pred",
    score: str = "p",
    class_truth: str = "class_true",
    class_predicted: str = "class_pred",
    proba: str = "proba",
) -> DataFrame:
    """``run, split, class, metric, value``: the whole evaluation of both models.

    The binary half takes all rows, the class half the attack rows (``truth`` 1) whose class is in
    ``classes`` (column ``class``, the classes learnt); the other attack rows, null labels too, are
    counted as ``unseen_rows_excluded``. Macro and weighted AUC are null unless every class occurs.
    """
    known = _held(classes.select("class").distinct())
    n_classes = known.count()
    seen = known.select(F.col("class").alias(class_truth))
    # One scan counts the rows by both truths and both predictions; every label metric follows from those counts.
    joint = write_through(df.groupBy(truth, predicted, class_truth, class_predicted).agg(F.count("*").alias("n_rows")), "joint-counts")
    attacks = joint.where(F.col(truth) == 1)

    def pairs(counts: DataFrame, actual: str, guess: str) -> DataFrame:
        return counts.groupBy(F.col(actual).cast("string").alias("actual"), F.col(guess).cast("string").alias("predicted")).agg(
            F.sum("n_rows").alias("n_rows"))

    binary = _held(pairs(joint, truth, predicted))
    multi = write_through(pairs(known_classes(attacks, class_truth, seen), class_truth, class_predicted), "class-pairs")
    kept = known_classes(df.where(F.col(truth) == 1), class_truth, seen)
    per_class = _held(M.per_class_rank_metrics(kept, class_truth, proba))
    per = per_class.select("class", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("roc_auc", "average_precision")
    ])).alias("m")).select(F.lit("multiclass").alias("run"), F.lit(split).alias("split"), "class", "m.metric", "m.value")
    sizes = multi.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("eval_rows"), F.lit(n_classes).alias("num_classes"))
    unseen = attacks.join(seen, class_truth, "left_anti").agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("unseen_rows_excluded"))
    parts = [
        M.long_metrics(M.summary_metrics(binary), "binary", split, CLASS_METRICS),
        M.long_metrics(M.rank_metrics(M.score_table(df, score, truth)), "binary", split, ["roc_auc", "average_precision"]),
        _matrix_and_report(binary, M.labels_seen(binary), "binary", split),
        M.long_metrics(M.summary_metrics(multi), "multiclass", split, CLASS_METRICS),
        M.long_metrics(sizes, "multiclass", split, ["eval_rows", "num_classes"]),
        M.long_metrics(unseen, "multiclass", split, ["unseen_rows_excluded"]),
        M.long_metrics(M.rank_means(per_class, n_classes), "multiclass", split, ["roc_auc_macro", "roc_auc_weighted"]),
        per,
        _matrix_and_report(multi, known, "multiclass", split),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _cell(run: str, metric: str):
    hit = (F.col("run") == run) & (F.col("metric") == metric) & (F.col("class") == "all")
    return F.max(F.when(hit, F.col("value")))


def report_card(metrics: DataFrame) -> DataFrame:
    """Grades read off the long metric table."""
    macro_auc = F.round(F.avg(F.when((F.col("class") != "all") & (F.col("metric") == "roc_auc"), F.col("value"))), 6)
    row = metrics.agg(
        _cell("binary", "accuracy").alias("acc_b"), _cell("multiclass", "accuracy").alias("acc_m"),
        _cell("multiclass", "f1_macro").alias("f1_macro"), _cell("multiclass", "f1_weighted").alias("f1_weighted"),
        macro_auc.alias("auc"),
    )
    return row.select(
        F.round(health_score("acc_b", "acc_m"), 6).alias("health_score"), macro_grade("f1_macro").alias("grade"),
        separation_grade("auc").alias("separation"), imbalance_flag("f1_weighted", "f1_macro").alias("imbalanced"),
    )


def posture(df: DataFrame, policy: DataFrame | None = None) -> DataFrame:
    """Mean of binary accuracy, macro F1 and the share of attack classes the policy lists, in percent."""
    spark = df.sparkSession
    policy = policy_table(spark) if policy is None else policy
    known = df.select(lookup_key("class_true").alias("class_key")).distinct()
    coverage = known.join(F.broadcast(policy), "class_key", "left").agg(
        F.avg(F.when(F.col("action").isNull(), 0.0).otherwise(1.0)).alias("c")
    )
    accuracy = M.summary_metrics(M.confusion(df, "y", "pred")).select("accuracy")
    classes = M.summary_metrics(M.confusion(df, "class_true", "class_pred")).select("f1_macro")
    # Three one-row results meet as scalar subqueries.
    return coverage.select(
        F.round(accuracy.scalar(), 6).alias("binary_accuracy"), F.round(classes.scalar(), 6).alias("f1_macro"),
        F.round("c", 6).alias("coverage"),
        F.round((accuracy.scalar() + classes.scalar() + F.col("c")) / 3 * 100, 1).alias("posture"),
    )
