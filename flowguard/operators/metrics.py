"""Classification metrics as relational work: confusion counts, reports, exact rank metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowguard.operators.ordered import range_bounds, running_totals


# --- from predicted labels -------------------------------------------------------


def confusion(df: DataFrame, actual: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """``by, actual, predicted, n_rows``: the pairs that occur. All label metrics start here."""
    return df.groupBy(*(by or []), F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count("*").alias("n_rows")
    )


def labels_seen(conf: DataFrame) -> DataFrame:
    return conf.select(F.col("actual").alias("class")).union(conf.select(F.col("predicted"))).distinct()


def dense_confusion(conf: DataFrame, classes: DataFrame) -> DataFrame:
    """All pairs of the class list, absent pairs as 0. ``classes`` is the (small) class list."""
    names = classes.agg(F.array_sort(F.collect_set("class")).alias("names"))  # class names only
    grid = names.select("names", F.explode("names").alias("actual")).select("actual", F.explode("names").alias("predicted"))
    return grid.join(conf, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("n_rows", F.lit(0)).alias("n_rows")
    )


def confusion_matrix(conf: DataFrame, classes: list[str]) -> DataFrame:
    """Matrix form: one row per actual class, one column per predicted class."""
    return conf.groupBy("actual").pivot("predicted", classes).agg(F.sum("n_rows")).na.fill(0)


def normalised_confusion(conf: DataFrame) -> DataFrame:
    """Share of each prediction within its actual class; null where a class has no rows."""
    row = F.sum("n_rows").over(W.partitionBy("actual"))
    return conf.select("actual", "predicted", F.round(F.try_divide(F.col("n_rows"), row), 6).alias("share"))


def can_normalise(conf: DataFrame, classes: DataFrame) -> bool:
    """Every listed class occurs as actual class."""
    empty = dense_confusion(conf, classes).groupBy("actual").agg(F.sum("n_rows").alias("n")).where("n = 0")
    return empty.isEmpty()


def class_report(conf: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """``class, precision, recall, f1, support`` (unrounded; 0 where undefined) per listed class."""
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n_rows")).otherwise(0)
    sides = conf.select(
        F.explode(F.array(
            F.struct(F.col("actual").alias("class"), F.col("n_rows").alias("sup"), F.lit(0).cast("bigint").alias("prd"), hit.alias("tp")),
            F.struct(F.col("predicted").alias("class"), F.lit(0).cast("bigint").alias("sup"), F.col("n_rows").alias("prd"), F.lit(0).cast("bigint").alias("tp")),
        )).alias("s")
    ).select("s.*")
    agg = sides.groupBy("class").agg(F.sum("sup").alias("sup"), F.sum("prd").alias("prd"), F.sum("tp").alias("tp"))
    if classes is not None:
        agg = classes.select("class").join(agg, "class", "left").na.fill(0, ["sup", "prd", "tp"])
    zero = F.lit(0.0)
    return agg.select(
        "class",
        F.coalesce(F.try_divide("tp", "prd"), zero).alias("precision"),
        F.coalesce(F.try_divide("tp", "sup"), zero).alias("recall"),
        F.coalesce(F.try_divide(2 * F.col("tp"), F.col("prd") + F.col("sup")), zero).alias("f1"),
        F.col("sup").alias("support"),
        F.col("tp").alias("hits"),
        F.col("prd").alias("predicted"),
    )


def report_with_total(report: DataFrame) -> DataFrame:
    """Per-class rows and the support-weighted overall row from one rollup (class null = overall)."""

    def weighted(c: str):
        mean = F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support"))
        return F.round(F.coalesce(mean, F.max(c)), 6).alias(c)

    return report.rollup("class").agg(
        weighted("precision"), weighted("recall"), weighted("f1"), F.sum("support").alias("support")
    )


def summary_metrics(conf: DataFrame) -> DataFrame:
    """One row: accuracy, weighted and macro F1, weighted precision and recall, 6 digits."""
    r = class_report(conf)  # classes seen in truth or prediction
    n = F.sum("support")

    def weighted(c: str):
        return F.try_divide(F.sum(F.col(c) * F.col("support")), n)

    return r.agg(
        F.round(F.try_divide(F.sum("hits"), n), 6).alias("accuracy"),
        F.round(weighted("f1"), 6).alias("f1_weighted"),
        F.round(F.avg("f1"), 6).alias("f1_macro"),
        F.round(weighted("precision"), 6).alias("precision_weighted"),
        F.round(weighted("recall"), 6).alias("recall_weighted"),
        n.alias("n_rows"),
    )


# --- from scores ---------------------------------------------------------------------


def score_table(df: DataFrame, score: str, positive: str, by: list[str] | None = None, bounds: list[float] | None = None) -> DataFrame:
    """Distinct scores, highest first in meaning, with running counts of both classes."""
    counted = df.groupBy(*(by or []), F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(positive) == 1).alias("pos"), F.count_if(F.col(positive) != 1).alias("neg")
    )
    bounds = range_bounds(df, score) if bounds is None else bounds
    return running_totals(counted, "score", ["pos", "neg"], by, descending=True, bounds=bounds)


def rank_metrics(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Exact ROC-AUC (ties count half) and average precision from a score table.

    Null where a class is missing. Works on distinct scores, never on a global sort of rows.
    """
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    p, n = F.sum(pos), F.sum(neg)
    auc = F.try_divide(F.sum(neg * (F.col("cum_pos") - pos / 2)), p * n)
    ap = F.try_divide(F.sum(pos * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))), p)
    out = [
        F.round(auc, 6).alias("roc_auc"), F.round(ap, 6).alias("average_precision"),
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
    ]
    return table.groupBy(*by).agg(*out) if by else table.agg(*out)


def roc_points(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """False and true positive rate at each distinct threshold."""
    by = by or []
    totals = table.groupBy(*by).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return _beside(table, totals, by).select(
        *by, F.col("score").alias("threshold"),
        F.round(F.try_divide("cum_neg", "_n"), 6).alias("fpr"), F.round(F.try_divide("cum_pos", "_p"), 6).alias("tpr"),
    )


def pr_points(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision and recall at each distinct threshold."""
    by = by or []
    totals = table.groupBy(*by).agg(F.sum("pos").alias("_p"))
    return _beside(table, totals, by).select(
        *by, F.col("score").alias("threshold"),
        F.round(F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")), 6).alias("precision"),
        F.round(F.try_divide("cum_pos", "_p"), 6).alias("recall"),
    )


def _beside(table: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    from flowguard.session import sized_side

    if by:
        return table.join(sized_side(totals), by)
    row = totals.first()  # one row of totals
    return table.withColumns({c: F.lit(row[c]) for c in totals.columns})


def one_vs_rest(df: DataFrame, truth: str, proba: str) -> DataFrame:
    """``class, score, is_class``: every class of the map against all others."""
    return df.select(F.col(truth).alias("_t"), F.explode(proba).alias("class", "score")).select(
        "class", "score", (F.col("_t") == F.col("class")).cast("int").alias("is_class")
    )


def per_class_rank_metrics(df: DataFrame, truth: str, proba: str) -> DataFrame:
    """AUC and AP per class, classes absent from the truth left out."""
    long = one_vs_rest(df, truth, proba)
    return rank_metrics(score_table(long, "score", "is_class", ["class"]), ["class"]).where("positives > 0")


def rank_means(per_class: DataFrame, n_classes: int) -> DataFrame:
    """Macro and support-weighted AUC; null unless every class is present."""
    full = (F.count("*") == n_classes) & (F.count("roc_auc") == n_classes)
    weighted = F.sum(F.col("roc_auc") * F.col("positives")) / F.sum("positives")
    return per_class.agg(
        F.when(full, F.round(F.avg("roc_auc"), 6)).alias("roc_auc_macro"),
        F.when(full, F.round(weighted, 6)).alias("roc_auc_weighted"),
    )


def long_metrics(row: DataFrame, run: str, split: str, metrics: list[str]) -> DataFrame:
    """A one-row metric table as ``run, split, class, metric, value`` rows."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return row.select(F.explode(cells).alias("m")).select(
        F.lit(run).alias("run"), F.lit(split).alias("split"), F.lit("all").alias("class"), "m.metric", "m.value"
    )


# --- reading a per-class table -----------------------------------------------------------


def weakest(per_class: DataFrame, n: int = 3) -> DataFrame:
    return per_class.orderBy("average_precision", "roc_auc", "class").limit(n)


def low_precision(per_class: DataFrame, below: float = 0.9) -> DataFrame:
    return per_class.where(F.col("average_precision") < below)
