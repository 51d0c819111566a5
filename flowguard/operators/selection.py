"""Feature selection: variance, correlation, ANOVA F and tree importance."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowguard.constants import SELECTION_DEFAULTS, TREE_SAMPLE_ROWS
from flowguard.operators.extra_trees import extra_tree_importance, fit_extra_trees
from flowguard.operators.split import balanced_sample
from flowguard.session import write_through


def _rows(df: DataFrame, cells: list) -> DataFrame:
    return df.agg(F.array(*cells).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def variance_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """Population variance of every column in one aggregate."""
    return _rows(df, [
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"), F.var_pop(c).alias("variance"))
        for i, c in enumerate(cols)
    ])


def keep_by_variance(df: DataFrame, cols: list[str], threshold: float = 0.01) -> list[str]:
    kept = variance_table(df, cols).where(F.col("variance") > threshold)
    return [r["feature"] for r in kept.orderBy("position").collect()]  # feature names only


def correlation_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """Absolute Pearson correlation of each column pair, earlier column first; null for a constant.

    One Gram-matrix pass over the rows that have a number in every column, whatever their count; only the
    k×k result comes to the driver. Fewer than two such rows: all null.
    """
    pairs = [(i, j) for j in range(len(cols)) for i in range(j)]
    if not pairs:
        return df.sparkSession.createDataFrame([], "i int, j int, first string, second string, r double")
    whole = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).where(
        reduce(and_, [F.col(c).isNotNull() & ~F.isnan(c) for c in cols]))
    if len(whole.take(2)) < 2:
        rows = [(i, j, cols[i], cols[j], None) for i, j in pairs]
    else:
        vec = VectorAssembler(inputCols=cols, outputCol="_x").transform(whole).select("_x")
        m = Correlation.corr(vec, "_x").head()[0].toArray()
        r = lambda i, j: None if math.isnan(m[i, j]) else abs(float(m[i, j]))
        rows = [(i, j, cols[i], cols[j], r(i, j)) for i, j in pairs]
    return df.sparkSession.createDataFrame(rows, "i int, j int, first string, second string, r double")


def correlated_columns(corr: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Columns with a strongly correlated earlier one (which itself need not survive)."""
    return corr.where((F.col("r") >= threshold) & ~F.isnan("r")).groupBy("j").agg(F.first("second").alias("feature"))


def keep_by_correlation(df: DataFrame, cols: list[str], threshold: float = 0.95) -> list[str]:
    dropped = {r["feature"] for r in correlated_columns(correlation_table(df, cols), threshold).collect()}
    return [c for c in cols if c not in dropped]


def anova_table(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """One-way F of every column against the classes.

    Per class only count, mean and variance are kept (one wide partial aggregate), so the result
    does not suffer from subtracting large sums of squares and a dominant class causes no skew.
    """
    cells = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"), F.count(c).alias("n"),
                      F.avg(c).alias("m"), F.var_pop(c).alias("v")) for i, c in enumerate(cols)]
    per = df.groupBy(label).agg(F.array(*cells).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    every = W.partitionBy("feature")
    grand = F.sum(F.col("n") * F.col("m")).over(every) / F.sum("n").over(every)
    spread = per.withColumn("_d", F.col("m") - grand)
    sums = spread.groupBy("position", "feature").agg(
        F.sum(F.col("n") * F.col("_d") * F.col("_d")).alias("between"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
        F.count("*").alias("k"), F.sum("n").alias("n"),
    )
    f = F.try_divide(F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k")))
    return sums.select("position", "feature", f.alias("f_score"))


def k_best(scores: DataFrame, k: int) -> DataFrame:
    """The k highest F scores; undefined scores last, of equal ones the later column first."""
    score = F.when(F.isnan("f_score"), None).otherwise(F.col("f_score"))
    order = W.partitionBy(F.lit(0)).orderBy(score.desc_nulls_last(), F.col("position").desc())
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def keep_k_best(df: DataFrame, cols: list[str], label: str, k: int = 40) -> tuple[list[str], dict[str, float]]:
    rows = k_best(anova_table(df, cols, label), min(k, len(cols))).orderBy("position").collect()  # ≤ k rows
    return [r["feature"] for r in rows], {r["feature"]: r["f_score"] for r in rows}


def tree_importance(
    df: DataFrame,
    cols: list[str],
    label: str,
    id_col: str,
    trees: int = 100,
    depth: int = 12,
    min_leaf: int = 5,
    seed: int = 42,
    sample_rows: int = TREE_SAMPLE_ROWS,
) -> dict[str, float]:
    """Mean importance of two forests on a class-balanced sample.

    The sample is ``sample_rows // 2`` labelled rows of each class once the table has more than ``sample_rows``.

    The second forest is one of extremely randomised trees, without bootstrap. ``depth`` bounds both.
    """
    from pyspark.ml.classification import RandomForestClassifier

    sample = balanced_sample(df.select(id_col, label, *cols), label, id_col, sample_rows // 2, sample_rows, seed)
    sample = write_through(sample.select(label, *cols), "tree-sample")  # every level of both forests reads it
    vec = VectorAssembler(inputCols=cols, outputCol="_x").transform(sample).select("_x", F.col(label).cast("double").alias("_y"))
    forest = RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf,
                                    featureSubsetStrategy="sqrt", seed=seed)
    first = forest.fit(vec).featureImportances
    second = extra_tree_importance(fit_extra_trees(sample, cols, label, trees, depth, min_leaf, seed=seed), len(cols))
    return {c: float((first[i] + second[i]) / 2) for i, c in enumerate(cols)}


def top_features(importance: DataFrame, n: int = 40) -> DataFrame:
    return importance.orderBy(F.col("importance").desc(), "feature").limit(n)


def resolve(config: dict | None = None, **given) -> dict:
    """Parameters: caller before config before default."""
    out = {}
    for name, default in SELECTION_DEFAULTS.items():
        value = given.get(name)
        out[name] = value if value is not None else (config or {}).get(name, default)
    return out


def select_features(
    df: DataFrame,
    cols: list[str],
    label: str,
    id_col: str,
    config: dict | None = None,
    trees: int = 100,
    depth: int = 12,
    with_trees: bool = True,
    sample_rows: int = TREE_SAMPLE_ROWS,
    **given,
) -> tuple[list[str], DataFrame, DataFrame]:
    """The whole cascade: (selected names, audit per step, score per feature).

    Reads are column-pruned per step; only names and per-feature scores reach the driver.
    """
    p = resolve(config, **given)
    audit, current = [], list(cols)

    def step(name: str, kept: list[str]) -> list[str]:
        audit.append((len(audit) + 1, name, len(current), len(kept), len(current) - len(kept)))
        return kept

    current = step("variance", keep_by_variance(df, current, p["variance_threshold"]))
    current = step("correlation", keep_by_correlation(df, current, p["correlation_threshold"]))
    kept, scores = keep_k_best(df, current, label, p["kbest_k"])
    current = step("anova_f", kept)
    weights: dict[str, float] = {}
    if with_trees:
        weights = tree_importance(df, current, label, id_col, trees, depth, seed=p["random_state"], sample_rows=sample_rows)
        best = sorted(weights, key=lambda c: -weights[c])[: p["tree_top_n"]]
        current = step("tree_importance", best)
    spark = df.sparkSession
    audit_df = spark.createDataFrame(audit, "step int, name string, n_in int, n_out int, dropped int")
    rows = [(i, c, scores.get(c), weights.get(c)) for i, c in enumerate(current)]
    score_df = spark.createDataFrame(rows, "position int, feature string, f_score double, importance double")
    return current, audit_df, score_df
