"""Queries that fit models. Values depend on the fit, so most have no SQL twin."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.operators import models, selection
from flowguard.operators.extra_trees import extra_tree_importance, fit_extra_trees, leaf_counts
from flowguard.plans import training
from flowguard.plans.cascade import Cascade
from flowguard.plans.fixture_sql import LABELLED_DOCS, with_views
from flowguard.plans.registry import query
from flowguard.session import work_folder, write_through
from flowguard.sources.tables import (
    DOC_FEATURES, EVENT_FLOW_FEATURES, VEC_FEATURES, event_flows, labelled_docs, vec_rows,
)

SMALL = dict(num_trees=10, depth=6)


def docs(spark: SparkSession, d: str) -> DataFrame:
    """Labelled texts as two-class rows; the attack classes are the kinds of bad text."""
    kind = F.when(F.col("quality") == 1, F.lit("BENIGN")).when(F.col("toxic") == 1, F.lit("Bot")).otherwise(F.lit("PortScan"))
    # The fits below read the rows many times; the text is scanned once.
    return write_through(labelled_docs(spark, d), "docs").withColumn("label", kind).withColumn("binary", F.when(F.col("quality") == 1, 0).otherwise(1))


@query("tree_importance")
def tree_importance(spark: SparkSession, d: str) -> DataFrame:
    w = selection.tree_importance(docs(spark, d), DOC_FEATURES, "binary", "doc_id", trees=10, depth=6)
    rows = [(f, round(v, 8)) for f, v in w.items()]
    return selection.top_features(spark.createDataFrame(rows, "feature string, importance double"))


@query("extra_tree_leaves", with_views(LABELLED_DOCS) + """
    select t.tree, count(*) as n_rows, sum(case when quality = 1 then 0 else 1 end)::bigint as n_attacks,
      true as leaves_large_enough, true as importances_whole
    from labelled_docs, (select unnest(range(10)) as tree) t group by t.tree""")
def extra_tree_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Every labelled row lands in one leaf of each tree, none below the least size; importances are shares."""
    rows, min_leaf = docs(spark, d), 5
    grown = fit_extra_trees(rows, DOC_FEATURES, "binary", trees=10, min_leaf=min_leaf)
    shares = extra_tree_importance(grown, len(DOC_FEATURES))
    whole = bool((shares >= 0).all() and abs(shares.sum() - 1) < 1e-9)
    leaves = leaf_counts(rows, grown, DOC_FEATURES, "binary").groupBy("tree", "leaf").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("class")).alias("bad"))
    return leaves.groupBy("tree").agg(
        F.sum("n").alias("n_rows"), F.sum("bad").alias("n_attacks"),
        (F.min("n") >= min_leaf).alias("leaves_large_enough"), F.lit(whole).alias("importances_whole"))


@query("selection_cascade")
def selection_cascade(spark: SparkSession, d: str) -> DataFrame:
    _, audit, _ = selection.select_features(docs(spark, d), DOC_FEATURES, "binary", "doc_id", trees=10, depth=6,
                                            variance_threshold=0.0)
    return audit


@query("binary_forest_importances")
def binary_forest_importances(spark: SparkSession, d: str) -> DataFrame:
    model = models.fit_forest(docs(spark, d), DOC_FEATURES, "binary", **SMALL)
    return spark.createDataFrame(models.importances(model, DOC_FEATURES), "feature string, importance double")


@query("trained_cascade_decisions")
def trained_cascade_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Train on flows, then score every flow: one decision per valid row."""
    rows = event_flows(spark, d).select("flow_id", *EVENT_FLOW_FEATURES, "label", "binary")
    features = ["n_events", "duration_s", "value_sum", "value_mean", "n_types"]
    prepared = training.prepare(rows, features, "flow_id")
    cascade = training.train_cascade(prepared, "flow_id", use_oversampling=False, **SMALL)
    out = cascade.transform(rows, ["flow_id"])
    return out.select(
        "flow_id", "action", "prediction", "attack_type", F.round("confidence", 6).alias("confidence"),
        "trust.trust_score", "trust.risk_level", F.round("margin", 6).alias("margin"),
    )


@query("full_training_run")
def full_training_run(spark: SparkSession, d: str) -> DataFrame:
    """All stages on the labelled texts, oversampling included; the test metrics."""
    out = training.run(spark, docs(spark, d), DOC_FEATURES, "doc_id", selection={"variance_threshold": 0.0},
                       split_path=work_folder(spark, "run-splits"), trees=5, **SMALL)
    return out["metrics"]


@query("calibrated_scores")
def calibrated_scores(spark: SparkSession, d: str) -> DataFrame:
    prepared = training.prepare(docs(spark, d), DOC_FEATURES, "doc_id")
    cascade = training.train_cascade(prepared, "doc_id", use_oversampling=False, **SMALL)
    scores = models.score_binary(cascade.binary, prepared.rows, DOC_FEATURES, ["doc_id", "binary"])
    return cascade.calibrator.transform(scores, "p_raw", "p_calibrated")


@query("attack_class_forest")
def attack_class_forest(spark: SparkSession, d: str) -> DataFrame:
    rows = vec_rows(spark, d).where("`binary` = 1").withColumn("label", F.concat(F.lit("class-"), F.col("label")))
    model, names = models.fit_attack_classes(rows, VEC_FEATURES, "label", **SMALL)
    out = model.transform(models.assemble(rows, VEC_FEATURES, ["vec_id", "label"]))
    named = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("class_index").cast("int") + 1)
    return out.select("vec_id", "label", named.alias("predicted"))


@query("pca_variance")
def pca_variance(spark: SparkSession, d: str) -> DataFrame:
    from flowguard.operators.scale import fit_scaler

    rows = vec_rows(spark, d)
    vec = models.assemble(fit_scaler(rows, VEC_FEATURES).transform(rows), VEC_FEATURES, ["vec_id"])
    model = models.fit_pca(vec, "_x", 64)
    k = models.components_for(model, 0.95)
    cells = [(i + 1, float(v), i < k) for i, v in enumerate(model.explainedVariance.toArray())]
    return spark.createDataFrame(cells, "component int, explained double, kept boolean")


def compared_chains(spark: SparkSession, d: str):
    """Three fitted chains and the test rows they are compared on."""
    from flowguard.operators.split import stratified_split

    parts = write_through(stratified_split(docs(spark, d), ["label"], ["doc_id"], test=0.2, val=0.0), "compared-split")
    train, test = parts.where("split = 'train'"), parts.where("split = 'test'")
    chains = {
        "decision_tree": models.fit_chain(train, DOC_FEATURES, "binary", models.tree_classifier(6), 3, 2),
        "naive_bayes": models.fit_chain(train, DOC_FEATURES, "binary", models.bayes_classifier(), 3, 2),
        "decision_tree_95": models.fit_chain(train, DOC_FEATURES, "binary", models.tree_classifier(6), 4, 0.95),
    }
    return chains, test


@query("model_comparison")
def model_comparison(spark: SparkSession, d: str) -> DataFrame:
    return models.compare(*compared_chains(spark, d), "binary")


@query("model_comparison_reports")
def model_comparison_reports(spark: SparkSession, d: str) -> DataFrame:
    reports = models.compare_reports(*compared_chains(spark, d), "binary")
    return reports.withColumn("called", F.to_json(F.col("called").cast("map<string,bigint>")))


@query("cascade_reload_parity", with_views(LABELLED_DOCS) + """select count(*) as n_rows, 0::bigint as n_different,
  0::bigint as n_rejected from labelled_docs""")
def cascade_reload_parity(spark: SparkSession, d: str) -> DataFrame:
    """A saved and reloaded cascade takes the same decision on every row, all fields of it."""
    rows = docs(spark, d)
    prepared = training.prepare(rows, DOC_FEATURES, "doc_id")
    cascade = training.train_cascade(prepared, "doc_id", use_oversampling=False, **SMALL)
    path = work_folder(spark, "cascade")
    cascade.save(path)
    again = Cascade.load(path)
    whole = lambda c, name: c.transform(rows, ["doc_id"]).select("doc_id", F.to_json(F.struct("*")).alias(name))
    both = whole(cascade, "a").join(whole(again, "b"), "doc_id")
    return both.agg(F.count("*").alias("n_rows"), F.count_if(F.col("a") != F.col("b")).alias("n_different")).withColumn(
        "n_rejected", F.lit(again.rejected(rows, ["doc_id"]).count()))


@query("reload_parity", with_views(LABELLED_DOCS) + "select count(*) as n_rows, 0::bigint as n_different from labelled_docs")
def reload_parity(spark: SparkSession, d: str) -> DataFrame:
    """A saved and reloaded forest gives the same probabilities."""
    rows = docs(spark, d)
    model = models.fit_forest(rows, DOC_FEATURES, "binary", **SMALL)
    path = work_folder(spark, "forest")
    model.save(path)
    again = RandomForestClassificationModel.load(path)
    vec = models.assemble(rows, DOC_FEATURES, ["doc_id"])
    a = model.transform(vec).select("doc_id", vector_to_array("probability")[1].alias("p"))
    b = again.transform(vec).select("doc_id", vector_to_array("probability")[1].alias("q"))
    gap = F.abs(F.col("p") - F.col("q")) > 1e-5 * F.abs("q")
    return a.join(b, "doc_id").agg(F.count("*").alias("n_rows"), F.count_if(gap).alias("n_different"))
