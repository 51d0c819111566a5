"""Fitted parts: loose quality bounds, monotone calibration, order and reload invariance."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowguard.operators import models
from flowguard.operators.calibrate import fit_isotonic
from flowguard.operators.scale import Scaler, fit_scaler
from flowguard.operators.selection import correlation_table, k_best, select_features
from flowguard.plans import training
from flowguard.plans.model_queries import compared_chains, docs
from flowguard.sources.tables import DOC_FEATURES, VEC_FEATURES, vec_rows


@pytest.fixture(scope="module")
def run(spark, folder):
    df = docs(spark, folder)
    return df, training.run(spark, df, DOC_FEATURES, "doc_id", stages=("split", "train", "evaluate"), num_trees=5, depth=5)


def test_run_separates_the_learnable_label(run):
    m = {(r.run, r.metric): r.value for r in run[1]["metrics"].collect()}
    assert m["binary", "roc_auc"] > 0.8


def test_cascade_gives_one_decision_per_valid_row(run, spark):
    df, out = run
    cascade = out["cascade"]
    dirty = df.withColumn("n_chars", F.when(F.col("doc_id") % 10 == 0, float("nan")).otherwise(F.col("n_chars")))
    good, bad = cascade.transform(dirty, ["doc_id"]), cascade.rejected(dirty, ["doc_id"])
    assert good.count() + bad.count() == df.count()
    assert {r.reject_feature for r in bad.collect()} == {"n_chars"}
    rows = good.collect()
    assert all(0.0 <= r.confidence <= 1.0 for r in rows)
    assert all((r.attack_type is None) == (r.prediction == "Normal") for r in rows)
    assert all(r.margin == 0.0 for r in rows if r.prediction == "Normal")


def test_class_forest_runs_on_called_attacks_only(run):
    """Its function stands inside the conditional, and the rows are read once."""
    df, out = run
    plan = out["cascade"].transform(df, ["doc_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
    # Class scores, their shares and the array of them: all three functions inside the conditional.
    assert re.search(r"CASE WHEN \(_binary_pred#\d+ = 1\) THEN UDF\(UDF\(UDF\(_x#\d+\)\)\) END AS _proba", plan)
    rows = out["cascade"].transform(df, ["doc_id"]).collect()
    assert {r.attack_proba is None for r in rows if r.binary_pred == 0} <= {True}
    called = [r for r in rows if r.binary_pred == 1]
    assert called and all(max(r.attack_proba.values()) == r.attack_proba[r.attack_type] for r in called)


def test_stored_cascade_and_evaluation_from_disk(spark, folder, tmp_path):
    df = docs(spark, folder)
    paths = dict(split_path=str(tmp_path / "splits"), cascade_path=str(tmp_path / "cascade"))
    first = training.run(spark, df, DOC_FEATURES, "doc_id", stages=("split", "train", "evaluate"), num_trees=5, depth=5, **paths)
    other = spark.newSession()
    again = training.run(other, other.createDataFrame([], df.schema), DOC_FEATURES, "doc_id", stages=("evaluate",), **paths)
    table = lambda m: sorted(tuple(r) for r in m.collect())
    assert table(first["metrics"]) == table(again["metrics"])
    loaded = again["cascade"]
    assert (loaded.classes, loaded.threshold, loaded.scaler) == (first["cascade"].classes, 0.5, first["cascade"].scaler)
    got = {(r.run, r.split, r["class"], r.metric) for r in again["metrics"].collect()}
    for split in ("val", "test"):
        assert {("binary", split, "all", m) for m in ("precision_weighted", "recall_weighted", "roc_auc", "average_precision")} <= got
        assert {("multiclass", split, "all", m) for m in ("unseen_rows_excluded", "eval_rows", "roc_auc_macro", "f1_macro")} <= got
        assert {("binary", split, "1", m) for m in ("precision", "recall", "f1", "support", "predicted:0")} <= got


def test_kept_columns_may_be_features(run):
    df, out = run
    got = out["cascade"].transform(df, ["doc_id", "n_chars"]).select("doc_id", "n_chars")
    assert got.exceptAll(df.select("doc_id", "n_chars")).isEmpty()


def test_column_order_does_not_matter(run):
    df, out = run
    a = out["cascade"].transform(df, ["doc_id"]).select("doc_id", "action", "confidence")
    b = out["cascade"].transform(df.select(*reversed(df.columns)), ["doc_id"]).select("doc_id", "action", "confidence")
    assert a.exceptAll(b).isEmpty()


def test_missing_feature_is_an_error(run):
    df, out = run
    with pytest.raises(ValueError, match="absent"):
        out["cascade"].transform(df.drop("n_chars"), ["doc_id"])


def test_unknown_stage_and_nothing_to_evaluate(run, spark):
    df, _ = run
    with pytest.raises(ValueError):
        training.run(spark, df, DOC_FEATURES, "doc_id", stages=("deploy",))
    with pytest.raises(ValueError, match="nothing to evaluate"):
        training.run(spark, df, DOC_FEATURES, "doc_id", stages=("split", "evaluate"))


def test_calibration_is_monotone_and_clipped(spark):
    df = spark.range(500).select((F.col("id") / 500).alias("p"), (F.pmod(F.col("id") * 7919, F.lit(500)) < F.col("id")).cast("int").alias("y"))
    model = fit_isotonic(df, "p", "y", digits=3)
    probe = spark.createDataFrame([(x / 10,) for x in range(-2, 13)], "p double")
    got = [r.q for r in model.transform(probe, "p", "q").orderBy("p").collect()]
    assert got == sorted(got) and 0.0 <= got[0] and got[-1] <= 1.0


def test_scaler_round_trip(spark, folder):
    s = fit_scaler(vec_rows(spark, folder), VEC_FEATURES[:3])
    assert Scaler.from_frame(s.to_frame(spark)) == s


def test_correlations_against_plain_pearson(spark):
    nan = float("nan")
    rows = [(float(i), float((i * 7) % 5), None if i % 4 == 0 else float(i * i), nan if i == 3 else 2.0 - i, 1.0) for i in range(30)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    got = {(r.i, r.j): r.r for r in correlation_table(df, list("abcde")).collect()}
    whole = np.array([row for row in rows if all(v is not None and v == v for v in row)]).T
    assert len(got) == 10
    for (i, j), r in got.items():
        x, y = whole[i], whole[j]
        want = None if x.std() == 0 or y.std() == 0 else abs(float(np.corrcoef(x, y)[0, 1]))
        assert r is None if want is None else r == pytest.approx(want, abs=1e-9), (i, j)


def test_k_best_ties_and_undefined_scores(spark):
    df = spark.createDataFrame([(0, "a", 2.0), (1, "b", 2.0), (2, "c", float("nan")), (3, "d", 1.0)], "position int, feature string, f_score double")
    assert [r.feature for r in k_best(df, 3).orderBy("rank").collect()] == ["b", "a", "d"]


def test_caller_before_config_before_default(spark, folder):
    from flowguard.operators.selection import resolve

    p = resolve({"kbest_k": 7, "tree_top_n": 9}, kbest_k=3)
    assert (p["kbest_k"], p["tree_top_n"], p["variance_threshold"]) == (3, 9, 0.01)
    names, audit, _ = select_features(vec_rows(spark, folder), VEC_FEATURES[:5], "binary", "vec_id", with_trees=False,
                                      variance_threshold=0.0, kbest_k=2)
    assert len(names) == 2 and audit.count() == 3


def test_components_for_share():
    class Fake:
        class explainedVariance:
            @staticmethod
            def toArray():
                return [0.6, 0.3, 0.1]

            def __len__(self):
                return 3

    assert models.components_for(Fake, 0.9) == 2 and models.components_for(Fake, 0.5) == 1


def test_split_evaluation_takes_known_attacks_and_gives_all_fields(spark):
    from flowguard.plans.evaluation import evaluate_split

    rows = [  # y, pred, p, class, predicted class, probability of A
        (1, 1, 0.9, "A", "A", 0.8), (1, 1, 0.8, "A", "B", 0.4), (1, 0, 0.3, "B", "B", 0.1), (1, 1, 0.7, "New", "A", 0.9),
        (1, 1, 0.6, None, "A", 0.6), (0, 0, 0.2, "A", "B", 0.2), (0, 1, 0.6, "B", "A", 0.9)]
    df = spark.createDataFrame([(*r[:5], {"A": r[5], "B": 1 - r[5]}) for r in rows],
                               "y int, pred int, p double, class_true string, class_pred string, proba map<string,double>")
    got = {(r["run"], r["class"], r.metric): r.value for r in evaluate_split(df, "test", spark.createDataFrame([("A",), ("B",)], "class string")).collect()}
    multi = lambda c, m: got["multiclass", c, m]
    assert (multi("all", "eval_rows"), multi("all", "unseen_rows_excluded"), multi("all", "num_classes")) == (3, 2, 2)
    assert multi("all", "accuracy") == 0.666667 and multi("all", "roc_auc_macro") == multi("all", "roc_auc_weighted") == 1.0
    assert [multi(c, f"predicted:{d}") for c in "AB" for d in "AB"] == [1, 1, 0, 1]
    assert [multi("A", m) for m in ("precision", "recall", "f1", "support")] == [1.0, 0.5, 0.666667, 2]
    binary = lambda c, m: got["binary", c, m]
    assert [binary(c, f"predicted:{d}") for c in "01" for d in "01"] == [1, 1, 1, 4]
    assert binary("all", "precision_weighted") == pytest.approx((2 * 0.5 + 5 * 0.8) / 7, abs=1e-6)
    assert binary("all", "recall_weighted") == binary("all", "accuracy") == pytest.approx(5 / 7, abs=1e-6)
    assert [binary("1", m) for m in ("precision", "recall", "support")] == [0.8, 0.8, 5]


def test_report_and_matrix_per_model(spark, folder):
    chains, test = compared_chains(spark, folder)
    got = {(r.model, r["class"]): r for r in models.compare_reports(chains, test, "binary").collect()}
    for name, chain in chains.items():
        pairs = [(int(r.binary), int(r.prediction)) for r in chain.transform(test, ["binary"]).collect()]
        for c in {x for p in pairs for x in p}:
            row, true, called = got[name, c], [p for t, p in pairs if t == c], [t for t, p in pairs if p == c]
            hits = true.count(c)
            assert row.support == len(true) and row.called == {float(x): true.count(x) for x in set(true)}
            assert abs(row.recall - (hits / len(true) if true else 0)) < 1e-9
            assert abs(row.precision - (hits / len(called) if called else 0)) < 1e-9
    assert {m for m, _ in got} == set(chains)
