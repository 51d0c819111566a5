"""Shape of the physical plans: pruning, pushdown, no all-pairs joins, limits before shuffles."""

import pytest
from pyspark.sql import functions as F

from flowguard.operators import clean, metrics, scenario, split
from flowguard.plans import catalogue
from flowguard.plans.decision_queries import event_scores
from flowguard.sources.tables import event_flows, scored, vec_rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["served_actions", "policy_lookup", "confusion_counts", "one_vs_rest_metrics",
                                  "flow_decision_table", "stratified_split", "class_report", "matched_scenarios"])
def test_no_pair_joins(spark, folder, name):
    text = plan(catalogue.QUERIES[name](spark, folder))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_expressions_need_no_python_and_no_shuffle(spark, folder):
    text = plan(event_scores(spark, folder))
    assert "Exchange" not in text and "Python" not in text


def test_scan_reads_only_what_is_used(spark, folder):
    text = plan(metrics.confusion(scored(spark, folder), "y", "pred"))
    assert "ReadSchema: struct<event_type:string,value:double>" in text


def test_filters_reach_the_scan(spark, folder):
    df = spark.read.parquet(f"{folder}/events.parquet")
    assert "PushedFilters: [In(event_type" in plan(clean.only_labels(df, "event_type", ["error", "view"]))


def test_group_limit_runs_before_the_shuffle(spark, folder):
    text = plan(split.one_per_group(event_flows(spark, folder), "label", [F.col("flow_id")]))
    assert text.count("WindowGroupLimit") == 2
    near = plan(scenario.representative_rows(vec_rows(spark, folder), "label", "vec_id", ["f0", "f1"]))
    assert near.count("WindowGroupLimit") == 2


def test_split_does_not_shuffle_rows(spark, folder):
    text = plan(split.stratified_split(scored(spark, folder).select("flow_id", "y"), ["y"], ["flow_id"]))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def test_split_table_is_partition_pruned(spark, folder, tmp_path):
    from flowguard.sources.files import load_split, write_splits

    write_splits(split.hashed_split(scored(spark, folder).select("flow_id", "y"), "flow_id"), str(tmp_path / "s"))
    assert "PartitionFilters: [isnotnull(split" in plan(load_split(spark, str(tmp_path / "s"), "val"))
