"""Sources, sinks and contracts: the error cases and round trips."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowguard.operators import clean
from flowguard.session import sized_side, work_folder
from flowguard.sources import files, payloads

NAN, INF = float("nan"), float("inf")


def schema():
    return T.StructType([T.StructField("a", T.DoubleType()), T.StructField("Label", T.StringType())])


def test_missing_day_file_is_an_error(spark, tmp_path):
    with pytest.raises(AnalysisException):
        files.read_day_files(spark, [str(tmp_path / "absent.csv")], schema())


def test_headers_are_trimmed(spark, tmp_path):
    (tmp_path / "d.csv").write_text(" a , Label\n1.5,BENIGN\n")
    df = files.read_day_files(spark, [str(tmp_path / "d.csv")])
    assert df.columns == ["a", "Label"] and df.first().a == 1.5


def test_empty_upload_is_an_error(spark, tmp_path):
    (tmp_path / "e.csv").write_text("a,Label\n")
    with pytest.raises(ValueError):
        files.read_batch_csv(spark, str(tmp_path / "e.csv"), schema(), ["a"])


def test_split_name_is_checked(spark, tmp_path):
    with pytest.raises(ValueError):
        files.load_split(spark, str(tmp_path), "holdout")


def test_clean_table(spark):
    raw = spark.createDataFrame(
        [(1.0, "BENIGN"), (1.0, "BENIGN"), (INF, "DDoS"), (NAN, "Bot"), (3.0, "DDoS"), (None, "Bot")], "`  a` double, ` Label` string")
    rows = files.build_clean_table(raw).orderBy("label", "a").collect()
    assert [(r.a, r.label, r.binary) for r in rows] == [
        (1.0, "BENIGN", 0), (2.0, "Bot", 1), (2.0, "Bot", 1), (2.0, "DDoS", 1), (3.0, "DDoS", 1)]


def test_label_columns_are_required(spark):
    assert clean.normalise_labels(spark.createDataFrame([("x", 1)], "Label string, Binary int")).columns == ["label", "binary"]
    with pytest.raises(ValueError, match="binary"):
        clean.normalise_labels(spark.createDataFrame([("x",)], "label string"))


def test_projection_enforces_order_and_names_the_absent(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "c double, a double, b double")
    assert clean.project(df, ["a", "b"]).columns == ["a", "b"]
    with pytest.raises(ValueError, match="2 required columns absent"):
        clean.project(df, ["a", "z", "y"])


def test_invalid_rows_are_rejected_with_a_reason(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, NAN, 1.0), (3, 1.0, INF), (4, None, None)], "id int, a double, b double")
    good, bad = clean.split_valid(df, ["a", "b"])
    assert [r.id for r in good.collect()] == [1]
    assert {r.id: r.reject_feature for r in bad.collect()} == {2: "a", 3: "b", 4: "a"}


def test_payload_shapes(spark):
    texts = ['{"features": {"a": 1, "b": "2.5"}}', '{"a": 3}', '{"features": {}}', '{}', '{"a": "x"}', '[{"a": 1}]', '{"a"', "7"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: (r.features, r.reject_reason) for r in payloads.parse_flows(df, "t").collect()}
    assert got[0] == ({"a": 1.0, "b": 2.5}, None) and got[1] == ({"a": 3.0}, None)
    assert [got[i][1] for i in range(2, 8)] == [
        "empty features", "empty features", "invalid value", "invalid json", "invalid json", "invalid json"]


def test_batch_explode(spark):
    df = spark.createDataFrame([(0, '[{"a": 1}, {"a": 2}]'), (1, "[]")], "i int, t string")
    rows = payloads.explode_batch(df, "t", ["i"]).collect()
    assert [(r.i, r.position, r.features["a"]) for r in rows] == [(0, 0, 1.0), (0, 1, 2.0)]


def test_batches_lose_no_flow_without_a_reason(spark):
    texts = ['{"flows": [{"a": 1}, {"a": "2.5"}]}', '[{"a": 1}, {"a": "x"}, {"a": 3}]', '[{"a": 1}, {"a"', '{"flows": []}', "[]", '[{}, 7, null, "t"]',
             '{"flows": {"a": 1}}', '{"a": 1}', '{"flows"', None, '  [{"a": 4}]', '[{"a": null}]', '{"flows": [{"a": 1}, {"a": [1]}]}', "", '{"flows": null}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {}
    for r in payloads.explode_batch(df, "t", ["i"]).collect():
        got.setdefault(r.i, []).append((r.position, r.features and r.features["a"], r.reject_reason))
    bad = [(None, None, "invalid json")]
    none = [(None, None, "no flows")]
    assert {i: sorted(x, key=str) for i, x in got.items()} == {
        0: [(0, 1.0, None), (1, 2.5, None)],
        1: [(0, 1.0, None), (1, None, "invalid value"), (2, 3.0, None)],
        2: bad, 5: [(0, None, "empty features"), *((p, None, "invalid json") for p in (1, 2, 3))],
        6: none, 7: none, 8: bad, 9: bad, 10: [(0, 4.0, None)], 11: [(0, None, "invalid value")],
        12: [(0, 1.0, None), (1, None, "invalid value")], 13: bad, 14: none}


def test_scenario_documents_skip_what_is_unusable(spark, tmp_path):
    good = '{"label":"DDoS","validated":true,"source_index":1,"features":{"a":1.0,"b":2.0}}'
    (tmp_path / "a.json").write_text(good)
    (tmp_path / "b.json").write_text(good.replace("true", "false"))
    (tmp_path / "c.json").write_text(good.replace(',"b":2.0', ""))
    (tmp_path / "d.json").write_text("{broken")
    usable, skipped = files.read_scenarios(spark, f"{tmp_path}/*.json", ["a", "b"])
    assert usable.count() == 1 and skipped.count() == 3


def test_sized_side_broadcasts_only_what_is_small(spark):
    big = spark.range(1000)
    small = sized_side(spark.range(10), 10)
    assert "Broadcast" in plan(big.join(small, "id"))
    assert sized_side(big, 10) is big


def test_work_folder_is_shared_on_a_cluster(spark):
    assert work_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_median_fit_on_other_rows(spark):
    df = spark.createDataFrame([(1, None), (2, 4.0)], "id int, a double")
    train = spark.createDataFrame([(10.0,), (20.0,)], "a double")
    assert [r.a for r in clean.repair(df, ["a"], fit_on=train).orderBy("id").collect()] == [15.0, 4.0]
    assert df.where(F.col("a").isNull()).count() == 1


def test_day_pools(spark):
    from flowguard.constants import TEST_DAY_FILES, TRAIN_DAY_FILES

    df = spark.createDataFrame([(f,) for f in [*TRAIN_DAY_FILES, *TEST_DAY_FILES, "other.csv"]], "source_file string")
    got = {r.split: r["count"] for r in files.day_pools(df).groupBy("split").count().collect()}
    assert got == {"train": 3, "test": 2}
