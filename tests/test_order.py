"""Order statistics: the distributed paths agree with plain computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowguard.functions.numbers import scatter
from flowguard.operators import metrics as M
from flowguard.operators import split
from flowguard.operators.ordered import first_in_order, order_quantiles, range_bounds, running_totals


@pytest.fixture(scope="module")
def rows(spark):
    # One group holds most rows and most of those are copies of one value.
    g = F.when(F.col("id") % 3 == 0, F.lit("b")).otherwise(F.lit("a"))
    v = F.when(F.col("id") % 2 == 0, F.lit(7.0)).otherwise(F.pmod(F.col("id") * 37, F.lit(1009)) / 8)
    return spark.range(3000).select("id", g.alias("g"), v.cast("double").alias("v"))


@pytest.mark.parametrize("rule", ["inclusive", "exclusive"])
def test_narrowed_quantiles_equal_the_sorted_ones(rows, rule):
    probs = [0.0, 0.05, 0.5, 0.95, 1.0] if rule == "inclusive" else [0.05, 0.5, 0.95]
    got = {(r.g, r.p): r.value for r in order_quantiles(rows, ["v"], probs, ["g"], rule, one_task_rows=100).collect()}
    pdf = rows.toPandas()
    for g, part in pdf.groupby("g"):
        for p in probs:
            want = np.quantile(part["v"], p, method="linear" if rule == "inclusive" else "weibull")
            assert got[g, p] == pytest.approx(want, abs=1e-9)


def test_ranged_totals_equal_plain_totals(rows):
    counted = rows.groupBy("v").agg(F.count("*").alias("n"))
    bounds = range_bounds(rows, "v", 200)
    assert len(bounds) > 3
    for down in (False, True):
        plain = {r.v: r.cum_n for r in running_totals(counted, "v", ["n"], descending=down).collect()}
        ranged = {r.v: r.cum_n for r in running_totals(counted, "v", ["n"], descending=down, bounds=bounds).collect()}
        assert plain == ranged


def test_rank_metrics_do_not_depend_on_ranges(rows):
    df = rows.withColumn("y", (F.col("id") % 5 == 0).cast("int"))
    a = M.rank_metrics(M.score_table(df, "v", "y", bounds=[])).first()
    b = M.rank_metrics(M.score_table(df, "v", "y", bounds=[1.0, 7.0, 30.0, 90.0])).first()
    assert a == b


def test_auc_of_one_class_is_null(rows):
    r = M.rank_metrics(M.score_table(rows.withColumn("y", F.lit(0)), "v", "y")).first()
    assert r.roc_auc is None


def test_take_n_is_exact_for_any_bucket_width(rows):
    for bits in (1, 4, 16):
        got = first_in_order(rows, ["g"], scatter("id", 5), ["id"], 321, bits)
        counts = {r.g: r["count"] for r in got.groupBy("g").count().collect()}
        assert counts == {"a": 321, "b": 321}
    h = lambda i: ((i % 2147483648) * 2654435761 + 5) % 4294967296
    want = sorted([i for i in range(3000) if i % 3 == 0], key=lambda i: (h(i), i))[:321]
    assert sorted(r.id for r in got.where("g = 'b'").collect()) == sorted(want)


def test_take_more_than_there_are_and_none(rows):
    assert first_in_order(rows, [], scatter("id"), ["id"], 10**6).count() == 3000
    assert first_in_order(rows, [], scatter("id"), ["id"], 0).count() == 0


def test_ids_beyond_32_bits(spark):
    big = spark.range(0, 100).select((F.col("id") * 10**15).alias("id"))
    assert first_in_order(big, [], scatter("id"), ["id"], 10).count() == 10


def test_split_is_exact_disjoint_and_repeatable(rows):
    a = split.stratified_split(rows, ["g"], ["id"], bits=3)
    n = {(r.g, r.split): r["count"] for r in a.groupBy("g", "split").count().collect()}
    assert n["a", "test"] == n["a", "val"] == 300 and n["b", "test"] == n["b", "val"] == 150
    assert sum(n.values()) == 3000
    b = split.stratified_split(rows.repartition(7), ["g"], ["id"])
    assert a.exceptAll(b).isEmpty()


def test_rows_without_a_stratum_stay(rows):
    holed = rows.withColumn("g", F.when(F.col("id") < 10, None).otherwise(F.col("g")))
    out = split.stratified_split(holed, ["g"], ["id"])
    assert out.count() == 3000 and out.where("g is null and split <> 'train'").isEmpty()


def test_balanced_sample_caps_only_large_tables(rows):
    assert split.balanced_sample(rows, "g", "id", per_class=50, when_above=5000).count() == 3000
    assert split.balanced_sample(rows, "g", "id", per_class=50, when_above=1000).count() == 100


def test_size_never_changes_rules(spark):
    """Null, NaN, constant and all-null input under small and under large limits."""
    from flowguard.operators import ordered, selection
    from flowguard.operators.neighbours import nearest_neighbours
    from flowguard.operators.split import balanced_sample

    rows = [(i, float(i % 7), 3.0, None, None if i % 6 == 0 else "A") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, x double, c double, e double, g string")
    for by in ([], ["g"]):
        got = [{tuple(r) for r in ordered.order_quantiles(df, ["x", "e"], [0.5], by, one_task_rows=n).collect()} for n in (1000, 5)]
        assert got[0] == got[1] and any(r[-1] is None for r in got[0])
    assert {r.g for r in balanced_sample(df, "g", "id", 50, 50).collect()} == {None, "A"}
    assert balanced_sample(df, "g", "id", 50, 50).count() == 60
    small, large = ({tuple(r) for r in nearest_neighbours(df, "id", ["x"], 1, "g", n).select("id").collect()} for n in (2000, 20))
    assert small == large == {(i,) for i in range(60)}
    wide = [f"w{i}" for i in range(11)]
    more = df.select("x", "c", *[(df.x * (i + 1) + (df.id % (i + 2))).alias(w) for i, w in enumerate(wide)])
    for cols in (["x", "c"], ["x", "c", *wide]):
        r = {(t["first"], t["second"]): t.r for t in selection.correlation_table(more, cols).collect()}
        assert r["x", "c"] is None and all(v is None or 0 <= v <= 1.0000001 for v in r.values())
    scored = df.select("id", ordered.F.when(df.id == 5, float("nan")).otherwise(df.x).alias("s")).groupBy("s").count()
    flat = {tuple(r) for r in ordered.running_totals(scored, "s", ["count"]).collect()}
    cut = {tuple(r) for r in ordered.running_totals(scored, "s", ["count"], bounds=[2.0, 4.0]).select("s", "count", "cum_count").collect()}
    assert {x[1:] for x in flat} == {x[1:] for x in cut}


def test_quantiles_among_nan_infinities_and_empty_groups(spark):
    from flowguard.operators import ordered

    nan, inf = float("nan"), float("inf")
    rows = [(g, v, w) for g, vs in (("nan", [nan] * 8 + [1.0, -inf]), ("none", [None] * 3), ("one", [4.0]), (None, [inf, -0.0, 0.0, -inf, 2.0] * 3))
            for v, w in zip(vs, [1e300, -1e-300] * 20)]
    df = spark.createDataFrame(rows, "g string, v double, w double")
    text = lambda q: {tuple(str(x) for x in r) for r in q.collect()}
    for by in ([], ["g"]):
        some = [text(ordered.order_quantiles(df, ["v", "w"], [0.0, 0.25, 0.5, 1.0], by, one_task_rows=n)) for n in (1000, 2)]
        assert some[0] == some[1] and len(some[0]) == (8 if not by else 32)
    assert ordered.order_quantiles(df.limit(0), ["v"], [0.5], ["g"], one_task_rows=-1).collect() == []
    assert [r.value for r in ordered.order_quantiles(df.limit(0), ["v"], [0.5], one_task_rows=-1).collect()] == [None]


def test_row_sample_is_exact_where_ids_repeat(spark):
    rows = [(i % 5 if i % 7 else None, i % 3, "x") for i in range(60)] + [(1, 1, "same")] * 20
    df = spark.createDataFrame(rows, "id long, v int, _h string")
    for n in (1, 11, 37, 79, 80, 200):
        got = split.row_sample(df, "id", n)
        assert got.count() == min(n, 80) and got.exceptAll(df).isEmpty()
        assert got.exceptAll(split.row_sample(df.repartition(5), "id", n)).isEmpty()
    assert split.row_sample(df, "id", 0).count() == split.row_sample(df.limit(0), "id", 5).count() == 0
