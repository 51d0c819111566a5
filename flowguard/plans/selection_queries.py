"""Queries for selection statistics, scaling and closed-form Bayes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.operators import selection
from flowguard.operators.bayes import fit_gaussian_bayes
from flowguard.operators.scale import fit_scaler
from flowguard.plans.fixture_sql import FLOW_ROWS, VEC_ROWS, scatter_sql, with_views
from flowguard.plans.registry import query
from flowguard.sources.tables import FLOW_ROW_FEATURES, FLOW_ROW_KEY, VEC_FEATURES, flow_rows, vec_rows

# A near-constant, a near-copy and the plain features.
WIDE = """wide as (select *, bytes * 2 + duration as bytes_copy, rate * 0.1 as tiny from flow_rows)"""
WIDE_FEATURES = [*FLOW_ROW_FEATURES, "bytes_copy", "tiny"]


def wide_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = flow_rows(spark, d)
    return rows.withColumn("bytes_copy", F.col("bytes") * 2 + F.col("duration")).withColumn("tiny", F.col("rate") * 0.1)


@query("population_variance", with_views(FLOW_ROWS, WIDE) + " union all ".join(
    f"select {i} as position, '{c}' as feature, round(var_pop({c}) / p, 8) * p as variance from (select *, pow(10, floor(log10(greatest((select var_pop({c}) from wide), 1e-300)))) as p from wide) group by p" for i, c in enumerate(WIDE_FEATURES)))
def population_variance(spark: SparkSession, d: str) -> DataFrame:
    v = selection.variance_table(wide_rows(spark, d), WIDE_FEATURES)
    # Nine significant digits: what no order of partial sums changes.
    p = F.pow(F.lit(10.0), F.floor(F.log10(F.greatest("variance", F.lit(1e-300)))))
    return v.select("position", "feature", (F.round(F.col("variance") / p, 8) * p).alias("variance"))


@query("variance_selection", with_views(FLOW_ROWS, WIDE) + "select feature from (" + " union all ".join(
    f"select '{c}' as feature, var_pop({c}) as v from wide" for c in WIDE_FEATURES) + ") where v > 0.01")
def variance_selection(spark: SparkSession, d: str) -> DataFrame:
    return selection.variance_table(wide_rows(spark, d), WIDE_FEATURES).where("variance > 0.01").select("feature")


_PAIRS = [(i, j) for j in range(len(WIDE_FEATURES)) for i in range(j)]
_CORR = "pairs as (" + " union all ".join(
    f"select {i} as i, {j} as j, '{WIDE_FEATURES[i]}' as first, '{WIDE_FEATURES[j]}' as second, abs(corr({WIDE_FEATURES[i]}, {WIDE_FEATURES[j]})) as r from wide"
    for i, j in _PAIRS) + ")"


@query("correlation_pairs", with_views(FLOW_ROWS, WIDE, _CORR) + "select i, j, first, second, round(r, 6) as r from pairs")
def correlation_pairs(spark: SparkSession, d: str) -> DataFrame:
    return selection.correlation_table(wide_rows(spark, d), WIDE_FEATURES).withColumn("r", F.round("r", 6))


@query("correlation_matrix_wide", with_views(VEC_ROWS) + " union all ".join(
    f"select {i} as i, {j} as j, round(abs(corr(f{i}, f{j})), 6) as r from vec_rows" for j in range(64) for i in range(j)))
def correlation_matrix_wide(spark: SparkSession, d: str) -> DataFrame:
    c = selection.correlation_table(vec_rows(spark, d), VEC_FEATURES)
    return c.select("i", "j", F.round("r", 6).alias("r"))


@query("correlation_pruning", with_views(FLOW_ROWS, WIDE, _CORR) + "select distinct second as dropped from pairs where r >= 0.95")
def correlation_pruning(spark: SparkSession, d: str) -> DataFrame:
    c = selection.correlation_table(wide_rows(spark, d), WIDE_FEATURES)
    return selection.correlated_columns(c, 0.95).select(F.col("feature").alias("dropped"))


def _anova_sql(cols, view, label):
    parts = []
    for i, c in enumerate(cols):
        parts.append(
            f"select {i} as position, '{c}' as feature, (sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) as f "
            f"from (select count(*) as n, avg({c}) as m, var_pop({c}) as v, (select avg({c}) from {view}) as g from {view} group by {label})"
        )
    return "anova as (" + " union all ".join(parts) + ")"


@query("anova_scores", with_views(FLOW_ROWS, WIDE, _anova_sql(WIDE_FEATURES, "wide", '"binary"')) + "select position, feature, round(f, 6) as f_score from anova")
def anova_scores(spark: SparkSession, d: str) -> DataFrame:
    a = selection.anova_table(wide_rows(spark, d), WIDE_FEATURES, "binary")
    return a.select("position", "feature", F.round("f_score", 6).alias("f_score"))


@query("k_best_features", with_views(VEC_ROWS, _anova_sql(VEC_FEATURES, "vec_rows", '"binary"')) + """
select feature, rank::int as rank from (select feature, row_number() over (order by f desc, position desc) as rank from anova) where rank <= 20""")
def k_best_features(spark: SparkSession, d: str) -> DataFrame:
    a = selection.anova_table(vec_rows(spark, d), VEC_FEATURES, "binary")
    return selection.k_best(a, 20).select("feature", "rank")


_SEL = f"""anova_all as (select * from anova),
v as ({' union all '.join(f"select {i} as position, '{c}' as feature, var_pop({c}) as v from wide" for i, c in enumerate(WIDE_FEATURES))}),
step1 as (select position, feature from v where v > 0.01),
step2 as (select position, feature from step1 where feature not in (
  select second from pairs where r >= 0.95 and first in (select feature from step1) and second in (select feature from step1))),
step3 as (select feature, row_number() over (order by f desc, position desc) as rn from anova join step2 using (feature, position))"""


@query("selection_audit", with_views(FLOW_ROWS, WIDE, _CORR, _anova_sql(WIDE_FEATURES, "wide", '"binary"'), _SEL) + """
select 1 as step, 'variance' as name, 7 as n_in, (select count(*) from step1)::int as n_out, (7 - (select count(*) from step1))::int as dropped
union all select 2, 'correlation', (select count(*) from step1)::int, (select count(*) from step2)::int, ((select count(*) from step1) - (select count(*) from step2))::int
union all select 3, 'anova_f', (select count(*) from step2)::int, least(3, (select count(*) from step2))::int, greatest(0, (select count(*) from step2) - 3)::int""")
def selection_audit(spark: SparkSession, d: str) -> DataFrame:
    _, audit, _ = selection.select_features(
        wide_rows(spark, d), WIDE_FEATURES, "binary", "l_orderkey", kbest_k=3, with_trees=False)
    return audit


@query("top_features", with_views(VEC_ROWS, _anova_sql(VEC_FEATURES, "vec_rows", "label")) + "select feature, round(f, 6) as importance from anova order by f desc, feature limit 10")
def top_features(spark: SparkSession, d: str) -> DataFrame:
    a = selection.anova_table(vec_rows(spark, d), VEC_FEATURES, "label").withColumnRenamed("f_score", "importance")
    return selection.top_features(a, 10).select("feature", F.round("importance", 6).alias("importance"))


_VZ = ", ".join(f"round((f{i} - (select avg(f{i}) from vec_rows)) / (select stddev_pop(f{i}) from vec_rows), 6) as f{i}" for i in range(64))


@query("standardised_vectors", with_views(VEC_ROWS) + f"select vec_id, {_VZ} from vec_rows")
def standardised_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = vec_rows(spark, d)
    z = fit_scaler(rows, VEC_FEATURES).transform(rows)
    return z.select("vec_id", *[F.round(f, 6).alias(f) for f in VEC_FEATURES])


@query("scaler_parameters", with_views(FLOW_ROWS) + " union all ".join(
    f"select '{c}' as feature, {i} as position, round(avg({c}), 6) as mean, round(stddev_pop({c}), 6) as scale from flow_rows where label <> 'PortScan'"
    for i, c in enumerate(FLOW_ROW_FEATURES)) + " union all select 'constant', 5, 1.0, 1.0")
def scaler_parameters(spark: SparkSession, d: str) -> DataFrame:
    train = flow_rows(spark, d).where("label <> 'PortScan'").withColumn("constant", F.lit(1.0))
    s = fit_scaler(train, [*FLOW_ROW_FEATURES, "constant"]).to_frame(spark)
    return s.select("feature", "position", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"))


_NB = f"""nb as (select label, count(*) as n, {', '.join(f'avg({c}) as m_{c}, var_pop({c}) + (select 1e-9 * greatest({", ".join(f"var_pop({x})" for x in FLOW_ROW_FEATURES)}) from flow_rows) as v_{c}' for c in FLOW_ROW_FEATURES)} from flow_rows group by label),
ll as (select f.*, nb.label as cls, ln(n / (select count(*) from flow_rows)) - 0.5 * ({' + '.join(f'ln(2 * pi() * v_{c})' for c in FLOW_ROW_FEATURES)})
  - 0.5 * ({' + '.join(f'(f.{c} - m_{c}) * (f.{c} - m_{c}) / v_{c}' for c in FLOW_ROW_FEATURES)}) as l from flow_rows f cross join nb)"""


@query("gaussian_bayes", with_views(FLOW_ROWS, _NB) + f"""
select {', '.join(FLOW_ROW_KEY)}, arg_max(cls, l) as predicted, round(max(l), 4) as log_likelihood from ll group by {', '.join(FLOW_ROW_KEY)}""")
def gaussian_bayes(spark: SparkSession, d: str) -> DataFrame:
    rows = flow_rows(spark, d)
    out = fit_gaussian_bayes(rows, FLOW_ROW_FEATURES, "label").transform(rows)
    return out.select(*FLOW_ROW_KEY, "predicted", F.round("log_likelihood", 4).alias("log_likelihood"))
