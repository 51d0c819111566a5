"""Queries over predictions and scores: matrices, reports, curves, rank metrics, grades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.operators import metrics as M
from flowguard.operators import report
from flowguard.operators.calibrate import fit_isotonic
from flowguard.plans.fixture_sql import POLICY, PROBA_LONG, SCORED, with_views
from flowguard.plans.registry import query
from flowguard.sources.tables import ATTACK_NAMES, scored

CONF = """conf as (select class_true as actual, class_pred as predicted, count(*) as n from scored group by 1, 2)"""
CLASSES = """classes as (select unnest(['Bot', 'DDoS', 'Ghost', 'Heartbleed', 'Infiltration', 'PortScan']) as class)"""
REPORT = """sides as (
  select class, (select coalesce(sum(n), 0) from conf where actual = class) as support,
    (select coalesce(sum(n), 0) from conf where predicted = class) as predicted,
    (select coalesce(sum(n), 0) from conf where predicted = class and actual = class) as tp
  from classes),
report as (
  select class, case when predicted > 0 then tp / predicted else 0 end as precision,
    case when support > 0 then tp / support else 0 end as recall,
    case when predicted + support > 0 then 2 * tp / (predicted + support) else 0 end as f1, support, tp
  from sides)"""


def _conf(spark: SparkSession, d: str) -> DataFrame:
    return M.confusion(scored(spark, d), "class_true", "class_pred")


def _classes(spark: SparkSession) -> DataFrame:
    names = sorted([*ATTACK_NAMES, "Ghost"])  # one class nobody has seen
    return spark.createDataFrame([(c,) for c in names], "class string")


@query("confusion_counts", with_views(SCORED, CONF) + "select actual, predicted, n as n_rows from conf")
def confusion_counts(spark: SparkSession, d: str) -> DataFrame:
    return _conf(spark, d)


@query("confusion_dense", with_views(SCORED, CONF, CLASSES) + """
select a.class as actual, p.class as predicted, coalesce(n, 0)::bigint as n_rows
from classes a cross join classes p left join conf on actual = a.class and predicted = p.class""")
def confusion_dense(spark: SparkSession, d: str) -> DataFrame:
    return M.dense_confusion(_conf(spark, d), _classes(spark))


@query("confusion_matrix", with_views(SCORED, CONF) + "select actual, " + ", ".join(
    f"coalesce(sum(case when predicted = '{c}' then n end), 0)::bigint as \"{c}\"" for c in ATTACK_NAMES) + " from conf group by actual")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return M.confusion_matrix(_conf(spark, d), ATTACK_NAMES)


@query("binary_confusion", with_views(SCORED) + "select y as actual, pred as predicted, count(*) as n_rows from scored group by 1, 2")
def binary_confusion(spark: SparkSession, d: str) -> DataFrame:
    return M.confusion(scored(spark, d), "y", "pred")


@query("confusion_normalised", with_views(SCORED, CONF) + """
select actual, predicted, round(n / sum(n) over (partition by actual), 6) as share from conf""")
def confusion_normalised(spark: SparkSession, d: str) -> DataFrame:
    return M.normalised_confusion(_conf(spark, d))


@query("class_report", with_views(SCORED, CONF, CLASSES, REPORT) + """
select class, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support::bigint as support from report""")
def class_report(spark: SparkSession, d: str) -> DataFrame:
    r = M.class_report(_conf(spark, d), _classes(spark))
    return r.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("class_report_rollup", with_views(SCORED, CONF, CLASSES, REPORT) + """
select class, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support::bigint as support from report
union all select null, round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), sum(support)::bigint from report""")
def class_report_rollup(spark: SparkSession, d: str) -> DataFrame:
    return M.report_with_total(M.class_report(_conf(spark, d), _classes(spark)))


_SUMMARY = """summary as (
  select round(sum(tp) / sum(support), 6) as accuracy, round(sum(f1 * support) / sum(support), 6) as f1_weighted,
    round(avg(case when class <> 'Ghost' then f1 end), 6) as f1_macro,
    round(sum(precision * support) / sum(support), 6) as precision_weighted,
    round(sum(recall * support) / sum(support), 6) as recall_weighted, sum(support)::bigint as n_rows
  from report)"""


@query("summary_metrics", with_views(SCORED, CONF, CLASSES, REPORT, _SUMMARY) + "select * from summary")
def summary_metrics(spark: SparkSession, d: str) -> DataFrame:
    return M.summary_metrics(_conf(spark, d))


# --- rank metrics ---------------------------------------------------------------------

BY_SCORE = """by_score as (
  select p as score, sum(y) as pos, sum(1 - y) as neg from scored group by p),
cum as (
  select *, sum(pos) over (order by score desc) as cum_pos, sum(neg) over (order by score desc) as cum_neg,
    sum(pos) over () as tp, sum(neg) over () as tn from by_score)"""
RANK_COLS = """round(sum(neg * (cum_pos - pos / 2)) / (any_value(tp) * any_value(tn)), 6) as roc_auc,
  round(sum(pos * cum_pos / (cum_pos + cum_neg)) / any_value(tp), 6) as average_precision,
  sum(pos)::bigint as positives, sum(neg)::bigint as negatives"""


@query("binary_rank_metrics", with_views(SCORED, BY_SCORE) + f"select {RANK_COLS} from cum")
def binary_rank_metrics(spark: SparkSession, d: str) -> DataFrame:
    return M.rank_metrics(M.score_table(scored(spark, d), "p", "y"))


@query("roc_points", with_views(SCORED, BY_SCORE) + """
select score as threshold, round(cum_neg / tn, 6) as fpr, round(cum_pos / tp, 6) as tpr from cum""")
def roc_points(spark: SparkSession, d: str) -> DataFrame:
    return M.roc_points(M.score_table(scored(spark, d), "p", "y"))


@query("pr_points", with_views(SCORED, BY_SCORE) + """
select score as threshold, round(cum_pos / (cum_pos + cum_neg), 6) as precision, round(cum_pos / tp, 6) as recall from cum""")
def pr_points(spark: SparkSession, d: str) -> DataFrame:
    return M.pr_points(M.score_table(scored(spark, d), "p", "y"))


OVR = """ovr_scores as (
  select class, q as score, sum(case when class_true = class then 1 else 0 end) as pos,
    sum(case when class_true = class then 0 else 1 end) as neg
  from proba_long group by 1, 2),
ovr_cum as (
  select *, sum(pos) over (partition by class order by score desc) as cum_pos,
    sum(neg) over (partition by class order by score desc) as cum_neg,
    sum(pos) over (partition by class) as tp, sum(neg) over (partition by class) as tn from ovr_scores),
per_class as (select class, """ + RANK_COLS + " from ovr_cum group by class)"


def _per_class(spark: SparkSession, d: str) -> DataFrame:
    return M.per_class_rank_metrics(scored(spark, d), "class_true", "proba")


@query("one_vs_rest_metrics", with_views(SCORED, PROBA_LONG, OVR) + "select * from per_class")
def one_vs_rest_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _per_class(spark, d)


@query("one_vs_rest_means", with_views(SCORED, PROBA_LONG, OVR) + """
select round(avg(roc_auc), 6) as roc_auc_macro, round(sum(roc_auc * positives) / sum(positives), 6) as roc_auc_weighted from per_class""")
def one_vs_rest_means(spark: SparkSession, d: str) -> DataFrame:
    return M.rank_means(_per_class(spark, d), len(ATTACK_NAMES))


@query("weakest_classes", with_views(SCORED, PROBA_LONG, OVR) + """
select class, average_precision, roc_auc from per_class order by average_precision, roc_auc, class limit 3""")
def weakest_classes(spark: SparkSession, d: str) -> DataFrame:
    return M.weakest(_per_class(spark, d)).select("class", "average_precision", "roc_auc")


@query("low_precision_classes", with_views(SCORED, PROBA_LONG, OVR) + """
select count(*) as n_classes, string_agg(class, ', ' order by class) as classes from per_class where average_precision < 0.9""")
def low_precision_classes(spark: SparkSession, d: str) -> DataFrame:
    low = M.low_precision(_per_class(spark, d))
    return low.agg(
        F.count("*").alias("n_classes"), F.concat_ws(", ", F.array_sort(F.collect_list("class"))).alias("classes")
    )


@query("per_class_performance", with_views(SCORED, PROBA_LONG, OVR) + """
select row_number() over (order by roc_auc desc, class) as rank, class, roc_auc, average_precision from per_class""")
def per_class_performance(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    # One row per class: the order is made on the small per-class table.
    order = W.partitionBy(F.lit(0)).orderBy(F.col("roc_auc").desc(), "class")
    return _per_class(spark, d).select(
        F.row_number().over(order).cast("bigint").alias("rank"), "class", "roc_auc", "average_precision"
    )


BINARY_REPORT = """bconf as (select y as actual, pred as predicted, count(*) as n from scored group by 1, 2),
bsides as (select c as class, (select coalesce(sum(n), 0) from bconf where actual = c) as support,
    (select coalesce(sum(n), 0) from bconf where predicted = c) as predicted,
    (select coalesce(sum(n), 0) from bconf where predicted = c and actual = c) as tp from (values (0), (1)) t(c)),
bsummary as (select round(sum(tp) / sum(support), 6) as accuracy,
    round(sum(2 * tp / (predicted + support) * support) / sum(support), 6) as f1_weighted,
    round(avg(2 * tp / (predicted + support)), 6) as f1_macro from bsides)"""


@query("evaluation_summary", with_views(SCORED, CONF, CLASSES, REPORT, _SUMMARY, BY_SCORE, PROBA_LONG, OVR, BINARY_REPORT) + f"""
, b as (select {RANK_COLS} from cum)
select * from (
  select 'binary' as run, 'test' as split, 'all' as class, unnest(['accuracy', 'f1_weighted', 'f1_macro', 'roc_auc', 'average_precision']) as metric,
    unnest([accuracy, f1_weighted, f1_macro, roc_auc, average_precision]) as value from bsummary, b
  union all
  select 'multiclass', 'test', 'all', unnest(['accuracy', 'f1_weighted', 'f1_macro', 'precision_weighted', 'recall_weighted']),
    unnest([accuracy, f1_weighted, f1_macro, precision_weighted, recall_weighted]) from summary
  union all select 'multiclass', 'test', class, 'roc_auc', roc_auc from per_class
  union all select 'multiclass', 'test', class, 'average_precision', average_precision from per_class)""")
def evaluation_summary(spark: SparkSession, d: str) -> DataFrame:
    from flowguard.plans.evaluation import evaluate_scored

    return evaluate_scored(scored(spark, d), split="test")


@query("split_evaluation")
def split_evaluation(spark: SparkSession, d: str) -> DataFrame:
    from flowguard.plans.evaluation import evaluate_split

    return evaluate_split(scored(spark, d), "test", _classes(spark))


@query("model_report_card", with_views(SCORED, CONF, CLASSES, REPORT, _SUMMARY, PROBA_LONG, OVR, BINARY_REPORT) + """
, m as (select round(avg(roc_auc), 6) as auc from per_class)
select round(0.4 * b.accuracy + 0.6 * s.accuracy, 6) as health_score,
  case when s.f1_macro < 0.85 then 'Action Required' when s.f1_macro < 0.9 then 'Optimization Recommended' else 'Production Ready' end as grade,
  case when auc >= 0.95 then 'Strong' when auc >= 0.8 then 'Adequate' when auc > 0 then 'Weak' end as separation,
  (s.f1_weighted - s.f1_macro) > 0.1 as imbalanced
from bsummary b, summary s, m""")
def model_report_card(spark: SparkSession, d: str) -> DataFrame:
    from flowguard.plans.evaluation import evaluate_scored, report_card

    return report_card(evaluate_scored(scored(spark, d), split="test"))


@query("threat_posture", with_views(SCORED, CONF, CLASSES, REPORT, _SUMMARY, BINARY_REPORT, POLICY) + """
, cov as (select avg(case when action is null then 0.0 else 1.0 end) as c from (select distinct lower(class_true) as class_key from scored) left join policy using (class_key))
select round(b.accuracy, 6) as binary_accuracy, round(s.f1_macro, 6) as f1_macro, round(c, 6) as coverage,
  round((b.accuracy + s.f1_macro + c) / 3 * 100, 1) as posture
from bsummary b, summary s, cov""")
def threat_posture(spark: SparkSession, d: str) -> DataFrame:
    from flowguard.plans.evaluation import posture

    return posture(scored(spark, d))


# --- calibration -------------------------------------------------------------------------


@query("isotonic_calibration", with_views(SCORED) + """
, bins as (select round(p, 2) as x, avg(y) as m, count(*) as w, row_number() over (order by round(p, 2)) as i from scored group by 1),
blocks as (select a.i as lo, b.i as hi, (select sum(m * w) / sum(w) from bins c where c.i between a.i and b.i) as mean
  from bins a join bins b on a.i <= b.i),
worst as (select t.i as pos, k.lo, min(k.mean) as low from bins t join blocks k on k.lo <= t.i and k.hi >= t.i group by 1, 2),
fitted as (select pos, max(low) as level from worst group by 1)
select flow_id, round(level, 6) as p_calibrated from scored s join bins b on round(s.p, 2) = b.x join fitted on fitted.pos = b.i""")
def isotonic_calibration(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    model = fit_isotonic(s, "p", "y", digits=2)
    return model.transform(s, "p", "p_calibrated").select("flow_id", F.round("p_calibrated", 6).alias("p_calibrated"))
