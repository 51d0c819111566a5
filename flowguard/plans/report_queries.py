"""Queries for distributions, summaries, logs and the behaviour reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.operators import insight, report, scenario, weights
from flowguard.plans.fixture_sql import EVENT_FLOWS, FLOW_ROWS, REQUEST_LOG, SCORED, VEC_ROWS, with_views
from flowguard.plans.registry import query
from flowguard.sources.tables import FLOW_ROW_FEATURES, VEC_FEATURES, event_flows, flow_rows, request_log, scored, vec_rows


@query("class_distribution", with_views(FLOW_ROWS) + """
select case when l_orderkey % 5 = 0 then 'test' else 'train' end as split, label, count(*) as n_rows from flow_rows group by 1, 2""")
def class_distribution(spark: SparkSession, d: str) -> DataFrame:
    rows = flow_rows(spark, d).withColumn("split", F.when(F.col("l_orderkey") % 5 == 0, F.lit("test")).otherwise(F.lit("train")))
    return report.class_counts(rows, ["split", "label"])


@query("split_sizes", with_views(FLOW_ROWS) + """
select case when l_orderkey % 5 = 0 then 'test' else 'train' end as split, count(*) as n_rows,
  round(count(*) / (select count(*) from flow_rows), 6) as fraction from flow_rows group by 1""")
def split_sizes(spark: SparkSession, d: str) -> DataFrame:
    rows = flow_rows(spark, d).withColumn("split", F.when(F.col("l_orderkey") % 5 == 0, F.lit("test")).otherwise(F.lit("train")))
    return report.split_sizes(rows)


@query("distinct_classes", with_views(FLOW_ROWS) + "select count(distinct label) as n_classes from flow_rows")
def distinct_classes(spark: SparkSession, d: str) -> DataFrame:
    return report.distinct_classes(flow_rows(spark, d), "label")


@query("column_summary", with_views(FLOW_ROWS) + " union all ".join(
    f"select '{c}' as feature, count({c}) as n, round(avg({c}), 5) as mean, round(stddev_samp({c}), 6) as std, min({c})::double as min, "
    f"max({c})::double as max, round(quantile_cont({c}, 0.25), 6) as q25, round(median({c}), 6) as q50, round(quantile_cont({c}, 0.75), 6) as q75 from flow_rows"
    for c in FLOW_ROW_FEATURES))
def column_summary(spark: SparkSession, d: str) -> DataFrame:
    s = report.column_summary(flow_rows(spark, d), FLOW_ROW_FEATURES)
    rounded = [F.round(c, 6).alias(c) for c in ("std", "q25", "q50", "q75")]
    return s.select("feature", "n", "min", "max", F.round("mean", 5).alias("mean"), *rounded)


@query("column_medians", with_views(FLOW_ROWS) + " union all ".join(
    f"select '{c}' as feature, round(median({c}), 6) as median from flow_rows" for c in FLOW_ROW_FEATURES))
def column_medians(spark: SparkSession, d: str) -> DataFrame:
    from flowguard.operators.ordered import order_quantiles

    q = order_quantiles(flow_rows(spark, d), FLOW_ROW_FEATURES, [0.5])
    return q.select("feature", F.round("value", 6).alias("median"))


@query("class_weights", with_views(FLOW_ROWS) + """
select label, count(*) as n_rows, round((select count(*) from flow_rows) / ((select count(distinct label) from flow_rows) * count(*)), 6) as weight
from flow_rows group by label""")
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return weights.class_weights(flow_rows(spark, d), "label").withColumn("weight", F.round("weight", 6))


@query("weighted_rows", with_views(EVENT_FLOWS) + """
, w as (select label, (select count(*) from event_flows) / ((select count(distinct label) from event_flows) * count(*)) as weight from event_flows group by label)
select flow_id, round(weight, 6) as weight from event_flows join w using (label)""")
def weighted_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = weights.with_weights(event_flows(spark, d).select("flow_id", "label"), "label")
    return rows.select("flow_id", F.round("weight", 6).alias("weight"))


@query("neighbour_clamp", """
with c as (select label, count(*) as n from embeddings group by label)
select min(n) as smallest, greatest(1, least(5, min(n) - 1))::int as neighbours from c""")
def neighbour_clamp(spark: SparkSession, d: str) -> DataFrame:
    return weights.neighbour_count(vec_rows(spark, d), "label")


_HIGH = """positions as (
  select level, latency_ms, row_number() over (partition by level order by latency_ms) as i, count(*) over (partition by level) as n from request_log),
high as (
  select level,
    max(case when i = least(greatest(floor(0.95 * (n + 1)), 1), n - 1) then latency_ms end) as a95,
    max(case when i = least(greatest(floor(0.95 * (n + 1)), 1), n - 1) + 1 then latency_ms end) as b95,
    max(case when i = least(greatest(floor(0.99 * (n + 1)), 1), n - 1) then latency_ms end) as a99,
    max(case when i = least(greatest(floor(0.99 * (n + 1)), 1), n - 1) + 1 then latency_ms end) as b99,
    max(0.95::double * (n + 1) - least(greatest(floor(0.95 * (n + 1)), 1), n - 1)) as f95,
    max(0.99::double * (n + 1) - least(greatest(floor(0.99 * (n + 1)), 1), n - 1)) as f99
  from positions group by level)"""


@query("service_summary", with_views(REQUEST_LOG, _HIGH) + """
, base as (select level, count(*) as requests, round(count(*) / (date_diff('microsecond', min(ts), max(ts)) / 1e6), 6) as throughput,
    round(sum(case when status <> 200 then 1 else 0 end) / count(*) * 100, 2) as error_pct, round(avg(cpu), 6) as cpu_mean,
    round(median(latency_ms), 2) as p50 from request_log group by level)
select base.*, round(a95 + (b95 - a95) * f95, 2) as p95, round(a99 + (b99 - a99) * f99, 2) as p99 from base join high using (level)""")
def service_summary(spark: SparkSession, d: str) -> DataFrame:
    return report.service_summary(request_log(spark, d), "level", "latency_ms", "status", "ts", ["cpu"])


@query("resource_growth", with_views(REQUEST_LOG) + " union all ".join(f"""
select '{m}' as measure, (select {m} from request_log order by ts, event_id limit 1) as initial,
  (select {m} from request_log order by ts desc, event_id desc limit 1) as final,
  (select {m} from request_log order by ts desc, event_id desc limit 1) - (select {m} from request_log order by ts, event_id limit 1) as growth,
  round(avg({m}), 6) as mean from request_log""" for m in ("latency_ms", "cpu")))
def resource_growth(spark: SparkSession, d: str) -> DataFrame:
    log = request_log(spark, d).select("ts", "event_id", "latency_ms", F.col("cpu").cast("double").alias("cpu"))
    return report.growth(log, "ts", "event_id", ["latency_ms", "cpu"])


_VM = ", ".join(f"round(median({f}), 6) as {f}" for f in VEC_FEATURES[:64])


@query("class_medians", with_views(VEC_ROWS) + f"select label, {_VM} from vec_rows group by label")
def class_medians(spark: SparkSession, d: str) -> DataFrame:
    m = scenario.class_medians(vec_rows(spark, d), "label", VEC_FEATURES)
    return m.select("label", *[F.round(f, 6).alias(f) for f in VEC_FEATURES])


@query("neutral_payload", with_views(FLOW_ROWS) + " union all ".join(
    f"select '{c}' as feature, round(coalesce(avg({c}), 0.0), 5) as value from flow_rows" for c in FLOW_ROW_FEATURES))
def neutral_payload(spark: SparkSession, d: str) -> DataFrame:
    return report.neutral_payload(flow_rows(spark, d), FLOW_ROW_FEATURES).withColumn("value", F.round("value", 5))


_DIST = " + ".join(f"(v.{f} - m.{f}) * (v.{f} - m.{f})" for f in VEC_FEATURES)
_RAW_MED = ", ".join(f"median({f}) as {f}" for f in VEC_FEATURES)
REPRESENTATIVE = f"""m as (select label, {_RAW_MED} from vec_rows group by label),
dist as (select v.vec_id, v.label, sqrt({_DIST}) as distance from vec_rows v join m on v.label = m.label),
near as (select *, row_number() over (partition by label order by distance, vec_id) as rank from dist)"""


@query("representative_rows", with_views(VEC_ROWS, REPRESENTATIVE) + """
select vec_id, label, rank::int as rank, round(distance, 6) as distance, 'QUARANTINE' as expected_action from near where rank <= 5""")
def representative_rows(spark: SparkSession, d: str) -> DataFrame:
    best = scenario.representative_rows(vec_rows(spark, d).withColumn("label", F.col("label").cast("string")), "label", "vec_id", VEC_FEATURES)
    return best.select("vec_id", F.col("label").cast("int").alias("label"), "rank", F.round("distance", 6).alias("distance"), "expected_action")


_FLOW_NEAR = """fm as (select label, median(n_events) as a, median(value_sum) as b from event_flows group by label),
fnear as (select f.flow_id, f.label, sqrt((n_events - a) * (n_events - a) + (value_sum - b) * (value_sum - b)) as distance
  from event_flows f join fm on f.label = fm.label),
cand as (select *, row_number() over (partition by label order by distance, flow_id) as rank from fnear),
decided as (select flow_id, case when value_sum > 30 then 'DENY' when value_sum > 5 then 'QUARANTINE' else 'ALLOW' end as action,
    case when value_sum > 5 then (case when n_events % 2 = 0 then label else 'DDoS' end) end as attack_type from event_flows),
ok as (select c.flow_id, c.label, c.distance, d.action, row_number() over (partition by c.label order by c.distance, c.flow_id) as rn
  from cand c join decided d using (flow_id) where c.rank <= 50
    and case when c.label = 'BENIGN' then d.action = 'ALLOW' else lower(d.attack_type) = lower(c.label) and d.action in ('QUARANTINE', 'DENY') end)"""


@query("matched_scenarios", with_views(EVENT_FLOWS, _FLOW_NEAR) + "select flow_id, label, round(distance, 6) as distance, action from ok where rn = 1")
def matched_scenarios(spark: SparkSession, d: str) -> DataFrame:
    flows = event_flows(spark, d)
    cand = scenario.representative_rows(flows, "label", "flow_id", ["n_events", "value_sum"], k=50)
    action = F.when(F.col("value_sum") > 30, F.lit("DENY")).when(F.col("value_sum") > 5, F.lit("QUARANTINE")).otherwise(F.lit("ALLOW"))
    kind = F.when(F.col("value_sum") > 5, F.when(F.col("n_events") % 2 == 0, F.col("label")).otherwise(F.lit("DDoS")))
    decisions = flows.select("flow_id", action.alias("action"), kind.alias("attack_type"), F.lit(0.9).alias("confidence"))
    out = scenario.matched_scenarios(cand, decisions, "flow_id", "label")
    return out.select("flow_id", "label", F.round("distance", 6).alias("distance"), "action")


# --- behaviour reports ------------------------------------------------------------------------


@query("anomaly_indicators", with_views(FLOW_ROWS) + """
, base as (select quantile_cont(duration, [0.05, 0.95]) as d, quantile_cont(bytes, [0.05, 0.95]) as b, quantile_cont(bytes_per_unit, [0.05, 0.95]) as u
  from flow_rows where label = 'BENIGN'),
marks as (select label, list_filter([
    case when bytes > b[2] then 'bytes>p95' when bytes < b[1] then 'bytes<p05' end,
    case when bytes_per_unit > u[2] then 'bytes_per_unit>p95' when bytes_per_unit < u[1] then 'bytes_per_unit<p05' end,
    case when duration > d[2] then 'duration>p95' when duration < d[1] then 'duration<p05' end], lambda x: x is not null) as m
  from flow_rows, base)
select label, array_to_string(m, ',') as marks, count(*) as n_rows from marks group by 1, 2""")
def anomaly_indicators(spark: SparkSession, d: str) -> DataFrame:
    rows = flow_rows(spark, d)
    out = insight.anomaly_indicators(rows, rows.where("label = 'BENIGN'"), ["bytes", "bytes_per_unit", "duration"])
    return out.groupBy("label", F.concat_ws(",", "indicators").alias("marks")).agg(F.count("*").alias("n_rows"))


@query("behaviour_fingerprint", with_views(EVENT_FLOWS) + """
, b as (select avg(n_events) m1, stddev_pop(n_events) s1, avg(duration_s) m2, stddev_pop(duration_s) s2, avg(value_sum) m3, stddev_pop(value_sum) s3,
    avg(value_mean) m4, stddev_pop(value_mean) s4 from event_flows where label = 'BENIGN')
select flow_id, round(((n_events - m1) / s1 + (duration_s - m2) / s2) / 2, 6) as envelope, round(((value_sum - m3) / s3 + (value_mean - m4) / s4) / 2, 6) as volume
from event_flows, b""")
def behaviour_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    flows = event_flows(spark, d)
    groups = {"envelope": ["n_events", "duration_s"], "volume": ["value_sum", "value_mean"]}
    return insight.fingerprint(flows, flows.where("label = 'BENIGN'"), groups, ["flow_id"])


@query("percentile_values", with_views(FLOW_ROWS) + " union all ".join(
    f"select '{c}' as feature, {p}::double as p, round(quantile_cont({c}, {p / 100}), 6) as value from flow_rows"
    for c in ("duration", "bytes", "bytes_per_unit") for p in (0, 5, 25, 50, 75, 95, 100)))
def percentile_values(spark: SparkSession, d: str) -> DataFrame:
    t = insight.percentile_lookup(flow_rows(spark, d), ["duration", "bytes", "bytes_per_unit"], [0, 5, 25, 50, 75, 95, 100])
    return t.select("feature", "p", F.round("value", 6).alias("value"))


@query("importance_alignment", with_views(FLOW_ROWS) + """
, g as (select avg(duration) a, avg(bytes) b from flow_rows),
c as (select label, count(*) n, avg(duration) a, var_pop(duration) va, avg(bytes) b, var_pop(bytes) vb from flow_rows group by label)
select 'duration' as feature, round((sum(n * (c.a - g.a) * (c.a - g.a)) / 2) / (sum(n * va) / (sum(n) - 3)), 6) as f_score, 0.6::double as importance from c, g
union all select 'bytes', round((sum(n * (c.b - g.b) * (c.b - g.b)) / 2) / (sum(n * vb) / (sum(n) - 3)), 6), 0.4::double from c, g""")
def importance_alignment(spark: SparkSession, d: str) -> DataFrame:
    from flowguard.operators.selection import anova_table

    scores = anova_table(flow_rows(spark, d), ["duration", "bytes"], "label")
    importance = spark.createDataFrame([("duration", 0.6), ("bytes", 0.4)], "feature string, importance double")
    return scores.join(F.broadcast(importance), "feature").select("feature", F.round("f_score", 6).alias("f_score"), "importance")
