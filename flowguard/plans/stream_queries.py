"""Queries that run as streams over the event files until all are processed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.functions import decision as D
from flowguard.functions.trust import anomaly_score
from flowguard.operators.scale import fit_scaler
from flowguard.plans.cascade import decide
from flowguard.plans.fixture_sql import EVENT_FLOWS, SCORED, scatter_sql, with_views
from flowguard.plans.decision_queries import EVENT_DECISIONS
from flowguard.plans.registry import query
from flowguard.session import work_folder
from flowguard.sources.files import feedback_rows
from flowguard.sources.tables import event_flows, scored_columns, table
from flowguard.streaming import streams
from flowguard.streaming.flows import complete_windows, window_flow_features


def _scorer(spark: SparkSession, d: str, keep_anomaly: bool = False):
    """Stateless scoring of events, with the scaler fitted on the stored table beforehand."""
    keep = ["flow_id", "ts", "user_id"] + ["anomaly"] * keep_anomaly
    scaler = fit_scaler(table(spark, d, "events"), ["value"])

    def score(events: DataFrame) -> DataFrame:
        s = scored_columns(events).withColumn("anomaly", anomaly_score([scaler.z("value")]))
        s = s.select("flow_id", "ts", "user_id", "anomaly", F.col("pred").alias("binary_pred"), F.col("p").alias("p_attack"),
                     F.col("proba").alias("attack_proba"), F.col("class_pred").alias("attack_type"))
        return decide(s, keep)

    return score


_DECIDED = """decided as (
  select *, case when pred = 1 and confidence >= 0.85 then 'DENY' when pred = 0 and confidence >= 0.8 then 'ALLOW'
      else 'QUARANTINE' end as action,
    case when pred = 1 and confidence >= 0.6 then 'HIGH' when pred = 0 and confidence >= 0.8 then 'LOW' else 'MEDIUM' end as risk
  from event_decisions)"""


@query("stream_scoring", with_views(SCORED, EVENT_DECISIONS, _DECIDED) + """
select flow_id, action, round(raw_trust, 4) as trust_score, risk as risk_level, case when pred = 1 then class_pred end as attack_type from decided""")
def stream_scoring(spark: SparkSession, d: str) -> DataFrame:
    out = streams.score_stream(streams.event_stream(spark, d), _scorer(spark, d))
    flat = out.select("flow_id", "action", "trust.trust_score", "trust.risk_level", "attack_type")
    return streams.run_available(flat, "stream-scores")


@query("stream_feedback", with_views(SCORED, EVENT_DECISIONS, _DECIDED) + f"""
select flow_id, 'Attack' as prediction, class_pred as attack_type, round(raw_trust, 4) as trust_score, risk as risk_level
from decided where pred = 1 and {scatter_sql('flow_id')} < 858993459""")
def stream_feedback(spark: SparkSession, d: str) -> DataFrame:
    rows = feedback_rows(_scorer(spark, d)(streams.event_stream(spark, d)), "flow_id")
    back = streams.run_available(rows, "stream-feedback", fmt="json")
    return back.select("flow_id", "prediction", "attack_type", "trust.trust_score", "trust.risk_level")


@query("stream_action_counts", with_views(SCORED, EVENT_DECISIONS, _DECIDED) + """
select * from (select time_bucket(interval '6 hours', ts)::timestamp as window_start, action, count(*) as n_flows from decided group by 1, 2)
where window_start + interval '6 hours' <= (select max(ts) from events) - interval '1 hour'""")
def stream_action_counts(spark: SparkSession, d: str) -> DataFrame:
    decisions = _scorer(spark, d)(streams.event_stream(spark, d)).select("ts", "action")
    counts = streams.windowed_action_counts(decisions, "ts", "6 hours", "1 hour")
    return streams.run_available(counts, "stream-counts").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


_WINDOWED = """g as (
  select *, time_bucket(interval '12 hours', ts) as w,
    date_diff('microsecond', lag(ts) over (partition by user_id, time_bucket(interval '12 hours', ts) order by ts, event_id), ts) as gap
  from events),
wf as (select * from (
  select user_id, w::timestamp as window_start, count(*) as n_events,
    round(date_diff('microsecond', min(ts), max(ts)) / 1e6, 6) as duration_s,
    round(case when count(*) > 1 then date_diff('microsecond', min(ts), max(ts)) / 1e6 / (count(*) - 1) end, 9) as iat_mean, 
    round(case when count(*) > 1 then sqrt(greatest(count(gap) * sum(gap::hugeint * gap) - date_diff('microsecond', min(ts), max(ts))::hugeint * date_diff('microsecond', min(ts), max(ts)), 0)::double) / count(gap) / 1e6 end, 9) as iat_std,
    round(min(gap) / 1e6, 6) as iat_min, round(max(gap) / 1e6, 6) as iat_max,
    round(case when count(*) > 1 then count(*) / (date_diff('microsecond', min(ts), max(ts)) / 1e6) end, 6) as events_per_s,
    round(sum(value), 4) as value_sum
  from g group by user_id, w) where window_start + interval '12 hours' <= (select max(ts) from events) - interval '1 hour')"""


def _rounded_windows(f: DataFrame) -> DataFrame:
    return f.select(
        "user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n_events",
        *[F.round(c, 6).alias(c) for c in ("duration_s", "iat_min", "iat_max")],
        F.round("iat_mean", 9).alias("iat_mean"),
        F.round("iat_std", 9).alias("iat_std"), F.round("events_per_s", 6).alias("events_per_s"),
        F.round("value_sum", 4).alias("value_sum"),
    )


@query("window_flow_features", with_views(_WINDOWED) + "select * from wf")
def window_flow_features_batch(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    latest = ev.agg(F.max("ts")).first()[0]  # one value
    f = window_flow_features(ev, "user_id", "ts", "value", "12 hours", "10 minutes", "1 hour")
    return _rounded_windows(complete_windows(f, latest, "1 hour"))


@query("stream_flow_features", with_views(_WINDOWED) + "select * from wf")
def stream_flow_features(spark: SparkSession, d: str) -> DataFrame:
    ev = streams.event_stream(spark, d)
    f = window_flow_features(ev, "user_id", "ts", "value", "12 hours", "10 minutes", "1 hour")
    return _rounded_windows(streams.run_available(f, "stream-flows"))


_VELOCITY = """slots as (
  select d.*, time_bucket(interval '2 hours', ts) - to_hours(2 * o) as w from decided d, (select unnest(range(6)) as o)),
vel as (
  select user_id, w, count(*) as n_anomalies from slots where anomaly > 1 group by 1, 2
  having w + interval '12 hours' <= (select max(ts) from decided where anomaly > 1) - interval '1 hour'),
busy as (select distinct s.flow_id from slots s join vel v on s.user_id = v.user_id and s.w = v.w where n_anomalies > 1)"""


@query("anomaly_velocity", with_views(SCORED, EVENT_DECISIONS, _DECIDED, _VELOCITY) + """
select user_id, w::timestamp as window_start, n_anomalies from vel""")
def anomaly_velocity(spark: SparkSession, d: str) -> DataFrame:
    v = _velocity(spark, d)
    return v.select("user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n_anomalies")


def _velocity(spark: SparkSession, d: str) -> DataFrame:
    scaler = fit_scaler(table(spark, d, "events"), ["value"])
    marked = streams.event_stream(spark, d).withColumn("odd", anomaly_score([scaler.z("value")]) > 1)
    counts = streams.anomaly_velocity(marked, "user_id", "ts", "odd", "12 hours", "2 hours", "1 hour")
    return streams.run_available(counts, "velocity")


@query("velocity_escalation", with_views(SCORED, EVENT_DECISIONS, _DECIDED, _VELOCITY) + """
select d.flow_id, action, case when action = 'ALLOW' and b.flow_id is not null then 'QUARANTINE' else action end as escalated_action
from decided d left join busy b on d.flow_id = b.flow_id""")
def velocity_escalation(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    decisions = _scorer(spark, d)(ev).select("flow_id", "ts", "user_id", "action")
    out = streams.escalate(decisions, _velocity(spark, d), "user_id", "flow_id", "ts", "12 hours", "2 hours", 1)
    return out.select("flow_id", "action", "escalated_action")


@query("live_escalation", with_views(SCORED, EVENT_DECISIONS, _DECIDED, """slots as (
  select d.*, time_bucket(interval '2 hours', ts) - to_hours(2 * o) as w from decided d, (select unnest(range(6)) as o)),
busy as (select user_id, w from slots where anomaly > 1 group by 1, 2 having count(*) > 1),
hit as (select distinct s.flow_id from slots s join busy b on s.user_id = b.user_id and s.w = b.w)""") + """
select d.flow_id, action, case when action = 'ALLOW' and h.flow_id is not null then 'QUARANTINE' else action end as escalated_action
from decided d left join hit h on d.flow_id = h.flow_id""")
def live_escalation(spark: SparkSession, d: str) -> DataFrame:
    """Escalation as flows arrive, windows that are still open included."""
    scored = _scorer(spark, d, keep_anomaly=True)(streams.event_stream(spark, d)).withColumn("odd", F.col("anomaly") > 1)
    raised = streams.escalate_stream(scored, "user_id", "flow_id", "ts", "odd", 12 * 3600, 2 * 3600, 1, "1 hour")
    return streams.last_word(streams.run_available(raised, "live-escalation"), "flow_id")


@query("batch_action_counts", with_views(SCORED, EVENT_DECISIONS, _DECIDED) + """
select action, count(*) as n_flows, count(*) as running, true as in_batches from decided group by action""")
def batch_action_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts per micro-batch of an event table that arrives in several files, added up."""
    parts = work_folder(spark, "event-parts")
    table(spark, d, "events").repartition(6, "event_id").write.parquet(f"{parts}/events.parquet")
    decisions = _scorer(spark, d)(streams.event_stream(spark, parts, files_per_batch=2))
    counts = streams.running_counts(streams.run_batches(decisions, "batch-counts", streams.action_counts))
    return counts.groupBy("action").agg(
        F.sum("n_flows").alias("n_flows"), F.max("running").alias("running"), (F.max("batch_id") > 0).alias("in_batches"))


@query("live_feed", with_views(SCORED, EVENT_DECISIONS, _DECIDED) + """
select flow_id, ts, action from decided order by ts desc, flow_id desc limit 20""")
def live_feed(spark: SparkSession, d: str) -> DataFrame:
    out = _scorer(spark, d)(streams.event_stream(spark, d)).select("flow_id", "ts", "action")
    feed = streams.live_feed(streams.run_available(out, "feed"), "ts", "flow_id", 20)
    return feed.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("flow_features_daily", with_views(EVENT_FLOWS) + """
select flow_id, n_events, duration_s, iat_mean, iat_std, iat_min, iat_max, value_sum, value_mean, n_types, events_per_s,
  source_day, label, "binary" from event_flows""")
def flow_features_daily(spark: SparkSession, d: str) -> DataFrame:
    return event_flows(spark, d)
