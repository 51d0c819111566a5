"""Queries over decisions: action mix, trust, confidence, policy lookups, texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.functions import decision as D
from flowguard.functions import labels as L
from flowguard.functions import narrative as N
from flowguard.functions import proba as P
from flowguard.functions import trust as T
from flowguard.operators import clean, report
from flowguard.operators.policy import expected_action, layered_action, policy_coverage, policy_table, with_policy
from flowguard.operators.scale import fit_scaler
from flowguard.plans.cascade import decide, flat_decisions
from flowguard.plans.fixture_sql import EVENT_FLOWS, POLICY, PROBA_LONG, SCORED, with_views
from flowguard.plans.registry import query
from flowguard.session import write_through
from flowguard.sources.tables import EVENT_FLOW_FEATURES, event_flows, scored

# --- the flagship: flows → repair → scale → score → trust → action → mix ----------

_FILLED = ", ".join(f"coalesce(c_{f}, (select m_{f} from med)) as {f}" for f in EVENT_FLOW_FEATURES)
_CLEANED = ", ".join(
    f"case when isinf({f}::double) or isnan({f}::double) then null else {f}::double end as c_{f}" for f in EVENT_FLOW_FEATURES
)
_MED = ", ".join(f"median(c_{f}) as m_{f}" for f in EVENT_FLOW_FEATURES)
_STATS = ", ".join(f"avg({f}) as a_{f}, stddev_pop({f}) as s_{f}" for f in EVENT_FLOW_FEATURES)
_Z = ", ".join(f"({f} - a_{f}) / s_{f} as z_{f}" for f in EVENT_FLOW_FEATURES)
_ABS = " + ".join(f"abs(z_{f})" for f in EVENT_FLOW_FEATURES)

FLOW_DECISIONS = f"""nulled as (select flow_id, {_CLEANED} from event_flows),
med as (select {_MED} from nulled),
filled as (select flow_id, {_FILLED} from nulled),
stats as (select {_STATS} from filled),
zs as (select flow_id, {_Z} from filled, stats),
flow_scores as (
  select flow_id, round(1 / (1 + exp(-(z_value_mean + z_n_events))), 4) as p, least(({_ABS}) / 10.0, 10.0) as anomaly
  from zs),
flow_conf as (
  select *, case when p >= 0.5 then 1 else 0 end as pred, case when p >= 0.5 then p else 1 - p end as confidence
  from flow_scores),
flow_decisions as (
  select flow_id, pred, confidence,
    case when pred = 1 and confidence >= 0.85 then 'DENY' when pred = 0 and confidence >= 0.8 then 'ALLOW'
         else 'QUARANTINE' end as action,
    case when pred = 1 and confidence >= 0.6 then 'HIGH' when pred = 0 and confidence >= 0.8 then 'LOW'
         else 'MEDIUM' end as risk,
    0.5 * confidence + 0.2 * exp(-anomaly) as raw_trust
  from flow_conf)"""


def scored_flows(spark: SparkSession, d: str) -> DataFrame:
    """Repaired and scaled event flows with an attack score in closed form."""
    # Medians, scaler and scoring each read the flows: built once, then read column-pruned.
    flows = write_through(event_flows(spark, d).select("flow_id", *EVENT_FLOW_FEATURES), "flows")
    fixed = clean.repair(flows, EVENT_FLOW_FEATURES)
    z = fit_scaler(fixed, EVENT_FLOW_FEATURES).transform(fixed)
    p = F.round(1 / (1 + F.exp(-(F.col("value_mean") + F.col("n_events")))), 4)
    return z.select(
        "flow_id", p.alias("p_attack"), D.binary_prediction(p).alias("binary_pred"),
        T.anomaly_score(EVENT_FLOW_FEATURES).alias("anomaly"),
        F.lit(None).cast("map<string,double>").alias("attack_proba"),
        F.lit(None).cast("string").alias("attack_type"),
    )


@query("action_mix", with_views(EVENT_FLOWS, FLOW_DECISIONS) + """
select a.action, count(f.flow_id) as n_flows, (select count(*) from flow_decisions) as total,
  round(count(f.flow_id) / (select count(*) from flow_decisions), 6) as share
from (values ('ALLOW'), ('QUARANTINE'), ('DENY')) a(action) left join flow_decisions f on f.action = a.action
group by a.action""")
def action_mix(spark: SparkSession, d: str) -> DataFrame:
    return report.action_mix(decide(scored_flows(spark, d), ["flow_id"]))


@query("flow_decision_table", with_views(EVENT_FLOWS, FLOW_DECISIONS) + """
select flow_id, action, pred as binary_pred, round(confidence, 6) as confidence, null::varchar as attack_type,
  case when pred = 1 then 'Attack' else 'Normal' end as prediction, 0.0::double as margin,
  round(raw_trust, 4) as trust_score, risk as risk_level
from flow_decisions""")
def flow_decision_table(spark: SparkSession, d: str) -> DataFrame:
    flat = flat_decisions(decide(scored_flows(spark, d), ["flow_id"]), ["flow_id"])
    return flat.withColumn("confidence", F.round("confidence", 6))


# --- the scored events ---------------------------------------------------------------

EVENT_DECISIONS = """bounds as (select avg(value) as av, stddev_pop(value) as sd from scored),
z as (
  select s.*, (value - av) / sd as z1, abs((value - av) / sd) as anomaly,
    list_reverse_sort([q0, q1, q2, q3, q4]) as qs
  from scored s, bounds),
event_decisions as (
  select *, case when pred = 1 then round(qs[1] - qs[2], 6) else 0.0 end as margin,
    0.5 * confidence + 0.3 * (case when pred = 1 then round(qs[1] - qs[2], 6) else 0.0 end)
      + 0.2 * exp(-least(anomaly, 10.0)) as raw_trust
  from z)"""


def event_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scored events with the standardised value and the margin."""
    s = scored(spark, d)
    z = fit_scaler(s, ["value"]).z("value")
    return s.withColumn("anomaly", T.anomaly_score([z])).withColumn(
        "margin", F.when(F.col("pred") == 1, F.round(P.top_margin("proba"), 6)).otherwise(F.lit(0.0))
    )


@query("trust_scores", with_views(SCORED, EVENT_DECISIONS) + """
select flow_id, round(least(anomaly, 10.0), 4) as anomaly_score, round(exp(-least(anomaly, 10.0)), 6) as component,
  round(raw_trust, 4) as trust_score,
  case when raw_trust >= 0.7 then 'LOW' when raw_trust >= 0.4 then 'MEDIUM' else 'HIGH' end as trust_risk
from event_decisions""")
def trust_scores(spark: SparkSession, d: str) -> DataFrame:
    t = T.trust_struct("confidence", "margin", "anomaly")
    return event_scores(spark, d).select(
        "flow_id", t["anomaly_score"].alias("anomaly_score"),
        F.round(T.anomaly_component("anomaly"), 6).alias("component"),
        t["trust_score"].alias("trust_score"), t["risk_level"].alias("trust_risk"),
    )


@query("trust_fallback", with_views(SCORED, EVENT_DECISIONS) + """
select flow_id,
  case when flow_id % 7 = 0 or flow_id % 5 = 0 then 0.5 else round(raw_trust, 4) end as trust_score,
  case when flow_id % 7 = 0 or flow_id % 5 = 0 then 'MEDIUM' when raw_trust >= 0.7 then 'LOW'
    when raw_trust >= 0.4 then 'MEDIUM' else 'HIGH' end as risk_level,
  case when flow_id % 7 = 0 then null else confidence end as confidence,
  case when flow_id % 7 = 0 or flow_id % 5 = 0 then 0.0 else round(least(anomaly, 10.0), 4) end as anomaly_score
from event_decisions""")
def trust_fallback(spark: SparkSession, d: str) -> DataFrame:
    conf = F.when(F.col("flow_id") % 7 != 0, F.col("confidence"))
    margin = F.when(F.col("flow_id") % 5 != 0, F.col("margin"))
    t = T.trust_struct(conf, margin, "anomaly")
    return event_scores(spark, d).select("flow_id", t.alias("t")).select("flow_id", "t.*")


@query("faulty_anomaly_scores", """
with base as (
  select event_id, case when event_id % 37 = 0 then 0.0 when event_id % 41 = 0 then 5.0 when event_id % 43 = 0 then 5.0
    when event_id % 47 = 0 then 0.0 else abs(value - 20) / 10 end as a, abs(user_id - 75) / 10.0 as b
  from (select * from events union all select * from events where event_id % 53 = 0))
select event_id as flow_id, round(least((a + b) / 2, 10.0), 4) as anomaly_score from base""")
def faulty_anomaly_scores(spark: SparkSession, d: str) -> DataFrame:
    from flowguard.sources.tables import dirty_rows

    z = [(F.col("value") - 20) / 10, (F.col("user_id") - 75) / 10]
    return dirty_rows(spark, d).select("flow_id", F.round(T.anomaly_score(z), 4).alias("anomaly_score"))


@query("inverse_attack_trust", with_views(SCORED) + "select flow_id, round(1 - p, 6) as trust from scored")
def inverse_attack_trust(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("flow_id", F.round(T.inverse_attack_trust("p"), 6).alias("trust"))


@query("threshold_predictions", with_views(SCORED) + """
select flow_id, case when p >= 0.3 then 1 else 0 end as pred_30, case when p >= 0.5 then 1 else 0 end as pred_50,
  case when p >= 0.5 then 'Attack' else 'Normal' end as prediction,
  case when y = 0 then 'Benign' else 'Attack' end as class_name
from scored""")
def threshold_predictions(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select(
        "flow_id", D.binary_prediction("p", 0.3).alias("pred_30"), D.binary_prediction("p").alias("pred_50"),
        D.prediction_label(D.binary_prediction("p")).alias("prediction"),
        D.class_name_of_binary("y").alias("class_name"),
    )


@query("served_actions", with_views(SCORED) + """
select flow_id, round(case when pred = 1 then p else 1 - p end, 6) as confidence,
  case when pred = 1 and confidence >= 0.85 then 'DENY' when pred = 0 and confidence >= 0.8 then 'ALLOW'
       else 'QUARANTINE' end as action,
  case when pred = 1 and confidence >= 0.6 then 'HIGH' when pred = 0 and confidence >= 0.8 then 'LOW'
       else 'MEDIUM' end as risk_level
from scored""")
def served_actions(spark: SparkSession, d: str) -> DataFrame:
    conf = D.binary_confidence("pred", "p")
    return scored(spark, d).select(
        "flow_id", F.round(conf, 6).alias("confidence"),
        D.served_action("pred", conf).alias("action"), D.served_risk("pred", conf).alias("risk_level"),
    )


@query("risk_driven_actions", with_views(SCORED, EVENT_DECISIONS) + """
select flow_id, case when raw_trust >= 0.7 then (case when pred = 1 then 'MONITOR' else 'ALLOW' end)
  when raw_trust >= 0.4 then 'QUARANTINE' else 'DENY' end as action
from event_decisions""")
def risk_driven_actions(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("pred") == 1, F.col("class_pred")).otherwise(F.lit("BENIGN"))
    risk = T.trust_risk(T.raw_trust("confidence", "margin", "anomaly"))
    return event_scores(spark, d).select("flow_id", D.risk_driven_action(kind, risk).alias("action"))


# Spelling variants make the lookup work for its result: case, blanks, en dash, unknown, null.
_VARIANT = """variants as (
  select flow_id, pred, confidence,
    case flow_id % 8 when 0 then upper(class_pred) when 1 then '  ' || class_pred || ' '
      when 2 then 'Web Attack – XSS' when 3 then 'UnknownAttack' when 4 then null
      when 5 then 'DoS Hulk' else class_pred end as attack_type
  from scored)"""


def _variants(spark: SparkSession, d: str) -> DataFrame:
    i, c = F.col("flow_id") % 8, F.col("class_pred")
    kind = (
        F.when(i == 0, F.upper(c)).when(i == 1, F.concat(F.lit("  "), c, F.lit(" ")))
        .when(i == 2, F.lit("Web Attack – XSS")).when(i == 3, F.lit("UnknownAttack"))
        .when(i == 4, F.lit(None).cast("string")).when(i == 5, F.lit("DoS Hulk")).otherwise(c)
    )
    return scored(spark, d).select("flow_id", "pred", "confidence", "p", "proba", kind.alias("attack_type"))


@query("policy_lookup", with_views(SCORED, _VARIANT, POLICY) + """
select flow_id, round(confidence, 6) as confidence, case when pred = 1 then attack_type end as attack_type,
  case when pred = 0 then 'ALLOW' else coalesce(action, 'QUARANTINE') end as policy_action,
  case when pred = 0 then 'Traffic classified as benign.'
    when attack_type is null then 'Attack detected; attack type unavailable — applying default policy.'
    when action = 'DENY' then 'High-risk attack type: ' || attack_type
    when action = 'QUARANTINE' then 'Low-risk attack type: ' || attack_type || ' — isolating for investigation.'
    else 'Attack type ''' || attack_type || ''' not in policy lists — applying default: QUARANTINE.' end as policy_reason
from variants v left join policy p on replace(lower(trim(v.attack_type)), '–', '-') = p.class_key""")
def policy_lookup(spark: SparkSession, d: str) -> DataFrame:
    out = with_policy(_variants(spark, d), "pred", "attack_type")
    return out.select(
        "flow_id", F.round("confidence", 6).alias("confidence"),
        F.when(F.col("pred") == 1, F.col("attack_type")).alias("attack_type"), "policy_action", "policy_reason",
    )


@query("expected_actions", with_views(SCORED, _VARIANT) + """
select flow_id, case when flow_id % 3 = 0 then 'BENIGN' else attack_type end as label,
  case when flow_id % 3 = 0 then 'ALLOW'
    when attack_type in ('DDoS', 'PortScan', 'Bot', 'DoS Hulk') then 'DENY' else 'QUARANTINE' end as expected_action
from variants""")
def expected_actions(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("flow_id") % 3 == 0, F.lit("BENIGN")).otherwise(F.col("attack_type"))
    return _variants(spark, d).select("flow_id", label.alias("label"), expected_action(label).alias("expected_action"))


@query("layered_policy", with_views(SCORED, _VARIANT, POLICY) + """
select flow_id, case when v.pred = 0 then 'ALLOW' when s.p > 0.85 then 'DENY'
  when replace(lower(trim(v.attack_type)), '–', '-') = 'dos hulk' and greatest(q0, q1, q2, q3, q4) > 0.3 then 'DENY'
  when replace(lower(trim(v.attack_type)), '–', '-') = 'portscan' and greatest(q0, q1, q2, q3, q4) > 0.3 then 'QUARANTINE'
  else coalesce(action, 'QUARANTINE') end as action
from variants v join scored s using (flow_id)
  left join policy p on replace(lower(trim(v.attack_type)), '–', '-') = p.class_key""")
def layered_policy(spark: SparkSession, d: str) -> DataFrame:
    base = with_policy(_variants(spark, d), "pred", "attack_type")
    action = layered_action(
        "pred", "p", L.lookup_key("attack_type"), P.best_value("proba"), "policy_action",
        rules=[("dos hulk", 0.3, "DENY"), ("portscan", 0.3, "QUARANTINE")], hard_block=0.85,
    )
    return base.select("flow_id", action.alias("action"))


@query("policy_coverage", with_views(SCORED, POLICY) + """
, known as (select distinct lower(class_true) as class_key from scored
            union select distinct 'new-' || lower(class_pred) from scored where class_pred = 'Bot'),
m as (select coalesce(action, 'DEFAULT') as action, count(*) as matched from known left join policy using (class_key) group by 1)
select a.action, case when a.action = 'DEFAULT' then greatest(0, (select count(*) from known) - (select count(*) from policy))
    else (select count(*) from policy p where p.action = a.action) end::bigint as listed,
  coalesce(matched, 0)::bigint as matched
from (values ('DENY'), ('QUARANTINE'), ('DEFAULT')) a(action) left join m on m.action = a.action""")
def policy_coverage_report(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    classes = s.select("class_true").union(
        s.where("class_pred = 'Bot'").select(F.concat(F.lit("new-"), "class_pred"))
    )
    return policy_coverage(classes, "class_true", policy_table(spark))


# --- probability maps ------------------------------------------------------------------


@query("probability_margins", with_views(SCORED) + """
, r as (select flow_id, pred, class_pred, list_reverse_sort([q0, q1, q2, q3, q4]) as qs, q1, q0, q2, q3, q4 from scored)
select flow_id, round(qs[1] - qs[2], 6) as margin, case when flow_id % 2 = 0 then round(q1, 6) else 0.0 end as single_margin,
  round(qs[1], 6) as top_value,
  case qs[1] when q0 then 'Bot' when q1 then 'DDoS' when q2 then 'Heartbleed' when q3 then 'Infiltration' else 'PortScan' end as top_class,
  round(q1, 4) as p_ddos, 0.0::double as p_absent,
  case when round(qs[1] - qs[2], 6) > 0.5 then 'HIGH' when round(qs[1] - qs[2], 6) > 0.2 then 'MODERATE' else 'LOW' end as band
from r""")
def probability_margins(spark: SparkSession, d: str) -> DataFrame:
    margin = F.round(P.top_margin("proba"), 6)
    single = P.top_margin(F.create_map(F.lit("DDoS"), P.value_of("proba", F.lit("DDoS"))))
    return scored(spark, d).select(
        "flow_id", margin.alias("margin"),
        F.when(F.col("flow_id") % 2 == 0, F.round(single, 6)).otherwise(F.lit(0.0)).alias("single_margin"),
        F.round(P.best_value("proba"), 6).alias("top_value"), P.best_class("proba").alias("top_class"),
        P.value_of(P.rounded("proba", 4), F.lit("DDoS")).alias("p_ddos"),
        P.value_of("proba", F.lit("Unheard")).alias("p_absent"),
        D.certainty_band(margin).alias("band"),
    )


@query("probability_spectrum", with_views(SCORED, PROBA_LONG) + """
, r as (select flow_id, class, q, row_number() over (partition by flow_id order by q desc, class) as rank
        from proba_long where q > 0.05)
select flow_id, rank::int as rank, class, round(q, 6) as q from r where rank <= 3""")
def probability_spectrum(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).select("flow_id", F.posexplode(P.spectrum("proba", 0.05, 3)).alias("pos", "e"))
    return s.select("flow_id", (F.col("pos") + 1).alias("rank"), F.col("e.name").alias("class"), F.round("e.value", 6).alias("q"))


@query("key_signals", with_views(EVENT_FLOWS) + """
, long as (select flow_id, unnest(['duration_s', 'iat_mean', 'iat_std', 'n_events', 'n_types', 'value_mean', 'value_sum']) as name,
    unnest([-coalesce(duration_s, 0), coalesce(iat_mean, 0), coalesce(iat_std, 0), n_events, n_types, -value_mean, value_sum]) as v from event_flows),
r as (select *, row_number() over (partition by flow_id order by abs(v) desc, name) as rank from long)
select flow_id, rank::int as rank, name, round(v, 9) as v from r where rank <= 5""")
def key_signals(spark: SparkSession, d: str) -> DataFrame:
    f = event_flows(spark, d)
    m = F.create_map(
        F.lit("duration_s"), -F.coalesce("duration_s", F.lit(0.0)), F.lit("iat_mean"), F.coalesce("iat_mean", F.lit(0.0)),
        F.lit("iat_std"), F.coalesce("iat_std", F.lit(0.0)), F.lit("n_events"), F.col("n_events").cast("double"),
        F.lit("n_types"), F.col("n_types").cast("double"), F.lit("value_mean"), -F.col("value_mean"),
        F.lit("value_sum"), F.col("value_sum"),
    )
    top = f.select("flow_id", F.posexplode(P.key_signals(m)).alias("pos", "e"))
    return top.select("flow_id", (F.col("pos") + 1).alias("rank"), "e.name", F.round("e.value", 9).alias("v"))


@query("zero_vector_guard", """
select event_id, (abs(value - floor(value)) < 1e-9 and event_id % 3 = 0) as all_zero from events""")
def zero_vector_guard(spark: SparkSession, d: str) -> DataFrame:
    from flowguard.sources.tables import table

    values = F.array(
        F.col("value") - F.floor("value"), F.when(F.col("event_id") % 3 == 0, F.lit(1e-10)).otherwise(F.lit(-1.0))
    )
    return table(spark, d, "events").select("event_id", P.all_zero(values).alias("all_zero"))


# --- texts -----------------------------------------------------------------------------


@query("label_forms", with_views(SCORED, _VARIANT) + """
select flow_id, replace(lower(trim(attack_type)), '–', '-') as lookup_key,
  replace(replace(attack_type, ' ', '_'), '.', '') as safe_name,
  case when attack_type = 'BENIGN' then 'low' when attack_type = 'Infiltration' then 'medium' else 'high' end as risk,
  upper(trim(attack_type)) = 'BENIGN' as benign
from variants""")
def label_forms(spark: SparkSession, d: str) -> DataFrame:
    return _variants(spark, d).select(
        "flow_id", L.lookup_key("attack_type").alias("lookup_key"), L.safe_name("attack_type").alias("safe_name"),
        L.scenario_risk("attack_type").alias("risk"), L.is_benign("attack_type").alias("benign"),
    )


_BRIEF = """acted as (
  select s.*, case when pred = 1 and confidence >= 0.85 then 'DENY' when pred = 0 and confidence >= 0.8 then 'ALLOW'
      else 'QUARANTINE' end as action,
    case when pred = 1 then class_pred end as kind,
    'ZT-' || strftime(ts, '%Y%m%d-%H%M%S') || '-' || upper(substr(md5(flow_id::varchar), 1, 4)) as incident
  from scored s)"""


@query("threat_briefs", with_views(SCORED, _BRIEF) + """
select flow_id, incident,
  case action when 'ALLOW' then 'Verified as within safe behavioral bounds.'
    when 'QUARANTINE' then 'Anomaly detected (' || coalesce(kind, 'Unknown Attack') || ') → isolated per policy.'
    else 'Critical threat identified (' || coalesce(kind, 'Unknown Attack') || ') → blocked.' end as reason,
  case when action = 'ALLOW' then 'INCIDENT: ' || incident || ' | Network flow matches normal behavioral patterns. | All monitored signals fall within expected operating thresholds. | Traffic allowed without escalation. | '
      || round(confidence::decimal(18,6) * 100, 1)::decimal(18,1)::varchar || '% — high certainty benign classification.'
    else 'INCIDENT: ' || incident || ' | The system detected behavior consistent with ' || coalesce(kind, 'Suspicious activity')
      || '. | Multiple telemetry signals deviated from normal traffic patterns. | Action applied: ' || action || ' | '
      || round(confidence::decimal(18,6) * 100, 1)::decimal(18,1)::varchar || '% — model strongly supports this classification. | Monitor source activity and validate upstream protections.' end as brief
from acted""")
def threat_briefs(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("pred") == 1, F.col("class_pred"))
    action = D.served_action("pred", "confidence")
    s = scored(spark, d).withColumn("incident", N.incident_id("ts", "flow_id"))
    return s.select(
        "flow_id", "incident", N.short_reason(action, kind).alias("reason"),
        N.threat_brief(action, kind, "confidence", "incident").alias("brief"),
    )


@query("decision_certainty", with_views(SCORED) + """
select flow_id, round(sqrt(confidence * greatest(q0, q1, q2, q3, q4)), 6) as certainty from scored""")
def decision_certainty(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select(
        "flow_id", F.round(D.decision_certainty("confidence", P.best_value("proba")), 6).alias("certainty")
    )


@query("next_steps", with_views(SCORED, _BRIEF) + """
select flow_id, action, case when action = 'DENY' and confidence > 0.95 then 'No analyst review needed. Automated block applied.'
  when action = 'DENY' then 'Automated block applied. Recommend analyst spot-check.'
  when action = 'QUARANTINE' then 'Flow isolated. Analyst review required within SLA.'
  when confidence > 0.95 then 'Normal traffic. No action required.'
  when confidence <= 0.70 then 'Permitted, but borderline. Flag for retrospective analysis.'
  else 'Permitted.' end as next_step,
  case when action = 'ALLOW' then 'LOW' when pred = 1 and confidence >= 0.6 then 'HIGH'
    when pred = 0 and confidence >= 0.8 then 'LOW' else 'MEDIUM' end as severity
from acted""")
def next_steps(spark: SparkSession, d: str) -> DataFrame:
    action = D.served_action("pred", "confidence")
    return scored(spark, d).select(
        "flow_id", action.alias("action"), D.next_step(action, "confidence").alias("next_step"),
        D.severity(action, D.served_risk("pred", "confidence")).alias("severity"),
    )


@query("response_shape", with_views(SCORED, _VARIANT) + """
select flow_id, case when flow_id % 4 = 0 then 'UNKNOWN' else case when pred = 1 then 'DENY' else 'ALLOW' end end as action,
  case when flow_id % 9 = 0 then 0.0 else round(confidence, 6) end as confidence, attack_type,
  case when flow_id % 5 = 0 then null when pred = 1 then 'Attack' else 'Normal' end as prediction,
  case when flow_id % 11 = 0 then null else round(p, 6) end as probability
from variants join (select flow_id, p from scored) using (flow_id)""")
def response_shape(spark: SparkSession, d: str) -> DataFrame:
    from flowguard.sources.payloads import shaped_response

    i = F.col("flow_id")
    raw = _variants(spark, d).select(
        "flow_id",
        F.when(i % 4 != 0, F.when(F.col("pred") == 1, F.lit("DENY")).otherwise(F.lit("ALLOW"))).alias("action"),
        F.when(i % 9 == 0, F.lit("n/a")).otherwise(F.col("confidence").cast("string")).alias("confidence"),
        "attack_type",
        F.when(i % 5 != 0, D.prediction_label("pred")).alias("prediction"),
        F.when(i % 11 != 0, F.col("p")).alias("probability"),
    )
    return raw.select("flow_id", *shaped_response())


# --- audit trail ---------------------------------------------------------------------


@query("decision_audit_trail", with_views(SCORED, _BRIEF, POLICY) + """
, steps as (
  select flow_id, 1 as step, 'Input Validation' as stage, 'PASS' as outcome from acted
  union all select flow_id, 2, 'Feature Scaling', 'PASS' from acted
  union all select flow_id, 3, 'Binary Classifier', case when pred = 1 then 'ATTACK' else 'NORMAL' end from acted
  union all select flow_id, 4, 'Multi-class Model', kind from acted where pred = 1
  union all select flow_id, 5, 'Policy Lookup', coalesce(p.action, 'QUARANTINE') from acted a
    left join policy p on lower(a.kind) = p.class_key where pred = 1
  union all select flow_id, 6, 'Final Action', action from acted)
select flow_id, step::int as step, stage, outcome from steps""")
def decision_audit_trail(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).withColumn("kind", F.when(F.col("pred") == 1, F.col("class_pred")))
    s = with_policy(s, "pred", "kind")
    attack = F.col("pred") == 1

    def step(n: int, stage: str, outcome, when=F.lit(True)):
        return F.when(when, F.struct(F.lit(n).alias("step"), F.lit(stage).alias("stage"), outcome.alias("outcome")))

    trail = F.array_compact(F.array(
        step(1, "Input Validation", F.lit("PASS")),
        step(2, "Feature Scaling", F.lit("PASS")),
        step(3, "Binary Classifier", F.when(attack, F.lit("ATTACK")).otherwise(F.lit("NORMAL"))),
        step(4, "Multi-class Model", F.col("kind"), attack),
        step(5, "Policy Lookup", F.col("policy_action"), attack),
        step(6, "Final Action", D.served_action("pred", "confidence")),
    ))
    return s.select("flow_id", F.explode(trail).alias("e")).select("flow_id", "e.*")
