"""SQL text of the flow-shaped views, for the SQL twins of the queries."""

FLOW_ROWS = """flow_rows as (
  select l_orderkey, l_partkey, l_suppkey, l_linenumber,
    l_quantity as duration, l_extendedprice as bytes, l_discount as rate, l_tax as flag,
    l_extendedprice / l_quantity as bytes_per_unit,
    case l_returnflag when 'N' then 'BENIGN' when 'A' then 'DDoS' else 'PortScan' end as label,
    case when l_returnflag = 'N' then 0 else 1 end as "binary"
  from lineitem)"""

EVENT_FLOWS = """gaps as (
  select *, user_id * 1000 + dayofyear(ts) as flow_id,
    date_diff('microsecond', lag(ts) over (partition by user_id, dayofyear(ts) order by ts, event_id), ts) as gap
  from events),
merged as (
  select flow_id, count(*) as n_events,
    date_diff('microsecond', min(ts), max(ts)) as span,
    stddev_pop(gap) as gap_std, min(gap) as gap_min, max(gap) as gap_max,
    sum(value) as value_sum, count(distinct event_type) as n_types,
    max(case when event_type = 'error' then 1 else 0 end) as has_error,
    max(case when event_type = 'signup' then 1 else 0 end) as has_signup,
    max(case when event_type = 'purchase' then 1 else 0 end) as has_purchase,
    min(date_trunc('day', ts))::timestamp as source_day
  from gaps group by flow_id),
event_flows as (
  select flow_id, n_events,
    round(span / 1e6, 6) as duration_s,
    round(case when n_events > 1 then span / 1e6 / (n_events - 1) end, 9) as iat_mean,
    round(gap_std / 1e6, 3) as iat_std,
    round(gap_min / 1e6, 6) as iat_min,
    round(gap_max / 1e6, 6) as iat_max,
    round(value_sum, 4) as value_sum,
    round(value_sum / n_events, 6) as value_mean,
    n_types,
    case when span > 0 then round(n_events / (span / 1e6), 6) else 'inf'::double end as events_per_s,
    source_day,
    case when has_error = 1 then 'DDoS' when has_signup = 1 then 'PortScan'
         when has_purchase = 1 then 'Infiltration' else 'BENIGN' end as label,
    case when has_error = 1 or has_signup = 1 or has_purchase = 1 then 1 else 0 end as "binary"
  from merged)"""

VEC_ROWS = (
    "vec_rows as (\n  select vec_id, label, case when label >= 5 then 1 else 0 end as \"binary\", "
    + ", ".join(f"embedding[{i + 1}]::double as f{i}" for i in range(64))
    + "\n  from embeddings)"
)

SCORED = """raw_scores as (
  select *, round(value / (value + 50), 4) as p0,
    (event_id * 3 + 7) % 101 + 1 as s0, (event_id * 4 + 7) % 101 + 1 as s1,
    (event_id * 5 + 7) % 101 + 1 as s2, (event_id * 6 + 7) % 101 + 1 as s3,
    (event_id * 7 + 7) % 101 + 1 as s4
  from events),
scored as (
  select event_id as flow_id, ts, user_id, value,
    case when event_type = 'error' then 1 else 0 end as y,
    p0 as p, case when p0 >= 0.5 then 1 else 0 end as pred,
    case when p0 >= 0.5 then p0 else 1 - p0 end as confidence,
    case event_type when 'click' then 'Bot' when 'error' then 'DDoS' when 'view' then 'Heartbleed'
      when 'purchase' then 'Infiltration' else 'PortScan' end as class_true,
    case greatest(s0, s1, s2, s3, s4) when s0 then 'Bot' when s1 then 'DDoS' when s2 then 'Heartbleed'
      when s3 then 'Infiltration' else 'PortScan' end as class_pred,
    round(s0 / (s0 + s1 + s2 + s3 + s4), 6) as q0, round(s1 / (s0 + s1 + s2 + s3 + s4), 6) as q1,
    round(s2 / (s0 + s1 + s2 + s3 + s4), 6) as q2, round(s3 / (s0 + s1 + s2 + s3 + s4), 6) as q3,
    round(s4 / (s0 + s1 + s2 + s3 + s4), 6) as q4
  from raw_scores)"""

PROBA_LONG = """proba_long as (
  select flow_id, class_true, class_pred, unnest(['Bot', 'DDoS', 'Heartbleed', 'Infiltration', 'PortScan']) as class,
    unnest([q0, q1, q2, q3, q4]) as q
  from scored)"""

LABELLED_DOCS = """labelled_docs as (
  select d.doc_id, n_chars::double as n_chars,
    round(length(regexp_replace(text, '[^A-Za-z ]', '', 'g')) / greatest(length(text), 1), 6) as letter_share,
    round(length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(length(text), 1), 6) as digit_share,
    round(len(list_distinct(string_split(text, ' '))) / len(string_split(text, ' ')), 6) as distinct_ratio,
    quality, toxic
  from documents d join labels l on d.doc_id = l.doc_id)"""

DIRTY_ROWS = """dirty_rows as (
  select event_id as flow_id,
    case when event_id % 37 = 0 then 'nan'::double when event_id % 41 = 0 then 'inf'::double
         when event_id % 43 = 0 then '-inf'::double when event_id % 47 = 0 then null else value end as value,
    user_id::double as user_id, event_type as label
  from (select * from events union all select * from events where event_id % 53 = 0))"""

JSON_FLOWS = """json_flows as (
  select event_id,
    case event_id % 6 when 0 then '{"features": ' || props || '}' when 1 then props when 2 then '{}'
      when 3 then '{"k": "fast"}' when 4 then '[' || props || ',' || props || ']'
      else substring(props, 1, length(props) - 1) end as payload
  from events)"""

REQUEST_LOG = """request_log as (
  select event_id, ts, event_type as level, value as latency_ms,
    case when event_type = 'error' then 500 else 200 end as status, user_id * 1.0 as cpu
  from events)"""

POLICY = """policy as (
  select * from (values ('ddos', 'DENY'), ('dos goldeneye', 'DENY'), ('dos hulk', 'DENY'),
    ('dos slowhttptest', 'DENY'), ('dos slowloris', 'DENY'), ('portscan', 'DENY'), ('ftp-patator', 'DENY'),
    ('ssh-patator', 'DENY'), ('bot', 'DENY'), ('web attack - brute force', 'QUARANTINE'),
    ('web attack - xss', 'QUARANTINE'), ('web attack - sql injection', 'QUARANTINE'),
    ('infiltration', 'QUARANTINE'), ('heartbleed', 'QUARANTINE')) t(class_key, action))"""

SCATTER = "(((({id}) % 2147483648) * 2654435761 + {seed}) % 4294967296)"


def scatter_sql(id_expr: str, seed: int = 0) -> str:
    return SCATTER.format(id=id_expr, seed=seed)


def with_views(*views: str) -> str:
    return "with " + ",\n".join(views) + "\n"
