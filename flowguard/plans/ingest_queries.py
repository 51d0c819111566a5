"""Queries over sources and sinks: each writes what it reads back, from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowguard.functions.labels import safe_name
from flowguard.operators import clean, joins, split
from flowguard.plans.cascade import decide, flat_decisions
from flowguard.plans.decision_queries import event_scores
from flowguard.plans.fixture_sql import (
    DIRTY_ROWS, EVENT_FLOWS, FLOW_ROWS, JSON_FLOWS, LABELLED_DOCS, SCORED, scatter_sql, with_views,
)
from flowguard.plans.registry import query
from flowguard.session import work_folder
from flowguard.sources import files, payloads
from flowguard.sources.tables import (
    FLOW_ROW_FEATURES, dirty_rows, event_flows, flow_rows, json_flows, labelled_docs, scored, table,
)

DAY_SCHEMA = T.StructType([
    T.StructField("flow_id", T.LongType()), T.StructField("duration", T.DoubleType()),
    T.StructField("n_events", T.DoubleType()), T.StructField("Label", T.StringType()),
])


def _write_days(spark: SparkSession, d: str) -> str:
    """All events as one CSV folder per weekday, with blanks in the header, as raw captures have."""
    raw = table(spark, d, "events").select(
        F.col("event_id").alias("flow_id"), F.col("value").alias(" duration"),
        F.col("user_id").cast("double").alias(" n_events"), F.col("event_type").alias(" Label"),
        F.dayofweek("ts").alias("day"),
    )
    path = work_folder(spark, "days")
    raw.write.partitionBy("day").option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    return path


@query("day_file_union", """
select event_id as flow_id, value as duration, user_id::double as n_events, event_type as Label from events""")
def day_file_union(spark: SparkSession, d: str) -> DataFrame:
    path = _write_days(spark, d)
    train, test = range(1, 6), range(4, 8)  # the pools overlap; every day is still read once
    return files.read_day_files(spark, [f"{path}/day={i}" for i in [*train, *test]], DAY_SCHEMA)


@query("mixed_schema_union", """
select event_id as flow_id, value as duration,
  case when dayofweek(ts) >= 5 then null else user_id::double end as n_events,
  case when dayofweek(ts) >= 5 then null else event_type end as Label from events""")
def mixed_schema_union(spark: SparkSession, d: str) -> DataFrame:
    path = _write_days(spark, d)
    short = T.StructType(DAY_SCHEMA.fields[:2])
    return files.read_mixed_days(spark, {f"{path}/day={i}": DAY_SCHEMA if i <= 5 else short for i in range(1, 8)})


@query("header_trim", "select l_orderkey as order_id, l_quantity as duration from lineitem")
def header_trim(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("  order_id"), F.col("l_quantity").alias(" duration "))
    return clean.strip_headers(raw)


@query("source_day_split", with_views(EVENT_FLOWS) + """
select case when day(source_day) > 20 then 'test' else 'train' end as split, source_day, count(*) as n_rows
from event_flows group by 1, 2""")
def source_day_split(spark: SparkSession, d: str) -> DataFrame:
    flows = event_flows(spark, d).withColumn("day_no", F.dayofmonth("source_day"))
    parts = split.source_split(flows, "day_no", list(range(21, 32)))
    return parts.groupBy("split", "source_day").agg(F.count("*").alias("n_rows"))


@query("clean_training_table", with_views(DIRTY_ROWS) + """
, once as (select distinct flow_id, value, user_id, label from dirty_rows),
med as (select median(value) as m from once where not isnan(value) and not isinf(value))
select flow_id, case when value is null or isnan(value) or isinf(value) then m else value end as value, user_id, label,
  case when label = 'BENIGN' then 0 else 1 end as "binary"
from once, med""")
def clean_training_table(spark: SparkSession, d: str) -> DataFrame:
    raw = dirty_rows(spark, d).select(
        "flow_id", F.col("value").alias(" value"), F.col("user_id").alias(" user_id"), F.col("label").alias(" Label")
    )
    return files.build_clean_table(raw).select("flow_id", "value", "user_id", "label", "binary").withColumn(
        "flow_id", F.col("flow_id").cast("bigint")
    )


_SPLIT_SQL = f"""ranked as (
  select flow_id, y, p, row_number() over (partition by y order by {scatter_sql('flow_id', 42)}, flow_id) as rn,
    count(*) over (partition by y) as n
  from scored),
parts as (
  select flow_id, y, p, case when rn <= round(n * 0.15) then 'test'
    when rn <= round(n * 0.15) + round(n * 0.15) then 'val' else 'train' end as split
  from ranked)"""


@query("split_round_trip", with_views(SCORED, _SPLIT_SQL) + "select flow_id, y, p from parts where split = 'val'")
def split_round_trip(spark: SparkSession, d: str) -> DataFrame:
    parts = split.stratified_split(scored(spark, d).select("flow_id", "y", "p"), ["y"], ["flow_id"])
    path = work_folder(spark, "splits")
    files.write_splits(parts, path)
    return files.load_split(spark, path, "val")


@query("stratified_split", with_views(SCORED, _SPLIT_SQL) + "select flow_id, y, split from parts")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return split.stratified_split(scored(spark, d).select("flow_id", "y"), ["y"], ["flow_id"])


@query("label_split", with_views(EVENT_FLOWS) + f"""
, r as (select flow_id, label, row_number() over (partition by label order by {scatter_sql('flow_id', 42)}, flow_id) as rn,
    count(*) over (partition by label) as n from event_flows)
select flow_id, label, case when rn <= round(n * 0.2) then 'test' else 'train' end as split from r""")
def label_split(spark: SparkSession, d: str) -> DataFrame:
    flows = event_flows(spark, d).select("flow_id", "label")
    return split.stratified_split(flows, ["label"], ["flow_id"], test=0.2, val=0.0)


@query("hashed_split", f"""
select event_id, case when {scatter_sql('event_id', 42)} / 4294967296.0 < 0.15 then 'test'
  when {scatter_sql('event_id', 42)} / 4294967296.0 < 0.3 then 'val' else 'train' end as split from events""")
def hashed_split(spark: SparkSession, d: str) -> DataFrame:
    return split.hashed_split(table(spark, d, "events").select("event_id"), "event_id")


@query("json_payloads", with_views(JSON_FLOWS) + """
select event_id, case when event_id % 6 in (0, 1) then cast(regexp_extract(payload, '"k": ([0-9]+)', 1) as double) end as k,
  case event_id % 6 when 0 then null when 1 then null when 2 then 'empty features' when 3 then 'invalid value'
    else 'invalid json' end as reject_reason
from json_flows""")
def json_payloads(spark: SparkSession, d: str) -> DataFrame:
    parsed = payloads.parse_flows(json_flows(spark, d), "payload")
    return parsed.select("event_id", F.try_element_at("features", F.lit("k")).alias("k"), "reject_reason")


@query("json_batches", with_views(JSON_FLOWS) + """
select event_id, unnest([0, 1]) as position, cast(regexp_extract(payload, '"k": ([0-9]+)', 1) as double) as k
from json_flows where event_id % 6 = 4""")
def json_batches(spark: SparkSession, d: str) -> DataFrame:
    flows = payloads.explode_batch(json_flows(spark, d), "payload", ["event_id"]).where("reject_reason is null")
    return flows.select("event_id", "position", F.try_element_at("features", F.lit("k")).alias("k"))


@query("json_batch_rejects", with_views(JSON_FLOWS) + """
select event_id, cast(null as integer) as position, case when event_id % 6 = 5 then 'invalid json' else 'no flows' end as reject_reason
from json_flows where event_id % 6 <> 4""")
def json_batch_rejects(spark: SparkSession, d: str) -> DataFrame:
    flows = payloads.explode_batch(json_flows(spark, d), "payload", ["event_id"])
    return flows.where("reject_reason is not null").select("event_id", "position", "reject_reason")


@query("missing_features", with_views(JSON_FLOWS) + """
select event_id, case when event_id % 2 = 0 then '' else 'rate' end as missing from json_flows where event_id % 6 in (0, 1)""")
def missing_features(spark: SparkSession, d: str) -> DataFrame:
    parsed = payloads.parse_flows(json_flows(spark, d), "payload").where("features is not null")
    grown = parsed.withColumn(
        "features",
        F.when(F.col("event_id") % 2 == 0, F.map_concat("features", F.create_map(F.lit("rate"), F.lit(1.0))))
        .otherwise(F.col("features")),
    )
    return grown.select("event_id", F.concat_ws(",", payloads.missing_features("features", ["k", "rate"])).alias("missing"))


@query("batch_upload", """
select event_id, value, user_id::double as user_id, 0.0::double as rate from events""")
def batch_upload(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").select("event_id", F.col("user_id").cast("double").alias("user_id"), "value", "props")
    path = work_folder(spark, "upload")
    ev.write.option("header", True).csv(path)
    schema = T.StructType.fromDDL("event_id bigint, user_id double, value double, props string")
    return files.read_batch_csv(spark, path, schema, ["value", "user_id", "rate"]).drop("props")


def _decided(spark: SparkSession, d: str) -> DataFrame:
    s = event_scores(spark, d).select(
        "flow_id", "anomaly", F.col("pred").alias("binary_pred"), F.col("p").alias("p_attack"),
        F.col("proba").alias("attack_proba"), F.col("class_pred").alias("attack_type"),
    )
    return decide(s, ["flow_id"])


@query("decision_csv_sink", with_views(SCORED) + """
select flow_id, case when pred = 1 and confidence >= 0.85 then 'DENY' when pred = 0 and confidence >= 0.8 then 'ALLOW'
    else 'QUARANTINE' end as action, pred as binary_pred, round(confidence, 6) as confidence,
  case when pred = 1 then class_pred end as attack_type
from scored""")
def decision_csv_sink(spark: SparkSession, d: str) -> DataFrame:
    flat = flat_decisions(_decided(spark, d), ["flow_id"])
    path = work_folder(spark, "decisions")
    files.write_decisions_csv(flat.select("flow_id", "action", "binary_pred", "confidence", "attack_type"), path)
    schema = "flow_id bigint, action string, binary_pred int, confidence double, attack_type string"
    back = spark.read.schema(schema).option("header", True).csv(path)
    return back.withColumn("confidence", F.round("confidence", 6))


@query("feedback_log_sink", with_views(SCORED) + f"""
select flow_id, 'Attack' as prediction, class_pred as attack_type,
  case when confidence >= 0.6 then 'HIGH' else 'MEDIUM' end as risk_level, true as stamped
from scored where pred = 1 and {scatter_sql('flow_id')} < 858993459""")
def feedback_log_sink(spark: SparkSession, d: str) -> DataFrame:
    path = work_folder(spark, "feedback")
    files.append_feedback(files.feedback_rows(_decided(spark, d), "flow_id"), path)
    schema = ("flow_id bigint, prediction string, attack_type string, timestamp string, "
              "trust struct<trust_score:double,risk_level:string>")
    back = spark.read.schema(schema).json(path)
    return back.select("flow_id", "prediction", "attack_type", F.col("trust.risk_level").alias("risk_level"),
                       F.col("timestamp").isNotNull().alias("stamped"))


@query("scenario_documents", """
select event_type as label, 'high' as risk, count(*) as n_docs,
  max(event_id) as last_index
from events where event_id % 4 <> 3 and event_id % 5 <> 0 group by 1""")
def scenario_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents of all events; some unvalidated, some without a required feature, are skipped."""
    from flowguard.functions.labels import scenario_risk

    ev = table(spark, d, "events")
    i = F.col("event_id")
    features = F.map_filter(
        F.create_map(F.lit("value"), F.col("value"), F.lit("user"), F.col("user_id").cast("double")),
        lambda k, v: (k != "user") | (i % 5 != 0),
    )
    docs = ev.select(
        F.col("event_type").alias("label"), (i % 4 != 3).alias("validated"), i.alias("source_index"),
        F.struct(F.col("event_type").alias("attack_type"), F.lit("DENY").alias("action")).alias("expected"),
        features.alias("features"),
    )
    path = work_folder(spark, "scenarios")
    files.write_scenarios(docs, path)
    good, _ = files.read_scenarios(spark, f"{path}/safe_label=*/*.json", ["value", "user"])
    return good.groupBy("label").agg(
        F.first(scenario_risk("label")).alias("risk"), F.count("*").alias("n_docs"), F.max("source_index").alias("last_index")
    )


@query("result_table_sink", """
select 'demo' as run, 'all' as split, event_type as class, 'support' as metric, count(*)::double as value from events group by event_type""")
def result_table_sink(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").groupBy(F.col("event_type").alias("class")).agg(F.count("*").cast("double").alias("value"))
    rows = ev.select(F.lit("demo").alias("run"), F.lit("all").alias("split"), "class", F.lit("support").alias("metric"), "value")
    path = work_folder(spark, "results")
    files.append_results(rows, path)
    return spark.read.schema("run string, split string, class string, metric string, value double").json(path)


# --- column contracts and repair -----------------------------------------------------------


@query("label_columns", 'select l_quantity as duration, l_returnflag as label, case when l_returnflag = \'N\' then 0 else 1 end as "binary" from lineitem')
def label_columns(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return clean.normalise_labels(li.select(
        F.col("l_quantity").alias("duration"), F.col("l_returnflag").alias("Label"),
        F.when(F.col("l_returnflag") == "N", 0).otherwise(1).alias("Binary"),
    ))


@query("feature_matrix", with_views(FLOW_ROWS) + "select bytes, duration, rate from flow_rows")
def feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Labels split off, text columns dropped, features put in model order."""
    rows = flow_rows(spark, d).withColumn("note", F.lit("text"))
    features, _ = clean.split_features(rows, ["label", "binary"])
    numeric = features.select(*clean.numeric_columns(features))
    return clean.project(numeric, ["bytes", "duration", "rate"])


@query("infinite_to_null", with_views(DIRTY_ROWS) + """
select flow_id, case when isnan(value) or isinf(value) then null else value end as value from dirty_rows""")
def infinite_to_null(spark: SparkSession, d: str) -> DataFrame:
    return clean.nullify_infinite(dirty_rows(spark, d).select("flow_id", "value"), ["value"])


@query("median_imputation", with_views(EVENT_FLOWS) + """
, m as (select median(iat_mean) as a, median(case when isinf(events_per_s) then null else events_per_s end) as b from event_flows)
select flow_id, coalesce(iat_mean, a) as iat_mean, case when isinf(events_per_s) then b else events_per_s end as events_per_s
from event_flows, m""")
def median_imputation(spark: SparkSession, d: str) -> DataFrame:
    flows = event_flows(spark, d).select("flow_id", "iat_mean", "events_per_s")
    return clean.repair(flows, ["iat_mean", "events_per_s"])


@query("train_only_imputation", with_views(SCORED, _SPLIT_SQL) + """
, m as (select median(p) as a from parts where split = 'train' and flow_id % 3 <> 0)
select flow_id, case when flow_id % 3 = 0 then a else p end as p from parts, m""")
def train_only_imputation(spark: SparkSession, d: str) -> DataFrame:
    holed = scored(spark, d).select("flow_id", "y", F.when(F.col("flow_id") % 3 != 0, F.col("p")).alias("p"))
    parts = split.stratified_split(holed, ["y"], ["flow_id"])
    return clean.repair(parts, ["p"], fit_on=parts.where("split = 'train'")).select("flow_id", "p")


@query("zero_fill_absent", with_views(FLOW_ROWS) + "select bytes, 0.0::double as idle, duration from flow_rows")
def zero_fill_absent(spark: SparkSession, d: str) -> DataFrame:
    return clean.zero_fill_absent(flow_rows(spark, d), ["bytes", "idle", "duration"])


@query("duplicate_removal", with_views(DIRTY_ROWS) + "select distinct flow_id, value, user_id, label from dirty_rows")
def duplicate_removal(spark: SparkSession, d: str) -> DataFrame:
    return clean.drop_copies(dirty_rows(spark, d))


@query("row_validation", with_views(DIRTY_ROWS) + """
select case when value is null or isnan(value) or isinf(value) then 'value' end as reject_feature, count(*) as n_rows,
  sum(flow_id)::bigint as id_sum
from dirty_rows group by 1""")
def row_validation(spark: SparkSession, d: str) -> DataFrame:
    good, bad = clean.split_valid(dirty_rows(spark, d), ["user_id", "value"])
    both = good.withColumn("reject_feature", F.lit(None).cast("string")).unionByName(bad)
    return both.groupBy("reject_feature").agg(F.count("*").alias("n_rows"), F.sum("flow_id").alias("id_sum"))


@query("vector_validation", """
select event_id, case when event_id % 5 = 0 then 'length' when event_id % 7 = 0 then 'value' end as reject_reason from events""")
def vector_validation(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    second = F.when(i % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    vec = F.when(i % 5 == 0, F.array("value")).otherwise(F.array(F.col("value"), second))
    return table(spark, d, "events").select("event_id", clean.vector_fault(vec, 2).alias("reject_reason"))


@query("storage_types", with_views(FLOW_ROWS) + """
select round(rate::float::double, 4) as rate, "binary"::int as "binary", label::varchar as label from flow_rows""")
def storage_types(spark: SparkSession, d: str) -> DataFrame:
    typed = clean.cast_for_sink(flow_rows(spark, d).select("rate", "binary", "label"), ["rate"])
    return typed.withColumn("rate", F.round(F.col("rate").cast("double"), 4))


_ATTACKS = """marked as (
  select flow_id, case when flow_id % 10 = 0 then ' benign ' else class_true end as label, y as "binary" from scored)"""


def _marked(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("flow_id") % 10 == 0, F.lit(" benign ")).otherwise(F.col("class_true"))
    return scored(spark, d).select("flow_id", label.alias("label"), F.col("y").alias("binary"))


@query("attack_filter", with_views(SCORED, _ATTACKS) + """
select flow_id, label from marked where "binary" = 1 and upper(trim(label)) <> 'BENIGN'""")
def attack_filter(spark: SparkSession, d: str) -> DataFrame:
    return clean.attacks_only(_marked(spark, d)).select("flow_id", "label")


@query("stray_benign_rows", with_views(SCORED, _ATTACKS) + """
select count(*) as n_rows from marked where "binary" = 1 and upper(trim(label)) = 'BENIGN'""")
def stray_benign_rows(spark: SparkSession, d: str) -> DataFrame:
    return clean.stray_benign(_marked(spark, d)).agg(F.count("*").alias("n_rows"))


@query("label_set_filter", with_views(SCORED) + "select flow_id, class_true from scored where class_true in ('Bot', 'PortScan')")
def label_set_filter(spark: SparkSession, d: str) -> DataFrame:
    return clean.only_labels(scored(spark, d).select("flow_id", "class_true"), "class_true", ["Bot", "PortScan"])


# --- joins and sets ---------------------------------------------------------------------------


_POOLS = """pools as (select flow_id, class_true, class_pred, case when day(ts) <= 20 then 'train' else 'test' end as split from scored)"""


def _pools(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).withColumn("day_no", F.dayofmonth("ts"))
    return split.source_split(s, "day_no", list(range(21, 32)))


@query("known_class_rows", with_views(SCORED, _POOLS) + """
select flow_id, class_true from pools where split = 'test'
  and class_true in (select class_pred from pools where split = 'train' and class_pred <> 'Bot')""")
def known_class_rows(spark: SparkSession, d: str) -> DataFrame:
    s = _pools(spark, d)
    seen = s.where("split = 'train' and class_pred <> 'Bot'").select(F.col("class_pred").alias("class_true"))
    return joins.known_classes(s.where("split = 'test'").select("flow_id", "class_true"), "class_true", seen)


@query("unseen_class_counts", with_views(SCORED, _POOLS) + """
select class_true, count(*) as n_rows from pools where split = 'test'
  and class_true not in (select class_pred from pools where split = 'train' and class_pred in ('DDoS', 'PortScan')) group by 1""")
def unseen_class_counts(spark: SparkSession, d: str) -> DataFrame:
    s = _pools(spark, d)
    seen = s.where("split = 'train' and class_pred in ('DDoS', 'PortScan')").select(F.col("class_pred").alias("class_true"))
    return joins.unseen_classes(s.where("split = 'test'"), "class_true", seen)


@query("label_encoding", with_views(SCORED) + """
, enc as (select label, row_number() over (order by label) - 1 as class_index from (select distinct class_true as label from scored))
select flow_id, class_index::int as class_index, e2.label as decoded
from scored s join enc e on s.class_true = e.label join enc e2 using (class_index)""")
def label_encoding(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).select("flow_id", "class_true")
    enc = joins.encode_labels(s, "class_true")
    coded = joins.with_class_index(s, "class_true", enc)
    return joins.decode_index(coded.drop("class_true"), "class_index", enc, "class_true", "decoded")


@query("feature_label_alignment", with_views(LABELLED_DOCS) + "select * from labelled_docs")
def feature_label_alignment(spark: SparkSession, d: str) -> DataFrame:
    return labelled_docs(spark, d)


@query("pool_union", """
select user_id, event_type from events where day(ts) <= 20 union all select user_id, event_type from events where day(ts) > 20""")
def pool_union(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    train = ev.where(F.dayofmonth("ts") <= 20).select("user_id", "event_type")
    test = ev.where(F.dayofmonth("ts") > 20).select("event_type", "user_id")
    return train.unionByName(test)


_CAPS = {"Bot": 120, "DDoS": 40, "PortScan": 5000}


@query("class_sample_union", with_views(SCORED) + f"""
, r as (select flow_id, class_true, row_number() over (partition by class_true order by {scatter_sql('flow_id', 42)}, flow_id) as rn from scored)
select flow_id, class_true from r where rn <= case class_true when 'Bot' then 120 when 'DDoS' then 40 when 'PortScan' then 5000 else 0 end""")
def class_sample_union(spark: SparkSession, d: str) -> DataFrame:
    from flowguard.functions.numbers import scatter

    s = scored(spark, d).select("flow_id", "class_true")
    return split.capped_union(s, "class_true", scatter("flow_id", 42), ["flow_id"], _CAPS)


@query("balanced_subsample", with_views(SCORED) + f"""
, r as (select flow_id, y, row_number() over (partition by y order by {scatter_sql('flow_id', 42)}, flow_id) as rn from scored)
select flow_id, y from r where rn <= 1500""")
def balanced_subsample(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).select("flow_id", "y")
    return split.balanced_sample(s, "y", "flow_id", per_class=1500, when_above=3000)


@query("seeded_row_sample", f"select event_id from events order by {scatter_sql('event_id', 42)}, event_id limit 700")
def seeded_row_sample(spark: SparkSession, d: str) -> DataFrame:
    return split.row_sample(table(spark, d, "events").select("event_id"), "event_id", 700)


@query("pick_per_group", with_views(EVENT_FLOWS) + f"""
, r as (select *, row_number() over (partition by label order by {scatter_sql('flow_id', 7)}, flow_id) as rn from event_flows)
select label, flow_id, n_events, value_sum from r where rn = 1""")
def pick_per_group(spark: SparkSession, d: str) -> DataFrame:
    from flowguard.functions.numbers import scatter

    flows = event_flows(spark, d).select("label", "flow_id", "n_events", "value_sum")
    return split.one_per_group(flows, "label", [scatter("flow_id", 7), F.col("flow_id")])


@query("pick_with_fallback", with_views(EVENT_FLOWS) + """
select 'listed' as pick, flow_id, label from (select * from event_flows where label in ('PortScan', 'Infiltration') order by flow_id limit 1)
union all select 'fallback', flow_id, label from (select * from event_flows order by flow_id limit 1)""")
def pick_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    flows = event_flows(spark, d).select("flow_id", "label")
    listed = split.pick_or_first(flows, "label", ["PortScan", "Infiltration"], ["flow_id"])
    fallback = split.pick_or_first(flows, "label", ["Heartbleed"], ["flow_id"])
    return listed.select(F.lit("listed").alias("pick"), "*").union(fallback.select(F.lit("fallback").alias("pick"), "*"))


@query("first_row_preview", "select event_id, user_id, value from events order by event_id limit 10")
def first_row_preview(spark: SparkSession, d: str) -> DataFrame:
    from flowguard.operators.report import first_rows

    return first_rows(table(spark, d, "events").select("event_id", "user_id", "value"), ["event_id"])


@query("scenario_names", "select distinct replace(replace(event_type || ' v.1', ' ', '_'), '.', '') as safe_name from events")
def scenario_names(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "events").select(F.concat("event_type", F.lit(" v.1")).alias("label"))
    return names.select(safe_name("label").alias("safe_name")).distinct()
