"""Parquet tables of a folder and the flow-shaped views derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.functions.numbers import INF
from flowguard.streaming.flows import flow_features

ATTACK_NAMES = ["Bot", "DDoS", "Heartbleed", "Infiltration", "PortScan"]
VEC_DIMS = 64
EVENT_KINDS = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def flow_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Wide labelled rows; the first six columns together are a key."""
    li = table(spark, folder, "lineitem")
    label = (
        F.when(F.col("l_returnflag") == "N", F.lit("BENIGN"))
        .when(F.col("l_returnflag") == "A", F.lit("DDoS"))
        .otherwise(F.lit("PortScan"))
    )
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.col("l_quantity").alias("duration"),
        F.col("l_extendedprice").alias("bytes"),
        F.col("l_discount").alias("rate"),
        F.col("l_tax").alias("flag"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("bytes_per_unit"),
        label.alias("label"),
        F.when(F.col("l_returnflag") == "N", 0).otherwise(1).alias("binary"),
    )


FLOW_ROW_FEATURES = ["duration", "bytes", "rate", "flag", "bytes_per_unit"]
FLOW_ROW_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "duration", "bytes"]


def event_flows(spark: SparkSession, folder: str) -> DataFrame:
    """One flow per user and day, with timing, volume and rate features."""
    ev = table(spark, folder, "events").withColumn(
        "flow_id", F.col("user_id") * 1000 + F.dayofyear("ts")
    )
    flows = flow_features(
        ev, key="flow_id", ts="ts", order="event_id", slice_seconds=60, value="value",
        kind="event_type", kinds=EVENT_KINDS,
        extra={"source_day": (F.min(F.date_trunc("day", F.col("ts"))), F.min)},
    )
    label = (
        F.when(F.col("has_error") == 1, F.lit("DDoS"))
        .when(F.col("has_signup") == 1, F.lit("PortScan"))
        .when(F.col("has_purchase") == 1, F.lit("Infiltration"))
        .otherwise(F.lit("BENIGN"))
    )
    return flows.select(
        "flow_id", "n_events",
        F.round("duration_s", 6).alias("duration_s"),
        F.round("iat_mean", 9).alias("iat_mean"),
        F.round("iat_std", 3).alias("iat_std"),
        F.round("iat_min", 6).alias("iat_min"),
        F.round("iat_max", 6).alias("iat_max"),
        F.round("value_sum", 4).alias("value_sum"),
        F.round("value_mean", 6).alias("value_mean"),
        "n_types",
        F.when(F.col("events_per_s") == INF, F.lit(INF)).otherwise(F.round("events_per_s", 6)).alias("events_per_s"),
        "source_day",
        label.alias("label"),
        F.when(label == "BENIGN", 0).otherwise(1).alias("binary"),
    )


EVENT_FLOW_FEATURES = [
    "n_events", "duration_s", "iat_mean", "iat_std", "iat_min", "iat_max",
    "value_sum", "value_mean", "n_types", "events_per_s",
]


def vec_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Dense vectors with a class and a binary label."""
    e = table(spark, folder, "embeddings")
    features = [F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(VEC_DIMS)]
    return e.select("vec_id", "label", (F.col("label") >= 5).cast("int").alias("binary"), *features)


VEC_FEATURES = [f"f{i}" for i in range(VEC_DIMS)]


def class_scores(id_col: str) -> list[Column]:
    """Integer scores of the attack classes for a row id, arithmetic only."""
    return [F.pmod(F.col(id_col) * (j + 3) + 7, F.lit(101)) + 1 for j in range(len(ATTACK_NAMES))]


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Events with a deterministic attack score and class-probability map."""
    return scored_columns(table(spark, folder, "events"))


def scored_columns(ev: DataFrame) -> DataFrame:
    """Score columns from event columns, row by row."""
    s = class_scores("event_id")
    total = s[0] + s[1] + s[2] + s[3] + s[4]
    entries = [x for name, v in zip(ATTACK_NAMES, s) for x in (F.lit(name), F.round(v / total, 6))]
    best = F.greatest(*s)
    predicted = F.when(s[0] == best, F.lit(ATTACK_NAMES[0]))
    for name, v in zip(ATTACK_NAMES[1:], s[1:]):
        predicted = predicted.when(v == best, F.lit(name))
    truth = (
        F.when(F.col("event_type") == "click", F.lit("Bot"))
        .when(F.col("event_type") == "error", F.lit("DDoS"))
        .when(F.col("event_type") == "view", F.lit("Heartbleed"))
        .when(F.col("event_type") == "purchase", F.lit("Infiltration"))
        .otherwise(F.lit("PortScan"))
    )
    p = F.round(F.col("value") / (F.col("value") + 50), 4)
    return ev.select(
        F.col("event_id").alias("flow_id"), "ts", "user_id", "value",
        (F.col("event_type") == "error").cast("int").alias("y"),
        p.alias("p"),
        (p >= 0.5).cast("int").alias("pred"),
        F.when(p >= 0.5, p).otherwise(1 - p).alias("confidence"),
        truth.alias("class_true"),
        predicted.alias("class_pred"),
        F.create_map(*entries).alias("proba"),
    )


def labelled_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Shape of the labelled texts: length, letter and digit share, distinct-token ratio."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    text = F.col("text")
    tokens = F.split(text, " ")
    n = F.greatest(F.length(text), F.lit(1))
    return (
        docs.select("doc_id", "text", "n_chars")
        .join(labels, "doc_id")
        .select(
            "doc_id",
            F.col("n_chars").cast("double").alias("n_chars"),
            F.round(F.length(F.regexp_replace(text, "[^A-Za-z ]", "")) / n, 6).alias("letter_share"),
            F.round(F.length(F.regexp_replace(text, "[^0-9]", "")) / n, 6).alias("digit_share"),
            F.round(F.size(F.array_distinct(tokens)) / F.size(tokens), 6).alias("distinct_ratio"),
            "quality", "toxic",
        )
    )


DOC_FEATURES = ["n_chars", "letter_share", "digit_share", "distinct_ratio"]


def dirty_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Events with faults put in by id: NaN, both infinities, nulls and exact copies."""
    ev = table(spark, folder, "events")
    i = F.col("event_id")
    value = (
        F.when(i % 37 == 0, F.lit(float("nan")))
        .when(i % 41 == 0, F.lit(INF))
        .when(i % 43 == 0, F.lit(-INF))
        .when(i % 47 == 0, F.lit(None).cast("double"))
        .otherwise(F.col("value"))
    )
    copies = F.when(i % 53 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        ev.select(
            i.alias("flow_id"), value.alias("value"), F.col("user_id").cast("double").alias("user_id"),
            F.col("event_type").alias("label"), F.explode(copies).alias("_copy"),
        ).drop("_copy")
    )


def json_flows(spark: SparkSession, folder: str) -> DataFrame:
    """Payload texts of six shapes: wrapped, bare, empty, non-numeric, batch, cut off."""
    ev = table(spark, folder, "events")
    i, body = F.col("event_id"), F.col("props")
    text = (
        F.when(i % 6 == 0, F.concat(F.lit('{"features": '), body, F.lit("}")))
        .when(i % 6 == 1, body)
        .when(i % 6 == 2, F.lit("{}"))
        .when(i % 6 == 3, F.lit('{"k": "fast"}'))
        .when(i % 6 == 4, F.concat(F.lit("["), body, F.lit(","), body, F.lit("]")))
        .otherwise(F.expr("substring(props, 1, length(props) - 1)"))
    )
    return ev.select(i.alias("event_id"), text.alias("payload"))


def request_log(spark: SparkSession, folder: str) -> DataFrame:
    ev = table(spark, folder, "events")
    return ev.select(
        "event_id", "ts",
        F.col("event_type").alias("level"),
        F.col("value").alias("latency_ms"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        (F.col("user_id") * 1.0).alias("cpu"),
    )
