"""JSON payloads: single flows, batches, and the response they lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RAW_MAP = "map<string,string>"


def _flow_fault(raw: str, numbers: str) -> Column:
    """Why a parsed flow is rejected, null if it is not."""
    bad_value = F.exists(F.map_values(numbers), lambda v: v.isNull())
    return (
        F.when(F.col(raw).isNull(), F.lit("invalid json"))
        .when(F.size(raw) == 0, F.lit("empty features"))
        .when(bad_value, F.lit("invalid value"))
    )


def parse_flows(df: DataFrame, payload: str) -> DataFrame:
    """Add ``features`` (map of doubles) and ``reject_reason``.

    A bare object is taken as the feature map itself. Rejected: text that is no JSON object, an
    empty map, a value that is no number.
    """
    text = F.col(payload)
    # A nested object comes out of the outer map as its text; it is parsed only where it exists.
    outer = df.withColumn("_root", F.when(F.ltrim(text).startswith("{"), F.from_json(text, RAW_MAP)))
    inner = F.try_element_at("_root", F.lit("features"))
    staged = outer.withColumn(
        "_raw",
        F.when(F.map_contains_key("_root", "features"), F.when(inner.startswith("{"), F.from_json(inner, RAW_MAP)))
        .otherwise(F.col("_root")),
    ).withColumn("_num", F.transform_values("_raw", lambda _, v: v.try_cast("double")))
    reason = _flow_fault("_raw", "_num")
    return staged.withColumn("reject_reason", reason).withColumn(
        "features", F.when(F.col("reject_reason").isNull(), F.col("_num"))
    ).drop("_root", "_raw", "_num")


def explode_batch(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """``keep, position, features, reject_reason``: one row per flow of a batch text.

    A batch is a JSON list of objects or an object with such a list under ``flows``; an empty list gives
    no rows. A flow is rejected by the rules of ``parse_flows``, by itself. A batch that can't be read
    is one rejected row without position: ``invalid json``, or ``no flows`` for an object without a list.
    """
    text = F.ltrim(F.col(payload))
    staged = df.select(*keep, text.alias("_text"), F.when(text.startswith("{"), F.from_json(text, RAW_MAP)).alias("_root"))
    listed = F.when(F.col("_text").startswith("["), F.col("_text")).otherwise(F.try_element_at("_root", F.lit("flows")))
    # The flows come out of the list as their texts, so one bad flow leaves the others whole.
    staged = staged.withColumn("_list", F.ltrim(listed)).withColumn(
        "_flows", F.when(F.col("_list").startswith("["), F.from_json("_list", "array<string>")))
    unread = F.when(F.col("_root").isNotNull() & ~F.coalesce(F.col("_list").startswith("["), F.lit(False)), F.lit("no flows")).when(
        F.col("_flows").isNull(), F.lit("invalid json"))
    flows = staged.withColumn("_unread", unread).where("_flows is null or size(_flows) > 0").select(
        *keep, "_unread", F.posexplode_outer("_flows").alias("position", "_flow"))
    parsed = flows.withColumn(
        "_raw", F.when(F.ltrim("_flow").startswith("{"), F.from_json("_flow", RAW_MAP))
    ).withColumn("_num", F.transform_values("_raw", lambda _, v: v.try_cast("double")))
    return parsed.withColumn("reject_reason", F.coalesce("_unread", _flow_fault("_raw", "_num"))).select(
        *keep, "position", F.when(F.col("reject_reason").isNull(), F.col("_num")).alias("features"), "reject_reason")


def missing_features(features: str, required: list[str]) -> Column:
    """Required names the map lacks, in required order."""
    return F.array_except(F.array(*[F.lit(r) for r in required]), F.map_keys(features))


def features_to_columns(df: DataFrame, features: str, required: list[str], keep: list[str]) -> DataFrame:
    return df.select(*keep, *[F.try_element_at(features, F.lit(r)).alias(r) for r in required])


def shaped_response() -> list[Column]:
    """Response columns with their defaults; numbers to 6 digits."""
    conf = F.col("confidence").cast("string").try_cast("double")
    return [
        F.coalesce("action", F.lit("UNKNOWN")).alias("action"),
        F.round(F.coalesce(conf, F.lit(0.0)), 6).alias("confidence"),
        "attack_type", "prediction",
        F.round("probability", 6).alias("probability"),
    ]
