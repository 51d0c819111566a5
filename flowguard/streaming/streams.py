"""Structured Streaming forms of scoring, feedback, action counts and rate checks.

Every transformation here takes a DataFrame and works on a stream and on a batch alike; only the
sources and ``run_available`` know about streams.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowguard.session import work_folder
from flowguard.streaming.keyed import KEY, VelocityEscalation, key_value, state_key

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet", files_per_batch: int = 1000) -> DataFrame:
    """Arriving event files, with ``ts`` as a zoned timestamp so it can carry a watermark.

    ``pattern`` names one file or a folder of part files inside ``folder``; a name that matches nothing is an
    error here, not a stream that waits for ever.
    """
    base = folder.rstrip("/")
    spark.read.schema(EVENT_SCHEMA).parquet(f"{base}/{pattern}")  # lists the files only; an error if there are none
    # A plain path has to be a directory for the file source; as a pattern the name may also be one file.
    name = pattern if set(pattern) & set("*?[{") else f"{{{pattern}}}"
    raw = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(f"{base}/{name}")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_on_disk(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB; one that goes on from a checkpoint keeps to its store."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS_DB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def run_available(stream: DataFrame, purpose: str, fmt: str = "parquet", path: str | None = None) -> DataFrame:
    """Process what has arrived, then stop; append to a file sink and read it back.

    Progress is in the checkpoint next to the sink, so a lost driver or executor resumes without
    loss or repetition.
    """
    spark = stream.sparkSession
    path = path or work_folder(spark, purpose)
    writer = (
        stream.writeStream.format(fmt).outputMode("append")
        .option("path", f"{path}/data").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    )
    with state_on_disk(spark):
        query = writer.start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).format(fmt).load(f"{path}/data")


def run_batches(stream: DataFrame, purpose: str, per_batch: Callable[[DataFrame], DataFrame], path: str | None = None) -> DataFrame:
    """``per_batch`` of every micro-batch, as a table with the batch's number in ``batch_id``.

    Each batch overwrites the folder of its own number, so one that is repeated after a failure changes nothing
    and a reader never sees it twice.
    """
    spark = stream.sparkSession
    path = path or work_folder(spark, purpose)

    def write(batch: DataFrame, batch_id: int) -> None:
        per_batch(batch).write.mode("overwrite").parquet(f"{path}/data/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    with state_on_disk(spark):
        query = writer.start()
    query.awaitTermination()
    return spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data/batch_id=*")


def score_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The batch scoring function applied to a stream; it must be stateless."""
    return score(stream)


def action_counts(decisions: DataFrame) -> DataFrame:
    """Actions of one batch, for ``run_batches``."""
    return decisions.groupBy("action").agg(F.count("*").alias("n_flows"))


def running_counts(batches: DataFrame) -> DataFrame:
    """``batch_id, action, n_flows, running``: counts of each batch and up to it, from a written ``run_batches``."""
    upto = W.partitionBy("action").orderBy("batch_id")
    return batches.select("batch_id", "action", "n_flows", F.sum("n_flows").over(upto).alias("running"))


def windowed_action_counts(decisions: DataFrame, ts: str, window: str, delay: str) -> DataFrame:
    """Actions per event-time window; late rows beyond ``delay`` are not counted."""
    return (
        decisions.withWatermark(ts, delay)
        .groupBy(F.window(ts, window).alias("w"), "action")
        .agg(F.count("*").alias("n_flows"))
        .select(F.col("w.start").alias("window_start"), "action", "n_flows")
    )


def anomaly_velocity(events: DataFrame, key: str, ts: str, anomaly: str, window: str, slide: str, delay: str) -> DataFrame:
    """Anomalies per key and sliding window."""
    return (
        events.where(F.col(anomaly)).withWatermark(ts, delay)
        .groupBy(key, F.window(ts, window, slide).alias("w"))
        .agg(F.count("*").alias("n_anomalies"))
        .select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_anomalies")
    )


def escalate(decisions: DataFrame, velocity: DataFrame, key: str, id_col: str, ts: str, window: str, slide: str, limit: int) -> DataFrame:
    """ALLOW becomes QUARANTINE inside any window with more than ``limit`` anomalies of the key.

    Only windows above the limit take part in the join.
    """
    busy = velocity.where(F.col("n_anomalies") > limit).select(key, "window_start").withColumn("_busy", F.lit(1))
    spread = decisions.select(id_col, key, F.window(ts, window, slide).alias("w")).select(
        id_col, key, F.col("w.start").alias("window_start")
    )
    hit = spread.join(busy, [key, "window_start"]).groupBy(id_col).agg(F.max("_busy").alias("_busy"))
    held = F.when((F.col("action") == "ALLOW") & (F.col("_busy") == 1), F.lit("QUARANTINE")).otherwise(F.col("action"))
    return decisions.join(hit, id_col, "left").withColumn("escalated_action", held).drop("_busy")


def escalate_stream(decisions: DataFrame, key: str, id_col: str, ts: str, anomaly: str, window_seconds: int, slide_seconds: int, limit: int, delay: str) -> DataFrame:
    """Rows ``key, id, action, escalated_action, n_anomalies`` as decisions arrive; see ``VelocityEscalation``.

    ``anomaly`` is a boolean column. An id comes a second time if its window gets busy later; ``last_word`` keeps
    the raised row. Rows behind the watermark and rows without a time are dropped; a null key is a key.
    """
    if window_seconds % slide_seconds:
        raise ValueError("the window must be a multiple of the slide")
    slide = slide_seconds * 1_000_000
    slot = F.floor(F.unix_micros(F.col(ts)) / F.lit(slide)).cast("bigint") * F.lit(slide)
    rows = decisions.withWatermark(ts, delay).where(F.col(ts).isNotNull()).select(
        state_key(F.col(key)), F.col(ts), F.col(id_col).alias("id"), slot.alias("slot"), "action", F.coalesce(F.col(anomaly), F.lit(False)).alias("odd"))
    id_type = decisions.schema[id_col].dataType.simpleString()
    out = f"{KEY} string, id {id_type}, action string, escalated_action string, n_anomalies bigint"
    processor = VelocityEscalation(id_type, slide, window_seconds // slide_seconds, limit)
    raised = rows.groupBy(KEY).transformWithStateInPandas(processor, out, "Append", "EventTime")
    return raised.select(
        key_value(decisions.schema[key].dataType).alias(key), F.col("id").alias(id_col), "action", "escalated_action", "n_anomalies")


def last_word(raised: DataFrame, id_col: str) -> DataFrame:
    """One row per id of a written ``escalate_stream``: an action once raised stays raised."""
    up = F.max(F.when(F.col("escalated_action") != F.col("action"), F.col("escalated_action")))
    return raised.groupBy(id_col).agg(F.first("action").alias("action"), up.alias("_up")).select(
        id_col, "action", F.coalesce("_up", "action").alias("escalated_action"))


def live_feed(decisions: DataFrame, ts: str, id_col: str, n: int = 20) -> DataFrame:
    """Newest decisions of the sink table."""
    return decisions.orderBy(F.col(ts).desc(), F.col(id_col).desc()).limit(n)
