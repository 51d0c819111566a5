"""Flow features from raw events, keyed and hot-key safe."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowguard.functions.numbers import INF
from flowguard.streaming.keyed import KEY, FlowWindows, key_value, state_key

SECOND = 1e6


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch, for both timestamp types."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), ts.cast("timestamp_ntz"))


LOW_BITS = 1 << 20


def flow_features(
    events: DataFrame,
    key: str,
    ts: str,
    order: str,
    slice_seconds: int,
    value: str,
    kind: str,
    kinds: list[str],
    extra: dict[str, tuple[Column, Callable[[Column], Column]]] | None = None,
) -> DataFrame:
    """Per ``key``: counts, duration, gaps between events, value sums, kinds seen and rates.

    ``kinds`` is the domain of ``kind``; ``has_<kind>`` flags come out for each. ``extra`` maps a
    column name to (aggregate over events, function merging slice values).
    """
    extra = dict(extra or {})
    flags = {f"has_{k}": (F.max(F.when(F.col(kind) == k, 1).otherwise(0)), F.max) for k in kinds}
    sums = {"_vsum": (F.sum(value), F.sum)}
    base = events.withColumn("_t", micros(ts))
    flows = flow_counters(base, [key], [order], slice_seconds * 1_000_000, sums | flags | extra)
    flows = flows.withColumnRenamed("_vsum", "value_sum")
    n_types = F.lit(0).cast("bigint")
    for k in kinds:
        n_types = n_types + F.col(f"has_{k}")
    return flows.select(key, *flow_rate_columns(), n_types.alias("n_types"), *[f"has_{k}" for k in kinds], *extra)


def flow_counters(
    base: DataFrame, keys: list[str], order: list[str], slice_micros: int, merged: dict[str, tuple[Column, Callable[[Column], Column]]],
) -> DataFrame:
    """Mergeable counters of the event times ``_t`` (microseconds) per ``keys``, and the columns of ``merged``.

    A busy key is split into time slices first: gaps inside a slice come from a window over
    ``(keys, slice)``, gaps between slices from a window over the few slice rows of the key. So no
    task ever sorts all events of one key. Both levels aggregate on the partitioning their window
    already made, which leaves two shuffles, the second one over slice rows only.
    """
    base = base.withColumn("_slice", F.floor(F.col("_t") / F.lit(slice_micros)))
    inside = W.partitionBy(*keys, "_slice").orderBy("_t", *order)
    gaps = base.withColumn("_gap", F.col("_t") - F.lag("_t").over(inside))
    slices = gaps.groupBy(*keys, "_slice").agg(
        F.count("*").alias("_n"),
        F.min("_t").alias("_first"),
        F.max("_t").alias("_last"),
        *_square_sums("_gap", "_in"),
        F.min("_gap").alias("_gmin"),
        F.max("_gap").alias("_gmax"),
        *[agg.alias(name) for name, (agg, _) in merged.items()],
    )
    across = W.partitionBy(*keys).orderBy("_slice")
    joined = slices.withColumn("_jump", F.col("_first") - F.lag("_last").over(across))
    return joined.groupBy(*keys).agg(
        F.sum("_n").alias("n_events"),
        F.min("_first").alias("_first"),
        F.max("_last").alias("_last"),
        *[F.sum(f"_in{i}").alias(f"_in{i}") for i in range(3)],
        *_square_sums("_jump", "_ju"),
        F.least(F.min("_gmin"), F.min("_jump")).alias("_gmin"),
        F.greatest(F.max("_gmax"), F.max("_jump")).alias("_gmax"),
        *[merge(F.col(name)).alias(name) for name, (_, merge) in merged.items()],
    )


def _square_sums(gap: str, name: str) -> list[Column]:
    """Exact sum of squared gaps as three BIGINT sums.

    A microsecond gap squared leaves the BIGINT range, and decimals are slow to add per row; with
    g = a·2^20 + b the sums of a², ab and b² stay in range and are put together once per key.
    """
    high, low = F.floor(F.col(gap) / F.lit(LOW_BITS)), F.pmod(F.col(gap), F.lit(LOW_BITS))
    parts = [high * high, high * low, low * low]
    return [F.coalesce(F.sum(p), F.lit(0)).alias(f"{name}{i}") for i, p in enumerate(parts)]


def flow_rate_columns() -> list[Column]:
    """Final feature columns from the merged counters."""
    span = F.col("_last") - F.col("_first")
    pairs = F.col("n_events") - 1
    duration = span / F.lit(SECOND)
    mean = F.when(pairs > 0, duration / pairs)
    part = [(F.col(f"_in{i}") + F.col(f"_ju{i}")).cast("decimal(19,0)") for i in range(3)]
    unit = F.lit(LOW_BITS).cast("decimal(7,0)")
    squares = ((part[0] * unit + 2 * part[1]) * unit + part[2]).cast("decimal(26,0)")
    wide = span.cast("decimal(19,0)")
    spread = pairs.cast("decimal(12,0)") * squares - wide * wide
    std = F.when(pairs > 0, F.sqrt(F.greatest(spread.cast("double"), F.lit(0.0))) / pairs / F.lit(SECOND))
    return [
        F.col("n_events"),
        duration.alias("duration_s"),
        mean.alias("iat_mean"),
        std.alias("iat_std"),
        (F.col("_gmin") / F.lit(SECOND)).alias("iat_min"),
        (F.col("_gmax") / F.lit(SECOND)).alias("iat_max"),
        F.col("value_sum"),
        (F.col("value_sum") / F.col("n_events")).alias("value_mean"),
        F.when(span > 0, F.col("n_events") / duration).otherwise(F.lit(INF)).alias("events_per_s"),
    ]


# --- event-time windows -----------------------------------------------------------------

WINDOW_COLUMNS = ["n_events", "duration_s", "iat_mean", "iat_std", "iat_min", "iat_max", "events_per_s", "value_sum"]


def window_flow_features(
    events: DataFrame, key: str, ts: str, value: str, window: str = "5 seconds", step: str = "100 milliseconds",
    delay: str = "10 seconds",
) -> DataFrame:
    """Flow features per key and tumbling window, the same rows from a batch and from a stream.

    A batch takes gaps in slices of ``step`` first, as ``flow_features`` does. A stream keeps a fixed-size
    summary per key in the state store (``FlowWindows``); a window appears once the watermark, ``delay`` behind
    the newest event, has passed its end, and rows behind the watermark are dropped. Rows without a time are left
    out; a null key is a key.
    """
    if events.isStreaming:
        return _stream_windows(events, key, ts, value, window, delay)
    span = F.expr(f"timestamp_micros(0) + interval {step}")
    slice_micros = events.sparkSession.range(1).select(F.unix_micros(span)).first()[0]  # one number
    timed = events.where(F.col(ts).isNotNull()).select(
        F.col(key), F.window(ts, window).alias("w"), micros(ts).alias("_t"), F.col(value).alias("_v"))
    flows = flow_counters(timed, [key, "w"], [], slice_micros, {"value_sum": (F.sum("_v"), F.sum)})
    rates = {c: e for c, e in zip(("n_events", "duration_s", "iat_mean", "iat_std", "iat_min", "iat_max"), flow_rate_columns())}
    per_second = F.try_divide(F.col("n_events"), (F.col("_last") - F.col("_first")) / F.lit(SECOND))
    return flows.select(
        key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *rates.values(),
        per_second.alias("events_per_s"), "value_sum")


def _stream_windows(events: DataFrame, key: str, ts: str, value: str, window: str, delay: str) -> DataFrame:
    w = F.window(ts, window)
    timed = events.withWatermark(ts, delay).where(F.col(ts).isNotNull()).select(
        state_key(F.col(key)), F.col(ts), micros(ts).alias("t"), F.unix_micros(w["start"]).alias("start"), F.unix_micros(w["end"]).alias("end"),
        F.col(value).cast("double").alias("v"))
    out = f"{KEY} string, start bigint, end bigint, n_events bigint, " + ", ".join(f"{c} double" for c in WINDOW_COLUMNS[1:])
    found = timed.groupBy(KEY).transformWithStateInPandas(FlowWindows(), out, "Append", "EventTime")
    return found.select(
        key_value(events.schema[key].dataType).alias(key), F.timestamp_micros("start").alias("window_start"), F.timestamp_micros("end").alias("window_end"), *WINDOW_COLUMNS)


def complete_windows(features: DataFrame, latest, delay: str) -> DataFrame:
    """Batch counterpart of the watermark: only windows that ended ``delay`` before ``latest``."""
    return features.where(F.col("window_end") <= F.lit(latest) - F.expr(f"interval {delay}"))
