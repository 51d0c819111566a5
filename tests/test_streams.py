"""Streams: same rows as the batch form, late rows dropped, nothing lost on resume."""

from pyspark.sql import functions as F

from flowguard.streaming import streams
from flowguard.streaming.flows import complete_windows, window_flow_features

COLUMNS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def write_file(spark, folder, rows):
    df = spark.createDataFrame([(i, s, u, "view", v, "{}") for i, s, u, v in rows],
                               "event_id bigint, s string, user_id bigint, event_type string, value double, props string")
    df.withColumn("ts", F.to_timestamp_ntz(F.col("s"))).select("event_id", "ts", "user_id", "event_type", "value", "props").coalesce(1).write.mode("append").parquet(folder)


def test_late_rows_are_not_counted(spark, tmp_path):
    folder = str(tmp_path / "in")
    write_file(spark, folder, [(1, "2024-01-01 00:00:01", 1, 1.0), (2, "2024-01-01 00:10:00", 1, 1.0)])
    out = str(tmp_path / "out")

    def step():
        s = streams.event_stream(spark, folder, "*.parquet").withColumn("action", F.lit("ALLOW"))
        counts = streams.windowed_action_counts(s, "ts", "1 minute", "30 seconds")
        return streams.run_available(counts, "late", path=out)

    step()
    # Arrives after the watermark has passed its window.
    write_file(spark, folder, [(3, "2024-01-01 00:00:02", 1, 1.0), (4, "2024-01-01 00:20:00", 1, 1.0)])
    got = {str(r.window_start)[11:16]: r.n_flows for r in step().collect()}
    assert got == {"00:00": 1, "00:10": 1}


def test_window_features_batch_equals_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [(i, f"2024-01-01 00:00:{(i * 7) % 60:02d}.{(i * 131) % 1000:03d}", i % 3, float(i)) for i in range(90)]
    write_file(spark, folder, rows)
    args = ("user_id", "ts", "value", "5 seconds", "100 milliseconds", "10 seconds")
    stream = streams.run_available(window_flow_features(streams.event_stream(spark, folder, "*.parquet"), *args), "w", path=str(tmp_path / "o"))
    batch = spark.read.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    latest = batch.agg(F.max("ts")).first()[0]
    whole = complete_windows(window_flow_features(batch, *args), latest, "10 seconds")
    assert stream.count() > 10
    assert stream.exceptAll(whole).isEmpty() and whole.exceptAll(stream).isEmpty()


def test_resume_reads_new_files_once(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_file(spark, folder, [(1, "2024-01-01 00:00:01", 1, 1.0)])
    for n in (1, 2):
        flat = streams.event_stream(spark, folder, "*.parquet").select("event_id")
        assert streams.run_available(flat, "again", path=out).count() == n
        write_file(spark, folder, [(n + 1, "2024-01-01 00:00:02", 1, 1.0)])


def test_escalation_only_touches_allowed_rows_in_busy_windows(spark):
    d = spark.createDataFrame([(1, 7, "2024-01-01 00:00:05", "ALLOW"), (2, 7, "2024-01-01 00:00:06", "DENY"), (3, 8, "2024-01-01 00:00:06", "ALLOW")],
                              "id int, user int, s string, action string").withColumn("ts", F.to_timestamp("s"))
    v = streams.anomaly_velocity(d.withColumn("odd", F.lit(True)), "user", "ts", "odd", "60 seconds", "10 seconds", "0 seconds")
    out = streams.escalate(d, v, "user", "id", "ts", "60 seconds", "10 seconds", 1)
    assert {r.id: r.escalated_action for r in out.collect()} == {1: "QUARANTINE", 2: "DENY", 3: "ALLOW"}


def test_event_stream_reads_a_folder_of_part_files(spark, folder, tmp_path):
    from flowguard.streaming.streams import event_stream, run_available

    events = spark.read.parquet(f"{folder}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    got = run_available(event_stream(spark, str(tmp_path)), "folder-stream")
    assert got.count() == events.count() == run_available(event_stream(spark, folder), "file-stream").count() > 0


def split_files(spark, folder, rows, files):
    """Rows ``(id, time, user, value)`` in files that a stream reads one after another."""
    for i in range(files):
        write_file(spark, folder, rows[i * len(rows) // files: (i + 1) * len(rows) // files])


def test_window_state_over_many_batches(spark, tmp_path):
    """Rows out of order within the delay, spread over batches and a restart, give the windows of the whole table."""
    import random

    rng = random.Random(8)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    at = sorted(rng.uniform(0, 55) for _ in range(160))
    rows = [(i, f"2024-01-01 00:00:{x:09.6f}", rng.choice([1, 2, None]), rng.choice([None, 1.5, 2.25])) for i, x in enumerate(at)]
    # Neighbours change places, so batches overlap in time, less than the delay.
    for i in range(0, len(rows) - 6, 10):
        rows[i], rows[i + 5] = rows[i + 5], rows[i]
    args = ("user_id", "ts", "value", "5 seconds", "100 milliseconds", "10 seconds")

    def step():
        stream = streams.event_stream(spark, folder, "*.parquet", files_per_batch=1)
        return streams.run_available(window_flow_features(stream, *args), "many", path=out)

    split_files(spark, folder, rows[:80], 2)
    step()
    split_files(spark, folder, rows[80:], 2)
    got = step()
    batch = spark.read.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    latest = batch.agg(F.max("ts")).first()[0]
    whole = complete_windows(window_flow_features(batch, *args), latest, "10 seconds")
    assert got.count() > 20
    assert got.exceptAll(whole).isEmpty() and whole.exceptAll(got).isEmpty()


def test_window_state_drops_late_rows_and_keeps_one_summary_a_key(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    args = ("user_id", "ts", "value", "5 seconds", "100 milliseconds", "10 seconds")

    def step():
        stream = streams.event_stream(spark, folder, "*.parquet", files_per_batch=1)
        return streams.run_available(window_flow_features(stream, *args), "late-state", path=out)

    write_file(spark, folder, [(1, "2024-01-01 00:00:01", 1, 1.0), (2, "2024-01-01 00:00:03", 1, 2.0), (3, "2024-01-01 00:01:00", 1, 4.0)])
    step()
    # The first is behind the watermark, the second fills the open window.
    write_file(spark, folder, [(4, "2024-01-01 00:00:02", 1, 9.0), (5, "2024-01-01 00:01:01", 1, 8.0), (6, "2024-01-01 00:02:00", 2, 1.0)])
    got = {(r.user_id, str(r.window_start)[14:19]): (r.n_events, r.value_sum, r.iat_max) for r in step().collect()}
    assert got == {(1, "00:00"): (2, 3.0, 2.0), (1, "01:00"): (2, 12.0, 1.0)}
    state = spark.read.format("statestore").option("stateVarName", "open").load(f"{out}/checkpoint")
    # User 1 has nothing left to wait for; user 2 waits with its one pending row.
    assert [r["key"]["_key"] for r in state.collect()] == ["=2"]


def test_empty_stream_and_lone_rows(spark, tmp_path):
    folder = str(tmp_path / "in")
    write_file(spark, folder, [(1, "2024-01-01 00:00:01", None, None), (2, None, 1, 1.0), (3, "2024-01-01 00:05:00", 1, 1.0)])
    args = ("user_id", "ts", "value", "5 seconds", "100 milliseconds", "10 seconds")
    got = streams.run_available(window_flow_features(streams.event_stream(spark, folder, "*.parquet"), *args), "lone").collect()
    assert [(r.user_id, r.n_events, r.duration_s, r.iat_std, r.events_per_s, r.value_sum) for r in got] == [(None, 1, 0.0, None, None, None)]


def test_escalation_does_not_depend_on_the_batches(spark, tmp_path):
    import random

    rng = random.Random(2)
    folder = str(tmp_path / "in")
    rows = [(i, f"2024-01-01 00:{i // 4:02d}:{(i % 4) * 15 + rng.randint(0, 9):02d}", rng.choice([1, 2, None]), rng.choice([0.0, 0.0, 9.0])) for i in range(160)]
    split_files(spark, folder, rows, 5)

    def decided(events):
        return events.select(F.col("event_id").alias("id"), "user_id", "ts", F.when(F.col("event_id") % 3 == 0, "DENY").otherwise("ALLOW").alias("action"),
                             (F.col("value") > 5).alias("odd"))

    def live(files_per_batch):
        stream = decided(streams.event_stream(spark, folder, "*.parquet", files_per_batch))
        raised = streams.escalate_stream(stream, "user_id", "id", "ts", "odd", 120, 30, 2, "1 minute")
        return streams.run_available(raised, "live")

    batch = decided(spark.read.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp")))
    v = streams.anomaly_velocity(batch, "user_id", "ts", "odd", "120 seconds", "30 seconds", "0 seconds")
    want = {r.id: r.escalated_action for r in streams.escalate(batch, v, "user_id", "id", "ts", "120 seconds", "30 seconds", 2).collect() if r.user_id}
    known = {r.id for r in batch.where("user_id is not null").collect()}
    assert len(set(want.values())) == 3
    for files in (1, 5):
        raised = live(files)
        got = {r.id: r.escalated_action for r in streams.last_word(raised, "id").collect()}
        assert len(got) == 160 and {i: got[i] for i in known} == want
        # The newest rows are in windows that are still open.
        assert "QUARANTINE" in {got[i] for i in range(140, 160)}
    assert live(1).count() > live(5).count() == 160


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    split_files(spark, folder, [(i, "2024-01-01 00:00:01", i % 2, 1.0) for i in range(30)], 3)

    def step():
        s = streams.event_stream(spark, folder, "*.parquet", files_per_batch=1).withColumn("action", F.col("user_id").cast("string"))
        return streams.running_counts(streams.run_batches(s, "again", streams.action_counts, path=out))

    first = sorted(tuple(r) for r in step().collect())
    assert [(b, a, n, r) for b, a, n, r in first if a == "1"] == [(0, "1", 5, 5), (1, "1", 5, 10), (2, "1", 5, 15)]
    # Lost before it was marked as done: the batch runs again.
    (tmp_path / "out" / "checkpoint" / "commits" / "2").unlink()
    (tmp_path / "out" / "checkpoint" / "commits" / ".2.crc").unlink(missing_ok=True)
    write_file(spark, folder, [(99, "2024-01-01 00:00:01", 1, 1.0)])
    again = sorted(tuple(r) for r in step().collect())
    assert again == first + [(3, "1", 1, 16)]
