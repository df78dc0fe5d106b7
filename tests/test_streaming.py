"""Batch equals stream: the same rows, landed as files and read one file per micro-batch."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from siftnet.bindings import state as binding
from siftnet.bindings.registry import events
from siftnet.operators import admission, dedup, polls, segments, sequence, throughput, triggers
from siftnet.sources import sinks
from siftnet.streaming import stateful


@pytest.fixture()
def streamed(spark, tmp_path):
    """Land a DataFrame as three files in arrival order and run a stream over them into memory."""

    def run(df, arrival, build, name):
        low, high = df.agg(F.min(arrival), F.max(arrival)).first()
        third = (high - low) // 3 + 1
        landed = tmp_path / name
        landed.mkdir()
        for i in range(3):
            part = tmp_path / f"{name}-{i}"
            df.where((F.col(arrival) - low).between(i * third, (i + 1) * third - 1)).coalesce(1).write.parquet(str(part))
            file = next(part.glob("*.parquet"))
            target = landed / f"{i}.parquet"
            shutil.copy(file, target)
            os.utime(target, (1_700_000_000 + i * 60,) * 2)
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(landed))
        query = (
            build(stream).writeStream.format("memory").queryName(name).outputMode("append")
            .option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
        )
        query.awaitTermination(120)
        assert query.exception() is None
        return spark.table(name)

    return run


def test_dual_export(spark, sf_dir, streamed, rows):
    flows = binding.exported(spark, sf_dir)
    batch = dedup.mark_duplicates(flows, "prefer-netflow", window_seconds=43200)
    stream = streamed(flows, "arrival_no", lambda s: stateful.mark_duplicates(s, "prefer-netflow", window_seconds=43200), "dual")
    assert rows(stream, "arrival_no", "suppressed") == rows(batch, "arrival_no", "suppressed")


def test_sequence(spark, sf_dir, streamed, rows):
    headers = binding.export_headers(spark, sf_dir)
    batch = sequence.sequence_events(headers)
    stream = streamed(headers, "arrival_no", stateful.sequence_events, "seq")
    assert rows(stream, "arrival_no", "event", "lost_units") == rows(batch, "arrival_no", "event", "lost_units")


def test_throughput(spark, sf_dir, streamed, rows):
    samples = binding.interface_samples(spark, sf_dir, True)
    columns = ["device_id", "poll_arrival", "accepted", F.round("in_kbps", 6), F.round("out_kbps", 6)]
    batch = throughput.device_throughput(samples)
    stream = streamed(samples, "poll_arrival", stateful.device_throughput, "throughput")
    assert rows(stream, *columns) == rows(batch, *columns)


def test_streaks_and_host_keys(spark, sf_dir, streamed, rows):
    log = binding.poll_log(spark, sf_dir)
    batch = polls.failure_streaks(log)
    stream = streamed(log, "arrival_no", stateful.failure_streaks, "streaks")
    assert rows(stream, "arrival_no", "failures", "expected_skip") == rows(batch, "arrival_no", "failures", "expected_skip")
    keys = binding.fingerprints(spark, sf_dir)
    stream = streamed(keys, "arrival_no", stateful.host_key_changes, "hostkeys")
    assert rows(stream, "arrival_no", "previous") == rows(polls.host_key_changes(keys), "arrival_no", "previous")


def test_admission(spark, sf_dir, streamed, rows):
    source = events(spark, sf_dir).select("device_id", "arrival_no", "ts")
    spaced = streamed(source, "arrival_no", lambda s: stateful.accept_spaced(s, keys=["device_id"], gap_seconds=86400), "spaced")
    batch = admission.accept_spaced(source, keys=["device_id"], gap_seconds=86400)
    assert rows(spaced, "arrival_no", "accepted") == rows(batch, "arrival_no", "accepted")
    options = {"keys": ["device_id"], "rate": 1, "per_seconds": 43200, "burst": 2}
    bucket = streamed(source, "arrival_no", lambda s: stateful.token_bucket(s, **options), "bucket")
    assert rows(bucket, "arrival_no", "accepted") == rows(admission.token_bucket(source, **options), "arrival_no", "accepted")


def test_latest_fresh(spark, sf_dir, streamed, rows):
    e = events(spark, sf_dir).where("event_type in ('view', 'purchase')")
    timeline = e.select("device_id", "arrival_no", "ts", F.expr("if(event_type = 'view', value, null)").alias("sample"))
    stream = streamed(timeline, "arrival_no", lambda s: stateful.latest_fresh(s, keys=["device_id"], value="sample", fresh_seconds=86400), "fresh")
    batch = throughput.latest_fresh(
        timeline.where("sample is null").drop("sample"), timeline.where("sample is not null"), keys=["device_id"], values=["sample"], fresh_seconds=86400
    )
    assert rows(stream, "arrival_no", "latest") == rows(batch, "arrival_no", "latest_sample")


def test_debounce(spark, sf_dir, streamed, rows):
    e = events(spark, sf_dir).select("device_id", "arrival_no", "ts")
    last = e.agg(F.max("arrival_no")).first()[0]
    sentinel = spark.range(1).select(F.lit(-1).cast("bigint").alias("device_id"), F.lit(last + 1).cast("bigint").alias("arrival_no"), F.expr("timestamp'2030-01-01'").alias("ts"))
    batch = triggers.debounce(e, keys=["device_id"], gap_seconds=21600)
    stream = streamed(e.unionByName(sentinel), "arrival_no", lambda s: stateful.debounce(s, keys=["device_id"], gap_seconds=21600), "debounced")
    columns = ["device_id", "first_arrival", "last_arrival", "event_count", "fire_ts"]
    assert rows(stream.where("device_id >= 0"), *columns) == rows(batch, *columns)


def test_command_log_and_replays(spark, sf_dir, streamed, rows):
    e = events(spark, sf_dir)
    attempts = e.select(
        "arrival_no", F.concat("device_id", F.lit("-"), F.col("k") % 3).alias("command_id"),
        F.expr("if(value > 60, 'failed', 'succeeded')").alias("status"), F.col("event_type").alias("result"),
    )
    first = attempts.groupBy("command_id").agg(F.min_by("status", "arrival_no").alias("s"), F.min("arrival_no").alias("a"))
    batch = attempts.join(first, "command_id").select("arrival_no", "s", (F.col("arrival_no") != F.col("a")).alias("r"))
    stream = streamed(attempts, "arrival_no", stateful.command_results, "commands")
    assert rows(stream, "arrival_no", "status", "redelivery") == rows(batch)
    batches = e.select((F.col("device_id") % 3).alias("probe_id"), F.col("ts").alias("recv_ts"), "arrival_no", (F.col("k") % 10).cast("string").alias("payload"))
    stream = streamed(batches, "arrival_no", lambda s: stateful.unseen_batches(s, delay="60 days"), "replays")
    assert rows(stream, "probe_id", "batch_key") == rows(sinks.unseen(batches), "probe_id", "batch_key")


def test_templates(spark, streamed, rows):
    data = [(1, "a", 0), (2, None, 60), (3, None, 4000), (4, None, 4010), (5, "b", 4020), (6, None, 4030), (7, "c", 9000), (8, None, 9001)]
    frame = spark.createDataFrame(data, "set_order bigint, fields_json string, s int").select(
        F.lit("x").alias("exporter"), F.lit(0).alias("domain"), F.lit(256).alias("template_id"), "set_order", "fields_json",
        F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("recv_ts"),
    )
    stream = streamed(frame, "set_order", stateful.with_templates, "templates")
    assert rows(stream, "set_order", "template_json") == [(2, "a"), (3, None), (4, None), (6, "b"), (8, "c")]


def test_snapshots(spark, streamed, rows):
    frame = spark.createDataFrame([(0, 1, 10), (1, 1, 30), (2, 2, 5), (3, 1, 20), (4, 1, 30)], "n bigint, device_id bigint, s int").withColumn(
        "timestamp", F.timestamp_seconds(F.col("s"))
    )
    stream = streamed(frame, "n", lambda s: stateful.newer_snapshots(s, keys=["device_id"]), "snapshots")
    assert (3,) not in rows(stream, "n") and (4,) in rows(stream, "n")


def test_segment_column_is_not_leaked(spark, sf_dir):
    assert segments.SEGMENT not in polls.failure_streaks(binding.poll_log(spark, sf_dir)).columns
