"""Sinks written batch by batch, with retries, replays and late snapshots."""

import os

from pyspark.sql import functions as F

from siftnet.sources import sinks

DAY = 86_400


def deliveries(spark, *rows):
    """rows: (probe, payload, day)"""
    data = spark.createDataFrame([(p, v, 1_700_006_400 + int(d * DAY)) for p, v, d in rows], "probe_id long, payload string, s long")
    return data.select("probe_id", "payload", F.timestamp_seconds("s").alias("recv_ts"))


def files(path):
    return {os.path.join(folder, f) for folder, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_replay_safe_writer(spark, tmp_path):
    path = str(tmp_path / "table")
    write = sinks.replay_safe_writer(path, horizon_days=3)
    write(deliveries(spark, (1, "a", 0), (1, "a", 0.1), (2, "a", 0), (None, "n", 0)), 0)
    assert held_of(spark, path) == {(1, "a", 0), (2, "a", 0), (None, "n", 0)}
    second = deliveries(spark, (1, "a", 1), (1, "b", 1), (None, "n", 2))
    write(second, 1)
    once = held_of(spark, path)
    assert once == {(1, "a", 0), (2, "a", 0), (None, "n", 0), (1, "b", 1)}
    # a batch that is retried after it was written, or half written, leaves the same rows
    write(second, 1)
    assert held_of(spark, path) == once and spark.read.parquet(f"{path}/rows").count() == 4
    write(deliveries(spark), 2)
    # a replay behind the horizon is a delivery of its own
    write(deliveries(spark, (1, "a", 3.5), (2, "a", 4.5)), 3)
    assert held_of(spark, path) == once | {(2, "a", 3)}


def held_of(spark, path):
    return {(r.probe_id, r.payload, r.batch) for r in spark.read.parquet(f"{path}/rows").collect()}


def test_replay_safe_writer_reads_only_its_days(spark, tmp_path):
    """Keys of days out of reach are not even opened."""
    path = str(tmp_path / "table")
    write = sinks.replay_safe_writer(path, horizon_days=2)
    write(deliveries(spark, (1, "a", 0)), 0)
    for name in files(f"{path}/keys"):
        with open(name, "w") as broken:
            broken.write("no table")
        os.remove(os.path.join(os.path.dirname(name), f".{os.path.basename(name)}.crc"))
    write(deliveries(spark, (1, "a", 9)), 1)
    assert held_of(spark, path) == {(1, "a", 0), (1, "a", 1)}


def test_snapshot_writer(spark, tmp_path):
    path = str(tmp_path / "table")
    write = sinks.snapshot_writer(path, keys=["device_id", "kind"], buckets=4)
    schema = "device_id long, kind string, entry string, timestamp timestamp"

    def snapshot(device, kind, day, *entries):
        rows = spark.createDataFrame([(device, kind, e, 1_700_006_400 + day * DAY) for e in entries], "device_id long, kind string, entry string, s long")
        return rows.select("device_id", "kind", "entry", F.timestamp_seconds("s").alias("timestamp"))

    shape = spark.createDataFrame([], schema).schema
    current = lambda: {(r.device_id, r.kind, r.entry) for r in sinks.read_snapshots(spark, path, shape).collect()}
    assert current() == set()
    write(snapshot(1, "arp", 5, "x", "y").unionByName(snapshot(2, None, 5, "z")), 0)
    write(snapshot(1, "arp", 6, "w").unionByName(snapshot(1, "fdb", 1, "f")), 1)
    expected = {(1, "arp", "w"), (1, "fdb", "f"), (2, None, "z")}
    assert current() == expected
    # a late snapshot changes no file
    before = files(path)
    write(snapshot(1, "arp", 4, "old").unionByName(snapshot(2, None, 5, "again")), 2)
    assert files(path) == before and current() == expected
    # a retry writes its own version again
    write(snapshot(1, "arp", 6, "w").unionByName(snapshot(1, "fdb", 1, "f")), 1)
    assert current() == expected
    write(snapshot(2, None, 7, "new", "more"), 3)
    assert current() == {(1, "arp", "w"), (1, "fdb", "f"), (2, None, "new"), (2, None, "more")}


def test_write_table(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.range(1000).selectExpr("id", "id % 3 as part")
    sinks.write_table(rows, path, partition_by=["part"], rows_per_file=100)
    sinks.write_table(rows.where("id < 10"), path, partition_by=["part"])
    assert spark.read.parquet(path).count() == 1010
    assert all(spark.read.parquet(f).count() <= 100 for f in files(path))


def test_replay_safe_writer_shuffles_once(spark, tmp_path):
    """Rows, their search for replays and their keys come from one pass: few stages, whatever is known."""
    write = sinks.replay_safe_writer(str(tmp_path / "table"))
    write(deliveries(spark, (1, "a", 0)), 0)
    context = spark.sparkContext
    context.setJobGroup("second delivery", "")
    write(deliveries(spark, (1, "a", 0), (2, "b", 1)), 1)
    jobs = context.statusTracker().getJobIdsForGroup("second delivery")
    context.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 8
