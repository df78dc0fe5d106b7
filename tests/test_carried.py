"""Streams cut into micro-batches, one key with two thirds of the rows, give the rows of the whole table; also if a batch is retried."""

import random

import pytest
from pyspark.sql import functions as F

from siftnet.operators import dedup, sequence, throughput
from siftnet.streaming import carried


@pytest.fixture(scope="module")
def flows(spark):
    rng, rows, clock = random.Random(3), [], 1_700_000_000
    for i in range(500):
        clock += rng.choice([1, 5, 40, 300])
        key = "hot" if rng.random() < 0.66 else rng.choice(["a", "b", None])
        rows.append((i, key, rng.choice(["netflow", "sflow", "sflow"]), clock, 9, i * 2 + rng.choice([0, 0, 0, 5]), clock % 100_000, rng.random() < 0.9, rng.random() < 0.3, float(i)))
    schema = "arrival_no long, dedup_key string, family string, s long, version int, sequence long, uptime_ms long, countable boolean, is_poll boolean, value double"
    return spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s")).withColumn("increment", F.lit(2).cast("long")).cache()


def streamed(rows, build, tmp_path, parts=3, retry=(1,)):
    """Rows of all micro-batches; those in ``retry`` run twice, and the second run's rows count."""
    results = {}

    def sink(df, batch_id):
        results[batch_id] = [r.asDict() for r in df.collect()]

    run = build(str(tmp_path / "state"), sink)
    for i in range(parts):
        part = rows.where((F.col("arrival_no") * parts / 500).cast("int") == i)
        for _ in range(1 + (i in retry)):
            run(part, i)
    return [row for batch in results.values() for row in batch]


def picked(dicts, *columns):
    return sorted((tuple(d[c] for c in columns) for d in dicts), key=repr)


def test_duplicates_and_changes(flows, rows, tmp_path, span=40):
    options = {"window_seconds": 600, "span": span}
    marked = dedup.mark_duplicates(flows, "prefer-netflow", window_seconds=600)
    got = streamed(flows, lambda path, sink: carried.mark_duplicates(path, sink, "prefer-netflow", **options), tmp_path / "marks")
    assert picked(got, "arrival_no", "suppressed") == rows(marked, "arrival_no", "suppressed")
    changes = streamed(marked, lambda path, sink: carried.suppression_changes(path, sink, span=span), tmp_path / "changes")
    assert picked(changes, "arrival_no", "family", "suppressed") == rows(dedup.suppression_changes(marked), "arrival_no", "family", "suppressed")


def test_sequence(flows, rows, tmp_path):
    keys = ("dedup_key", "version")
    expected = sequence.sequence_events(flows, keys=keys)
    got = streamed(flows, lambda path, sink: carried.sequence_events(path, sink, keys=keys, span=30), tmp_path)
    assert picked(got, "arrival_no", "event", "lost_units") == rows(expected, "arrival_no", "event", "lost_units")
    assert any(d["event"] for d in got) and not all(d["event"] for d in got)


def test_vitals(flows, rows, tmp_path):
    table = flows.select("arrival_no", F.col("dedup_key").alias("device_id"), "ts", "is_poll", *[F.col("value").alias(v) for v in throughput.VITALS])
    expected = throughput.coherent_vitals(table.where("not is_poll"), table.where("is_poll"), poll_seconds=100)
    got = streamed(table, lambda path, sink: carried.coherent_vitals(path, sink, is_poll=F.col("is_poll"), poll_seconds=100, span=50), tmp_path)
    columns = ["arrival_no", "cpu_usage", "session_count", "from_poll"]
    assert picked(got, *columns) == rows(expected, *columns)
    assert {d["from_poll"] for d in got} == {True, False}
