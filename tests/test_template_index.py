"""Announcements are repeats: what is found once for all of them equals what each tells, and payloads are walked once."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from siftnet.bindings import wire
from siftnet.bindings.registry import QUERIES
from siftnet.operators import asof, datagrams
from siftnet.plans import flows as plan

T0 = 1_700_000_000


def times(df, operator):
    return df._jdf.queryExecution().executedPlan().toString().count(f"{operator} [")


def test_payloads_are_walked_once(spark, sf_dir):
    """A filter that the optimizer makes of what a walk finds would repeat the walk below it."""
    assert times(QUERIES["wide_template_flows"](spark, sf_dir), "ArrowEvalPython") == 1


def test_template_sets_are_read_once(spark):
    rows = spark.createDataFrame([(9, 0, b"abc")], "version int, set_id int, body binary")
    context = rows.select("*", *[F.lit(1).alias(c) for c in ("exporter", "domain", "recv_ts", "arrival_no", "set_order")])
    assert times(datagrams.templates(context), "ArrowEvalPython") == 1


@pytest.mark.parametrize("span", [8, 64])
def test_index_is_the_same_without_repeats(spark, rows, span):
    rng = random.Random(span)
    told, value = [], {}
    for n in range(600):
        key = rng.choice([None, 1, 1, 1, 2])
        if rng.random() < (0.4 if n // 64 % 2 else 0.02):
            value[key] = rng.choice([None, b"a", b"b"])
        told.append((key, n, value.get(key, b"a")))
    facts = spark.createDataFrame(told, "key int, arrival_no long, v binary").repartition(5)
    how = {"keys": ["key"], "order": "arrival_no", "value": "v", "span": span}
    places = facts.select("key", "arrival_no")
    fewer = asof.changes(facts, **how)
    assert rows(asof.index(fewer, places, **how)) == rows(asof.index(facts, places, **how))
    cells = facts.where("arrival_no < 64").selectExpr("key", f"arrival_no div {span}").distinct().count()
    assert fewer.where("arrival_no < 64").count() <= cells + 8 < 64


def captured(spark, seed):
    """Datagrams of two exporters whose templates change, repeat in other company, and die in long pauses."""
    rng = random.Random(seed)
    layouts = [struct.pack(">HHHH", 8, 4, 1, 4), struct.pack(">HHHH", 12, 4, 2, 4), struct.pack(">HHHHHH", 8, 4, 7, 2, 11, 2)]
    sent, now = [], T0
    for n in range(160):
        now += rng.choice([1, 5, 5, 5, 900, 4000] if n % 40 > 30 else [1, 5])
        body = b""
        for _ in range(rng.randint(0, 2)):
            specs = rng.choice(layouts)
            told = struct.pack(">HH", rng.choice([300, 301]), len(specs) // 4) + specs + rng.choice([b"", struct.pack(">HH", 302, 1) + struct.pack(">HH", 1, 4), struct.pack(">HHH", 300, 9, 1)])
            body += struct.pack(">HH", 0, 4 + len(told)) + told
        body += struct.pack(">HH", rng.choice([300, 301, 302]), 4 + 8) + bytes(rng.randrange(256) for _ in range(8))
        head = struct.pack(">HHIIII", 9, 2, 1000, now, n, rng.choice([0, 0, 7]))
        sent.append((n, now, rng.choice(["a", "b"]), head + body))
    frame = spark.createDataFrame(sent, "arrival_no long, t long, exporter string, payload binary").repartition(3)
    return frame.select("arrival_no", F.timestamp_seconds("t").alias("recv_ts"), "exporter", "payload")


@pytest.mark.parametrize("seed", [1, 2])
def test_templates_of_distinct_sets_equal_those_of_each(spark, rows, seed):
    frame = captured(spark, seed)
    sets = datagrams.sets(datagrams.framed(frame))
    bodies = datagrams.template_bodies(sets)
    assert bodies.select("body").distinct().count() < sets.where("set_id < 256").count()
    announced = datagrams.templates(sets)
    assert "malformed" in {r.verdict for r in announced.collect()}
    assert rows(datagrams.templates(sets, bodies), *announced.columns) == rows(announced)

    each = datagrams.with_templates(datagrams.data_sets(sets), datagrams.usable_templates(announced))
    found = plan.matched_sets(frame, plan.set_heads(frame))
    assert {r.event for r in each.collect()} == {None, "data_before_template"}
    assert rows(found, *each.columns) == rows(each)


def test_wide_payloads_lie_in_runs_of_arrivals(spark, sf_dir, monkeypatch):
    """So that what is found per key and time shrinks where the payloads are read."""
    monkeypatch.setattr(wire, "landed", lambda rows: rows)
    monkeypatch.setattr(wire, "BLOCK", 64)
    made = wire.wide_datagrams(spark, sf_dir).select(F.spark_partition_id().alias("part"), F.expr("arrival_no div 64").alias("run"))
    parts = made.groupBy("run").agg(F.countDistinct("part").alias("parts"))
    assert parts.where("parts > 1").count() == 0 and parts.count() > 3
