"""Steps whose memory and shuffles must be bounded whatever one scan task reads, shown by their plans."""

import ipaddress

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftnet.bindings import wire
from siftnet.bindings.registry import QUERIES
from siftnet.functions import net
from siftnet.functions.ragged import addresses
from siftnet.operators import oids, snmp


def lowest(df, *operators):
    """Line of the plan on which each operator stands last; lower operators run earlier."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return [max((i for i, line in enumerate(lines) if f" {name}" in line), default=-1) for name in operators]


@pytest.mark.parametrize("name", ["sflow_flows", "sflow_interface_counters"])
def test_sflow_lines_are_dealt_before_they_are_bytes(spark, sf_dir, name):
    grouped, dealt = lowest(QUERIES[name](spark, sf_dir), "ObjectHashAggregate", "Exchange")
    assert -1 < grouped < dealt


def test_v5_lines_are_dealt_before_they_are_bytes(spark, sf_dir):
    grouped, dealt = lowest(wire.v5_datagrams(spark, sf_dir), "ObjectHashAggregate", "Exchange")
    assert -1 < grouped < dealt


@pytest.mark.parametrize("table, prefix", [(snmp.scalars, oids.SYS_NAME), (snmp.pivot, oids.SYS_NAME.removesuffix(".0"))])
def test_pdus_are_dealt_before_they_are_sorted(spark, table, prefix):
    walk = spark.range(10).select(
        F.col("id").alias("device_id"), F.timestamp_seconds("id").alias("poll_ts"), F.lit(oids.SYS_NAME).alias("oid"), F.lit("OctetString").alias("pdu_type"),
        F.col("id").cast("string").alias("value"), F.lit(None).cast("binary").alias("value_bytes"), F.col("id").alias("pdu_no"),
    )
    sorted_in, dealt = lowest(table(walk, {"hostname": prefix}), "SortAggregate", "Exchange")
    assert -1 < sorted_in < dealt


def test_records_are_not_shuffled_to_rates_nobody_announced(spark, sf_dir):
    """The indexes of templates and rates are small here, so decoded records stay in the task that decodes them."""
    decoded, dealt = lowest(QUERIES["wide_template_flows"](spark, sf_dir), "MapInArrow", "Exchange")
    assert -1 < dealt < decoded or dealt == -1


def test_wide_lines_are_dealt_before_they_are_bytes(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(wire, "landed", lambda rows: rows)
    grouped, dealt = lowest(wire.wide_datagrams(spark, sf_dir), "ObjectHashAggregate", "Exchange")
    assert -1 < grouped < dealt


def test_addresses_of_records_are_written_like_everywhere(spark):
    texts = ["0.0.0.0", "10.0.200.9", "255.255.255.255", "::", "::1", "1::", "2001:db8::9", "1:0:0:2:0:0:0:3", "1:0:2:0:3:0:4:0", "0:0:1::", "::ffff:1.2.3.4", "a:b0:c00:d000:1:20:300:4000"]
    packed = [ipaddress.ip_address(t).packed for t in texts] + [b"", b"abc", bytes(17)]
    lengths = np.array([len(p) for p in packed])
    written = addresses(np.frombuffer(b"".join(packed), np.uint8), np.cumsum(lengths) - lengths, lengths, np.ones(len(packed), bool)).to_pylist()
    rows = spark.createDataFrame(list(enumerate(packed)), "no int, b binary")
    assert written == [r[0] for r in rows.orderBy("no").select(net.ip_from_bytes(F.col("b"))).collect()]


def test_partitions_of_lines_are_not_joined_to_the_size_of_their_numbers(spark, sf_dir):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert wire.sflow_datagrams(spark, sf_dir).rdd.getNumPartitions() == 7
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
