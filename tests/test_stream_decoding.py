"""A capture cut into micro-batches is decoded like the whole capture."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from siftnet.operators import datagrams
from siftnet.plans import flows as plan
from siftnet.streaming import decoding

T0 = 1_700_000_000
SCHEMA = "arrival_no bigint, exporter string, payload binary, recv_ts timestamp"


def set_of(set_id, body):
    return struct.pack(">HH", set_id, len(body) + 4) + body


def capture(seed, size=200):
    """Datagrams of three exporters, the first of which sends half; templates change, fall silent, come late and carry options."""
    rng, out, clock = random.Random(seed), [], T0
    for i in range(size):
        clock += rng.choice([0, 1, 5, 30, 400]) if rng.random() < 0.97 else 3000
        exporter = "192.0.2.1" if rng.random() < 0.5 else f"192.0.2.{rng.randint(2, 3)}"
        body = b""
        for _ in range(rng.randint(1, 3)):
            template_id = rng.randint(256, 259)
            if rng.random() < 0.25:
                layout = rng.choice([[(8, 4), (1, 4)], [(1, 8), (8, 4), (9999, 2)], [(8, 4), (7, 2), (1, 2)]])
                body += set_of(0, struct.pack(">HH", template_id, len(layout)) + b"".join(struct.pack(">HH", *f) for f in layout))
            elif rng.random() < 0.1:
                body += set_of(1, struct.pack(">HHH", template_id, 4, 4) + struct.pack(">HHHH", 1, 4, 34, 4))
            else:
                body += set_of(template_id, bytes(rng.randint(0, 255) for _ in range(rng.randint(0, 40))))
        head = struct.pack(">HHIIII", 9, 2, 1000, clock, i, 0)
        out.append((i, exporter, bytearray(head + body), clock))
    return out


def frame(spark, rows):
    data = spark.createDataFrame(rows, "arrival_no bigint, exporter string, payload binary, s bigint")
    return data.select("arrival_no", "exporter", "payload", F.timestamp_seconds("s").alias("recv_ts"))


def streamed(spark, folder, rows, parts, build):
    """The rows of ``build`` over a stream of the capture's parts, one micro-batch each."""
    size = -(-len(rows) // parts)
    for i in range(parts):
        frame(spark, rows[i * size : (i + 1) * size]).coalesce(1).write.parquet(f"{folder}/in/part={i:03}")
    files = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    collected = []
    query = (
        build(files).writeStream.foreachBatch(lambda df, _: collected.extend(df.collect()))
        .option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return collected


@pytest.mark.parametrize("parts", [4])
def test_micro_batches_equal_the_batch(spark, tmp_path, parts):
    rows = capture(parts)
    columns = ["arrival_no", "set_order", "record_no", "exporter", "is_options", "fwd_bytes", "src_v4", "src_port", "interval_34"]
    heads = plan.set_heads(frame(spark, rows))
    matched = plan.matched_sets(frame(spark, rows), heads)
    expected = sorted((tuple(r) for r in datagrams.records(matched).select(*columns).collect()), key=repr)
    got = streamed(spark, tmp_path, rows, parts, lambda stream: decoding.records(stream, slices=3).select(*columns))
    assert sorted((tuple(r) for r in got), key=repr) == expected and len(expected) > 100


def test_flows_with_learned_rates_equal_the_batch(spark, tmp_path):
    """Domain rates in options and in data, rates of samplers, and an override."""
    rng, rows, clock = random.Random(9), [], T0
    template = set_of(0, struct.pack(">HH", 300, 4) + struct.pack(">HHHHHHHH", 8, 4, 48, 1, 1, 4, 34, 4))
    plain = set_of(0, struct.pack(">HH", 301, 2) + struct.pack(">HHHH", 8, 4, 1, 4))
    options = set_of(1, struct.pack(">HHH", 500, 4, 8) + struct.pack(">HHHHHH", 1, 4, 48, 1, 50, 2))
    packets = set_of(1, struct.pack(">HHH", 501, 4, 8) + struct.pack(">HHHHHH", 1, 4, 305, 2, 306, 2))
    for i in range(160):
        clock += rng.randint(0, 9)
        body = template + plain + options + packets if i % 40 < 3 else b""
        for _ in range(rng.randint(1, 4)):
            kind = rng.random()
            if kind < 0.1:
                body += set_of(500, struct.pack(">IBH", 0, rng.randint(0, 2), rng.choice([0, 7, 100])))
            elif kind < 0.2:
                body += set_of(501, struct.pack(">IHH", 0, rng.choice([0, 1, 4]), rng.randint(0, 40)))
            elif kind < 0.6:
                body += set_of(301, b"".join(struct.pack(">II", 0x0A000000 + rng.randint(1, 9), rng.randint(1, 99)) for _ in range(rng.randint(0, 5))))
            else:
                body += set_of(300, b"".join(struct.pack(">IBII", 0x0A000000 + rng.randint(1, 9), rng.randint(0, 3), rng.randint(1, 99), rng.choice([0, 0, 0, 0, 3, 50])) for _ in range(rng.randint(0, 5))))
        exporter = "192.0.2.1" if rng.random() < 0.6 else f"192.0.2.{rng.randint(2, 3)}"
        rows.append((i, exporter, bytearray(struct.pack(">HHIIII", 9, 2, 1000, clock, i, 0) + body), clock))
    overrides = spark.createDataFrame([("192.0.2.3", 1000)], "exporter string, rate bigint")
    columns = ["arrival_no", "set_order", "record_no", "sampler_address", "src_addr", "sampling_rate", "bytes", "flow_end"]
    expected = sorted((tuple(r) for r in plan.template_flows(frame(spark, rows), overrides).select(*columns).collect()), key=repr)
    got = streamed(spark, tmp_path, rows, 3, lambda stream: decoding.template_flows(stream, overrides, slices=2).select(*columns))
    assert sorted((tuple(r) for r in got), key=repr) == expected
    assert len({r[5] for r in expected}) > 10 and len(expected) > 400


def test_sets_without_template_and_expired_ones(spark, tmp_path):
    template = set_of(0, struct.pack(">HH", 300, 1) + struct.pack(">HH", 8, 4))
    data = set_of(300, bytes([10, 0, 0, 1]))
    sent = [(0, data), (10, template), (20, data), (1500, data), (3200, data), (5100, data), (5200, template + data)]
    rows = [(i, "192.0.2.1", bytearray(struct.pack(">HHIIII", 9, 2, 1000, T0 + s, i, 0) + body), T0 + s) for i, (s, body) in enumerate(sent)]
    got = streamed(spark, tmp_path, rows, 4, lambda stream: decoding.matched_sets(stream, slices=2).select("arrival_no", "event", F.get("fields", F.lit(0))["ie"]))
    # the use at 1500 s keeps the template alive until 3200 s; the silence after that is too long
    before, found = ("data_before_template", None), (None, 8)
    assert sorted(tuple(r) for r in got) == [(0, *before), (2, *found), (3, *found), (4, *found), (5, *before), (6, *found)]


def test_layout_round_trip(spark):
    fields = [{"ie": 8, "length": 4, "pen": 0}, {"ie": 1, "length": 65535, "pen": 4294967295}]
    rows = [(1, bytearray(decoding.packed_fields(fields))), (2, None), (3, bytearray(decoding.packed_fields(fields[:1])))]
    got = spark.createDataFrame(rows, "i int, layout binary").select("i", decoding.unpacked_fields("layout").alias("f")).orderBy("i").collect()
    assert [None if r.f is None else [f.asDict() for f in r.f] for r in got] == [fields, None, fields[:1]]
