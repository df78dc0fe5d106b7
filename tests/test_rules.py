"""The rules on small hand-made cases."""

import struct

import pytest
from pyspark.sql import functions as F

from siftnet.functions import net
from siftnet.operators import cli, datagrams, dedup, flows, metrics, sequence, sflow, snmp, snapshots, syslog, throughput, topology, triggers
from siftnet.plans import flows as plan

T0 = 1_700_000_000


def at(seconds):
    return F.timestamp_micros((F.lit(T0 * 1_000_000) + F.round(seconds * 1_000_000)).cast("bigint"))


# ------------------------------------------------------------------------------------------------------ throughput


def polls_of(spark, polls):
    """polls: list of (seconds, [(if_index, type, in, out, high_speed)])"""
    rows = [(i, float(s), *iface) for i, (s, ifaces) in enumerate(polls) for iface in ifaces]
    frame = spark.createDataFrame(rows, "poll_arrival bigint, s double, if_index int, if_type int, in_bytes bigint, out_bytes bigint, high_speed bigint")
    return frame.withColumn("poll_ts", at(F.col("s"))).withColumn("device_id", F.lit(1).cast("bigint"))


KB = 750_000


@pytest.mark.parametrize(
    "polls, expected",
    [
        ([(0, [(1, 6, 0, 0, 1000)])], (0, 0)),
        ([(0, [(1, 6, 0, 0, 1000)]), (60, [(1, 6, KB, 2 * KB, 1000)])], (100, 200)),
        ([(0, [(1, 6, 0, 0, 1000), (2, 6, 0, 0, 1000)]), (60, [(1, 6, KB, KB, 1000), (2, 6, KB, KB, 1000)])], (200, 200)),
        ([(0, [(1, 6, 9 * KB, 9 * KB, 1000), (2, 6, 0, 0, 1000)]), (60, [(1, 6, 5, 5, 1000), (2, 6, KB, KB, 1000)])], (100, 100)),
        ([(0, [(1, 6, 0, 0, 1000)]), (60, [(1, 6, KB, KB, 1000), (2, 6, 10**15, 10**15, 1000)])], (100, 100)),
        ([(0, [(1, 6, 0, 0, 1000), (2, 6, 5, 5, 1000)]), (60, [(1, 6, KB, KB, 1000)])], (100, 100)),
        ([(0, [(1, 6, 0, 0, 1000)]), (60, [(1, 6, 10**12, KB, 1000)])], (0, 100)),
        ([(0, [(1, 6, 0, 0, 0)]), (60, [(1, 6, 10**12, 0, 0)])], (1e12 * 8 / 60 / 1000, 0)),
        ([(0, [(1, 6, 0, 0, 1000), (2, 131, 0, 0, 0)]), (60, [(1, 6, KB, KB, 1000), (2, 131, KB, KB, 0)])], (100, 100)),
        ([(0, [(1, 6, 0, 0, 1000)]), (3, [(1, 6, KB, KB, 1000)])], (0, 0)),
        # an interface that vanishes for a poll starts anew; a late poll repeats the known rate and moves nothing
        ([(0, [(1, 6, 0, 0, 9)]), (60, [(2, 6, 0, 0, 9)]), (120, [(1, 6, KB, KB, 9), (2, 6, 0, 0, 9)])], (0, 0)),
        ([(0, [(1, 6, 0, 0, 9)]), (60, [(1, 6, KB, KB, 9)]), (30, [(1, 6, 9, 9, 9)])], (100, 100)),
        ([(0, [(1, 6, 0, 0, 9)]), (60, [(1, 6, KB, KB, 9)]), (30, [(1, 6, 9, 9, 9)]), (120, [(1, 6, 2 * KB, 2 * KB, 9)])], (100, 100)),
    ],
)
def test_throughput(spark, polls, expected):
    result = throughput.device_throughput(polls_of(spark, polls)).orderBy(F.desc("poll_arrival")).first()
    assert (result["in_kbps"], result["out_kbps"]) == pytest.approx(expected)


# -------------------------------------------------------------------------------------------------- dedup and gaps


def test_dual_export(spark, rows):
    def marked(policy, data):
        frame = spark.createDataFrame(data, "arrival_no bigint, dedup_key string, family string, s double").withColumn("ts", at(F.col("s")))
        return dedup.mark_duplicates(frame, policy)

    data = [(0, "dev:1", "sflow", 0.0), (1, "dev:1", "netflow", 1.0), (2, "dev:1", "sflow", 2.0), (3, "dev:1", "sflow", 299.0), (4, "dev:1", "sflow", 302.0), (5, "dev:2", "sflow", 2.0)]
    got = marked("prefer-netflow", data)
    assert [r[1] for r in rows(got, "arrival_no", "suppressed")] == [False, False, True, True, False, False]
    changes = dedup.suppression_changes(got)
    assert rows(changes, "arrival_no", "suppressed") == [(2, True), (4, False)]
    for policy in ("off", "bogus", ""):
        assert not any(r[0] for r in rows(marked(policy, data), "suppressed"))
    mirrored = [(a, k, {"sflow": "netflow", "netflow": "sflow"}[f], s) for a, k, f, s in data]
    assert [r[1] for r in rows(marked("prefer-sflow", mirrored), "arrival_no", "suppressed")] == [False, False, True, True, False, False]


@pytest.mark.parametrize(
    "version, stream, expected",
    [
        (5, [(0, 10, 1000), (10, 5, 2000), (40, 3, 3000), (43, 1, 4000)], [None, None, "seq_gap", None]),
        (9, [(100, 1, 0), (101, 1, 1), (105, 1, 2)], [None, None, "seq_gap"]),
        (10, [(500, 12, None), (512, 4, None), (600, 1, None)], [None, None, "seq_gap"]),
        (5, [(0xFFFFFFFE, 3, 0), (1, 2, 1), (3, 1, 2)], [None, None, None]),
        (5, [(4000000000, 5, 0), (3, 1, 1), (4, 1, 2)], [None, "seq_resync", None]),
        (9, [(100, 1, 500000), (150, 1, 3000)], [None, "seq_resync"]),
    ],
)
def test_sequence(spark, version, stream, expected):
    data = [(i, "e", 0, version, *s, True) for i, s in enumerate(stream)]
    frame = spark.createDataFrame(data, "arrival_no bigint, exporter string, domain bigint, version int, sequence bigint, increment bigint, uptime_ms bigint, countable boolean")
    got = sequence.sequence_events(frame).orderBy("arrival_no").collect()
    assert [r["event"] for r in got] == expected


def test_in_order_stream_never_reports_loss(spark):
    """Property: a stream without loss stays silent across any number of counter wraps."""
    frame = spark.range(500).selectExpr(
        "id as arrival_no", "'e' as exporter", "0 as domain", "5 as version", "pmod(id * 40000000, 4294967296) as sequence", "40000000L as increment", "id as uptime_ms", "true as countable"
    )
    assert sequence.sequence_events(frame, span=37).where("event is not null").count() == 0


def test_debounce(spark, rows):
    data = [(0, 1, "7", 0.0), (1, 1, "7", 30.0), (2, 1, "8", 31.0), (3, 2, "7", 32.0), (4, 1, "7", 90.0), (5, 1, "7", 151.0), (6, 1, "", 0.0)]
    frame = spark.createDataFrame(data, "arrival_no bigint, device_id int, cfgtid string, s double").withColumn("ts", at(F.col("s")))
    keyed = frame.withColumn("trigger", triggers.trigger_key())
    got = triggers.debounce(keyed, keys=["device_id", "trigger"])
    assert rows(got, "device_id", "trigger", "event_count", "last_arrival") == [(1, "7", 1, 5), (1, "7", 3, 4), (1, "8", 1, 2), (1, "_", 1, 6), (2, "7", 1, 3)]


# ------------------------------------------------------------------------------------------------------ flow times

RECV = 1_783_080_000_000


def record(spark, **given):
    columns = {name: None for name in datagrams.COLUMNS} | given
    kinds = {name: "string" if datagrams.ELEMENTS.get(name, ("u",))[0] != "u" else "bigint" for name in datagrams.COLUMNS}
    frame = spark.range(1).select(*[F.lit(v).cast(kinds[k]).alias(k) for k, v in columns.items()])
    return frame.withColumn("export_ms", F.lit(RECV).cast("bigint")).withColumn("uptime_ms", F.lit(500000).cast("bigint"))


@pytest.mark.parametrize(
    "given, expected",
    [
        ({"start_s": RECV // 1000 - 70, "end_s": RECV // 1000 - 10}, (-70000, -10000)),
        ({"start_s": RECV // 1000 - 70, "end_s": RECV // 1000 - 10, "start_ms": RECV - 30000, "end_ms": RECV - 5000}, (-30000, -5000)),
        ({"start_delta_us": 60_000_000, "end_delta_us": 5_000_000}, (-60000, -5000)),
        ({"observed_ms": RECV - 3000}, (-3000, -3000)),
        ({"observed_ms": RECV - 3000, "duration_ms": 2000}, (-5000, -3000)),
        ({"start_uptime": 440000}, (-60000, -60000)),
        ({}, (0, 0)),
        ({"start_ms": RECV + 10_750_000, "end_ms": RECV + 10_800_000}, (-50000, 0)),
        ({"start_ms": RECV + 10_900_000, "end_ms": RECV + 10_800_000}, (0, 0)),
        ({"start_ms": 0, "end_ms": RECV - 5000}, (-5000, -5000)),
        ({"start_ms": RECV, "end_ms": RECV - 5000}, (-5000, -5000)),
        ({"start_ms": RECV - 5000 - 86_400_000, "end_ms": RECV - 5000}, (-86405000, -5000)),
        ({"start_ms": RECV - 5001 - 86_400_000, "end_ms": RECV - 5000}, (-5000, -5000)),
    ],
)
def test_flow_times(spark, given, expected):
    got = flows.with_record_times(record(spark, **given), F.lit(float(RECV))).first()["_t"]
    assert (got["start_ms"] - RECV, got["end_ms"] - RECV) == expected


def test_ntp(spark):
    export = F.lit(1_780_000_000_000).cast("bigint")

    def ms(seconds, fraction, micro, export_ms=export):
        value = f"{(seconds + flows.NTP_UNIX_OFFSET) % 2**32:08X}{fraction:08X}"
        return spark.range(1).select(flows.ntp_to_ms(F.lit(value), export_ms, micro=micro)).first()[0]

    assert ms(1779999990, 0x80000000, True) == 1779999990500
    assert ms(1779999990, 0x00418938, False) - 1779999990000 == 1
    assert ms(1779999990, 0x00418938, True) == 1779999990000
    far = 2_208_988_800 + 5
    assert ms(far, 0, False, F.lit(far * 1000).cast("bigint")) == far * 1000


def test_v5_wraps(spark):
    def times(uptime, first, last, export=T0 * 1000):
        frame = spark.range(1).select(
            F.lit(uptime).cast("bigint").alias("uptime_ms"), F.lit(first).cast("bigint").alias("first_ms"), F.lit(last).cast("bigint").alias("last_ms"), F.lit(export).cast("bigint").alias("export_ms")
        )
        t = frame.select(flows.v5_times(F.lit(float(export))).alias("t")).first()["t"]
        return t["end_ms"] - export, t["end_ms"] - t["start_ms"]

    assert times(200000, 4294800000, 100000) == (-100000, 267296)
    assert times(5000, 4294400000, 4294500000) == (-472296, 100000)


@pytest.mark.parametrize(
    "given, expected",
    [
        ({"fwd_bytes": 100, "fwd_packets": 2}, [(100, 2)]),
        ({"out_bytes": 300, "out_packets": 3}, [(300, 3)]),
        ({"initiator_bytes": 5000}, [(5000, 0)]),
        ({"fwd_bytes": 100, "out_bytes": 40, "out_packets": 1}, [(40, 1), (100, 0)]),
        ({"fwd_bytes": 100, "rev_bytes": 0, "rev_packets": 0}, [(100, 0)]),
        ({"responder_bytes": 10}, []),
        ({"total_bytes": 10}, []),
        ({"fwd_bytes": 10, "fw_event": 5}, []),
        ({"fw_event": 3}, [(0, 0)]),
        ({"fwd_bytes": 2**62}, [(None, 0)]),
    ],
)
def test_counters(spark, rows, given, expected):
    base = record(spark, src_v4="10.0.0.1", **given)
    frame = base.selectExpr("*", "0L as arrival_no", "0L as set_order", "0 as record_no", "'e' as exporter", "1L as sequence", "9 as version", "4L as sampling_rate", "timestamp_millis(export_ms) as recv_ts")
    got = rows(flows.template_flows(frame), "bytes", "packets")
    scaled = sorted(((None if b is None else b * 4, p * 4) for b, p in expected), key=repr)
    assert got == scaled


# ------------------------------------------------------------------------------------------------ hand-made packets


def datagram_frame(spark, payloads):
    data = [(i, "192.0.2.1", bytearray(p)) for i, p in enumerate(payloads)]
    return spark.createDataFrame(data, "arrival_no bigint, exporter string, payload binary").withColumn("recv_ts", F.timestamp_seconds(F.lit(T0)))


def set_of(set_id, body):
    return struct.pack(">HH", set_id, len(body) + 4) + body


def test_ipfix_variable_length_and_enterprise(spark, rows):
    fields = struct.pack(">HH", 8, 4) + struct.pack(">HHI", 0x8000 | 56701, 65535, 25461) + struct.pack(">HH", 1, 3) + struct.pack(">HHI", 0x8001, 4, 29305)
    template = struct.pack(">HH", 400, 4) + fields
    withdrawal = struct.pack(">HH", 401, 0)
    long_name = b"x" * 300
    one = bytes([10, 0, 0, 9]) + b"\x04ssl\x00" + b"\x00\x01\x00" + struct.pack(">I", 7)
    two = bytes([10, 0, 0, 8]) + b"\xff" + struct.pack(">H", 300) + long_name + b"\x00\x00\x05" + struct.pack(">I", 0)
    body = set_of(2, withdrawal + template) + set_of(400, one + two + b"\x00\x00") + set_of(7, b"skip")
    head = struct.pack(">HHIII", 10, 16 + len(body), T0, 5, 77)
    frame = datagram_frame(spark, [head + body + b"trailing"])
    got = plan.template_flows(frame)
    # the element number of the application name has the enterprise bit set itself, so only v9 can carry it
    assert rows(got, "src_addr", "app_name", "bytes") == [("10.0.0.8", None, 5), ("10.0.0.9", None, 256), (None, None, 7)]
    announced = datagrams.templates(datagrams.sets(datagrams.framed(frame)))
    assert rows(announced, "template_id", "verdict") == [(400, None), (None, "template_withdrawal")]


def test_v9_application_name(spark, rows):
    template = struct.pack(">HH", 300, 2) + struct.pack(">HHHH", 8, 4, 56701, 32)
    data = bytes([10, 0, 0, 1]) + b"web-browsing ".ljust(32, b"\x00")
    head = struct.pack(">HHIIII", 9, 2, 1000, T0, 1, 0)
    got = plan.template_flows(datagram_frame(spark, [head + set_of(0, template) + set_of(300, data)]))
    assert rows(got, "src_addr", "app_name") == [("10.0.0.1", "web-browsing")]


def test_v9_options_are_counted_in_bytes_and_scale_flows(spark, rows):
    options = struct.pack(">HHH", 500, 4, 8) + struct.pack(">HHHHHH", 1, 4, 48, 1, 50, 2)
    template = struct.pack(">HH", 300, 3) + struct.pack(">HHHHHH", 8, 4, 48, 1, 1, 4)
    sampler = struct.pack(">IBH", 0, 3, 100)
    data = bytes([10, 0, 0, 1, 3]) + struct.pack(">I", 5) + bytes([10, 0, 0, 2, 4]) + struct.pack(">I", 5)
    body = set_of(1, options) + set_of(0, template) + set_of(500, sampler) + set_of(300, data)
    head = struct.pack(">HHIIII", 9, 9, 1000, T0, 1, 0)
    got = plan.template_flows(datagram_frame(spark, [head + body]))
    assert rows(got, "src_addr", "sampling_rate", "bytes") == [("10.0.0.1", 100, 500), ("10.0.0.2", 1, 5)]


def test_broken_sets_keep_what_came_before(spark, rows):
    template = struct.pack(">HH", 300, 1) + struct.pack(">HH", 8, 4)
    good = set_of(0, template) + set_of(300, bytes([10, 0, 0, 1]))
    head = struct.pack(">HHIIII", 9, 2, 1000, T0, 1, 0)
    frame = datagram_frame(spark, [head + good + struct.pack(">HH", 300, 2), head[:10]])
    assert rows(plan.template_flows(frame), "src_addr") == [("10.0.0.1",)]
    assert rows(datagrams.framed(frame), "arrival_no", "event") == [(0, "malformed"), (1, "malformed")]
    events = {r["event"]: r["total"] for r in plan.parse_events(frame).collect()}
    assert events["malformed"] == 2


def sflow_packet(samples):
    head = struct.pack(">III", 5, 1, 0x0A000001) + struct.pack(">IIII", 0, 9, 1, len(samples))
    return head + b"".join(struct.pack(">II", tag, len(body)) + body for tag, body in samples)


def test_sflow_tunnel_and_broken_samples(spark, rows):
    inner = struct.pack(">IHBB", 0x60000000, 0, 17, 64) + bytes(15) + b"\x01" + bytes(15) + b"\x02" + struct.pack(">HHHH", 53, 5353, 8, 0)
    ip = struct.pack(">BBHHHBBH", 0x45, 0, 100, 0, 0, 64, 41, 0) + bytes([10, 0, 0, 1, 10, 0, 0, 2])
    frame = bytes(12) + struct.pack(">H", 0x0800) + ip

    def sample(header, broken=False):
        raw = struct.pack(">IIII", 1, 200, 0, len(header)) + header
        items = struct.pack(">II", 1, len(raw) + (50 if broken else 0)) + raw
        return struct.pack(">IIIIIIII", 1, 2, 10, 0, 4, 0x40000003, 5, 1) + items

    packet = sflow_packet([(1, sample(frame + inner)), (1, sample(frame + inner[:20])), (1, sample(frame + inner, True)), (0x1001, b"abcd")])
    got = sflow.flow_samples(sflow.samples(datagram_frame(spark, [packet])))
    assert rows(got, "src_addr", "protocol", "dst_port", "bytes", "packets", "input_if_index", "drops") == [
        ("10.0.0.1", 41, None, 2000, 10, 3, 4),
        ("::1", 17, 5353, 2000, 10, 3, 4),
    ]


def test_both_listeners_end_to_end(spark, rows):
    record = bytes([172, 16, 0, 1, 172, 16, 0, 2, 0, 0, 0, 0]) + struct.pack(">HHIIIIHH", 1, 2, 3, 400, 1000, 2000, 1234, 443) + bytes([0, 2, 6, 0]) + bytes(8)
    netflow = struct.pack(">HHIIIIBBH", 5, 1, 2000, T0, 0, 1, 0, 0, 0) + record
    ip = struct.pack(">BBHHHBBH", 0x45, 0, 100, 0, 0, 64, 17, 0) + bytes([172, 16, 0, 3, 172, 16, 0, 4]) + struct.pack(">HH", 53, 53)
    frame = bytes(12) + struct.pack(">H", 0x0800) + ip
    raw = struct.pack(">IIII", 1, 90, 0, len(frame)) + frame
    sample = struct.pack(">IIIIIIII", 1, 2, 1, 0, 0, 1, 2, 1) + struct.pack(">II", 1, len(raw)) + raw
    first = datagram_frame(spark, [netflow]).withColumn("exporter", F.lit("10.0.0.1"))
    second = datagram_frame(spark, [b"", sflow_packet([(1, sample)])]).where("arrival_no = 1")
    devices = spark.createDataFrame([(5, 0, "10.0.0.1")], "id bigint, list_no bigint, ip_address string")
    addresses = spark.createDataFrame([], "device_id bigint, write_no bigint, ip_address string")

    def table(policy):
        result = plan.flow_samples(first, second, devices, addresses, probe_id=3, policy=policy)
        return rows(result, "device_id", "probe_id", "flow_source", "src_addr", "bytes", "drops")

    v5, sampled = (5, 3, 1, "172.16.0.1", 400, 0), (5, 3, 0, "172.16.0.3", 90, 0)
    assert table("off") == [sampled, v5]
    assert table("prefer-netflow") == [v5]


# ------------------------------------------------------------------------------------------------- texts and tables


def test_addresses(spark, rows):
    cases = {"::1": "::1", "2001:DB8:0:0:1:0:0:1": "2001:db8::1:0:0:1", "1:0:0:4:0:0:0:8": "1:0:0:4::8", "::ffff:1.2.3.4": "1.2.3.4", "010.0.0.1": None, "1:2:3": None, "10.0.0.1": "10.0.0.1"}
    frame = spark.createDataFrame(list(cases.items()), "text string, want string")
    assert frame.where(~net.canonical_ip(F.col("text")).eqNullSafe(F.col("want"))).count() == 0


@pytest.mark.parametrize(
    "host, sd, expected",
    [("FGT-1000", "x", 1000), ("fgt.1000", "x", 1000), ("fgt_1000", "x", 1000), ("FGT1234", "x", 1234), ("FG100A-0042", "x", 100), ("FGT-abc", "x", 0), ("FGT", "", 0), ("-", "[12]", 12),
     ("core", '{"fortigate@1": {"device-id": "0x10"}}', 10)],
)
def test_device_hint(spark, host, sd, expected):
    assert spark.range(1).select(syslog.device_hint(F.lit(host), F.lit(sd))).first()[0] == expected


def test_syslog_line(spark):
    line = '<189> 1 2025-04-10T05:01:53.000000-07:00 FGT-1000 fglog 1234 MSG-001 [origin] date=2025-04-10 time=05:01:53 logid="0100044547" msg="a b" user= x'
    frame = spark.createDataFrame([(line,)], "line string").withColumn("recv_ts", F.timestamp_seconds(F.lit(T0)))
    got = syslog.events(syslog.messages(frame)).first()
    assert (got["priority"], got["facility"], got["severity"], got["hostname"], got["device_hint"]) == (189, 23, 5, "FGT-1000", 1000)
    assert (got["logid"], got["msg"], got["user"], got["timestamp"].isoformat()) == ("0100044547", "a b", "", "2025-04-10T12:01:53")


@pytest.mark.parametrize("text, ok", [("2025-04-10T05:01:53.000Z", True), ("2025-04-10T05:01:53+02:00", True), ("Oct  1 05:01:53", True), ("Oct 11 05:01:53", True), ("2025-04-10 05:01:53", True), ("not a timestamp", False), ("10-04-2025T05:01:53Z", False), ("-", False)])
def test_timestamps(spark, text, ok):
    value = spark.range(1).select(F.unix_seconds(syslog.timestamp(F.lit(text), F.timestamp_seconds(F.lit(T0))))).first()[0]
    assert (value != T0) == ok


def pdu_frame(spark, cells):
    data = [(1, i, oid, kind, value if isinstance(value, str) else None, bytearray(value) if isinstance(value, bytes) else None) for i, (oid, kind, value) in enumerate(cells)]
    frame = spark.createDataFrame(data, "device_id bigint, pdu_no int, oid string, pdu_type string, value string, value_bytes binary")
    return frame.withColumn("poll_ts", F.timestamp_seconds(F.lit(T0)))


def test_topology(spark, rows):
    good, multicast = b"\xaa\xbb\xcc\x00\x11\x22", b"\x01\x00\x5e\x00\x00\x01"
    media, physical = ".1.3.6.1.2.1.4.22.1.2.", ".1.3.6.1.2.1.4.35.1.4."
    arp = pdu_frame(spark, [(media + "4.192.168.5.107", "OctetString", good), (media + "4.192.168.5.108", "OctetString", multicast), (media + "192.168.5.1", "OctetString", good)])
    assert rows(topology.arp_table(arp), "if_index", "ip_address", "mac_address") == [(4, "192.168.5.107", "aa:bb:cc:00:11:22")]
    newer = pdu_frame(spark, [(physical + "2.1.4.10.1.1.5", "OctetString", good), (physical + "3.1.10.1.1.6", "OctetString", good), (physical + "2.2.16.1", "OctetString", good)])
    assert rows(topology.arp_table(newer), "if_index", "ip_address") == [(2, "10.1.1.5"), (3, "10.1.1.6")]
    port, status, base = ".1.3.6.1.2.1.17.7.1.2.2.1.2.", ".1.3.6.1.2.1.17.7.1.2.2.1.3.", ".1.3.6.1.2.1.17.1.4.1.2."
    mac = "0.17.34.51.68.85"
    fdb = pdu_frame(spark, [
        (base + "1", "Integer", "9"), (base + "2", "Integer", "10"), (port + "10." + mac, "Integer", "1"), (status + "10." + mac, "Integer", "3"), (port + "20." + mac, "Integer", "2"),
        (port + "30." + mac, "Integer", "1"), (status + "30." + mac, "Integer", "4"), (port + "40." + mac, "Integer", "7"), (port + "50.1.0.94.0.0.1", "Integer", "1"),
    ])
    assert rows(topology.fdb_table(fdb), "vlan_id", "if_index") == [(10, 9), (20, 10)]


@pytest.mark.parametrize("arp, fdb, kept, dropped", [(10, 20, 30, 0), (1000, 4000, 4000, 1000), (4005, 3, 4000, 8)])
def test_cap(spark, arp, fdb, kept, dropped):
    frame = spark.range(arp + fdb).selectExpr("1 as device_id", "id as entry_no", f"if(id < {fdb}, 'fdb', 'arp') as entry_type")
    report = snapshots.cap_report(frame, keys=["device_id"], cap=snapshots.TOPOLOGY_ROW_CAP).first()
    rows_kept = snapshots.cap_rows(frame, keys=["device_id"], cap=snapshots.TOPOLOGY_ROW_CAP)
    assert (report["kept"], report["dropped"], rows_kept.count()) == (kept, dropped, kept)
    assert rows_kept.where("entry_type = 'arp'").count() == min(arp, 4000)


def test_disk(spark, rows):
    base = ".1.3.6.1.2.1.25.2.3.1."
    cells = []
    for index, kind, mount in ((31, "4", "/"), (32, "2", "/ram"), (33, "4", "/var/unbound/dev"), (34, "4", "/")):
        cells += [(f"{base}2.{index}", "ObjectIdentifier", f".1.3.6.1.2.1.25.2.1.{kind}"), (f"{base}3.{index}", "OctetString", mount), (f"{base}4.{index}", "Integer", "512"), (f"{base}5.{index}", "Integer", "59927272"), (f"{base}6.{index}", "Integer", "2452560")]
    assert rows(snmp.disk_usage(pdu_frame(spark, cells)), "mount", "total_bytes", "used_bytes") == [("/", 30682763264, 1255710720)]


def test_phase2_selectors(spark, rows):
    text = 'edit "a"\n set src-subnet 192.168.13.7 255.255.255.0\n set dst-subnet 10.0.0.0 255.0.255.0\nnext\nedit "b"\nnext'
    frame = spark.createDataFrame([(1, text)], "device_id int, output string")
    assert rows(cli.vpn_phase2(frame), "tunnel_name", "local_subnet", "remote_subnet") == [("a", "192.168.13.0/24", ""), ("b", "", "")]


def test_ping(spark):
    frame = spark.createDataFrame([("t", True, 10.0), ("t", False, None), ("u", False, None)], "target string, replied boolean, latency_ms double")
    got = {r["target"]: (r["success"], r["latency"], r["packet_loss"], r["error_message"]) for r in metrics.ping_summary(frame, keys=["target"]).collect()}
    assert got == {"t": (True, 10.0, 50.0, ""), "u": (False, 0.0, 100.0, "Request timeout")}
