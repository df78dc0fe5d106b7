"""Decoding of whole batches against plain parsers that read one payload, one item and one field at a time."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from siftnet.operators import datagrams, sflow
from siftnet.plans import flows as plan

T0 = 1_700_000_000
VARIABLE = 65535


def frame_of(spark, payloads, parts=3):
    data = [(i, f"192.0.2.{i % 3}", bytearray(p)) for i, p in enumerate(payloads)]
    rows = spark.createDataFrame(data, "arrival_no bigint, exporter string, payload binary")
    return rows.withColumn("recv_ts", F.timestamp_seconds(F.lit(T0))).repartition(parts)


def u(data, at, width):
    return int.from_bytes(data[at : at + width], "big")


# ------------------------------------------------------------------------------------------------------ v9 and IPFIX


def plain_sets(payload):
    """(sets, broken) of one datagram; None if it is no v9 or IPFIX."""
    version = u(payload, 0, 2)
    if len(payload) < 2 or version not in (9, 10):
        return None
    head = 20 if version == 9 else 16
    end = len(payload) if version == 9 or len(payload) < 4 else min(u(payload, 2, 2), len(payload))
    if len(payload) < head or end < head:
        return [], True
    at, sets = head, []
    while at + 4 <= end:
        size = u(payload, at + 2, 2)
        if size < 4 or at + size > end:
            return sets, True
        sets.append((u(payload, at, 2), payload[at + 4 : at + size]))
        at += size
    return sets, False


def plain_records(body, layout):
    """Records of a data set as dicts of columns, and whether it broke off."""
    slots = datagrams.element_slots()
    shortest = sum(1 if n == VARIABLE else n for _, n, _ in layout)
    records, at = [], 0
    while len(body) - at >= shortest:
        row = {}
        for ie, size, pen in layout:
            if size == VARIABLE:
                if at >= len(body):
                    return records, True
                size, at = body[at], at + 1
                if size == 255:
                    if at + 2 > len(body):
                        return records, True
                    size, at = u(body, at, 2), at + 2
            if at + size > len(body):
                return records, True
            value, at = body[at : at + size], at + size
            if (pen, ie) not in slots:
                continue
            slot, kind, width = slots[pen, ie]
            name = datagrams.COLUMNS[slot]
            if kind == "u":
                if 1 <= size <= 8:
                    row[name] = u(value, 0, size) if u(value, 0, size) < 2**63 else None
            elif kind == "t":
                if 1 <= size <= 8:
                    row[name] = value.hex().upper().rjust(16, "0")
            elif kind == "s":
                row[name] = value.split(b"\0")[0].decode().strip(" ")
            elif kind == "n":
                if size == width and any(value):
                    row[name] = value.hex()
            else:
                row[name] = value.hex() if size == width else None
        records.append(row)
    return records, False


def random_layout(rng):
    known = list(datagrams.element_slots())
    fields = []
    for _ in range(rng.randint(1, 12)):
        pen, ie = rng.choice(known) if rng.random() < 0.85 else (0, 9999)
        fields.append((ie, rng.choice([1, 2, 3, 4, 4, 8, 16, VARIABLE, 0, 9]), pen))
    return fields


def random_body(rng, layout, records):
    out = b""
    for _ in range(records):
        for ie, size, _ in layout:
            if size == VARIABLE:
                size = rng.choice([0, 1, 4, 16, 30, 300])
                out += bytes([size]) if size < 255 else b"\xff" + struct.pack(">H", size)
            out += bytes(rng.choice([0, 0, 1, 65, 255]) if ie != 56701 else rng.choice([0, 32, 65, 66]) for _ in range(size))
    return out + bytes(rng.randint(0, 3))


@pytest.mark.parametrize("seed", [1])
def test_records_equal_a_plain_parser(spark, seed):
    rng = random.Random(seed)
    layouts = [random_layout(rng) for _ in range(12)]
    layouts = [fields for fields in layouts if sum(1 if n == VARIABLE else n for _, n, _ in fields)]
    sets = []
    for i in range(120):
        layout = rng.choice(layouts)
        body = random_body(rng, layout, rng.randint(0, 9))
        sets.append((i, body[: rng.randint(0, len(body))] if rng.random() < 0.4 else body, layout))
    schema = "set_order long, body binary, fields array<struct<ie: int, length: int, pen: bigint>>, event string"
    rows = [(i, bytearray(body), layout, None) for i, body, layout in sets] + [(999, bytearray(b"abcd"), None, "data_before_template")]
    matched = spark.createDataFrame(rows, schema).repartition(3)

    addresses = {c for c, kind in datagrams.KINDS.items() if kind in "46an"}
    got = {}
    for r in datagrams.records(matched).collect():
        got[r.set_order, r.record_no] = {c: r[c] for c in datagrams.COLUMNS}
    expected = {}
    for i, body, layout in sets:
        for n, row in enumerate(plain_records(body, layout)[0]):
            expected[i, n] = {c: row.get(c) for c in datagrams.COLUMNS}
    used = {row[c] for row in expected.values() for c in addresses} - {None}
    data = spark.createDataFrame([(v,) for v in used], "v string")
    texts = {r.v: r.t for r in data.select("v", datagrams.net.ip_from_bytes(F.unhex("v")).alias("t")).collect()}
    for row in expected.values():
        row.update({c: texts[row[c]] for c in addresses if row[c] is not None})
    assert got == expected
    outcome = {r.set_order: (r.records, r.event) for r in datagrams.decoded_sets(matched).collect()}
    assert outcome.pop(999) == (0, "data_before_template")
    for i, body, layout in sets:
        records, broken = plain_records(body, layout)
        assert outcome[i] == (len(records), "malformed" if broken else None), i


def test_sets_equal_a_plain_parser(spark):
    rng = random.Random(3)
    payloads = [b"", b"\0", b"\0\x09", struct.pack(">HH", 10, 3)]
    for _ in range(150):
        body = b"".join(struct.pack(">HH", s, n + 4 + rng.choice([0, 0, 0, 0, 1, 500])) + bytes(n) for s, n in ((rng.choice([0, 1, 2, 3, 9, 256, 300]), rng.randint(0, 20)) for _ in range(rng.randint(0, 6))))
        head = struct.pack(">HHIIII", 9, 2, 1000, T0, 1, 0) if rng.random() < 0.5 else struct.pack(">HHIII", 10, 16 + len(body) + rng.choice([0, 0, -3, 7]), T0, 5, 77)
        whole = head + body
        payloads.append(whole[: rng.randint(0, len(whole))] if rng.random() < 0.3 else whole)
    frame = frame_of(spark, payloads)
    for bodies in (True, False):
        framed = datagrams.framed(frame, bodies=bodies)
        got = {r.arrival_no: ([(s.set_id, None if s.body is None else bytes(s.body)) for s in r.sets], r.event) for r in framed.collect()}
        for i, payload in enumerate(payloads):
            plain = plain_sets(payload)
            if plain is None:
                assert i not in got
                continue
            sets = [(s, b if bodies or s < 256 else None) for s, b in plain[0]]
            assert got[i] == (sets, "malformed" if plain[1] else None), i


# ------------------------------------------------------------------------------------------------------------- sFlow


def plain_items(data, at, count):
    found = []
    while count and at < len(data):
        if at + 8 > len(data) or at + 8 + u(data, at + 4, 4) > len(data):
            return found, True
        size = u(data, at + 4, 4)
        found.append((u(data, at, 4), data[at + 8 : at + 8 + size]))
        at, count = at + 8 + size, count - 1
    return found, False


def plain_packet(o):
    """(src, dst, protocol, src_port, dst_port, flags) of a sampled Ethernet header."""
    if len(o) < 14:
        return (None,) * 6
    kind, at = u(o, 12, 2), 14
    while kind in sflow.VLAN_TYPES:
        kind, at = (u(o, at + 2, 2) if at + 4 <= len(o) else None), at + 4
    src = dst = protocol = transport = None
    six = at if kind == 0x86DD else None
    if kind == 0x0800 and len(o) - at >= 20 and len(o) - at >= (o[at] & 15) * 4 >= 20:
        src, dst, protocol, transport = o[at + 12 : at + 16], o[at + 16 : at + 20], o[at + 9], at + (o[at] & 15) * 4
        if protocol == 41:
            six, transport = transport, None
    if six is not None and len(o) - six >= 40:
        src, dst, protocol, transport = o[six + 8 : six + 24], o[six + 24 : six + 40], o[six + 6], six + 40
        while protocol in sflow.EXTENSION_HEADERS and transport + 2 <= len(o):
            units = o[transport + 1]
            step = 8 if protocol == 44 else (units + 2) * 4 if protocol == 51 else (units + 1) * 8
            protocol, transport = o[transport], transport + step
    left = len(o) - transport if transport is not None else -1
    ports = (protocol == 6 and left >= 14) or (protocol == 17 and left >= 4)
    return (
        src, dst, protocol, u(o, transport, 2) if ports else None, u(o, transport + 2, 2) if ports else None,
        o[transport + 13] if ports and protocol == 6 else None,
    )


def plain_path(r):
    """(next hop, own system, path) of a gateway record."""
    size = {1: 4, 2: 16}.get(u(r, 0, 4) if len(r) >= 4 else 0)
    if size is None:
        return None, None, None
    hop = r[4 : 4 + size] if len(r) >= 4 + size else None
    own = u(r, size + 8, 4) if len(r) >= size + 12 else None
    if len(r) < size + 20:
        return hop, own, None
    at, path = size + 20, []
    for _ in range(u(r, size + 16, 4)):
        if at >= len(r):
            break
        if at + 8 > len(r):
            return hop, own, None
        listed, room = u(r, at + 4, 4), len(r) - at - 8
        fitting = min(listed, room // 4)
        if fitting < listed and room % 4:
            return hop, own, None
        path += [u(r, at + 8 + 4 * i, 4) for i in range(fitting)]
        at += 8 + 4 * fitting
    return hop, own, path or None


def plain_samples(payload):
    if len(payload) < 8 or u(payload, 0, 4) != 5 or u(payload, 4, 4) not in (1, 2):
        return []
    size = 4 if u(payload, 4, 4) == 1 else 16
    if len(payload) < size + 24:
        return []
    return list(enumerate(plain_items(payload, size + 24, u(payload, size + 20, 4))[0]))


def plain_flows(payload):
    for no, (tag, body) in plain_samples(payload):
        at = {1: (8, 16, 20, 24, 28), 3: (12, 20, 28, 36, 40)}.get(tag)
        if at is None or len(body) < at[4] + 4:
            continue
        records, broken = plain_items(body, at[4] + 4, u(body, at[4], 4))
        if broken:
            continue
        last = dict(records)
        raw, gateway = last.get(1, b""), last.get(1003)
        frame, header = None, b""
        if len(raw) >= 16 and len(raw) >= 16 + u(raw, 12, 4):
            frame = u(raw, 4, 4)
            header = raw[16 : 16 + u(raw, 12, 4)] if u(raw, 0, 4) == 1 else b""
        packet = plain_packet(header)
        if packet[0] is None:
            continue
        low = (1 << 30) - 1 if tag == 1 else -1
        hop, own, path = plain_path(gateway) if gateway is not None else (None, None, None)
        yield (no, u(body, at[0], 4), u(body, at[1], 4), u(body, at[2], 4) & low, u(body, at[3], 4) & low, frame or 0, *packet[2:], own, path and path[-1], path and " ".join(map(str, path)))


def sflow_payload(rng):
    def header():
        ports = struct.pack(">HHIIBBH", rng.randint(0, 65535), 80, 1, 2, 80, 18, 0) + bytes(6)
        kind = rng.randint(0, 4)
        if kind == 0:
            inner = struct.pack(">HBBHHHBBH", 0x0800, 0x45, 0, 100, 0, 0, 64, rng.choice([6, 17, 1]), 0) + bytes([10, 0, 0, 1, 10, 0, 0, 2])
        elif kind == 1:
            inner = struct.pack(">H", 0x0800) + struct.pack(">BBHHHBBH", 0x46, 0, 100, 0, 0, 64, 6, 0) + bytes([10, 0, 0, 3, 10, 0, 0, 4]) + bytes(4)
        else:
            chain = rng.choice([[], [0], [43, 44], [51, 60], [0, 43, 51, 44, 135]])
            order = [*chain, rng.choice([6, 17, 58])]
            parts = b"".join(bytes([following, n := rng.randint(0, 2)]) + bytes(8 if now == 44 else (n + 2) * 4 if now == 51 else (n + 1) * 8)[2:] for now, following in zip(order, order[1:]))
            six = struct.pack(">IHBB", 0x60000000, 0, order[0], 64) + bytes(15) + b"\1" + bytes(15) + b"\2" + parts
            tunnel = struct.pack(">BBHHHBBH", 0x45, 0, 100, 0, 0, 64, 41, 0) + bytes([10, 0, 0, 5, 10, 0, 0, 6])
            inner = struct.pack(">H", 0x86DD) + six if kind < 4 else struct.pack(">H", 0x0800) + tunnel + six
        tags = b"".join(struct.pack(">HH", rng.choice(sflow.VLAN_TYPES), 5) for _ in range(rng.choice([0, 0, 1, 3])))
        whole = bytes(12) + tags + inner + ports
        return whole[: rng.randint(0, len(whole))] if rng.random() < 0.4 else whole

    def gateway():
        family = rng.choice([1, 2, 1, 3])
        out = struct.pack(">I", family) + bytes(range(1, 5 if family != 2 else 17)) + struct.pack(">III", 64500, rng.randint(1, 9), 3)
        segments = rng.randint(0, 3)
        out += struct.pack(">I", segments)
        for _ in range(segments):
            n = rng.randint(0, 4)
            out += struct.pack(">II", 2, n + rng.choice([0, 0, 0, 2])) + b"".join(struct.pack(">I", rng.randint(1, 99)) for _ in range(n))
        out += struct.pack(">III", 1, 7, 100) if rng.random() < 0.5 else b""
        return out[: rng.randint(0, len(out))] if rng.random() < 0.3 else out

    def items(parts):
        return b"".join(struct.pack(">II", tag, len(body) + rng.choice([0] * 60 + [3, 900])) + body for tag, body in parts)

    def counters():
        return struct.pack(">IIQIIQIIIIIIQIIIII", rng.choice([0, 7]), 6, rng.choice([10**9, 2**63]), 1, 3, 5 * 10**12, 0, 0, 0, 4, 5, 0, 6 * 10**12, 0, 0, 0, 7, 8)[: rng.choice([84, 84, 88, 70])]

    samples = []
    for _ in range(rng.randint(0, 5)):
        if rng.random() < 0.6:
            h = header()
            raw = struct.pack(">IIII", rng.choice([1, 1, 1, 2]), rng.choice([0, 90, 1500]), 4, len(h) + rng.choice([0, 0, 0, 0, 5])) + h
            parts = [(1, raw)] + [(1003, gateway())] * rng.randint(0, 1) + [(999, b"zzzz")] * rng.randint(0, 1) + [(1, raw)] * rng.choice([0, 0, 1])
            if rng.random() < 0.5:
                samples.append((1, struct.pack(">IIIIIIII", 1, 2, rng.choice([0, 1, 10]), 0, 4, 0x40000003, 5, len(parts)) + items(parts)))
            else:
                samples.append((3, struct.pack(">IIIIIIIIIII", 1, 0, 2, 10, 0, 4, 0, 2**31, 0, 5, len(parts)) + items(parts)))
        else:
            parts = [(1, counters()) for _ in range(rng.randint(0, 3))]
            tag = rng.choice([2, 4, 0x1002])
            samples.append((tag, (struct.pack(">III", 1, 0x03000009, len(parts)) if tag != 4 else struct.pack(">IIII", 1, 3, 9, len(parts))) + items(parts)))
    family = rng.choice([1, 1, 2, 3])
    head = struct.pack(">II", 5, family) + bytes(range(1, 17 if family == 2 else 5)) + struct.pack(">IIII", 0, 9, 1, len(samples) + rng.choice([0, 0, 1, -1]) % 9)
    whole = head + items(samples)
    return whole[: rng.randint(0, len(whole))] if rng.random() < 0.2 else whole


@pytest.mark.parametrize("seed", [1, 2])
def test_sflow_equals_a_plain_parser(spark, seed):
    rng = random.Random(seed)
    payloads = [b"", b"\0\0\0\5"] + [sflow_payload(rng) for _ in range(250)]
    taken = sflow.samples(frame_of(spark, payloads))
    columns = ["sample_no", "sampling_rate", "drops", "input_if_index", "output_if_index"]
    decoded = sflow.flow_samples(taken).collect()
    got = sorted(((r.arrival_no, *(r[c] for c in columns), r.protocol, r.src_port, r.dst_port, r.tcp_flags, r.src_as, r.dst_as, r.as_path) for r in decoded), key=repr)
    expected = sorted(((i, *row[:5], *row[6:]) for i, p in enumerate(payloads) for row in plain_flows(p)), key=repr)
    assert got == expected and len(got) > 50
    frames = {(r.arrival_no, r.sample_no): (r.bytes, r.packets) for r in decoded}
    for i, payload in enumerate(payloads):
        for row in plain_flows(payload):
            rate, frame = row[1], row[5]
            sampled = frame > 0 and rate > 1
            assert frames[i, row[0]] == (frame * rate if sampled else frame, rate if sampled else int(frame > 0))

    counted = sorted((r.arrival_no, r.sample_no, r.record_no, r.if_index, r.if_speed or 0, r.in_octets, r.out_errors) for r in sflow.interface_counters(taken).collect())
    wanted = []
    for i, payload in enumerate(payloads):
        for no, (tag, body) in plain_samples(payload):
            at = {2: 8, 4: 12}.get(tag)
            if at is None or len(body) < at + 4:
                continue
            for k, (kind, record) in enumerate(plain_items(body, at + 4, u(body, at, 4))[0]):
                if kind == 1 and len(record) >= 84:
                    speed = u(record, 8, 8)
                    wanted.append((i, no, k, u(record, 0, 4) or (u(body, 4, 4) & 0xFFFFFF if tag == 2 else u(body, 8, 4)), speed if speed < 2**63 else 0, u(record, 24, 8), u(record, 80, 4)))
    assert counted == sorted(wanted) and len(wanted) > 20


def test_nothing_to_decode(spark):
    nothing = spark.createDataFrame([(1, "e", None)], "arrival_no bigint, exporter string, payload binary").withColumn("recv_ts", F.timestamp_seconds(F.lit(T0)))
    rows = nothing.unionByName(frame_of(spark, []))
    assert plan.template_flows(rows).count() == 0
    assert plan.sflow_flows(rows).count() == 0
    assert sflow.interface_counters(sflow.samples(rows)).count() == 0
