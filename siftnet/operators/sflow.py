"""sFlow v5 datagrams: flow samples, sampled packet headers, BGP records and interface counters.

The datagram is a list of (tag, length, body) items, and so is every sample inside it. Datagrams become decoded samples in one pass
over Arrow batches: the lists of all datagrams are walked in step, then headers and records of all samples are read field by
field (:mod:`siftnet.functions.ragged`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftnet.functions import net
from siftnet.functions.binary import uint
from siftnet.functions.ragged import Items, Payloads, items, numbers, slices, spread
from siftnet.operators.flows import scaled

# Fixed values of the wire format.
VERSION = 5
FLOW_SAMPLE, COUNTER_SAMPLE, FLOW_SAMPLE_EXPANDED, COUNTER_SAMPLE_EXPANDED = 1, 2, 3, 4
RAW_HEADER, IF_COUNTERS, GATEWAY = 1, 1, 1003
ETHERNET = 1
VLAN_TYPES = [0x8100, 0x88A8, 0x9100]
IPV4_TYPE, IPV6_TYPE = 0x0800, 0x86DD
EXTENSION_HEADERS = [0, 43, 44, 51, 60, 135]
FRAGMENT, AUTHENTICATION, TUNNELLED_IPV6 = 44, 51, 41
TCP, UDP = 6, 17

LOW_30, LOW_24 = (1 << 30) - 1, (1 << 24) - 1
IF_COUNTERS_LENGTH = 84


def samples(datagrams: DataFrame) -> DataFrame:
    """The sFlow v5 datagrams among ``datagrams``: ``arrival_no``, ``recv_ts``, ``payload``."""
    data = F.col("payload")
    return datagrams.where((uint(data, 0, 4) == VERSION) & uint(data, 4, 4).isin(1, 2)).select("arrival_no", "recv_ts", "payload")


@dataclass
class _Samples:
    """Samples of the wanted formats in one batch: the datagram of each, and where its fields stand."""

    payloads: Payloads
    found: Items
    plain: np.ndarray
    agent: np.ndarray
    agent_length: np.ndarray
    sequence: np.ndarray

    def field(self, plain_at: int, expanded_at: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """A number of each sample, by the places it has in plain and in expanded samples."""
        return self.payloads.number(self.found.starts + np.where(self.plain, plain_at, expanded_at), width, self.found.ends)

    def records(self, count_at: tuple[int, int]) -> Items:
        """The records of all samples, behind their number."""
        count, known = self.field(*count_at)
        start = self.found.starts + np.where(self.plain, count_at[0], count_at[1]) + 4
        return items(self.payloads, np.where(known, start, self.found.ends), self.found.ends, np.where(known, count, 0), width=4, whole=False)

    def context(self, batch: pa.RecordBatch, at: np.ndarray) -> dict[str, pa.Array]:
        """Columns of the datagram and the sample, for the samples numbered ``at``."""
        owner = self.found.owner[at]
        of_datagram = pa.array(owner)
        return {
            "arrival_no": batch.column("arrival_no").take(of_datagram),
            "recv_ts": batch.column("recv_ts").take(of_datagram),
            "agent": slices(self.payloads.data, self.agent[owner], self.agent_length[owner]),
            "sequence": pa.array(self.sequence[owner]),
            "sample_no": pa.array(self.found.number[at], pa.int32()),
        }


def _samples(batch: pa.RecordBatch, plain: int, expanded: int) -> _Samples:
    payloads = Payloads.of(batch.column("payload"))
    starts, ends = payloads.starts, payloads.ends
    length = np.where(payloads.number(starts + 4, 4, ends)[0] == 1, 4, 16)
    sequence, _ = payloads.number(starts + length + 12, 4, ends)
    # a datagram that ends before its number of samples has none
    count, known = payloads.number(starts + length + 20, 4, ends)
    found = items(payloads, starts + length + 24, ends, np.where(known, count, 0), width=4, whole=False)
    # the upper 20 bits of the tag are the enterprise; only 0 is decoded
    wanted = found[(found.tag == plain) | (found.tag == expanded)]
    return _Samples(payloads, wanted, wanted.tag == plain, starts + 8, length, sequence)


def _decoder(decode: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield decode(batch)

    return run


CONTEXT = "arrival_no long, recv_ts timestamp, agent binary, sequence long, sample_no int"


# ----------------------------------------------------------------------------------------------------- packet headers


@dataclass
class _Packets:
    """Addresses (place and length, 0 if absent), protocol, ports and flags of sampled headers, with what is known of each."""

    source: np.ndarray
    target: np.ndarray
    address_length: np.ndarray
    protocol: tuple[np.ndarray, np.ndarray]
    ports: tuple[np.ndarray, np.ndarray]
    with_ports: np.ndarray
    flags: tuple[np.ndarray, np.ndarray]


def _behind_tags(p: Payloads, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ethertype, place behind it) after all stacked VLAN tags; type -1 if the header ends inside a tag."""
    kind, known = p.number(start + 12, 2, end)
    kind = np.where(known & (end - start >= 14), kind, -1)
    place = start + 14
    while True:
        tagged = np.flatnonzero(np.isin(kind, VLAN_TYPES))
        if not len(tagged):
            return kind, place
        following, known = p.number(place[tagged] + 2, 2, end[tagged])
        kind[tagged], place[tagged] = np.where(known, following, -1), place[tagged] + 4


def _behind_extensions(p: Payloads, base: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(protocol, place) of an IPv6 payload behind its extension headers, each of eight bytes or more."""
    protocol, _ = p.number(base + 6, 1, end)
    place, active = base + 40, np.arange(len(base))
    while len(active):
        active = active[np.isin(protocol[active], EXTENSION_HEADERS)]
        units, known = p.number(place[active] + 1, 1, end[active])
        active, units = active[known], units[known]
        kind = protocol[active]
        length = np.where(kind == FRAGMENT, 8, np.where(kind == AUTHENTICATION, (units + 2) * 4, (units + 1) * 8))
        protocol[active] = p.data[place[active]]
        place[active] += length
    return protocol, place


def _packets(p: Payloads, start: np.ndarray, end: np.ndarray) -> _Packets:
    """Sampled Ethernet headers, each between ``start`` and ``end``; an absent one is empty."""
    kind, network = _behind_tags(p, start, end)
    first, _ = p.number(network, 1, end)
    header = (first & 15) * 4
    v4 = (kind == IPV4_TYPE) & (end - network >= 20) & (header >= 20) & (end - network >= header)
    carried, _ = p.number(network + 9, 1, end)
    tunnel = v4 & (carried == TUNNELLED_IPV6)
    six = np.where(tunnel, network + header, network)
    v6 = (tunnel | (kind == IPV6_TYPE)) & (end - six >= 40)
    protocol, transport = np.where(v4, carried, 0), np.where(v4 & ~tunnel, network + header, end)
    at = np.flatnonzero(v6)
    protocol[at], transport[at] = _behind_extensions(p, six[at], end[at])
    left = end - transport
    tcp, udp = (protocol == TCP) & (left >= 14), (protocol == UDP) & (left >= 4)
    source, target = (np.where(v6, six + in_v6, network + in_v4) for in_v6, in_v4 in ((8, 12), (24, 16)))
    ports = tuple(p.number(transport + shift, 2, end)[0] for shift in (0, 2))
    flags, _ = p.number(transport + 13, 1, end)
    return _Packets(source, target, np.where(v6, 16, np.where(v4, 4, 0)), (protocol, v4 | v6), ports, tcp | udp, (flags, tcp))


# ------------------------------------------------------------------------------------------------------- BGP records


def _gateways(p: Payloads, start: np.ndarray, end: np.ndarray) -> dict[str, pa.Array]:
    """next_hop, src_as, dst_as and as_path of extended-gateway records; a short record keeps what it had, an absent one is empty.

    Path segments of all records are read in step. A list that ends exactly with the record is kept, one that breaks off inside a
    number is not.
    """
    family, _ = p.number(start, 4, end)
    length = np.where(family == 1, 4, np.where(family == 2, 16, 0))
    hop = (length > 0) & (start + 4 + length <= end)
    own, has_own = p.number(start + length + 8, 4, end)
    count, counted = p.number(start + length + 16, 4, end)
    whole = counted & (length > 0)
    place, left, active, pieces = start + length + 20, count.copy(), np.flatnonzero(whole & (count > 0)), []
    step = 0
    while len(active):
        active = active[(place[active] < end[active]) & (left[active] > 0)]
        listed, known = p.number(place[active] + 4, 4, end[active])
        room = end[active] - place[active] - 8
        fitting = np.where(known, np.minimum(listed, room // 4), 0)
        good = known & ((fitting == listed) | (room % 4 == 0))
        whole[active[~good]] = False
        owner, inside = spread(fitting)
        pieces.append((active[owner], np.full(len(owner), step), inside, place[active][owner] + 8 + 4 * inside))
        place[active] += 8 + 4 * fitting
        left[active] -= 1
        active = active[good]
        step += 1
    owner, step_no, inside, at = (np.concatenate(c) for c in zip(*pieces)) if pieces else (np.zeros(0, np.int64),) * 4
    order = np.lexsort((inside, step_no, owner))
    order = order[whole[owner[order]]]
    owner, path = owner[order], p.number(at[order], 4, np.full(len(order), len(p.data)))[0]
    bounds = np.searchsorted(owner, np.arange(len(start) + 1))
    some = bounds[1:] > bounds[:-1]
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(path).cast(pa.string())), " ")
    last = path[np.maximum(bounds[1:] - 1, 0)] if len(path) else np.zeros(len(start), np.int64)
    return {
        "next_hop": slices(p.data, start + 4, length, hop),
        "src_as": numbers(own, has_own & (length > 0)),
        "dst_as": numbers(last, some),
        "as_path": pc.if_else(pa.array(some), texts, pa.scalar(None, pa.string())),
    }


# ------------------------------------------------------------------------------------------------------ flow samples

_FLOWS = (
    f"{CONTEXT}, sampling_rate long, drops long, input_if_index long, output_if_index long, frame long, src_addr binary, dst_addr binary, "
    "protocol long, src_port long, dst_port long, tcp_flags long, next_hop binary, src_as long, dst_as long, as_path string"
)


def _decode_flows(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = _samples(batch, FLOW_SAMPLE, FLOW_SAMPLE_EXPANDED)
    p = found.payloads
    records = found.records((28, 40))
    whole = np.flatnonzero(~records.broken & found.field(28, 40)[1])

    def last_of(tag: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each sample's last record of this tag; empty without one."""
        start, end = np.zeros(len(records.broken), np.int64), np.zeros(len(records.broken), np.int64)
        of_tag = records[records.tag == tag]
        start[of_tag.owner], end[of_tag.owner] = of_tag.starts, of_tag.ends
        return start[whole], end[whole]

    start, end = last_of(RAW_HEADER)
    protocol, _ = p.number(start, 4, end)
    frame, _ = p.number(start + 4, 4, end)
    size, known = p.number(start + 12, 4, end)
    fits = known & (start + 16 + size <= end)
    ethernet = fits & (protocol == ETHERNET)
    packets = _packets(p, np.where(ethernet, start + 16, 0), np.where(ethernet, start + 16 + size, 0))

    def of_sample(plain_at: int, expanded_at: int, mask: int = -1) -> pa.Array:
        value, held = (v[whole] for v in found.field(plain_at, expanded_at))
        return numbers(np.where(found.plain[whole], value & mask, value), held)

    has_address = packets.address_length > 0
    return pa.record_batch(
        found.context(batch, whole)
        | {
            "sampling_rate": of_sample(8, 12),
            "drops": of_sample(16, 20),
            "input_if_index": of_sample(20, 28, LOW_30),
            "output_if_index": of_sample(24, 36, LOW_30),
            "frame": numbers(frame, fits),
            "src_addr": slices(p.data, packets.source, packets.address_length, has_address),
            "dst_addr": slices(p.data, packets.target, packets.address_length, has_address),
            "protocol": numbers(*packets.protocol),
            "src_port": numbers(packets.ports[0], packets.with_ports),
            "dst_port": numbers(packets.ports[1], packets.with_ports),
            "tcp_flags": numbers(*packets.flags),
        }
        | _gateways(p, *last_of(GATEWAY))
    )


def flow_samples(sample_rows: DataFrame) -> DataFrame:
    """``flow_samples`` rows of formats 1 and 3. A sample whose record list breaks off gives no row."""
    # the sFlow gate, on addresses that are still bytes
    rows = sample_rows.mapInArrow(_decoder(_decode_flows), _FLOWS).where("src_addr is not null or dst_addr is not null")
    rate, frame = F.col("sampling_rate"), F.coalesce("frame", F.lit(0))
    sampled = (frame > 0) & (rate > 1)
    return rows.select(
        "arrival_no",
        "sample_no",
        "recv_ts",
        F.col("recv_ts").alias("timestamp"),
        net.ip_from_bytes(F.col("agent")).alias("sampler_address"),
        F.col("sequence").alias("sequence_number"),
        "sampling_rate",
        F.lit(0).alias("flow_source"),
        net.ip_from_bytes(F.col("src_addr")).alias("src_addr"),
        net.ip_from_bytes(F.col("dst_addr")).alias("dst_addr"),
        "src_port",
        "dst_port",
        "protocol",
        "tcp_flags",
        F.when(sampled, scaled(frame, rate)).otherwise(frame).alias("bytes"),
        F.when(sampled, rate).when(frame > 0, 1).otherwise(0).cast("bigint").alias("packets"),
        "input_if_index",
        "output_if_index",
        "drops",
        net.ip_from_bytes(F.col("next_hop")).alias("next_hop"),
        "src_as",
        "dst_as",
        "as_path",
    )


# -------------------------------------------------------------------------------------------------- interface counters


# Columns of the generic interface record, by offset and width.
IF_FIELDS = {
    "if_type": (4, 4), "if_speed": (8, 8), "if_direction": (16, 4), "if_status": (20, 4), "in_octets": (24, 8), "in_discards": (44, 4),
    "in_errors": (48, 4), "out_octets": (56, 8), "out_discards": (76, 4), "out_errors": (80, 4),
}
_COUNTERS = f"{CONTEXT}, record_no int, if_index long, " + ", ".join(f"{name} long" for name in IF_FIELDS)


def _decode_counters(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = _samples(batch, COUNTER_SAMPLE, COUNTER_SAMPLE_EXPANDED)
    p = found.payloads
    records = found.records((8, 12))
    records = records[(records.tag == IF_COUNTERS) & (records.ends - records.starts >= IF_COUNTERS_LENGTH)]
    source, held = found.field(4, 8)
    source = np.where(found.plain, source & LOW_24, source)
    own, _ = p.number(records.starts, 4, records.ends)
    columns = {name: numbers(*p.number(records.starts + at, width, records.ends)) for name, (at, width) in IF_FIELDS.items()}
    return pa.record_batch(
        found.context(batch, records.owner)
        | {
            "record_no": pa.array(records.number, pa.int32()),
            "if_index": numbers(np.where(own == 0, source[records.owner], own), (own != 0) | held[records.owner]),
        }
        | columns
    )


def interface_counters(sample_rows: DataFrame) -> DataFrame:
    """``interface_counters`` rows of formats 2 and 4. The record's interface wins over the sample's unless it is 0."""
    return sample_rows.mapInArrow(_decoder(_decode_counters), _COUNTERS).select(
        "arrival_no",
        "sample_no",
        "record_no",
        F.col("recv_ts").alias("timestamp"),
        net.ip_from_bytes(F.col("agent")).alias("sampler_address"),
        "if_index",
        *IF_FIELDS,
    )
