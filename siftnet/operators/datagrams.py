"""Flow datagrams: dispatch by content, NetFlow v5 records, and the set framing shared by NetFlow v9 and IPFIX.

Input rows are captured datagrams: ``arrival_no`` (unique BIGINT), ``recv_ts``, ``exporter`` (source address) and
``payload`` (BINARY). Fixed layouts are decoded with Spark expressions. The three walks whose step depends on lengths found in
the data (sets, templates, records) work on whole Arrow batches: all payloads are walked in step, and the records of one layout
are read column by column (:mod:`siftnet.functions.ragged`).
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftnet.functions import net
from siftnet.functions.binary import cut, low_bits, uint
from siftnet.functions.ragged import Payloads, addresses, items, numbers, slices, spread, unsigned
from siftnet.operators import asof, segments
from siftnet.operators.dedup import FLOW_SOURCE_IPFIX, FLOW_SOURCE_NETFLOW_V5, FLOW_SOURCE_NETFLOW_V9

# Fixed values of the wire formats.
VERSION_V5, VERSION_V9, VERSION_IPFIX = 5, 9, 10
V5_HEADER, V5_RECORD = 24, 48
V9_HEADER, IPFIX_HEADER, SET_HEADER = 20, 16, 4
FIRST_DATA_SET = 256
VARIABLE_LENGTH = 65535
ENTERPRISE_BIT = 0x8000
MAX_RECORD_LENGTH = 2048
MAX_FIELD_LENGTH = 64
TEMPLATE_IDLE_SECONDS = 1800
#: Sets per datagram are bounded by 64 KiB / 4, so this orders sets inside the arrival order of datagrams.
SETS_PER_DATAGRAM = 1 << 14


# ------------------------------------------------------------------------------------------------------- dispatch


def dispatch(datagrams: DataFrame) -> DataFrame:
    """Add ``version`` (5, 9, 10 or null) and ``event`` (``malformed`` / ``unknown_version``). Ports play no part."""
    word = uint(F.col("payload"), 0, 2)
    known = word.isin(VERSION_V5, VERSION_V9, VERSION_IPFIX)
    return datagrams.withColumn("version", F.when(known, word).cast("int")).withColumn(
        "event", F.when(word.isNull(), "malformed").when(~known, "unknown_version")
    )


# ----------------------------------------------------------------------------------------------------- NetFlow v5


def v5_headers(datagrams: DataFrame) -> DataFrame:
    """Header fields of v5 datagrams, the usable record count and ``event`` (``malformed`` where counts disagree)."""
    data = F.col("payload")
    rows = datagrams.where(uint(data, 0, 2) == VERSION_V5)
    body = F.length(data) - V5_HEADER
    complete = F.length(data) >= V5_HEADER
    available = F.floor(body / V5_RECORD)
    declared = uint(data, 2, 2)
    rate = low_bits(uint(data, 22, 2), 14)
    return rows.select(
        *rows.columns,
        declared.alias("increment"),
        F.when(complete, F.least(declared, available)).otherwise(0).cast("int").alias("records"),
        F.when(~complete | (declared > available) | (body % V5_RECORD != 0), "malformed").alias("event"),
        uint(data, 4, 4).alias("uptime_ms"),
        (uint(data, 8, 4) * 1000 + F.floor(uint(data, 12, 4) / 1_000_000)).alias("export_ms"),
        uint(data, 16, 4).alias("sequence"),
        uint(data, 20, 2).alias("domain"),
        F.when(rate == 0, 1).otherwise(rate).alias("sampling_rate"),
    )


def v5_records(headers: DataFrame) -> DataFrame:
    """One row per complete v5 record, still in exporter units: the input of ``flows.v5_flows``."""
    numbered = headers.where("records > 0").withColumn("record_no", F.explode(F.sequence(F.lit(0), F.col("records") - 1)))
    record = cut(F.col("payload"), F.lit(V5_HEADER) + F.col("record_no") * V5_RECORD, V5_RECORD)
    rows = numbered.withColumn("_r", record)
    r = F.col("_r")
    return rows.select(
        "arrival_no",
        "record_no",
        "recv_ts",
        "exporter",
        "domain",
        "sequence",
        "sampling_rate",
        "uptime_ms",
        "export_ms",
        net.ipv4_from_bytes(r, 0).alias("src_addr"),
        net.ipv4_from_bytes(r, 4).alias("dst_addr"),
        net.ipv4_from_bytes(r, 8).alias("next_hop"),
        uint(r, 12, 2).alias("in_if"),
        uint(r, 14, 2).alias("out_if"),
        uint(r, 16, 4).alias("packets"),
        uint(r, 20, 4).alias("bytes"),
        uint(r, 24, 4).alias("first_ms"),
        uint(r, 28, 4).alias("last_ms"),
        uint(r, 32, 2).alias("src_port"),
        uint(r, 34, 2).alias("dst_port"),
        uint(r, 37, 1).alias("tcp_flags"),
        uint(r, 38, 1).alias("protocol"),
        uint(r, 39, 1).alias("tos"),
        uint(r, 40, 2).alias("src_as"),
        uint(r, 42, 2).alias("dst_as"),
    )


# -------------------------------------------------------------------------------------------- v9 and IPFIX framing

_SET = T.StructType(
    [
        T.StructField("set_no", T.IntegerType()),
        T.StructField("set_id", T.IntegerType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("length", T.IntegerType()),
    ]
)
_SETS = T.StructType(
    [
        T.StructField("readable", T.BooleanType()),
        T.StructField("uptime_ms", T.LongType()),
        T.StructField("export_s", T.LongType()),
        T.StructField("sequence", T.LongType()),
        T.StructField("domain", T.LongType()),
        T.StructField("sets", T.ArrayType(_SET)),
        T.StructField("broken", T.BooleanType()),
    ]
)


def _sets_of(payload: pa.Array) -> pa.Array:
    """Header fields of v9 and IPFIX datagrams, and where the body of each set stands in its payload."""
    payloads = Payloads.of(payload)
    begin, length = payloads.starts, payloads.ends - payloads.starts
    v9 = payloads.number(begin, 2, payloads.ends)[0] == VERSION_V9
    header = np.where(v9, V9_HEADER, IPFIX_HEADER)
    declared, known = payloads.number(begin + 2, 2, payloads.ends)
    message = np.where(v9 | ~known, length, np.minimum(declared, length))
    readable = (length >= header) & (message >= header)
    found = items(payloads, begin + header, begin + np.where(readable, message, 0), None, width=2, whole=True)

    def word(at: int | np.ndarray, only: np.ndarray | bool = True) -> pa.Array:
        value, held = payloads.number(begin + at, 4, payloads.ends)
        return numbers(value, held & only)

    kind = _arrow_type(_SETS)
    places = (found.number, found.tag, found.starts - begin[found.owner], found.ends - found.starts)
    per_payload = np.searchsorted(found.owner, np.arange(len(payload) + 1)).astype(np.int32)
    each = pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in places], fields=list(_arrow_type(_SET)))
    later = np.where(v9, 4, 0)
    columns = [pa.array(readable), word(4, v9), word(4 + later), word(8 + later), word(12 + later), pa.ListArray.from_arrays(pa.array(per_payload), each)]
    return pa.StructArray.from_arrays([*columns, pa.array(found.broken)], fields=list(kind))


# not to be repeated: a filter on what it finds would otherwise be pushed below it, as a second walk over every payload
_split_sets = F.arrow_udf(_sets_of, _SETS).asNondeterministic()


def _arrow_type(spark_type: T.DataType) -> pa.DataType:
    """Arrow type of the few Spark types the helpers return."""
    if isinstance(spark_type, T.StructType):
        return pa.struct([(f.name, _arrow_type(f.dataType)) for f in spark_type.fields])
    if isinstance(spark_type, T.ArrayType):
        return pa.list_(_arrow_type(spark_type.elementType))
    return {
        T.IntegerType: pa.int32(),
        T.LongType: pa.int64(),
        T.BinaryType: pa.binary(),
        T.BooleanType: pa.bool_(),
        T.StringType: pa.string(),
    }[type(spark_type)]


def framed(datagrams: DataFrame, *, bodies: bool = True) -> DataFrame:
    """v9 and IPFIX datagrams with header fields, ``sets`` and ``event``. Without ``bodies``, those of data sets are left out: what
    remains is a few bytes a set.

    The v9 header count is not used. An IPFIX message ends at its own length or the datagram's, whichever is shorter.
    """
    data = F.col("payload")
    word = F.substring(data, 1, 2)
    v9, ipfix = (F.lit(struct.pack(">H", version)) for version in (VERSION_V9, VERSION_IPFIX))
    # nullable, like all columns of a set: a stream adds rows that have none of them
    rows = datagrams.where(word.isin(v9, ipfix)).withColumn("version", F.when(word == v9, VERSION_V9).when(word == ipfix, VERSION_IPFIX))
    split = rows.withColumn("_split", _split_sets("payload"))

    def listed(found: Column) -> Column:
        body = F.substring(data, found["start"] + 1, found["length"])
        held = body if bodies else F.when(found["set_id"] < FIRST_DATA_SET, body)
        return F.struct(found["set_no"].alias("set_no"), found["set_id"].alias("set_id"), held.alias("body"))

    return split.select(
        *[c for c in rows.columns if c != "payload"],
        F.col("_split.readable").alias("readable"),
        F.col("_split.uptime_ms").alias("uptime_ms"),
        (F.col("_split.export_s") * 1000).alias("export_ms"),
        F.col("_split.sequence").alias("sequence"),
        F.col("_split.domain").alias("domain"),
        F.transform("_split.sets", listed).alias("sets"),
        F.when(~F.col("_split.readable") | F.col("_split.broken"), "malformed").alias("event"),
    )


def sets(framed_rows: DataFrame) -> DataFrame:
    """One row per set, with ``set_order``: the order of sets over all datagrams."""
    context = [c for c in framed_rows.columns if c not in {"sets", "event", "readable"}]
    # the outer form, because a filter for lists with sets in them would be pushed down and make them once more
    exploded = framed_rows.select(*context, F.inline_outer("sets")).where("set_no >= 0")
    order = F.col("arrival_no") * F.lit(SETS_PER_DATAGRAM) + F.col("set_no")
    return exploded.withColumn("set_order", order)


def is_template_set() -> Column:
    """v9 uses sets 0 and 1, IPFIX 2 and 3; other ids below 256 are skipped."""
    v9 = F.col("version") == VERSION_V9
    return F.when(v9, F.col("set_id").isin(0, 1)).otherwise(F.col("set_id").isin(2, 3))


def data_sets(set_rows: DataFrame) -> DataFrame:
    return set_rows.where(F.col("set_id") >= FIRST_DATA_SET)


# --------------------------------------------------------------------------------------------------------- templates

_FIELD = T.StructType(
    [
        T.StructField("ie", T.IntegerType()),
        T.StructField("length", T.IntegerType()),
        T.StructField("pen", T.LongType()),
    ]
)
#: What a template set tells: templates, and events without one.
_TEMPLATES = T.ArrayType(
    T.StructType(
        [
            T.StructField("template_id", T.IntegerType()),
            T.StructField("fields", T.ArrayType(_FIELD)),
            T.StructField("definition", T.BinaryType()),
            T.StructField("_shortest", T.IntegerType()),
            T.StructField("_wide", T.BooleanType()),
            T.StructField("_event", T.StringType()),
        ]
    )
)


def _field_list(body: bytes, offset: int, count: int, enterprise: bool) -> tuple[list[dict], int] | None:
    """``count`` field specifiers from ``offset``; None if the set ends before them."""
    fields = []
    for _ in range(count):
        if offset + 4 > len(body):
            return None
        ie, length = struct.unpack_from(">HH", body, offset)
        offset += 4
        pen = 0
        if enterprise and ie & ENTERPRISE_BIT:
            if offset + 4 > len(body):
                return None
            (pen,) = struct.unpack_from(">I", body, offset)
            ie &= ~ENTERPRISE_BIT
            offset += 4
        fields.append({"ie": ie, "length": length, "pen": pen})
    return fields, offset


def _template_set(body: bytes, version: int, options: bool) -> dict:
    """Templates and events of one template set. The three counting rules of option templates differ by protocol:
    v9 counts bytes, IPFIX counts fields, and only IPFIX knows withdrawals (field count 0)."""
    templates, events, offset = [], [], 0
    ipfix = version == VERSION_IPFIX
    head = 6 if options and not ipfix else 4
    while offset + head <= len(body):
        template_id, count = struct.unpack_from(">HH", body, offset)
        if template_id == 0:
            break
        if ipfix and count == 0:
            events.append("template_withdrawal")
            offset += 4
            continue
        start, valid = offset + 4, template_id >= FIRST_DATA_SET
        if options:
            if offset + 6 > len(body):
                events.append("malformed")
                break
            (second,) = struct.unpack_from(">H", body, offset + 4)
            start = offset + 6
            if ipfix:
                valid = valid and second <= count
            else:
                valid = valid and count % 4 == 0 and second % 4 == 0
                count = (count + second) // 4
        else:
            valid = valid and count > 0
        parsed = _field_list(body, start, count, ipfix) if valid else None
        if parsed is None:
            events.append("malformed")
            break
        fields, offset = parsed
        lengths = [f["length"] for f in fields]
        shortest = sum(1 if n == VARIABLE_LENGTH else n for n in lengths)
        wide = any(MAX_FIELD_LENGTH < n != VARIABLE_LENGTH for n in lengths)
        told = hashlib.sha256(repr([options, *(tuple(f.values()) for f in fields)]).encode()).digest()
        templates.append({"template_id": template_id, "fields": fields, "definition": told, "_shortest": shortest, "_wide": wide})
    return {"templates": templates, "events": events}


def _templates_of(body: pa.Array, version: pa.Array, options: pa.Array) -> pa.Array:
    """Exporters repeat their announcements all the time, so each distinct body is read once."""
    encoded = body.dictionary_encode()
    protocol, kind = version.to_numpy(zero_copy_only=False).astype(np.int64), options.to_numpy(zero_copy_only=False)
    keys = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 64 + protocol * 2 + kind
    distinct, place = np.unique(keys, return_inverse=True)
    bodies = encoded.dictionary.to_pylist()
    parsed = [_template_set(bodies[key // 64], key % 64 // 2, bool(key % 2)) for key in distinct.tolist()]
    told = [[*p["templates"], *({"_event": event} for event in p["events"])] for p in parsed]
    return pa.array(told, _arrow_type(_TEMPLATES)).take(pa.array(place))


# like the walk over sets, not to be repeated below it by a filter on what it finds
_parse_templates = F.arrow_udf(_templates_of, _TEMPLATES).asNondeterministic()


def min_record_length(fields: Column) -> Column:
    """Sum of the field lengths, a variable-length field counting 1."""
    return F.aggregate(
        fields,
        F.lit(0),
        lambda total, f: total + F.when(f["length"] == VARIABLE_LENGTH, F.lit(1)).otherwise(f["length"]),
    )


def template_verdict(fields: Column) -> Column:
    """What is odd about a template: no length at all (unusable), or unusually long (reported, and decoded like any other)."""
    wide = F.exists(fields, lambda f: (f["length"] != VARIABLE_LENGTH) & (f["length"] > MAX_FIELD_LENGTH))
    return _verdict(min_record_length(fields), wide)


def _verdict(shortest: Column, wide: Column) -> Column:
    return F.when(shortest == 0, "template_zero_min_len").when(
        (shortest > MAX_RECORD_LENGTH) | wide, "template_quarantined"
    )


def _announcing(set_rows: DataFrame) -> DataFrame:
    options = F.when(F.col("version") == VERSION_V9, F.col("set_id") == 1).otherwise(F.col("set_id") == 3)
    return set_rows.where(is_template_set()).withColumn("is_options", options)


def _read_templates(rows: DataFrame, context: list[str]) -> DataFrame:
    told = rows.withColumn("_told", _parse_templates("body", "version", "is_options")).select(*context, F.inline("_told"))
    verdict = F.coalesce("_event", _verdict(F.col("_shortest"), F.col("_wide"))).alias("verdict")
    return told.select(*context, "template_id", "fields", "definition", verdict)


_BODY = ["version", "is_options", "body"]


def template_bodies(set_rows: DataFrame) -> DataFrame:
    """What each distinct template set among ``set_rows`` announces. Exporters repeat theirs all the time, so these are few rows for
    :func:`templates` to look up; a caller that writes them lets Spark see that."""
    return _read_templates(_announcing(set_rows).select(*_BODY).distinct(), _BODY)


def templates(set_rows: DataFrame, bodies: DataFrame | None = None) -> DataFrame:
    """One row per announced template with ``verdict``; set-level events as rows without template.

    ``bodies`` (:func:`template_bodies` of these sets) are for callers that have them at hand; then ``definition``, a digest of the fields
    and of whether they are of options, is given too.
    """
    rows = _announcing(set_rows)
    context = ["exporter", "domain", "version", "recv_ts", "arrival_no", "set_order", "is_options"]
    if bodies is None:
        return _read_templates(rows, context).drop("definition")
    return rows.join(bodies, _BODY).select(*context, "template_id", "fields", "definition", "verdict")


def usable_templates(announced: DataFrame) -> DataFrame:
    """Announced templates that records can be cut by: all but those without any length."""
    return announced.where(F.col("template_id").isNotNull() & ~F.col("verdict").eqNullSafe("template_zero_min_len"))


def capped_templates(announced: DataFrame, *, cap: int, idle_seconds: float = TEMPLATE_IDLE_SECONDS) -> DataFrame:
    """Usable templates with ``admitted``: whether a cache of ``cap`` live templates per domain would hold them.

    An opt-in report; no default plan caps anything. A template lives from an announcement until it was not announced again for
    ``idle_seconds``; lives are found with segmented scans. A life is admitted while fewer than ``cap`` admitted ones of its
    domain go on, and a redefinition belongs to its life. Only lives, not announcements, meet per domain.
    """
    usable = usable_templates(announced)
    keys, domain = ["exporter", "domain", "template_id"], ["exporter", "domain"]
    span = segments.SEGMENT_SPAN * SETS_PER_DATAGRAM
    idle = int(idle_seconds * 1_000_000)
    before = segments.scan(usable, keys, "set_order", prev={"_before": F.unix_micros("recv_ts")}, span=span)
    begins = F.coalesce(F.unix_micros("recv_ts") - F.col("_before") > idle, F.lit(True))
    lived = segments.scan(before.withColumn("_begins", begins.cast("bigint")), keys, "set_order", running_sum={"_life": F.col("_begins")}, span=span)
    lived = segments.finish(lived.drop("_before", "_begins"))
    lives = lived.groupBy(*keys, "_life").agg(
        F.min("set_order").alias("_from"), F.min(F.unix_micros("recv_ts")).alias("_start"), F.max(F.unix_micros("recv_ts")).alias("_last")
    )

    def admit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_from", kind="stable")
        ends: list[int] = []
        admitted = []
        for start, last in zip(frame["_start"].tolist(), frame["_last"].tolist()):
            while ends and ends[0] < start:
                heapq.heappop(ends)
            admitted.append(len(ends) < cap)
            if admitted[-1]:
                heapq.heappush(ends, last + idle)
        return frame.assign(admitted=admitted)[[*keys, "_life", "admitted"]]

    kept = T.StructType([*(lives.schema[k] for k in [*keys, "_life"]), T.StructField("admitted", T.BooleanType())])
    judged = lives.groupBy(*domain).applyInPandas(admit, kept)
    return lived.join(judged, [*keys, "_life"]).drop("_life")


def touch_gaps(
    touches: DataFrame, *, keys: list[str], order: str = "set_order", ts: str = "recv_ts", idle_seconds: float, unless: Column | None = None
) -> DataFrame:
    """Touches more than the idle time after their key's previous one, but for those where ``unless`` holds.

    Touches are first reduced to the first and last of each idle-time bucket: a gap longer than the bucket never lies
    inside one, so nothing is lost, and what remains of a key grows with the time covered, not with the traffic.
    """
    idle = int(idle_seconds * 1_000_000)
    bucket = F.expr(f"unix_micros({ts}) div {idle}")
    ends = touches.groupBy(*keys, bucket.alias("_bucket")).agg(
        F.min(order).alias(order), F.min_by(ts, order).alias(ts), F.max_by(ts, order).alias("_until"),
        F.min(F.when(F.lit(False) if unless is None else unless, F.col(order))).alias("_excepted"),
    )
    before = F.lag("_until").over(Window.partitionBy(*keys).orderBy(order))
    gaps = ends.withColumn("_before", before)
    late = F.unix_micros(ts) - F.unix_micros("_before") > idle
    return gaps.where(late & ~F.col(order).eqNullSafe(F.col("_excepted"))).select(*keys, order, ts)


def idle_expiries(
    touches: DataFrame, *, keys: list[str], order: str = "set_order", ts: str = "recv_ts", idle_seconds: float = TEMPLATE_IDLE_SECONDS
) -> DataFrame:
    """Touches (announcements or uses) that found their template expired."""
    return touch_gaps(touches, keys=keys, order=order, ts=ts, idle_seconds=idle_seconds)


TEMPLATE_KEYS = ["exporter", "domain", "template_id"]
_AS_OF = {"keys": TEMPLATE_KEYS, "order": "set_order", "value": "template", "span": asof.INDEX_SPAN * SETS_PER_DATAGRAM}


def template_index(
    announced: DataFrame,
    uses: DataFrame,
    *,
    idle_seconds: float | None = TEMPLATE_IDLE_SECONDS,
    definitions: DataFrame | None = None,
    kept: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    """Which template holds when, for the places of ``uses`` (``exporter``, ``domain``, ``set_id``, ``set_order``, ``recv_ts`` of the data sets).

    A template that was neither announced nor used for more than ``idle_seconds`` is dead until it is announced again; a use refreshes it.

    With ``definitions`` (``definition``, ``fields``, ``is_options``) the announcements are told apart by their ``definition``, and the
    fields are looked up for the index alone. ``kept`` may write the small tables that are read several times (see :func:`asof.changes`).
    """
    told = F.struct("fields", "is_options") if definitions is None else F.col("definition")
    facts = announced.select(*TEMPLATE_KEYS, "set_order", told.alias("template"))
    heads = uses.withColumnRenamed("set_id", "template_id").select(*TEMPLATE_KEYS, "set_order", "recv_ts")
    if idle_seconds is not None:
        touches = announced.select(*TEMPLATE_KEYS, "set_order", "recv_ts", F.lit(True).alias("told")).unionByName(heads.withColumn("told", F.lit(False)))
        # a gap that ends with an announcement revives the template at once
        deaths = touch_gaps(touches, keys=TEMPLATE_KEYS, idle_seconds=idle_seconds, unless=F.col("told"))
        gone = F.lit(None).cast(facts.schema["template"].dataType)
        facts = facts.unionByName(kept(deaths.select(*TEMPLATE_KEYS, "set_order", gone.alias("template"))))
    if definitions is None:
        return asof.index(facts, heads, **_AS_OF)
    known = asof.index(asof.changes(facts, kept=kept, **_AS_OF), heads, **_AS_OF).withColumnRenamed("template", "definition")
    template = F.when(F.col("definition").isNotNull(), F.struct("fields", "is_options")).alias("template")
    return known.join(definitions, "definition", "left").select(*[c for c in known.columns if c != "definition"], template)


def with_templates(
    set_rows: DataFrame, announced: DataFrame | None = None, *, index: DataFrame | None = None, idle_seconds: float | None = TEMPLATE_IDLE_SECONDS
) -> DataFrame:
    """Data sets with the newest template of their (exporter, domain, id) received before them.

    Adds ``fields``, ``is_options`` and ``event`` (``data_before_template`` where there is none). Which template holds when is a small
    ``index`` (:func:`template_index`, made of ``announced`` and these sets if not given); the set bodies are not shuffled for it.
    """
    if index is None:
        index = template_index(announced, set_rows, idle_seconds=idle_seconds)
    rows = set_rows.withColumnRenamed("set_id", "template_id")
    matched = asof.looked_up(rows, index, **_AS_OF)
    return matched.select(
        *rows.columns,
        F.col("template.fields").alias("fields"),
        F.coalesce("template.is_options", F.lit(False)).alias("is_options"),
        F.when(F.col("template").isNull(), "data_before_template").alias("event"),
    )


# ------------------------------------------------------------------------------------------------------------ records

# Information elements by target column. Where several elements feed one column, the last in the record
# wins. Kinds: u = unsigned 1..8 bytes, t = 64-bit NTP time, 4 / 6 = address of that family, a = address of the
# element's family, n = the same but never the unspecified address, s = text.
ELEMENTS = {
    "fwd_bytes": ("u", [1]),
    "fwd_packets": ("u", [2]),
    "protocol": ("u", [4]),
    "tos": ("u", [5]),
    "tcp_flags": ("u", [6]),
    "src_port": ("u", [7]),
    "src_v4": ("4", [8]),
    "in_if": ("u", [10]),
    "dst_port": ("u", [11]),
    "dst_v4": ("4", [12]),
    "out_if": ("u", [14]),
    "next_hop": ("n", [15, 62]),
    "src_as": ("u", [16]),
    "dst_as": ("u", [17]),
    "end_uptime": ("u", [21]),
    "start_uptime": ("u", [22]),
    "out_bytes": ("u", [23]),
    "out_packets": ("u", [24]),
    "src_v6": ("6", [27]),
    "dst_v6": ("6", [28]),
    "icmp": ("u", [32, 139]),
    "interval_34": ("u", [34]),
    "sampler_id": ("u", [48, 302]),
    "random_50": ("u", [50]),
    "src_vlan": ("u", [58]),
    "dst_vlan": ("u", [59]),
    "total_bytes": ("u", [85]),
    "total_packets": ("u", [86]),
    "end_reason": ("u", [136]),
    "start_s": ("u", [150]),
    "end_s": ("u", [151]),
    "start_ms": ("u", [152]),
    "end_ms": ("u", [153]),
    "start_ntp_us": ("t", [154]),
    "end_ntp_us": ("t", [155]),
    "start_ntp_ns": ("t", [156]),
    "end_ntp_ns": ("t", [157]),
    "start_delta_us": ("u", [158]),
    "end_delta_us": ("u", [159]),
    "duration_ms": ("u", [161]),
    "nat_src": ("a", [225, 281, 40001]),
    "nat_dst": ("a", [226, 282, 40002]),
    "nat_src_port": ("u", [227, 40003]),
    "nat_dst_port": ("u", [228, 40004]),
    "nat_event": ("u", [230]),
    "initiator_bytes": ("u", [231]),
    "responder_bytes": ("u", [232]),
    "fw_event": ("u", [233]),
    "interval_305": ("u", [305]),
    "space_306": ("u", [306]),
    "observed_ms": ("u", [323]),
    "app_name": ("s", [56701]),
}
# Elements that belong to an enterprise number.
ENTERPRISE_ELEMENTS = {
    ("rev_bytes", "u"): (29305, 1),
    ("rev_packets", "u"): (29305, 2),
    ("app_name", "s"): (25461, 56701),
}
#: Elements that carry an IPv6 address; the other address elements are IPv4.
IPV6_ELEMENTS = {27, 28, 62, 281, 282}

COLUMNS = [*ELEMENTS, "rev_bytes", "rev_packets"]


def element_slots() -> dict[tuple[int, int], tuple[int, str, int]]:
    """(enterprise, element) -> (column number, kind, address width)."""
    slots = {}
    for column, (kind, elements) in ELEMENTS.items():
        for ie in elements:
            slots[(0, ie)] = (COLUMNS.index(column), kind, 16 if ie in IPV6_ELEMENTS else 4)
    for (column, kind), (pen, ie) in ENTERPRISE_ELEMENTS.items():
        slots[(pen, ie)] = (COLUMNS.index(column), kind, 0)
    return slots


KINDS = {name: kind for name, (kind, _) in ELEMENTS.items()} | {name: kind for name, kind in ENTERPRISE_ELEMENTS}


ADDRESS_KINDS = "46an"


def column_type(name: str) -> T.DataType:
    """Type in which records are cut: addresses are text at once."""
    return T.LongType() if KINDS[name] == "u" else T.StringType() if KINDS[name] in ADDRESS_KINDS else T.BinaryType()


class _Cells:
    """Where the columns of the records of one layout stand in the data: per column the place, the length and whether it counts."""

    def __init__(self, payloads: Payloads, records: int):
        self.data, self.records = payloads.data, records
        self.places: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def put(self, target: tuple[int, str, int], start: np.ndarray, length: int | np.ndarray) -> None:
        """A field of every record. It replaces an earlier one of its column where it is usable."""
        slot, kind, width = target
        length = np.broadcast_to(np.asarray(length, np.int64), self.records)
        valid, usable = np.ones(self.records, bool), None
        if kind in "ut":
            usable = (length >= 1) & (length <= 8)
        elif kind == "n":
            usable = length == width
            inside = np.where(usable, start, 0)[:, None] + np.arange(width)
            usable = usable & self.data[np.minimum(inside, len(self.data) - 1)].any(axis=1)
        elif kind in "46a":
            valid = length == width
        before = self.places.get(slot)
        if usable is not None:
            if before is None:
                before = (np.zeros(self.records, np.int64), np.zeros(self.records, np.int64), np.zeros(self.records, bool))
            start, length, valid = (np.where(usable, new, old) for new, old in zip((start, length, valid), before))
        self.places[slot] = (start, length, valid)

    def column(self, slot: int) -> pa.Array:
        name = COLUMNS[slot]
        if slot not in self.places:
            return pa.nulls(self.records, _arrow_type(column_type(name)))
        start, length, valid = self.places[slot]
        if KINDS[name] in ADDRESS_KINDS:
            return addresses(self.data, start, length, valid)
        if KINDS[name] != "u":
            return slices(self.data, start, length, valid)
        same = self.records and (length == length[0]).all()
        value = unsigned(self.data, start, int(length[0]) if same else length)
        return numbers(value, valid & (value >= 0))


def _fixed_records(payloads: Payloads, at: np.ndarray, ends: np.ndarray, layout: list) -> tuple[np.ndarray, np.ndarray, _Cells]:
    """Records of one length: as many as fit, one behind the other."""
    size = sum(length for length, _ in layout)
    owner, number = spread((ends - at) // size)
    start = at[owner] + number * size
    cells = _Cells(payloads, len(owner))
    for length, target in layout:
        if target is not None:
            cells.put(target, start, length)
        start = start + length
    return owner, number, cells


def _variable_records(payloads: Payloads, at: np.ndarray, ends: np.ndarray, layout: list) -> tuple[np.ndarray, np.ndarray, _Cells, np.ndarray]:
    """Records with variable-length fields: the n-th records of all sets are read in step. Also tells which sets broke off."""
    shortest = sum(1 if length == VARIABLE_LENGTH else length for length, _ in layout)
    last = len(payloads.data) - 1
    active, offset, broken, found = np.arange(len(at)), at.copy(), np.zeros(len(at), bool), []
    while True:
        active = active[ends[active] - offset[active] >= shortest]
        if not len(active):
            break
        place, end, whole, fields = offset[active], ends[active], np.ones(len(active), bool), []
        for length, target in layout:
            if length == VARIABLE_LENGTH:
                short = payloads.data[np.minimum(place, last)].astype(np.int64)
                long = short == 255
                whole &= place + np.where(long, 3, 1) <= end
                length = np.where(long, unsigned(payloads.data, place + 1, 2), short)
                place = place + np.where(long, 3, 1)
            whole &= place + length <= end
            if target is not None:
                fields.append((target, place, np.broadcast_to(length, len(active))))
            place = np.where(whole, place + length, end)
        broken[active[~whole]] = True
        found.append((active[whole], np.full(int(whole.sum()), len(found)), [(t, p[whole], n[whole]) for t, p, n in fields]))
        offset[active] = place
        active = active[whole]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), _Cells(payloads, 0), broken
    owner, number = (np.concatenate([f[i] for f in found]) for i in range(2))
    cells = _Cells(payloads, len(owner))
    for i, (target, _, _) in enumerate(found[0][2]):
        cells.put(target, *(np.concatenate([f[2][i][part] for f in found]) for part in (1, 2)))
    return owner, number, cells, broken


def cut_columns(body: pa.Array, fields: pa.Array, names: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, dict[str, pa.Array]]]:
    """Of each layout among the sets: the set and number of every record, and the given columns."""
    payloads = Payloads.of(body)
    for layout, sets in _layouts(fields):
        at, ends = payloads.starts[sets], payloads.ends[sets]
        fixed = all(length != VARIABLE_LENGTH for length, _ in layout)
        owner, number, cells = (_fixed_records if fixed else _variable_records)(payloads, at, ends, layout)[:3]
        yield sets[owner], number, {name: cells.column(COLUMNS.index(name)) for name in names}


def _layouts(fields: pa.Array) -> Iterator[tuple[list[tuple[int, tuple | None]], np.ndarray]]:
    """The distinct layouts of a batch, as lengths with the column each field goes to, and the rows of each."""
    slots = element_slots()
    bounds, flat = fields.offsets.to_numpy(), fields.values
    specs = np.stack([flat.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("ie", "length", "pen")], axis=1)
    rows: dict[bytes, list[int]] = {}
    for row, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        rows.setdefault(specs[a:b].tobytes(), []).append(row)
    for key, members in rows.items():
        layout = [(length, slots.get((pen, ie))) for ie, length, pen in np.frombuffer(key, np.int64).reshape(-1, 3).tolist()]
        if sum(length for length, _ in layout):
            yield layout, np.array(members)


@F.arrow_udf(T.StructType([T.StructField("records", T.IntegerType()), T.StructField("truncated", T.BooleanType())]))
def _count_variable(body: pa.Array, fields: pa.Array) -> pa.Array:
    """Records of the sets with variable-length fields; the others are not given."""
    counts, truncated = np.zeros(len(body), np.int32), np.zeros(len(body), bool)
    given = np.flatnonzero(fields.is_valid().to_numpy(zero_copy_only=False))
    if len(given):
        payloads = Payloads.of(body)
        for layout, rows in _layouts(fields.take(pa.array(given))):
            sets = given[rows]
            owner, _, _, broken = _variable_records(payloads, payloads.starts[sets], payloads.ends[sets], [(n, None) for n, _ in layout])
            counts[sets], truncated[sets] = np.bincount(owner, minlength=len(sets)), broken
    return pa.StructArray.from_arrays([pa.array(counts), pa.array(truncated)], names=["records", "truncated"])


def decoded_sets(matched: DataFrame) -> DataFrame:
    """What decoding makes of each data set: the number of ``records``, and ``event`` (``malformed`` if the set was cut short).

    Records of a fixed length need no decoding to be counted, and padding is no fault.
    """
    variable = F.exists("fields", lambda f: f["length"] == VARIABLE_LENGTH)
    walked = _count_variable(F.when(variable, F.col("body")), F.when(variable, F.col("fields")))
    rows = matched.withColumn("_walk", walked)
    fixed = F.expr("length(body)") / min_record_length(F.col("fields"))
    return rows.select(
        *[c for c in matched.columns if c not in {"body", "fields", "event"}],
        F.coalesce(F.when(variable, F.col("_walk.records")).otherwise(F.floor(fixed)), F.lit(0)).cast("int").alias("records"),
        F.coalesce("event", F.when(variable & F.col("_walk.truncated"), "malformed")).alias("event"),
    )


def _so_far(owner: np.ndarray, number: np.ndarray, values: pa.Array, most: int) -> pa.Array:
    """The last value from 1 to ``most`` of each record's set, up to the record."""
    order = np.lexsort((number, owner))
    value = values.fill_null(0).to_numpy()[order]
    usable = (value >= 1) & (value <= most)
    place = np.maximum.accumulate(np.where(usable, np.arange(len(value)), -1))
    held = place >= 0
    held[held] = owner[order][place[held]] == owner[order][held]
    out, known = np.zeros(len(value), np.int64), np.zeros(len(value), bool)
    out[order], known[order] = np.where(held, value[place], 0), held
    return numbers(out, known)


def columns_told(bodies: DataFrame) -> list[str]:
    """Those of :data:`COLUMNS` that any template among ``bodies`` (:func:`template_bodies`) has an element for."""
    known = {pen << 16 | ie: COLUMNS[slot] for (pen, ie), (slot, _, _) in element_slots().items()}
    elements = bodies.select(F.explode("fields").alias("f")).select((F.shiftleft("f.pen", 16) + F.col("f.ie")).alias("element"))
    told = {known[r.element] for r in elements.where(F.col("element").isin(*known)).distinct().collect()}
    return [c for c in COLUMNS if c in told]


def records(matched: DataFrame, *, so_far: tuple[str, int] | None = None, told: list[str] | None = None) -> DataFrame:
    """One row per data record of the sets that have a template, with one typed column per entry of :data:`COLUMNS`.

    ``so_far`` names a number column and its largest usable value: ``<column>_so_far`` is then its last usable value in the set. ``told``
    (:func:`columns_told` of all templates) are for callers that have them at hand: the other columns are null without being cut.
    """
    cut_out = COLUMNS if told is None else told
    rows = matched.where("fields is not null").drop("event")
    context = [f for f in rows.schema.fields if f.name not in {"body", "fields"}]
    schema = T.StructType(
        [
            *context,
            T.StructField("record_no", T.IntegerType()),
            *[T.StructField(c, column_type(c)) for c in cut_out],
            *([T.StructField(f"{so_far[0]}_so_far", T.LongType())] if so_far else []),
        ]
    )

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owner, number, cut_here in cut_columns(batch.column("body"), batch.column("fields"), cut_out):
                of_set = pa.array(owner)
                given = {f.name: batch.column(f.name).take(of_set) for f in context}
                if so_far:
                    cut_here[f"{so_far[0]}_so_far"] = _so_far(owner, number, cut_here[so_far[0]], so_far[1])
                yield pa.record_batch(given | {"record_no": pa.array(number, pa.int32())} | cut_here)

    cut_rows = rows.mapInArrow(decode, schema)
    columns = []
    for name in COLUMNS:
        value, kind = F.col(name), KINDS[name]
        if name not in cut_out:
            value = F.lit(None).cast("bigint" if kind == "u" else "string")
        elif kind == "t":
            value = F.lpad(F.hex(value), 16, "0")
        elif kind == "s":
            value = F.trim(F.split_part(value.cast("string"), F.lit("\x00"), F.lit(1)))
        columns.append(value.alias(name))
    return cut_rows.select(*[f.name for f in context], "record_no", *columns, *([f"{so_far[0]}_so_far"] if so_far else []))


FLOW_SOURCE_BY_VERSION = {
    VERSION_V5: FLOW_SOURCE_NETFLOW_V5,
    VERSION_V9: FLOW_SOURCE_NETFLOW_V9,
    VERSION_IPFIX: FLOW_SOURCE_IPFIX,
}


def flow_source(version: Column) -> Column:
    chain = F.when(version == VERSION_V5, FLOW_SOURCE_NETFLOW_V5)
    return chain.when(version == VERSION_V9, FLOW_SOURCE_NETFLOW_V9).otherwise(FLOW_SOURCE_IPFIX)


def export_headers(framed_rows: DataFrame, decoded: DataFrame) -> DataFrame:
    """Headers for ``sequence.sequence_events``: v9 counts datagrams, IPFIX counts decoded data records and is
    uncountable when a set was broken, cut short or had no template."""
    per_datagram = decoded.groupBy("arrival_no").agg(
        F.sum("records").alias("_records"), F.bool_and(F.col("event").isNull()).alias("_complete")
    )
    joined = framed_rows.where("readable").join(per_datagram, "arrival_no", "left")
    v9 = F.col("version") == VERSION_V9
    return joined.select(
        "arrival_no",
        "exporter",
        "domain",
        "version",
        "sequence",
        F.when(v9, F.lit(1)).otherwise(F.coalesce("_records", F.lit(0))).cast("bigint").alias("increment"),
        "uptime_ms",
        F.when(v9, F.lit(True))
        .otherwise(F.col("event").isNull() & F.coalesce("_complete", F.lit(True)))
        .alias("countable"),
    )
