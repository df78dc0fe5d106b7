"""Meaning of decoded flow records: counters, directions, sampling, times. Pure column logic plus the learned rates.

Input rows are ``datagrams.records`` output: one nullable column per information element. Null is "absent", 0 is a
present zero, and the two are kept apart until the final projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftnet.functions import net
from siftnet.functions.binary import low_bits
from siftnet.operators import asof, datagrams, filters
from siftnet.schemas import conform

# Fixed values.
NTP_UNIX_OFFSET = 2208988800
WRAP = 1 << 32
HALF_WRAP = 1 << 31
V5_LAST_SLACK_MS = 100_000
CLOCK_SKEW_MS = 15 * 60 * 1000
LONGEST_FLOW_MS = 24 * 3600 * 1000
NSEL_UPDATE = 5
ICMP, ICMP6 = 1, 58
MAX_RATE = (1 << 32) - 1


# ------------------------------------------------------------------------------------------------------------ times


def uptime_to_ms(export_ms: Column, uptime_ms: Column, stamp: Column) -> Column:
    """Absolute time of a 32-bit uptime stamp, whatever wrapped in between."""
    return export_ms - F.pmod(uptime_ms - low_bits(stamp, 32), F.lit(WRAP))


def ntp_to_ms(value_hex: Column, export_ms: Column, *, micro: bool) -> Column:
    """64-bit NTP time, given as 16 hex digits, in the era nearest to the export time."""
    raw = F.conv(F.substring(value_hex, 1, 8), 16, 10).cast("bigint") - NTP_UNIX_OFFSET
    fraction = F.conv(F.substring(value_hex, 9, 8), 16, 10).cast("bigint")
    if micro:
        fraction = fraction.bitwiseAND(F.lit(0xFFFFF800).cast("bigint"))
    export = F.floor(export_ms / 1000)

    def in_era(seconds: Column) -> Column:
        early, late = export - HALF_WRAP - seconds, seconds - export - HALF_WRAP
        return (
            F.when(early > 0, seconds + F.ceil(early / WRAP) * WRAP)
            .when(late > 0, seconds - F.ceil(late / WRAP) * WRAP)
            .otherwise(seconds)
        )

    # few records have such a time, and the others need not be taken through the eras
    return F.when(value_hex.isNotNull(), net.let(raw, in_era) * 1000 + F.shiftright(fraction * 1000, 32))


def clamp_times(start_ms: Column, end_ms: Column, recv_ms: Column) -> Column:
    """Struct (start_ms, end_ms): a broken clock is replaced by the receive time, an unbelievable start by the end.

    ``recv_ms`` is the receive time in milliseconds, possibly fractional.
    """
    duration = end_ms - start_ms
    believable = duration.between(0, LONGEST_FLOW_MS)
    skewed = F.abs(end_ms - recv_ms) > CLOCK_SKEW_MS
    end = F.when(skewed, recv_ms).otherwise(end_ms)
    start = F.when(believable, end - duration).otherwise(end)
    return F.struct(start.alias("start_ms"), end.alias("end_ms"))


def with_record_times(rows: DataFrame, recv_ms: Column) -> DataFrame:
    """Add ``_t``: struct (start_ms, end_ms) from whichever time elements a record carries.

    The two sides are columns of their own first, so that the clamp reads them instead of repeating them.
    """
    c = F.col
    export, uptime = c("export_ms"), c("uptime_ms")

    def side(ms: str, s: str, ntp_us: str, ntp_ns: str, up: str, delta: str, observed: Column) -> Column:
        return F.coalesce(
            c(ms),
            c(s) * 1000,
            ntp_to_ms(c(ntp_us), export, micro=True),
            ntp_to_ms(c(ntp_ns), export, micro=False),
            uptime_to_ms(export, uptime, c(up)),
            export - F.floor(c(delta) / 1000),
            observed,
        )

    end = side("end_ms", "end_s", "end_ntp_us", "end_ntp_ns", "end_uptime", "end_delta_us", c("observed_ms"))
    start = side(
        "start_ms",
        "start_s",
        "start_ntp_us",
        "start_ntp_ns",
        "start_uptime",
        "start_delta_us",
        c("observed_ms") - c("duration_ms"),
    )
    timed = rows.withColumns({"_start_ms": start, "_end_ms": end, "_recv_ms": recv_ms})
    none = c("_end_ms").isNull() & c("_start_ms").isNull()
    clamped = clamp_times(F.coalesce("_start_ms", "_end_ms"), F.coalesce("_end_ms", "_start_ms"), c("_recv_ms"))
    arrival = F.struct(c("_recv_ms").alias("start_ms"), c("_recv_ms").alias("end_ms"))
    return timed.withColumn("_t", F.when(none, arrival).otherwise(clamped)).drop("_start_ms", "_end_ms", "_recv_ms")


def v5_times(recv_ms: Column) -> Column:
    """Struct (start_ms, end_ms) of v5 records from boot time plus uptime stamps, with both wrap corrections."""
    first, last, uptime = F.col("first_ms"), F.col("last_ms"), F.col("uptime_ms")
    boot = F.col("export_ms") - uptime
    late = F.when(last - uptime > V5_LAST_SLACK_MS, WRAP).otherwise(0)
    start = boot + first - F.when(first > last, WRAP).otherwise(0) - late
    return clamp_times(start, boot + last - late, recv_ms)


def receive_ms(recv_ts: str = "recv_ts") -> Column:
    return F.unix_micros(recv_ts) / F.lit(1000.0)


def to_timestamp(ms: Column) -> Column:
    return F.timestamp_micros(F.round(ms * 1000).cast("bigint"))


# --------------------------------------------------------------------------------------------------------- counters


def drop_reason() -> Column:
    """Why a record must not be counted, tested in this order; null if it may."""
    c = F.col
    has_delta = c("fwd_bytes").isNotNull() | c("fwd_packets").isNotNull()
    has_total = c("total_bytes").isNotNull() | c("total_packets").isNotNull()
    forward = has_delta | c("out_bytes").isNotNull() | c("out_packets").isNotNull() | c("initiator_bytes").isNotNull()
    # without deltas the out-counters are the forward direction, so only these two are reverse
    reverse = c("rev_bytes").isNotNull() | c("rev_packets").isNotNull() | c("responder_bytes").isNotNull()
    return (
        F.when(c("fw_event") == NSEL_UPDATE, "nsel_update_skipped")
        .when(has_total & ~has_delta, "total_counters_skipped")
        .when(~forward & reverse, "reverse_only_dropped")
    )


def directions() -> tuple[Column, Column]:
    """(forward, reverse): structs (bytes, packets), null where the direction is absent."""
    c = F.col

    def pair(octets: Column, packets: Column) -> Column:
        return F.struct(
            F.coalesce(octets, F.lit(0)).cast("bigint").alias("bytes"),
            F.coalesce(packets, F.lit(0)).cast("bigint").alias("packets"),
        )

    has_delta = c("fwd_bytes").isNotNull() | c("fwd_packets").isNotNull()
    has_out = c("out_bytes").isNotNull() | c("out_packets").isNotNull()
    forward = (
        F.when(has_delta, pair(c("fwd_bytes"), c("fwd_packets")))
        .when(has_out, pair(c("out_bytes"), c("out_packets")))
        .when(c("initiator_bytes").isNotNull(), pair(c("initiator_bytes"), F.lit(0)))
    )
    reverse = (
        F.when(c("rev_bytes").isNotNull() | c("rev_packets").isNotNull(), pair(c("rev_bytes"), c("rev_packets")))
        .when(has_delta & has_out, pair(c("out_bytes"), c("out_packets")))
        .when(c("responder_bytes").isNotNull(), pair(c("responder_bytes"), F.lit(0)))
    )
    return forward, reverse


def icmp(protocol: Column, dst_port: Column, type_code: Column, *protocols: int) -> tuple[Column, Column]:
    """(is ICMP, type and code): the element if present, else the destination port."""
    is_icmp = F.coalesce(protocol.isin(*protocols), F.lit(False))
    return is_icmp, F.when(is_icmp, F.coalesce(type_code, dst_port, F.lit(0)))


# --------------------------------------------------------------------------------------------------------- sampling


def options_rate() -> Column:
    """Sampling rate an options record teaches, null if it teaches none. An unusable value does not fall through."""
    c = F.col
    packets = F.when(
        c("space_306").isNotNull() & (c("interval_305") > 0),
        F.floor((c("interval_305") + c("space_306")) / c("interval_305")),
    ).otherwise(c("interval_305"))
    rate = F.when(c("interval_305").isNotNull(), packets).when(c("random_50").isNotNull(), c("random_50")).otherwise(
        c("interval_34")
    )
    return F.when(rate.between(1, MAX_RATE), rate.cast("bigint"))


#: Elements whose presence lets a record teach a rate.
RATE_ELEMENTS = [34, 50, 305, 306]


def teaches_rate(fields: Column, is_options: Column) -> Column:
    """Whether records of a layout can teach a sampling rate: all that have a rate element, of data records those with element 34."""
    told = F.exists(fields, lambda f: f["ie"].isin(RATE_ELEMENTS) & (is_options | (f["ie"] == 34)))
    return F.coalesce(told, F.lit(False))


def rate_facts(records: DataFrame) -> DataFrame:
    """What records teach about sampling rates: ``exporter``, ``domain``, ``sampler_id``, ``arrival_no``, ``set_order``, ``record_no``,
    ``learned`` (by an options record) and ``in_data`` (element 34 in a data record)."""
    learned = F.when(F.col("is_options"), options_rate())
    in_data = F.when(~F.col("is_options") & F.col("interval_34").between(1, MAX_RATE), F.col("interval_34"))
    place = ("exporter", "domain", "sampler_id", "arrival_no", "set_order", "record_no")
    return records.select(*place, learned.alias("learned"), in_data.alias("in_data")).where("learned is not null or in_data is not null")


def rate_indexes(facts: DataFrame, places: DataFrame, *, span: int = asof.INDEX_SPAN) -> tuple[DataFrame, DataFrame]:
    """Which rate a domain and a sampler have when (:func:`asof.index`), for records of ``places`` (``exporter``, ``domain``, ``arrival_no``).

    Both are as small as what is taught is rare. A caller that writes them lets Spark see that: records then stay where they are.
    """
    told = facts.withColumn("_order", F.struct("set_order", "record_no"))
    for_domain = F.coalesce(F.when(F.col("sampler_id").isNull(), F.col("learned")), F.col("in_data"))
    domain_rates = told.withColumn("_domain_rate", for_domain).where("_domain_rate is not null")
    sampler_rates = told.where("sampler_id is not null and learned is not null").withColumnRenamed("learned", "_sampler_rate")
    domain = _RATE_OF_DOMAIN["keys"]
    covered = places.select(*domain, "arrival_no")
    # a domain has few samplers: each may be met wherever its domain is
    cells = covered.groupBy(*domain, F.expr(f"arrival_no div {span}")).agg(F.min("arrival_no").alias("arrival_no"))
    of_samplers = cells.join(sampler_rates.select(*domain, "sampler_id").distinct(), domain)
    return asof.index(domain_rates, covered, **_RATE_OF_DOMAIN, span=span), asof.index(sampler_rates, of_samplers, **_RATE_OF_SAMPLER, span=span)


_RATE_OF_DOMAIN = {"keys": ["exporter", "domain"], "order": "_order", "value": "_domain_rate", "arrival": "arrival_no"}
_RATE_OF_SAMPLER = _RATE_OF_DOMAIN | {"keys": ["exporter", "domain", "sampler_id"], "value": "_sampler_rate"}


def with_sampling_rate(
    records: DataFrame,
    overrides: DataFrame | None = None,
    *,
    indexes: tuple[DataFrame, DataFrame] | None = None,
    span: int = asof.INDEX_SPAN,
) -> DataFrame:
    """Data records with their ``sampling_rate``; options records are consumed.

    Order of preference: operator override of the exporter, latest rate of the record's sampler, latest rate of the
    domain, 1. Rates are learned in arrival order; element 34 in a data record teaches the domain before that record is
    scaled. ``overrides``: ``exporter``, ``rate``. Only what records teach is ordered, and of that only changes
    are kept (see :mod:`siftnet.operators.asof`).

    ``indexes`` (:func:`rate_indexes` of what these records teach, for the same span) are for callers that have them at hand; else they
    are made of the records.
    """
    rows = records.where(~F.col("is_options")).withColumn("_order", F.struct("set_order", "record_no"))
    of_domains, of_samplers = rate_indexes(rate_facts(records), rows, span=span) if indexes is None else indexes
    rows = asof.looked_up(rows, of_domains, **_RATE_OF_DOMAIN, span=span)
    rows = asof.looked_up(rows, of_samplers, **_RATE_OF_SAMPLER, span=span)
    rates = [F.col("_sampler_rate"), F.col("_domain_rate"), F.lit(1)]
    if overrides is not None:
        pinned = overrides.select("exporter", F.col("rate").alias("_override"))
        rows = rows.join(pinned, "exporter", "left")
        rates.insert(0, F.col("_override"))
    rated = rows.withColumn("sampling_rate", F.coalesce(*rates).cast("bigint"))
    return rated.drop("_order", "_domain_rate", "_sampler_rate", "_override")


def live_rates(rates: DataFrame, templates: DataFrame) -> DataFrame:
    """Learned rates of domains that still have a live template."""
    return rates.join(templates.select("exporter", "domain").distinct(), ["exporter", "domain"], "left_semi")


def parse_overrides(text: str, spark) -> DataFrame:
    """``ip=rate,ip=rate`` as rows (exporter, rate); entries that do not parse are skipped."""
    return sampling_overrides(spark.range(1).select(F.lit(text).alias("text")), "text").select("exporter", "rate")


def sampling_overrides(rows: DataFrame, text: str) -> DataFrame:
    """Explode override texts held in a column. The last entry of an address wins."""
    entries = rows.select(*rows.columns, F.posexplode(F.split(text, ",")).alias("_no", "_entry"))
    ip = net.canonical_ip(F.trim(F.split_part("_entry", F.lit("="), F.lit(1))))
    rate = F.trim(F.expr("substring(_entry, instr(_entry, '=') + 1)"))
    number = F.when(rate.rlike("^[0-9]{1,10}$"), rate.try_cast("bigint"))
    parsed = entries.select(*rows.columns, "_no", ip.alias("exporter"), number.alias("rate"))
    valid = parsed.where(F.col("exporter").isNotNull() & F.col("rate").between(1, MAX_RATE))
    return valid.groupBy(*rows.columns, "exporter").agg(F.max_by("rate", "_no").alias("rate"))


def scaled(value: Column, rate: Column) -> Column:
    """Counter times rate; null instead of a wrapped value on overflow."""
    return F.try_multiply(value, rate)


# ------------------------------------------------------------------------------------------------------- projections


def v5_flows(records: DataFrame) -> DataFrame:
    """``flow_samples`` rows from ``datagrams.v5_records``."""
    is_icmp, type_code = icmp(F.col("protocol"), F.col("dst_port"), F.lit(None), ICMP)
    times = v5_times(receive_ms())
    rows = records.withColumn("_t", times).select(
        "arrival_no",
        "record_no",
        "recv_ts",
        F.col("exporter").alias("sampler_address"),
        F.col("sequence").alias("sequence_number"),
        "sampling_rate",
        F.lit(datagrams.FLOW_SOURCE_NETFLOW_V5).alias("flow_source"),
        "src_addr",
        "dst_addr",
        F.when(is_icmp, 0).otherwise(F.col("src_port")).alias("src_port"),
        F.when(is_icmp, 0).otherwise(F.col("dst_port")).alias("dst_port"),
        "protocol",
        scaled(F.col("bytes"), F.col("sampling_rate")).alias("bytes"),
        scaled(F.col("packets"), F.col("sampling_rate")).alias("packets"),
        F.col("in_if").alias("input_if_index"),
        F.col("out_if").alias("output_if_index"),
        "tcp_flags",
        "tos",
        "src_as",
        "dst_as",
        F.when(F.col("next_hop") != "0.0.0.0", F.col("next_hop")).alias("next_hop"),
        type_code.alias("icmp_type_code"),
        to_timestamp(F.col("_t.start_ms")).alias("flow_start"),
        to_timestamp(F.col("_t.end_ms")).alias("flow_end"),
        to_timestamp(F.col("_t.end_ms")).alias("timestamp"),
    )
    return rows


def emitted(records: DataFrame) -> DataFrame:
    """Records that pass the double-count guards and carry anything, with addresses resolved."""
    c = F.col
    guarded = records.where(drop_reason().isNull())
    addressed = guarded.withColumn("src_addr", F.coalesce("src_v6", "src_v4")).withColumn(
        "dst_addr", F.coalesce("dst_v6", "dst_v4")
    )
    forward, reverse = directions()
    rows = addressed.withColumn("_forward", forward).withColumn("_reverse", reverse)
    has_event = c("fw_event").isNotNull() | c("nat_event").isNotNull()
    return rows.where(filters.flow_has_content(c("_forward").isNotNull(), has_event))


def drop_events(records: DataFrame) -> DataFrame:
    """Counts of records the guards refuse, by reason."""
    data = records.where(~F.col("is_options")).withColumn("event", drop_reason())
    return data.where("event is not null").groupBy("event").agg(F.count("*").alias("records"))


def template_flows(records: DataFrame) -> DataFrame:
    """``flow_samples`` rows from rated v9/IPFIX records: the forward flow, and a mirrored one if the record also
    counted the reverse direction."""
    c = F.col
    timed = with_record_times(emitted(records), receive_ms())
    # made before the directions are told apart, once for both
    rows = timed.withColumns({"_start": to_timestamp(c("_t.start_ms")), "_end": to_timestamp(c("_t.end_ms"))})
    is_icmp, type_code = icmp(c("protocol"), c("dst_port"), c("icmp"), ICMP, ICMP6)
    port = {side: F.when(is_icmp, 0).otherwise(c(f"{side}_port")) for side in ("src", "dst")}
    zero = F.struct(F.lit(0).cast("bigint").alias("bytes"), F.lit(0).cast("bigint").alias("packets"))

    def one_way(counters: Column, a: str, b: str, if_a: str, if_b: str, reverse: bool) -> Column:
        return F.struct(
            F.lit(reverse).alias("reverse"),
            scaled(counters["bytes"], c("sampling_rate")).alias("bytes"),
            scaled(counters["packets"], c("sampling_rate")).alias("packets"),
            c(f"{a}_addr").alias("src_addr"),
            c(f"{b}_addr").alias("dst_addr"),
            port[a].alias("src_port"),
            port[b].alias("dst_port"),
            c(if_a).alias("input_if_index"),
            c(if_b).alias("output_if_index"),
            c(f"{a}_as").alias("src_as"),
            c(f"{b}_as").alias("dst_as"),
            c(f"{a}_vlan").alias("src_vlan"),
            c(f"{b}_vlan").alias("dst_vlan"),
            c(f"nat_{a}").alias("post_nat_src_addr"),
            c(f"nat_{b}").alias("post_nat_dst_addr"),
            c(f"nat_{a}_port").alias("post_nat_src_port"),
            c(f"nat_{b}_port").alias("post_nat_dst_port"),
        )

    forward = one_way(F.coalesce("_forward", zero), "src", "dst", "in_if", "out_if", False)
    backward = one_way(F.coalesce("_reverse", zero), "dst", "src", "out_if", "in_if", True)
    counted = (c("_reverse.bytes") > 0) | (c("_reverse.packets") > 0)
    both = F.when(F.coalesce(counted, F.lit(False)), F.array(forward, backward)).otherwise(F.array(forward))
    return rows.select(
        "arrival_no",
        "set_order",
        "record_no",
        "recv_ts",
        c("exporter").alias("sampler_address"),
        c("sequence").alias("sequence_number"),
        "sampling_rate",
        datagrams.flow_source(c("version")).alias("flow_source"),
        "protocol",
        "tcp_flags",
        "tos",
        c("fw_event").alias("firewall_event"),
        c("end_reason").alias("flow_end_reason"),
        "app_name",
        "next_hop",
        type_code.alias("icmp_type_code"),
        c("_start").alias("flow_start"),
        c("_end").alias("flow_end"),
        c("_end").alias("timestamp"),
        F.inline(both),
    )


def flow_samples(rows: DataFrame) -> DataFrame:
    """The canonical table."""
    return conform(rows, "flow_samples")
