"""SNMP walks (long rows of OID and value) to typed tables.

``pdus`` has ``device_id``, ``poll_ts``, ``pdu_no`` (order inside the poll), ``oid``, ``pdu_type``, ``value`` (text form)
and ``value_bytes`` (octet strings). Every table is one conditional aggregation: a prefix filter that Parquet can use,
the column named by prefix, and ``max_by`` so that the last PDU of a cell wins. That is one shuffle on
(device, poll, index). The PDUs are shuffled before they are combined: text values are aggregated by sorting, and that sort
must be bounded by a partition of the shuffle, not by what a scan task happens to read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftnet.functions import net
from siftnet.operators import filters, oids

# PDU types that carry no value, and those an interface index may have.
INVALID_TYPES = ["NoSuchObject", "NoSuchInstance", "EndOfMibView"]
INDEX_TYPES = ["Integer", "Gauge32", "Counter32"]

POLL = ["device_id", "poll_ts"]


def valid_pdus(pdus: DataFrame) -> DataFrame:
    return pdus.where(~F.col("pdu_type").isin(INVALID_TYPES))


def oid_index(oid: Column) -> Column:
    """Last component of an OID, null if it is no number."""
    index = F.substring_index(oid, ".", -1).try_cast("bigint")
    return F.when(index >= 0, index)


def under(prefixes: list[str]) -> Column:
    condition = F.lit(False)
    for prefix in prefixes:
        condition = condition | F.col("oid").startswith(prefix + ".")
    return condition


def cells(pdus: DataFrame, columns: dict[str, str]) -> DataFrame:
    """PDUs of the given table columns with ``_column`` and ``_suffix`` (the OID below the column)."""
    rows = valid_pdus(pdus).where(under(list(columns.values())))
    name, suffix = F.lit(None).cast("string"), F.lit(None).cast("string")
    for column, prefix in columns.items():
        match = F.col("oid").startswith(prefix + ".")
        name = F.when(match, column).otherwise(name)
        suffix = F.when(match, F.substr(F.col("oid"), F.lit(len(prefix) + 2))).otherwise(suffix)
    return rows.withColumn("_column", name).withColumn("_suffix", suffix)


def _latest(column: str, value: Column) -> Column:
    return F.max_by(value, F.when(F.col("_column") == column, F.col("pdu_no"))).alias(column)


def pivot(
    pdus: DataFrame, columns: dict[str, str], *, binary: tuple[str, ...] = (), index: Column | None = None
) -> DataFrame:
    """One row per (device, poll, idx) with the text (or bytes) of each column, null where absent."""
    found = cells(pdus, columns)
    keyed = found.withColumn("idx", oid_index(F.col("oid")) if index is None else index).where("idx is not null")
    return keyed.repartition(*POLL, "idx").groupBy(*POLL, "idx").agg(
        *[_latest(c, F.col("value_bytes") if c in binary else F.col("value")) for c in columns]
    )


def scalars(pdus: DataFrame, columns: dict[str, str], *, binary: tuple[str, ...] = ()) -> DataFrame:
    """One row per (device, poll) from exact OIDs."""
    name = F.lit(None).cast("string")
    for column, oid in columns.items():
        name = F.when(F.col("oid") == oid, column).otherwise(name)
    rows = valid_pdus(pdus).where(F.col("oid").isin(list(columns.values()))).withColumn("_column", name)
    return rows.repartition(*POLL).groupBy(*POLL).agg(*[_latest(c, F.col("value_bytes") if c in binary else F.col("value")) for c in columns])


# ------------------------------------------------------------------------------------------------------ coercion


def number(value: Column) -> Column:
    """Integer PDU as BIGINT: absent stays null, a value that is no number reads 0."""
    return F.when(value.isNotNull(), F.coalesce(value.try_cast("bigint"), F.lit(0).cast("bigint")))


def decimal(value: Column) -> Column:
    """Number held as text; 0 if it is none."""
    return F.when(value.isNotNull(), F.coalesce(F.trim(value).try_cast("double"), F.lit(0.0)))


def leading_decimal(value: Column) -> Column:
    """The number a text starts with."""
    digits = F.regexp_extract(value, r"^\s*([+-]?[0-9]*\.?[0-9]+([eE][+-]?[0-9]+)?)", 1)
    return F.when(value.isNotNull(), F.coalesce(digits.try_cast("double"), F.lit(0.0)))


def not_negative(value: Column) -> Column:
    return F.greatest(number(value), F.lit(0).cast("bigint"))


def text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def printable(value: Column) -> Column:
    """Text without control characters, trimmed."""
    return F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r"[\x00-\x1f\x7f]", "")


def printable_or_mac(value: Column, data: Column, subtype: Column, mac_subtype: int) -> Column:
    mac = F.coalesce(net.mac_from_bytes(data), F.lit(""))
    is_mac = F.coalesce(subtype == mac_subtype, F.lit(False)) & (mac != "")
    return F.when(is_mac, mac).otherwise(printable(value))


def ip_value(value: Column, data: Column) -> Column:
    """IpAddress PDU as text: an address in text form, or four raw bytes, else the text itself."""
    return F.coalesce(net.canonical_ip(value), F.when(F.length(data) == 4, net.ipv4_from_bytes(data)), value, F.lit(""))


def state(up: Column) -> tuple[Column, Column]:
    """(status, state) of a tunnel."""
    up = F.coalesce(up, F.lit(False))
    return F.when(up, "up").otherwise("down"), F.when(up, "active").otherwise("inactive")


def lookup(value: Column, names: dict, default: Column | None = None) -> Column:
    """Small fixed code table as an expression."""
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for code, name in names.items():
        chain = chain.when(value == code, name)
    return chain.otherwise(default)


# ----------------------------------------------------------------------------------------------------- interfaces


def interface_stats(pdus: DataFrame) -> DataFrame:
    """ifTable joined with the wide counters of ifXTable and the port VLAN, for interfaces ifTable knows.

    Both tables share the index, so the override needs no join: one pivot holds both and rows without any ifTable cell
    are dropped.
    """
    wide = pivot(pdus, oids.INTERFACE | oids.INTERFACE_X, binary=("mac",))
    known = F.lit(False)
    for column in oids.INTERFACE:
        known = known | F.col(column).isNotNull()
    c = F.col
    rows = wide.where(known)
    oper = number(c("oper"))
    return rows.select(
        *POLL,
        c("idx").alias("index"),
        F.coalesce(F.nullif(text(c("x_name")), F.lit("")), text(c("descr"))).alias("name"),
        number(c("type")).alias("type"),
        number(c("speed")).alias("speed"),
        F.when(oper == 1, "up").when(oper == 2, "down").when(oper.isNotNull(), "unknown").otherwise("").alias("status"),
        F.when(number(c("admin")) == 1, "up").when(c("admin").isNotNull(), "down").otherwise("").alias("admin_status"),
        F.coalesce(number(c("hc_in")), number(c("in_octets"))).alias("in_bytes"),
        number(c("in_packets")).alias("in_packets"),
        number(c("in_errors")).alias("in_errors"),
        number(c("in_discards")).alias("in_discards"),
        F.coalesce(number(c("hc_out")), number(c("out_octets"))).alias("out_bytes"),
        number(c("out_packets")).alias("out_packets"),
        number(c("out_errors")).alias("out_errors"),
        number(c("out_discards")).alias("out_discards"),
        text(c("alias")).alias("alias"),
        number(c("mtu")).alias("mtu"),
        F.coalesce(net.mac_from_bytes(c("mac"), upper=True), F.lit("")).alias("mac_address"),
        text(lookup(number(c("type")), oids.IF_TYPE_NAMES)).alias("type_name"),
        number(c("high_speed")).alias("high_speed"),
        number(c("vlan")).alias("vlan_id"),
    )


def interface_addresses(pdus: DataFrame) -> DataFrame:
    """Addresses from the table index; loopback and unspecified ones skipped; the index only from integer PDUs."""
    found = cells(pdus, oids.ADDRESS)
    ip = F.substring_index(F.col("_suffix"), ".", 4)
    rows = found.withColumn("ip_address", F.when(net.is_ipv4(ip), ip)).where(
        "ip_address is not null and ip_address not like '127.%' and ip_address <> '0.0.0.0'"
    )
    is_index = (F.col("_column") == "if_index") & F.col("pdu_type").isin(INDEX_TYPES)
    mask = F.when(F.length("value_bytes") == 4, net.ipv4_from_bytes(F.col("value_bytes"))).otherwise(F.col("value"))
    return rows.groupBy(*POLL, "ip_address").agg(
        number(F.max_by("value", F.when(is_index, F.col("pdu_no")))).alias("if_index"),
        text(F.max_by(mask, F.when(F.col("_column") == "net_mask", F.col("pdu_no")))).alias("net_mask"),
    )


# --------------------------------------------------------------------------------------------------------- tunnels


def _selector(begin: str, end: str) -> Column:
    b, e = text(F.col(begin)), text(F.col(end))
    return F.when((b != "") & (e != "") & (b != e), F.concat(b, F.lit(" - "), e)).otherwise(b)


def site_tunnels(pdus: DataFrame) -> DataFrame:
    rows = pivot(pdus, oids.SITE_TUNNEL)
    # a row made of selectors only has no tunnel behind it
    own = [c for c in oids.SITE_TUNNEL if c not in ("src_begin", "src_end", "dst_begin", "dst_end")]
    rows = rows.where(F.coalesce(*[F.col(c) for c in own]).isNotNull())
    status = number(F.col("status"))
    return rows.select(
        *POLL,
        text(F.col("tunnel_name")).alias("tunnel_name"),
        F.lit("ipsec").alias("tunnel_type"),
        text(F.col("remote_ip")).alias("remote_ip"),
        F.when(status == 2, "up").when(status.isNotNull(), "down").otherwise("").alias("status"),
        F.when(status == 2, "active").when(status.isNotNull(), "inactive").otherwise("").alias("state"),
        number(F.col("bytes_in")).alias("bytes_in"),
        number(F.col("bytes_out")).alias("bytes_out"),
        text(F.col("phase1_name")).alias("phase1_name"),
        _selector("src_begin", "src_end").alias("local_subnet"),
        _selector("dst_begin", "dst_end").alias("remote_subnet"),
        number(F.col("uptime")).alias("tunnel_uptime"),
    )


def dialup_tunnels(pdus: DataFrame) -> DataFrame:
    rows = pivot(pdus, oids.DIALUP_TUNNEL)
    rows = rows.where(F.coalesce("remote_ip", "uptime", "bytes_in", "bytes_out").isNotNull())
    remote = text(F.col("remote_ip"))
    return rows.select(
        *POLL,
        F.concat(F.lit("dialup-"), F.when(remote == "", "unknown").otherwise(remote)).alias("tunnel_name"),
        F.lit("ipsec-dialup").alias("tunnel_type"),
        remote.alias("remote_ip"),
        F.lit("up").alias("status"),
        F.lit("active").alias("state"),
        number(F.col("bytes_in")).alias("bytes_in"),
        number(F.col("bytes_out")).alias("bytes_out"),
        net.range_to_cidr(text(F.col("src_begin")), text(F.col("src_end"))).alias("local_subnet"),
        net.range_to_cidr(text(F.col("dst_begin")), text(F.col("dst_end"))).alias("remote_subnet"),
        number(F.col("uptime")).alias("tunnel_uptime"),
    )


def ssl_sessions(pdus: DataFrame) -> DataFrame:
    rows = pivot(pdus, oids.SSL_SESSION)
    return rows.select(
        *POLL,
        F.when(F.col("user").isNotNull(), F.concat(F.lit("sslvpn-"), F.col("user"))).otherwise("").alias("tunnel_name"),
        F.lit("sslvpn").alias("tunnel_type"),
        text(F.col("remote_ip")).alias("remote_ip"),
        F.lit("up").alias("status"),
        F.lit("active").alias("state"),
        number(F.col("bytes_in")).alias("bytes_in"),
        number(F.col("bytes_out")).alias("bytes_out"),
    )


def tunnel_type_bsd(name: Column) -> Column:
    lower = F.lower(name)
    return (
        F.when(lower.startswith("ovpns"), "openvpn-server")
        .when(lower.startswith("ovpnc"), "openvpn-client")
        .when(lower.startswith("wg") | lower.startswith("tun_wg"), "wireguard")
        .when(lower.startswith("ipsec"), "ipsec")
    )


def tunnel_type_linux(name: Column, if_type: Column) -> Column:
    lower = F.lower(name)
    return (
        F.when(lower.startswith("wg"), "wireguard")
        .when(lower.startswith("tun") & F.coalesce(if_type.isin(53, 131, 1), F.lit(False)), "openvpn")
        .when(lower.startswith("tap"), "openvpn")
        .when(lower.startswith("vti"), "ipsec")
    )


def tunnel_type_paloalto(name: Column) -> Column:
    return F.when(F.lower(name).startswith("tunnel."), "ipsec")


def interface_tunnels(pdus: DataFrame, family: str) -> DataFrame:
    """Tunnels inferred from interface names: ``bsd``, ``linux`` or ``paloalto``. Palo Alto also reads the 64-bit
    counters; of the two counter columns the later PDU of the walk counts."""
    columns = {c: oids.INTERFACE[c] for c in ("descr", "type", "oper", "in_octets", "out_octets")}
    if family == "paloalto":
        named = cells(pdus, columns | {"hc_in": oids.INTERFACE_X["hc_in"], "hc_out": oids.INTERFACE_X["hc_out"]})
        narrow = F.when(F.col("_column") == "hc_in", "in_octets").when(F.col("_column") == "hc_out", "out_octets")
        merged = named.withColumn("_column", F.coalesce(narrow, F.col("_column"))).withColumn("idx", oid_index(F.col("oid")))
        rows = merged.where("idx is not null").groupBy(*POLL, "idx").agg(*[_latest(c, F.col("value")) for c in columns])
    else:
        rows = pivot(pdus, columns)
    name = text(F.col("descr"))
    kind = {
        "bsd": tunnel_type_bsd(name),
        "linux": tunnel_type_linux(name, number(F.col("type"))),
        "paloalto": tunnel_type_paloalto(name),
    }[family]
    status, condition = state(number(F.col("oper")) == 1)
    return rows.withColumn("tunnel_type", kind).where("tunnel_type is not null").select(
        *POLL,
        name.alias("tunnel_name"),
        "tunnel_type",
        status.alias("status"),
        condition.alias("state"),
        number(F.col("in_octets")).alias("bytes_in"),
        number(F.col("out_octets")).alias("bytes_out"),
    )


def security_associations(pdus: DataFrame) -> DataFrame:
    """Listed associations are up; in = decrypted, out = encrypted bytes."""
    addresses = ("peer", "src_begin", "src_end", "dst_begin", "dst_end")
    found = cells(pdus, oids.SECURITY_ASSOCIATION).withColumn("idx", oid_index(F.col("oid"))).where("idx is not null")
    ip = ip_value(F.col("value"), F.col("value_bytes"))
    rows = found.groupBy(*POLL, "idx").agg(
        *[_latest(c, ip if c in addresses else F.col("value")) for c in oids.SECURITY_ASSOCIATION]
    )
    peer, user = text(F.col("peer")), text(F.col("user"))
    return rows.select(
        *POLL,
        F.when(user != "", user).otherwise(F.concat(F.lit("SA-"), peer)).alias("tunnel_name"),
        F.lit("ipsec").alias("tunnel_type"),
        peer.alias("remote_ip"),
        F.lit("up").alias("status"),
        F.lit("active").alias("state"),
        number(F.col("decrypted")).alias("bytes_in"),
        number(F.col("encrypted")).alias("bytes_out"),
        net.range_text(F.col("src_begin"), F.col("src_end")).alias("local_subnet"),
        net.range_text(F.col("dst_begin"), F.col("dst_end")).alias("remote_subnet"),
    )


# --------------------------------------------------------------------------------------------------------- sensors


def sensor_class(name: Column) -> tuple[Column, Column]:
    """(class, unit) from a sensor's name; empty where nothing matches."""
    lower = F.lower(name)

    def has(*words: str) -> Column:
        return lower.rlike("|".join(w.replace("+", r"\+").replace(".", r"\.") for w in words))

    temperature, fan = has("temp", "dts", "lm75"), has("fan")
    voltage = has("vcc", "vdd", "+1.", "+2.", "+3.", "+5.", "+12", "volt")
    power = lower.contains("ps") & lower.contains("status")
    kind = F.when(temperature, "temperature").when(fan, "fan").when(voltage, "voltage").when(power, "power").otherwise("")
    unit = F.when(temperature, "°C").when(fan, "RPM").when(voltage, "mV").otherwise("")
    return kind, unit


def sonicwall_sensor_class(name: Column, unit: Column) -> Column:
    lower = F.lower(F.concat_ws(" ", name, unit))
    return (
        F.when(lower.rlike("temp|celsius"), "temperature")
        .when(lower.rlike("fan|rpm"), "fan")
        .when(lower.rlike("volt|vcc|vdd"), "voltage")
        .when(lower.rlike("power|watt"), "power")
        .otherwise("other")
    )


def fortinet_sensors(pdus: DataFrame) -> DataFrame:
    rows = pivot(pdus, oids.FORTINET_SENSOR)
    kind, unit = sensor_class(text(F.col("name")))
    alarm = number(F.col("alarm"))
    return rows.select(
        *POLL,
        text(F.col("name")).alias("name"),
        kind.alias("type"),
        decimal(F.col("value")).alias("value"),
        F.when(alarm == 0, "normal").when(alarm.isNotNull(), "alarm").otherwise("").alias("status"),
        unit.alias("unit"),
    )


def entity_scale(code: Column) -> Column:
    """Scale code to factor; a missing or unknown code means units."""
    scale = F.when(code.between(1, oids.ENTITY_SCALE_LAST), code).otherwise(oids.ENTITY_SCALE_UNITS)
    names = {c: f"1e{3 * (c - oids.ENTITY_SCALE_UNITS)}" for c in range(1, oids.ENTITY_SCALE_LAST + 1)}
    return lookup(scale, names).cast("double")


def entity_sensors(pdus: DataFrame) -> DataFrame:
    """ENTITY-SENSOR rows; unavailable (2) and broken (3) ones and unknown types are skipped."""
    rows = pivot(pdus, oids.ENTITY_SENSOR)
    status = F.coalesce(number(F.col("status")), F.lit(0))
    kind = number(F.col("sensor_type"))
    rows = rows.where(~status.isin(2, 3) & kind.isin(list(oids.ENTITY_SENSOR_TYPES)))
    precision = F.coalesce(number(F.col("precision")), F.lit(0))
    value = F.coalesce(number(F.col("value")), F.lit(0)).cast("double")
    exact = F.when(precision > 0, value / F.pow(F.lit(10.0), precision)).otherwise(value)
    pattern = lookup(kind, {k: v[0] for k, v in oids.ENTITY_SENSOR_TYPES.items()})
    return rows.select(
        *POLL,
        F.replace(pattern, F.lit("%d"), F.col("idx").cast("string")).alias("name"),
        lookup(kind, {k: v[1] for k, v in oids.ENTITY_SENSOR_TYPES.items()}).alias("type"),
        (exact * entity_scale(number(F.col("scale")))).alias("value"),
        F.lit("normal").alias("status"),
        lookup(kind, {k: v[2] for k, v in oids.ENTITY_SENSOR_TYPES.items()}).alias("unit"),
    )


def sonicwall_sensors(pdus: DataFrame) -> DataFrame:
    rows = pivot(pdus, oids.SONICWALL_SENSOR).where(text(F.col("name")) != "")
    return rows.select(
        *POLL,
        "name",
        sonicwall_sensor_class(F.col("name"), text(F.col("unit"))).alias("type"),
        F.coalesce(number(F.col("value")), F.lit(0)).cast("double").alias("value"),
        F.lit("normal").alias("status"),
        text(F.col("unit")).alias("unit"),
    )


def lm_sensors(pdus: DataFrame) -> DataFrame:
    """Temperatures in thousandths of a degree, and fans."""
    rows = pivot(pdus, oids.LM_SENSOR)
    c = F.col

    def sensor(kind: str, name: str, value: str, unit: str, divisor: int) -> Column:
        named = c(name).isNotNull()
        return F.struct(
            (c(name).isNotNull() | c(value).isNotNull()).alias("present"),
            text(c(name)).alias("name"),
            F.when(named, kind).otherwise("").alias("type"),
            (F.coalesce(number(c(value)), F.lit(0)).cast("double") / divisor).alias("value"),
            F.when(c(value).isNotNull(), "normal").otherwise("").alias("status"),
            F.when(named, unit).otherwise("").alias("unit"),
        )

    both = F.array(
        sensor("temperature", "temp_name", "temp_value", "°C", 1000), sensor("fan", "fan_name", "fan_value", "RPM", 1)
    )
    return rows.select(*POLL, F.inline(both)).where("present").drop("present")


# ------------------------------------------------------------------------------------------------------ processors


def processors(pdus: DataFrame, column: str = oids.HR_PROCESSOR_LOAD) -> DataFrame:
    rows = pivot(pdus, {"load": column})
    return rows.select(*POLL, F.col("idx").alias("index"), number(F.col("load")).cast("double").alias("usage"))


def cisco_processors(pdus: DataFrame) -> DataFrame:
    """One-minute load; the five-minute one only for indexes without it."""
    rows = pivot(pdus, {"one": oids.CISCO_CPU_1MIN, "five": oids.CISCO_CPU_5MIN})
    usage = F.coalesce(number(F.col("one")), number(F.col("five")))
    return rows.select(*POLL, F.col("idx").alias("index"), usage.cast("double").alias("usage"))


# ------------------------------------------------------------------------------------------------ high availability


def fortinet_ha(pdus: DataFrame) -> DataFrame:
    """Cluster members with the cluster scalars copied onto each; a standalone device has none. Members of a poll without the
    scalars keep an empty mode."""
    mode = number(F.col("mode"))
    cluster = scalars(pdus, oids.FORTINET_HA).select(
        *POLL,
        F.when(mode == 2, "activeActive").when(mode == 3, "activePassive").when(mode.isNotNull(), "standalone").otherwise("").alias("system_mode"),
        number(F.col("group_id")).alias("group_id"),
        text(F.col("group_name")).alias("group_name"),
    )
    members = pivot(pdus, oids.FORTINET_HA_MEMBER)
    sync = number(F.col("sync"))
    numbers = ["network_usage", "session_count", "packet_count", "byte_count"]
    system_mode = F.coalesce("system_mode", F.lit(""))
    return members.join(cluster, POLL, "left").where(system_mode != "standalone").select(
        *POLL,
        system_mode.alias("system_mode"),
        "group_id",
        "group_name",
        F.col("idx").alias("member_index"),
        text(F.col("member_serial")).alias("member_serial"),
        text(F.col("member_hostname")).alias("member_hostname"),
        number(F.col("cpu_usage")).cast("double").alias("cpu_usage"),
        number(F.col("memory_usage")).cast("double").alias("memory_usage"),
        *[number(F.col(c)).alias(c) for c in numbers],
        F.when(sync == 1, "in-sync").when(sync.isNotNull(), "out-of-sync").otherwise("").alias("sync_status"),
        text(F.col("master_serial")).alias("master_serial"),
    )


def paloalto_ha(pdus: DataFrame) -> DataFrame:
    rows = scalars(pdus, oids.PALO_ALTO_HA).where(~text(F.col("mode")).isin("", "disabled"))
    lost = text(F.col("peer")).isin("", "non-functional", "suspended")
    return rows.select(
        *POLL,
        F.col("mode").alias("system_mode"),
        F.lit(1).alias("group_id"),
        F.lit("HA").alias("group_name"),
        F.lit(0).alias("member_index"),
        text(F.col("serial")).alias("member_serial"),
        text(F.col("state")).alias("member_hostname"),
        F.when(lost, "out-of-sync").otherwise("in-sync").alias("sync_status"),
    )


def cisco_ha(pdus: DataFrame) -> DataFrame:
    """Rows 6 (primary) and 7 (secondary) that have a status value."""
    rows = pivot(pdus, oids.CISCO_FAILOVER).where("idx in (6, 7) and value is not null")
    status = lookup(number(F.col("value")), oids.CISCO_FAILOVER_STATES, F.lit("unknown"))
    detail = text(F.col("detail"))
    return rows.select(
        *POLL,
        F.lit("failover").alias("system_mode"),
        F.lit("failover").alias("group_name"),
        (F.col("idx") - 5).alias("member_index"),
        text(F.col("info")).alias("member_hostname"),
        F.when(detail != "", F.concat(status, F.lit(" ("), detail, F.lit(")"))).otherwise(status).alias("sync_status"),
    )


# ---------------------------------------------------------------------------------- counters, SD-WAN, licences, disks


def security_stats(pdus: DataFrame) -> DataFrame:
    rows = scalars(pdus, oids.SECURITY)
    return rows.select(*POLL, *[F.coalesce(number(F.col(c)), F.lit(0)).alias(c) for c in oids.SECURITY])


def sdwan_health(pdus: DataFrame) -> DataFrame:
    """Loss in percent of packets sent; more received than sent counts as none and sets ``loss_suspect``."""
    rows = pivot(pdus, oids.SDWAN)
    sent = F.coalesce(number(F.col("packet_send")), F.lit(0))
    received = F.coalesce(number(F.col("packet_recv")), F.lit(0))
    lost = F.greatest(sent - received, F.lit(0))
    condition = number(F.col("state"))
    return rows.select(
        *POLL,
        text(F.col("name")).alias("name"),
        text(F.col("interface")).alias("interface"),
        F.when(condition == 0, "alive").when(condition.isNotNull(), "dead").otherwise("").alias("state"),
        F.coalesce(leading_decimal(F.col("latency")), F.lit(0.0)).alias("latency"),
        F.when(sent > 0, lost.cast("double") / F.when(sent > 0, sent) * 100).otherwise(0.0).alias("packet_loss"),
        sent.alias("packet_send"),
        received.alias("packet_recv"),
        (received > sent).alias("loss_suspect"),
    )


def licenses(pdus: DataFrame) -> DataFrame:
    rows = pivot(pdus, oids.LICENSE)
    return rows.select(*POLL, *[text(F.col(c)).alias(c) for c in oids.LICENSE])


def disk_usage(pdus: DataFrame) -> DataFrame:
    rows = pivot(pdus, oids.STORAGE)
    typed = rows.select(
        *POLL,
        "idx",
        text(F.col("storage_type")).alias("storage_type"),
        text(F.col("mount")).alias("mount"),
        *[F.coalesce(not_negative(F.col(c)), F.lit(0)).alias(c) for c in ("units", "size", "used")],
    )
    total = F.try_multiply(F.col("size"), F.col("units"))
    sized = filters.fixed_disks(typed).withColumn("total_bytes", total)
    used = F.least(F.try_multiply(F.col("used"), F.col("units")), F.col("total_bytes"))
    return sized.withColumn("used_bytes", used).select(
        *POLL,
        "mount",
        "total_bytes",
        "used_bytes",
        (F.col("used_bytes").cast("double") / F.col("total_bytes") * 100).alias("used_percent"),
    )


def load_average(pdus: DataFrame) -> DataFrame:
    rows = cells(pdus, {"load": oids.LOAD}).withColumn("idx", oid_index(F.col("oid"))).where("idx in (1, 2, 3)")
    names = {1: "load1", 2: "load5", 3: "load15"}
    return rows.groupBy(*POLL).agg(
        *[
            F.coalesce(decimal(F.max_by("value", F.when(F.col("idx") == i, F.col("pdu_no")))), F.lit(0.0)).alias(name)
            for i, name in names.items()
        ]
    )


# --------------------------------------------------------------------------------------------------- system status


def version_text(vendor: str, descr: Column) -> Column:
    """Version out of the system description, by vendor."""
    clean = F.trim(descr)
    words = F.filter(F.split(clean, r"\s+"), lambda w: w != "")
    first_and_third = F.concat_ws(" ", F.get(words, F.lit(0)), F.get(words, F.lit(2)))
    if vendor == "fortigate":
        return descr
    if vendor == "opnsense":
        at = F.instr(F.lower(descr), "opnsense")
        tail = F.filter(F.split(F.substr(descr, at), r"\s+"), lambda w: w != "")
        named = F.concat_ws(" ", F.lit("OPNsense"), F.get(tail, F.lit(1)))
        return F.when(descr == "", "").when(at > 0, named).when(F.size(words) >= 3, first_and_third).otherwise(descr)
    if vendor == "pfsense":
        at = F.instr(F.lower(descr), "pfsense")
        tail = F.filter(F.split(F.substr(descr, at), r"\s+"), lambda w: w != "")
        release = F.get(F.filter(tail, lambda w: w.rlike(r"-CE-|-RELEASE|2\.|24\.")), F.lit(0))
        word = F.coalesce(release, F.get(tail, F.lit(1)))
        return (
            F.when(descr == "", "")
            .when((at > 0) & word.isNotNull(), F.concat(F.lit("pfSense "), word))
            .when(F.size(words) >= 3, first_and_third)
            .otherwise(descr)
        )
    if vendor == "firewalla":
        linux = (F.size(words) >= 3) & (F.lower(F.get(words, F.lit(0))) == "linux")
        return F.when(linux, F.concat(F.lit("Linux "), F.get(words, F.lit(2)))).otherwise(descr)
    if vendor == "cisco_asa":
        at = F.array_position(F.transform(words, F.lower), "version").cast("int")
        following = F.when(at > 0, F.get(words, at))
        return F.when(following.isNotNull(), F.concat(F.lit("ASA "), following)).otherwise(clean)
    return clean


def _ticks() -> Column:
    return F.floor(number(F.col("ticks")) / 100)


def fortinet_system(pdus: DataFrame) -> DataFrame:
    rows = scalars(pdus, oids.FORTINET_SYSTEM)
    texts = ["hostname", "version", "av_version", "ips_version"]
    plain = [c for c in oids.FORTINET_SYSTEM if c not in {*texts, "cpu", "memory", "disk", "disk_total"}]
    disk, cap = number(F.col("disk")), F.coalesce(number(F.col("disk_total")), F.lit(0))
    return rows.select(
        *POLL,
        *[text(F.col(c)).alias(c) for c in texts],
        F.coalesce(number(F.col("cpu")), F.lit(0)).cast("double").alias("cpu_usage"),
        F.coalesce(number(F.col("memory")), F.lit(0)).cast("double").alias("memory_usage"),
        F.when(cap > 0, F.coalesce(disk, F.lit(0)).cast("double") / F.when(cap > 0, cap) * 100).otherwise(0.0).alias("disk_usage"),
        cap.alias("disk_total"),
        *[F.coalesce(number(F.col(c)), F.lit(0)).alias(c) for c in plain],
    )


def ucd_system(pdus: DataFrame, vendor: str) -> DataFrame:
    """pfSense, OPNsense and Firewalla (which has no session counter)."""
    columns = {k: v for k, v in oids.UCD_SYSTEM.items() if vendor != "firewalla" or k != "session_count"}
    raw = scalars(pdus, columns)
    if "session_count" not in columns:
        raw = raw.withColumn("session_count", F.lit("0"))
    names = ["cpu_user", "cpu_system", "cpu_idle", "mem_total", "mem_avail", "mem_buffer", "mem_cached", "session_count"]
    rows = raw.select(
        *POLL, "hostname", "descr", "ticks", *[F.coalesce(number(F.col(c)), F.lit(0)).alias(c) for c in names]
    )
    c = F.col
    total = c("cpu_user") + c("cpu_system") + c("cpu_idle")
    cpu = (c("cpu_user") + c("cpu_system")).cast("double") / F.when(total > 0, total) * 100
    tight = c("mem_total") - c("mem_avail") - c("mem_buffer") - c("mem_cached")
    used = F.when(tight < 0, c("mem_total") - c("mem_avail")).otherwise(tight)
    has_memory = c("mem_total") > 0
    return rows.select(
        *POLL,
        text(c("hostname")).alias("hostname"),
        version_text(vendor, text(c("descr"))).alias("version"),
        F.coalesce(_ticks(), F.lit(0)).alias("uptime"),
        F.when(total > 0, cpu)
        .when(c("cpu_idle") > 0, (F.lit(100) - c("cpu_idle")).cast("double"))
        .otherwise(0.0)
        .alias("cpu_usage"),
        F.when(has_memory, F.floor(c("mem_total") / 1024)).otherwise(0).alias("memory_total"),
        F.when(has_memory, used.cast("double") / F.when(has_memory, c("mem_total")) * 100).otherwise(0.0).alias("memory_usage"),
        "session_count",
    )


def paloalto_system(pdus: DataFrame) -> DataFrame:
    rows = scalars(pdus, oids.PALO_ALTO_SYSTEM)
    version = F.concat(F.lit("PAN-OS "), F.col("sw_version"))
    return rows.select(
        *POLL,
        text(F.col("hostname")).alias("hostname"),
        text(version).alias("version"),
        F.coalesce(_ticks(), F.lit(0)).alias("uptime"),
        F.coalesce(number(F.col("cpu")), F.lit(0)).cast("double").alias("cpu_usage"),
        F.coalesce(number(F.col("session_count")), F.lit(0)).alias("session_count"),
        text(F.col("av_version")).alias("av_version"),
        text(F.col("ips_version")).alias("ips_version"),
        F.coalesce(number(F.col("sslvpn_tunnels")), F.lit(0)).alias("sslvpn_tunnels"),
    )


def sonicwall_system(pdus: DataFrame) -> DataFrame:
    rows = scalars(pdus, oids.SONICWALL_SYSTEM)
    return rows.select(
        *POLL,
        text(F.col("hostname")).alias("hostname"),
        text(F.concat(F.lit("SonicOS "), F.col("firmware"))).alias("version"),
        F.coalesce(_ticks(), F.lit(0)).alias("uptime"),
        F.coalesce(number(F.col("cpu")), F.lit(0)).cast("double").alias("cpu_usage"),
        F.coalesce(number(F.col("memory")), F.lit(0)).cast("double").alias("memory_usage"),
        F.coalesce(number(F.col("session_count")), F.lit(0)).alias("session_count"),
    )


def cisco_system(pdus: DataFrame) -> DataFrame:
    rows = scalars(pdus, oids.CISCO_SYSTEM)
    used = F.coalesce(number(F.col("mem_used")), F.lit(0))
    total = used + F.coalesce(number(F.col("mem_free")), F.lit(0))
    some = F.when(total > 0, total)
    return rows.select(
        *POLL,
        text(F.col("hostname")).alias("hostname"),
        version_text("cisco_asa", text(F.col("descr"))).alias("version"),
        F.coalesce(_ticks(), F.lit(0)).alias("uptime"),
        F.coalesce(number(F.col("cpu")), F.lit(0)).cast("double").alias("cpu_usage"),
        F.coalesce(F.floor(some / (1024 * 1024)), F.lit(0)).alias("memory_total"),
        F.coalesce(used.cast("double") / some * 100, F.lit(0.0)).alias("memory_usage"),
        F.coalesce(number(F.col("session_count")), F.lit(0)).alias("session_count"),
    )


def generic_system(pdus: DataFrame) -> DataFrame:
    rows = scalars(pdus, oids.GENERIC_SYSTEM)
    return rows.select(
        *POLL,
        text(F.col("hostname")).alias("hostname"),
        version_text("generic", text(F.col("descr"))).alias("version"),
        F.coalesce(_ticks(), F.lit(0)).alias("uptime"),
        F.coalesce(F.floor(number(F.col("mem_kb")) / 1024), F.lit(0)).alias("memory_total"),
    )


# --------------------------------------------------------------------------------------------------------- vendors


def resolve_vendor(vendor: Column) -> Column:
    """Profile of a device: an empty vendor means the first profile, an unknown one ``generic``."""
    named = F.coalesce(vendor, F.lit(""))
    return F.when(named == "", oids.VENDORS[0]).when(named.isin(oids.VENDORS), named).otherwise("generic")


#: Extension point: vendor -> {table: function of the PDU rows}. Add an entry to support a vendor.
PROFILES = {
    "fortigate": {
        "system_status": fortinet_system,
        "vpn_status": site_tunnels,
        "dialup_vpn_status": dialup_tunnels,
        "sslvpn_status": ssl_sessions,
        "hardware_sensors": fortinet_sensors,
        "processor_stats": lambda pdus: processors(pdus, oids.FORTINET_PROCESSOR),
        "ha_status": fortinet_ha,
        "security_stats": security_stats,
        "sdwan_health": sdwan_health,
        "license_info": licenses,
    },
    "paloalto": {
        "system_status": paloalto_system,
        "vpn_status": lambda pdus: interface_tunnels(pdus, "paloalto"),
        "hardware_sensors": entity_sensors,
        "processor_stats": processors,
        "ha_status": paloalto_ha,
    },
    "sonicwall": {
        "system_status": sonicwall_system,
        "vpn_status": security_associations,
        "hardware_sensors": sonicwall_sensors,
    },
    "pfsense": {
        "system_status": lambda pdus: ucd_system(pdus, "pfsense"),
        "vpn_status": lambda pdus: interface_tunnels(pdus, "bsd"),
        "processor_stats": processors,
    },
    "opnsense": {
        "system_status": lambda pdus: ucd_system(pdus, "opnsense"),
        "vpn_status": lambda pdus: interface_tunnels(pdus, "bsd"),
        "processor_stats": processors,
        "disk_usage": disk_usage,
        "load_average": load_average,
    },
    "firewalla": {
        "system_status": lambda pdus: ucd_system(pdus, "firewalla"),
        "vpn_status": lambda pdus: interface_tunnels(pdus, "linux"),
        "hardware_sensors": lm_sensors,
        "processor_stats": processors,
    },
    "cisco_asa": {"system_status": cisco_system, "processor_stats": cisco_processors, "ha_status": cisco_ha},
    "generic": {"system_status": generic_system, "processor_stats": processors},
}


def vendor_table(pdus: DataFrame, table: str) -> DataFrame:
    """One canonical table over a mixed fleet: each vendor's rows go through its own profile."""
    profiled = pdus.withColumn("_profile", resolve_vendor(F.col("vendor")))
    parts = [
        build(profiled.where(F.col("_profile") == vendor))
        for vendor, tables in PROFILES.items()
        if (build := tables.get(table)) is not None
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    return result
