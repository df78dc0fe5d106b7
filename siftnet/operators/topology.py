"""Layer-2 topology from SNMP walks: ARP, forwarding tables, LLDP and CDP neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftnet.functions import net
from siftnet.operators import lookups, oids, snmp
from siftnet.operators.snmp import POLL

# Status of a learned forwarding entry, and the subtypes whose value is a MAC.
FDB_LEARNED = 3
CHASSIS_IS_MAC, PORT_IS_MAC = 4, 3


def _parts(suffix: Column) -> Column:
    return F.split(suffix, r"\.")


def _part(parts: Column, at: int) -> Column:
    return F.get(parts, F.lit(at))


def _arp(rows: DataFrame, ip: Column) -> DataFrame:
    parts = _parts(F.col("_suffix"))
    found = rows.withColumn("ip_address", ip).withColumn("if_index", _part(parts, 0).try_cast("bigint"))
    found = found.withColumn("mac_address", net.mac_from_bytes(F.col("value_bytes")))
    valid = F.col("if_index").isNotNull() & (F.col("if_index") >= 0) & net.is_ipv4(F.col("ip_address"))
    return found.where(valid & net.is_unicast_mac(F.col("mac_address"))).select(
        *POLL, F.lit("arp").alias("entry_type"), "pdu_no", "if_index", "mac_address", "ip_address", "_column"
    )


def _media_ip(parts: Column) -> Column:
    """Of an index ifIndex.a.b.c.d."""
    return F.when(F.size(parts) == 5, F.concat_ws(".", F.slice(parts, 2, 4)))


def _physical_ip(parts: Column) -> Column:
    """Of an index ifIndex.1[.4].a.b.c.d; other address types are skipped."""
    ipv4 = _part(parts, 1) == "1"
    with_length = ipv4 & (F.size(parts) == 7) & (_part(parts, 2) == "4")
    bare = ipv4 & (F.size(parts) == 6)
    return F.when(with_length, F.concat_ws(".", F.slice(parts, 4, 4))).when(bare, F.concat_ws(".", F.slice(parts, 3, 4)))


def arp_table(pdus: DataFrame) -> DataFrame:
    """The older table, and the newer one only for polls where the older gave no usable row; both from one scan."""
    rows = snmp.cells(pdus, {"media": oids.ARP_MEDIA, "physical": oids.ARP_PHYSICAL})
    parts, older = _parts(F.col("_suffix")), F.col("_column") == "media"
    found = _arp(rows, F.when(older, _media_ip(parts)).otherwise(_physical_ip(parts)))
    return lookups.with_preferred(found, older, keys=POLL).drop("_column")


def fdb_mac(suffix: Column, *, with_vlan: bool) -> tuple[Column, Column]:
    """(MAC, VLAN) from a forwarding-table index, null where the index has another shape."""
    parts = _parts(suffix)
    octets = F.slice(parts, 2, 6) if with_vlan else parts
    numbers = F.transform(octets, lambda p: p.try_cast("int"))
    shaped = (F.size(parts) == (7 if with_vlan else 6)) & F.forall(
        numbers, lambda n: F.coalesce(n.between(0, 255), F.lit(False))
    )
    digits = F.array_join(F.transform(numbers, lambda n: F.lpad(net.hex_digits(n), 2, "0")), ":")
    vlan = _part(parts, 0).try_cast("int") if with_vlan else F.lit(0)
    return F.when(shaped & vlan.isNotNull(), digits), vlan


def fdb_table(pdus: DataFrame) -> DataFrame:
    """VLAN-aware rows, and legacy bridge rows only for polls where those gave nothing usable.

    Both forwarding tables and the map of bridge ports to interfaces come from one scan and one shuffle by poll: ports are
    pivoted with their status (missing = learned), then every entry takes the interface that its poll maps its port to.
    """
    columns = {
        "aware.port": oids.QBRIDGE_FDB_PORT, "aware.status": oids.QBRIDGE_FDB_STATUS, "legacy.port": oids.BRIDGE_FDB_PORT,
        "legacy.status": oids.BRIDGE_FDB_STATUS, "map.port": oids.BRIDGE_PORT_IF_INDEX,
    }
    found = snmp.cells(pdus, columns).select(
        *POLL, "pdu_no", "value", F.split_part("_column", F.lit("."), F.lit(1)).alias("_table"), F.col("_column").endswith(".port").alias("_is_port"),
        F.when(F.col("_column") == "map.port", snmp.oid_index(F.col("oid")).cast("string")).otherwise(F.col("_suffix")).alias("_suffix"),
    )
    is_port, is_map = F.col("_is_port"), F.col("_table") == "map"
    rows = found.where("_suffix is not null").repartition(*POLL).groupBy(*POLL, "_table", "_suffix").agg(
        snmp.number(F.max_by("value", F.when(is_port, F.col("pdu_no")))).alias("_main"),
        snmp.number(F.max_by("value", F.when(~is_port, F.col("pdu_no")))).alias("status"),
        F.max(F.when(is_port, F.col("pdu_no"))).alias("pdu_no"),
    )
    placed = rows.withColumn("port", F.when(is_map, F.col("_suffix").try_cast("bigint")).otherwise(F.col("_main")))
    mapped = placed.withColumn("if_index", F.max(F.when(is_map, F.col("_main"))).over(Window.partitionBy(*POLL, "port")))
    learned = mapped.where(~is_map & (F.col("port") > 0) & (F.col("if_index") > 0) & (F.coalesce("status", F.lit(FDB_LEARNED)) == FDB_LEARNED))
    aware = F.col("_table") == "aware"
    (mac, vlan), (legacy_mac, legacy_vlan) = (fdb_mac(F.col("_suffix"), with_vlan=with_vlan) for with_vlan in (True, False))
    entries = learned.withColumns({"mac_address": F.when(aware, mac).otherwise(legacy_mac), "vlan_id": F.when(aware, vlan).otherwise(legacy_vlan)})
    usable = entries.where(net.is_unicast_mac(F.col("mac_address")))
    return lookups.with_preferred(usable, aware, keys=POLL).select(
        *POLL, F.lit("fdb").alias("entry_type"), "pdu_no", "if_index", "mac_address", "vlan_id"
    )


def lldp_local_ports(pdus: DataFrame) -> DataFrame:
    """Local port number -> name: the description, else the id."""
    ports = snmp.pivot(pdus, oids.LLDP_LOCAL)
    name = F.coalesce(F.nullif(snmp.printable(F.col("port_desc")), F.lit("")), snmp.printable(F.col("port_id")))
    return ports.select(*POLL, F.col("idx").alias("local_if_index"), name.alias("local_port_name"))


def lldp_neighbors(pdus: DataFrame) -> DataFrame:
    """Index timeMark.port.remote. Rows without chassis id and system name identify nobody and are dropped."""
    found = snmp.cells(pdus, oids.LLDP_REMOTE)
    parts = _parts(F.col("_suffix"))
    rows = found.where(F.size(parts) == 3).withColumn("local_if_index", _part(parts, 1).try_cast("bigint"))

    def latest(column: str, value: str) -> Column:
        return F.max_by(value, F.when(F.col("_column") == column, F.col("pdu_no")))

    wide = rows.where("local_if_index is not null").groupBy(*POLL, "_suffix", "local_if_index").agg(
        *[latest(c, "value").alias(c) for c in oids.LLDP_REMOTE],
        latest("chassis", "value_bytes").alias("chassis_bytes"),
        latest("port", "value_bytes").alias("port_bytes"),
    )
    c = F.col
    chassis = snmp.printable_or_mac(c("chassis"), c("chassis_bytes"), snmp.number(c("chassis_subtype")), CHASSIS_IS_MAC)
    port = snmp.printable_or_mac(c("port"), c("port_bytes"), snmp.number(c("port_subtype")), PORT_IS_MAC)
    named = wide.select(
        *POLL,
        F.lit("lldp").alias("protocol"),
        "local_if_index",
        chassis.alias("remote_chassis_id"),
        port.alias("remote_port_id"),
        snmp.printable(c("port_desc")).alias("remote_port_desc"),
        snmp.printable(c("sys_name")).alias("remote_sys_name"),
        snmp.printable(c("sys_desc")).alias("remote_sys_desc"),
    ).where("remote_chassis_id <> '' or remote_sys_name <> ''")
    return named.join(lldp_local_ports(pdus), [*POLL, "local_if_index"], "left").withColumn(
        "local_port_name", F.coalesce("local_port_name", F.lit(""))
    )


def cdp_neighbors(pdus: DataFrame) -> DataFrame:
    """Index ifIndex.device. Rows without a device id are dropped; only 4-byte addresses are used."""
    found = snmp.cells(pdus, oids.CDP_CACHE)
    parts = _parts(F.col("_suffix"))
    rows = found.where(F.size(parts) == 2).withColumn("local_if_index", _part(parts, 0).try_cast("bigint"))
    address = F.when(F.length("value_bytes") == 4, F.col("value_bytes"))
    wide = rows.where("local_if_index is not null").groupBy(*POLL, "_suffix", "local_if_index").agg(
        *[F.max_by("value", F.when(F.col("_column") == c, F.col("pdu_no"))).alias(c) for c in ("device", "port", "platform")],
        F.max_by(address, F.when((F.col("_column") == "address") & address.isNotNull(), F.col("pdu_no"))).alias("address"),
    )
    device = snmp.printable(F.col("device"))
    return wide.withColumn("remote_chassis_id", device).where("remote_chassis_id <> ''").select(
        *POLL,
        F.lit("cdp").alias("protocol"),
        "local_if_index",
        "remote_chassis_id",
        snmp.printable(F.col("port")).alias("remote_port_id"),
        F.col("remote_chassis_id").alias("remote_sys_name"),
        snmp.printable(F.col("platform")).alias("remote_sys_desc"),
        F.coalesce(net.ipv4_from_bytes(F.col("address")), F.lit("")).alias("remote_mgmt_addr"),
    )
