"""SNMP tables: cells made from the star schema's columns, one PDU each, and pivoted back."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftnet.bindings.registry import query, spread, table
from siftnet.bindings.scalars import ip_expr, ip_sql
from siftnet.operators import lookups, oids, snmp, topology, traps


def pdus(rows, columns: dict[str, str], cells: dict[str, tuple[str, str]], *, index: str | None, binary=()):
    """PDU rows from wide rows with ``device_id``: cells map a column to (PDU type, SQL value); a null value makes no
    PDU. Every cell is sent twice, the first time with a wrong value, so that the last PDU must win."""
    listed = []
    for no, (name, (kind, value)) in enumerate(cells.items()):
        oid = F.lit(columns[name]) if index is None else F.concat(F.lit(columns[name] + "."), F.expr(f"cast({index} as string)"))
        raw = F.expr(value)
        for round_no, stale in ((0, True), (1, False)):
            text = F.lit("0") if stale else (F.lit(None).cast("string") if name in binary else raw.cast("string"))
            data = (F.lit(None).cast("binary") if stale or name not in binary else raw.cast("binary"))
            listed.append(
                F.struct(
                    oid.alias("oid"),
                    F.lit(kind).alias("pdu_type"),
                    F.when(raw.isNotNull(), text).alias("value"),
                    data.alias("value_bytes"),
                    F.lit(round_no * 1000 + no).alias("pdu_no"),
                    raw.isNotNull().alias("present"),
                )
            )
    exploded = rows.select("device_id", F.lit(0).cast("timestamp").alias("poll_ts"), F.inline(F.array(*listed)))
    return exploded.where("present").drop("present")


def parts(spark, sf_dir):
    return spread(table(spark, sf_dir, "part")).withColumn("device_id", F.expr("p_partkey div 16"))


def wide(df, *names):
    return df.select("device_id", *names)


INDEX = "p_partkey % 16"


@query(
    "interface_stats",
    """SELECT p_partkey // 16 AS device_id, p_partkey % 16 AS index, CASE WHEN p_size % 3 = 0 THEN 'x' || p_size ELSE p_name END AS name, 6 AS type,
  p_size * 1000 AS speed, CASE p_size % 3 WHEN 0 THEN 'up' WHEN 1 THEN 'down' ELSE 'unknown' END AS status, CASE WHEN p_size % 2 = 0 THEN 'up' ELSE 'down' END AS admin_status,
  CASE WHEN p_size % 4 = 0 THEN p_partkey * 1000000 ELSE p_partkey END AS in_bytes, p_partkey + 1 AS in_packets, p_partkey + 2 AS out_bytes,
  CASE WHEN p_size % 3 = 1 THEN p_brand ELSE '' END AS alias, upper(regexp_replace(lpad(printf('%x', p_partkey + 16777216), 12, '0'), '(..)(..)(..)(..)(..)(..)', '\\1:\\2:\\3:\\4:\\5:\\6')) AS mac_address,
  'ethernet' AS type_name, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size END AS high_speed, p_size AS vlan_id FROM part""",
)
def interface_stats(spark, sf_dir):
    cells = {
        "descr": ("OctetString", "p_name"), "type": ("Integer", "6"), "speed": ("Gauge32", "p_size * 1000"),
        "oper": ("Integer", "p_size % 3 + 1"), "admin": ("Integer", "p_size % 2 + 1"),
        "mac": ("OctetString", "unhex(lpad(hex(p_partkey + 16777216), 12, '0'))"),
        "in_octets": ("Counter32", "p_partkey"), "in_packets": ("Counter32", "p_partkey + 1"), "out_octets": ("Counter32", "p_partkey + 2"),
        "x_name": ("OctetString", "if(p_size % 3 = 0, concat('x', p_size), '')"), "alias": ("OctetString", "if(p_size % 3 = 1, p_brand, null)"),
        "hc_in": ("Counter64", "if(p_size % 4 = 0, p_partkey * 1000000, null)"), "high_speed": ("Gauge32", "if(p_size % 5 = 0, null, p_size)"),
        "vlan": ("Gauge32", "p_size"),
    }
    rows = pdus(parts(spark, sf_dir), oids.INTERFACE | oids.INTERFACE_X, cells, index=INDEX, binary=("mac",))
    stray = rows.where("oid like '%.31.1.1.1.15.%'").withColumn("oid", F.concat("oid", F.lit("77")))
    return snmp.interface_stats(rows.unionByName(stray)).select(
        "device_id", "index", "name", "type", "speed", "status", "admin_status", "in_bytes", "in_packets", "out_bytes", "alias",
        "mac_address", "type_name", "high_speed", "vlan_id",
    )


@query(
    "interface_addresses",
    f"""SELECT p_partkey // 16 AS device_id, {ip_sql('p_partkey')} AS ip_address, CASE WHEN p_size % 2 = 0 THEN p_size END AS if_index, '255.255.255.0' AS net_mask FROM part""",
)
def interface_addresses(spark, sf_dir):
    rows = parts(spark, sf_dir)
    cells = {"if_index": ("Integer", "if(p_size % 2 = 0, p_size, null)"), "net_mask": ("IPAddress", "'255.255.255.0'")}
    loopback = pdus(rows, oids.ADDRESS, {"net_mask": ("IPAddress", "'255.0.0.0'")}, index="'127.0.0.1'")
    text_index = pdus(rows, oids.ADDRESS, {"if_index": ("OctetString", "if(p_size % 2 = 1, '9', null)")}, index=ip_expr("p_partkey"))
    found = pdus(rows, oids.ADDRESS, cells, index=ip_expr("p_partkey")).unionByName(loopback).unionByName(text_index)
    return snmp.interface_addresses(found).drop("poll_ts")


_SELECTORS = {
    "src_begin": ("IPAddress", ip_expr("p_partkey * 256")),
    "src_end": ("IPAddress", f"if(p_size % 2 = 0, {ip_expr('p_partkey * 256')}, {ip_expr('p_partkey * 256 + 255')})"),
    "dst_begin": ("IPAddress", f"if(p_size % 3 = 0, null, {ip_expr('p_partkey')})"),
}


@query(
    "site_tunnels",
    f"""SELECT p_partkey // 16 AS device_id, p_name AS tunnel_name, 'p1-' || p_size AS phase1_name, CASE WHEN p_size % 3 = 2 THEN 'up' ELSE 'down' END AS status,
  CASE WHEN p_size % 3 = 2 THEN 'active' ELSE 'inactive' END AS state, p_partkey AS bytes_in, p_partkey * 2 AS bytes_out, p_size AS tunnel_uptime,
  {ip_sql('p_partkey * 256')} || CASE WHEN p_size % 2 = 0 THEN '' ELSE ' - ' || {ip_sql('p_partkey * 256 + 255')} END AS local_subnet,
  CASE WHEN p_size % 3 = 0 THEN '' ELSE {ip_sql('p_partkey')} END AS remote_subnet FROM part""",
)
def site_tunnels(spark, sf_dir):
    cells = {
        "phase1_name": ("OctetString", "concat('p1-', p_size)"), "tunnel_name": ("OctetString", "p_name"), **_SELECTORS,
        "bytes_in": ("Counter64", "p_partkey"), "bytes_out": ("Counter64", "p_partkey * 2"), "status": ("Integer", "p_size % 3"),
        "uptime": ("Counter64", "p_size"),
    }
    rows = snmp.site_tunnels(pdus(parts(spark, sf_dir), oids.SITE_TUNNEL, cells, index=INDEX))
    return rows.select("device_id", "tunnel_name", "phase1_name", "status", "state", "bytes_in", "bytes_out", "tunnel_uptime", "local_subnet", "remote_subnet")


@query(
    "dialup_tunnels",
    f"""SELECT p_partkey // 16 AS device_id, 'dialup-' || CASE WHEN p_size % 4 = 0 THEN 'unknown' ELSE {ip_sql('p_partkey')} END AS tunnel_name, p_size AS tunnel_uptime,
  {ip_sql('p_partkey * 256')} || CASE WHEN p_size % 2 = 0 THEN '/32' ELSE '/24' END AS local_subnet, CASE WHEN p_size % 3 = 0 THEN '' ELSE {ip_sql('p_partkey')} || '/32' END AS remote_subnet FROM part""",
)
def dialup_tunnels(spark, sf_dir):
    cells = {"remote_ip": ("IPAddress", f"if(p_size % 4 = 0, '', {ip_expr('p_partkey')})"), "uptime": ("Counter64", "p_size"), **_SELECTORS}
    rows = snmp.dialup_tunnels(pdus(parts(spark, sf_dir), oids.DIALUP_TUNNEL, cells, index=INDEX))
    return rows.select("device_id", "tunnel_name", "tunnel_uptime", "local_subnet", "remote_subnet")


@query(
    "ssl_sessions",
    f"SELECT p_partkey // 16 AS device_id, 'sslvpn-' || p_name AS tunnel_name, {ip_sql('p_partkey')} AS remote_ip, p_partkey AS bytes_in, p_size AS bytes_out, 'up' AS status FROM part",
)
def ssl_sessions(spark, sf_dir):
    cells = {"user": ("OctetString", "p_name"), "remote_ip": ("IPAddress", ip_expr("p_partkey")), "bytes_in": ("Counter64", "p_partkey"), "bytes_out": ("Counter64", "p_size")}
    rows = snmp.ssl_sessions(pdus(parts(spark, sf_dir), oids.SSL_SESSION, cells, index=INDEX))
    return rows.select("device_id", "tunnel_name", "remote_ip", "bytes_in", "bytes_out", "status")


@query(
    "interface_tunnels",
    """WITH n AS (SELECT *, (['wg', 'ovpns', 'tunnel.', 'eth', 'vti', 'tun'])[p_partkey % 6 + 1] || p_size AS name FROM part)
SELECT 'bsd' AS family, p_partkey // 16 AS device_id, name AS tunnel_name, CASE p_partkey % 6 WHEN 0 THEN 'wireguard' ELSE 'openvpn-server' END AS tunnel_type, CASE WHEN p_size % 2 = 1 THEN 'up' ELSE 'down' END AS status, p_partkey AS bytes_in FROM n WHERE p_partkey % 6 IN (0, 1)
UNION ALL SELECT 'linux', p_partkey // 16, name, CASE p_partkey % 6 WHEN 0 THEN 'wireguard' WHEN 4 THEN 'ipsec' ELSE 'openvpn' END, CASE WHEN p_size % 2 = 1 THEN 'up' ELSE 'down' END, p_partkey FROM n WHERE p_partkey % 6 IN (0, 4) OR p_partkey % 6 IN (2, 5) AND p_size % 3 = 1
UNION ALL SELECT 'paloalto', p_partkey // 16, name, 'ipsec', CASE WHEN p_size % 2 = 1 THEN 'up' ELSE 'down' END, p_partkey * 10 FROM n WHERE p_partkey % 6 = 2""",
)
def interface_tunnels(spark, sf_dir):
    cells = {
        "descr": ("OctetString", "concat(element_at(array('wg', 'ovpns', 'tunnel.', 'eth', 'vti', 'tun'), cast(p_partkey % 6 as int) + 1), p_size)"),
        "type": ("Integer", "if(p_size % 3 = 1, 131, 6)"), "oper": ("Integer", "2 - p_size % 2"), "in_octets": ("Counter32", "p_partkey"),
        "hc_in": ("Counter64", "p_partkey * 10"),
    }
    rows = pdus(parts(spark, sf_dir), oids.INTERFACE | oids.INTERFACE_X, cells, index=INDEX)
    result = None
    for family in ("bsd", "linux", "paloalto"):
        part = snmp.interface_tunnels(rows, family).select(F.lit(family).alias("family"), "device_id", "tunnel_name", "tunnel_type", "status", "bytes_in")
        result = part if result is None else result.unionByName(part)
    return result


@query(
    "security_associations",
    f"""SELECT p_partkey // 16 AS device_id, CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'SA-' || {ip_sql('p_partkey')} END AS tunnel_name, p_partkey AS bytes_in, p_size AS bytes_out,
  {ip_sql('p_partkey * 256')} || CASE WHEN p_size % 2 = 0 THEN '/32' ELSE '-' || {ip_sql('p_partkey * 256 + 255')} END AS local_subnet FROM part""",
)
def security_associations(spark, sf_dir):
    cells = {
        "peer": ("IPAddress", ip_expr("p_partkey")), **_SELECTORS, "decrypted": ("Counter64", "p_partkey"), "encrypted": ("Counter64", "p_size"),
        "user": ("OctetString", "if(p_size % 2 = 0, p_name, '')"),
    }
    rows = snmp.security_associations(pdus(parts(spark, sf_dir), oids.SECURITY_ASSOCIATION, cells, index=INDEX))
    return rows.select("device_id", "tunnel_name", "bytes_in", "bytes_out", "local_subnet")


@query(
    "fortinet_sensors",
    "SELECT p_partkey // 16 AS device_id, 'Temp ' || p_partkey AS name, 'temperature' AS type, p_retailprice AS value, CASE WHEN p_size % 2 = 0 THEN 'normal' ELSE 'alarm' END AS status, '°C' AS unit FROM part",
)
def fortinet_sensors(spark, sf_dir):
    cells = {"name": ("OctetString", "concat('Temp ', p_partkey)"), "value": ("OctetString", "concat(' ', p_retailprice)"), "alarm": ("Integer", "p_size % 2")}
    return snmp.fortinet_sensors(pdus(parts(spark, sf_dir), oids.FORTINET_SENSOR, cells, index=INDEX)).drop("poll_ts")


@query(
    "entity_sensors",
    """SELECT p_partkey // 16 AS device_id, CASE WHEN p_size % 2 = 0 THEN 'Temperature Sensor ' ELSE 'Fan ' END || (p_partkey % 16) AS name,
  CASE WHEN p_size % 2 = 0 THEN 'temperature' ELSE 'fan' END AS type, p_partkey / 10.0::DOUBLE * CASE WHEN p_size % 3 = 0 THEN 1000 ELSE 1 END AS value, 'normal' AS status,
  CASE WHEN p_size % 2 = 0 THEN '°C' ELSE 'RPM' END AS unit FROM part WHERE p_size % 5 NOT IN (2, 3) AND p_size % 7 <> 0""",
)
def entity_sensors(spark, sf_dir):
    cells = {
        "sensor_type": ("Integer", "if(p_size % 7 = 0, 99, if(p_size % 2 = 0, 8, 10))"), "scale": ("Integer", "if(p_size % 3 = 0, 10, null)"),
        "precision": ("Integer", "1"), "value": ("Integer", "p_partkey"), "status": ("Integer", "p_size % 5"),
    }
    return snmp.entity_sensors(pdus(parts(spark, sf_dir), oids.ENTITY_SENSOR, cells, index=INDEX)).drop("poll_ts")


@query(
    "named_sensors",
    """SELECT 'sonicwall' AS family, p_partkey // 16 AS device_id, 'CPU Fan' AS name, 'fan' AS type, CAST(p_partkey AS DOUBLE) AS value, 'rpm' AS unit FROM part WHERE p_size % 2 = 0
UNION ALL SELECT 'lm', p_partkey // 16, p_name, 'temperature', p_partkey / 1000.0::DOUBLE, '°C' FROM part UNION ALL SELECT 'lm', p_partkey // 16, p_brand, 'fan', CAST(p_size AS DOUBLE), 'RPM' FROM part""",
)
def named_sensors(spark, sf_dir):
    rows = parts(spark, sf_dir)
    sonicwall = {"name": ("OctetString", "if(p_size % 2 = 0, 'CPU Fan', '')"), "value": ("Integer", "p_partkey"), "unit": ("OctetString", "'rpm'")}
    lm = {"temp_name": ("OctetString", "p_name"), "temp_value": ("Gauge32", "p_partkey"), "fan_name": ("OctetString", "p_brand"), "fan_value": ("Gauge32", "p_size")}
    a = snmp.sonicwall_sensors(pdus(rows, oids.SONICWALL_SENSOR, sonicwall, index=INDEX)).withColumn("family", F.lit("sonicwall"))
    b = snmp.lm_sensors(pdus(rows, oids.LM_SENSOR, lm, index=INDEX)).withColumn("family", F.lit("lm"))
    return a.unionByName(b).select("family", "device_id", "name", "type", "value", "unit")


@query(
    "processor_loads",
    """SELECT 'hr' AS source, p_partkey // 16 AS device_id, p_partkey % 16 AS index, CAST(p_size AS DOUBLE) AS usage FROM part
UNION ALL SELECT 'preferred', p_partkey // 16, p_partkey % 16, CAST(CASE WHEN p_size % 2 = 0 THEN p_size ELSE p_partkey END AS DOUBLE) FROM part""",
)
def processor_loads(spark, sf_dir):
    rows = parts(spark, sf_dir)
    hr = snmp.processors(pdus(rows, {"load": oids.HR_PROCESSOR_LOAD}, {"load": ("Integer", "p_size")}, index=INDEX))
    columns = {"one": oids.CISCO_CPU_1MIN, "five": oids.CISCO_CPU_5MIN}
    cisco = snmp.cisco_processors(pdus(rows, columns, {"one": ("Gauge32", "if(p_size % 2 = 0, p_size, null)"), "five": ("Gauge32", "p_partkey")}, index=INDEX))
    return hr.withColumn("source", F.lit("hr")).unionByName(cisco.withColumn("source", F.lit("preferred"))).drop("poll_ts")


def customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").withColumn("device_id", F.col("c_custkey"))


@query(
    "fortinet_ha_members",
    """SELECT c_custkey AS device_id, CASE WHEN c_nationkey % 5 = 4 THEN '' WHEN c_nationkey % 4 = 2 THEN 'activeActive' ELSE 'activePassive' END AS system_mode,
  CASE WHEN c_nationkey % 5 <> 4 THEN c_nationkey END AS group_id, CASE WHEN c_nationkey % 5 <> 4 THEN c_mktsegment END AS group_name,
  i AS member_index, c_name || i AS member_serial, CAST(c_nationkey AS DOUBLE) AS cpu_usage, CASE WHEN c_nationkey % 3 = 1 THEN 'in-sync' ELSE 'out-of-sync' END AS sync_status
FROM customer, (SELECT unnest([1, 2]) AS i) WHERE c_nationkey % 5 = 4 OR c_nationkey % 4 IN (2, 3)""",
)
def fortinet_ha_members(spark, sf_dir):
    rows = customers(spark, sf_dir)
    # a fifth of the polls lacks the cluster scalars
    cluster = pdus(rows.where("c_nationkey % 5 <> 4"), oids.FORTINET_HA, {"mode": ("Integer", "c_nationkey % 4"), "group_id": ("Integer", "c_nationkey"), "group_name": ("OctetString", "c_mktsegment")}, index=None)
    for i in (1, 2):
        cells = {"member_serial": ("OctetString", f"concat(c_name, '{i}')"), "cpu_usage": ("Gauge32", "c_nationkey"), "sync": ("Integer", "c_nationkey % 3")}
        cluster = cluster.unionByName(pdus(rows, oids.FORTINET_HA_MEMBER, cells, index=str(i)))
    return snmp.fortinet_ha(cluster).select("device_id", "system_mode", "group_id", "group_name", "member_index", "member_serial", "cpu_usage", "sync_status")


@query(
    "failover_pairs",
    """SELECT 'paloalto' AS vendor, c_custkey AS device_id, 'active-passive' AS system_mode, 0 AS member_index, 'active' AS member_hostname, CASE c_nationkey % 3 WHEN 0 THEN 'in-sync' ELSE 'out-of-sync' END AS sync_status FROM customer WHERE c_nationkey % 2 = 0
UNION ALL SELECT 'cisco', c_custkey, 'failover', i, 'unit' || i, CASE c_nationkey WHEN 9 THEN 'active' WHEN 10 THEN 'standby' WHEN 1 THEN 'other' WHEN 2 THEN 'up' WHEN 3 THEN 'down' WHEN 4 THEN 'error' WHEN 5 THEN 'overTemp' WHEN 6 THEN 'busy' WHEN 7 THEN 'noMedia' WHEN 8 THEN 'backup' ELSE 'unknown' END
  || CASE WHEN i = 1 THEN ' (' || c_mktsegment || ')' ELSE '' END FROM customer, (SELECT unnest([1, 2]) AS i)""",
)
def failover_pairs(spark, sf_dir):
    rows = customers(spark, sf_dir)
    palo = {"state": ("OctetString", "'active'"), "peer": ("OctetString", "case c_nationkey % 3 when 0 then 'passive' when 1 then 'suspended' else '' end"), "mode": ("OctetString", "if(c_nationkey % 2 = 0, 'active-passive', 'disabled')"), "serial": ("OctetString", "c_name")}
    a = snmp.paloalto_ha(pdus(rows, oids.PALO_ALTO_HA, palo, index=None))
    walk = None
    for i in (1, 2):
        cells = {"info": ("OctetString", f"'unit{i}'"), "value": ("Integer", "c_nationkey"), "detail": ("OctetString", "c_mktsegment" if i == 1 else "''")}
        part = pdus(rows, oids.CISCO_FAILOVER, cells, index=str(i + 5))
        walk = part if walk is None else walk.unionByName(part)
    b = snmp.cisco_ha(walk)
    names = ["device_id", "system_mode", "member_index", "member_hostname", "sync_status"]
    return a.select(F.lit("paloalto").alias("vendor"), *names).unionByName(b.select(F.lit("cisco").alias("vendor"), *names))


@query(
    "security_counters",
    "SELECT c_custkey AS device_id, c_custkey AS av_detected, c_nationkey AS ips_critical, c_custkey * 3 AS wf_url_blocked, 0::BIGINT AS av_blocked FROM customer",
)
def security_counters(spark, sf_dir):
    cells = {"av_detected": ("Counter32", "c_custkey"), "ips_critical": ("Counter32", "c_nationkey"), "wf_url_blocked": ("Counter32", "c_custkey * 3")}
    rows = snmp.security_stats(pdus(customers(spark, sf_dir), oids.SECURITY, cells, index=None))
    return rows.select("device_id", "av_detected", "ips_critical", "wf_url_blocked", "av_blocked")


@query(
    "sdwan_health",
    """SELECT p_partkey // 16 AS device_id, p_name AS name, p_brand AS interface, CASE WHEN p_size % 2 = 0 THEN 'alive' ELSE 'dead' END AS state, p_size + 0.25::DOUBLE AS latency,
  CAST(greatest(p_size - p_partkey % 60, 0) AS DOUBLE) / p_size * 100 AS packet_loss, p_partkey % 60 > p_size AS loss_suspect FROM part""",
)
def sdwan_health(spark, sf_dir):
    cells = {
        "name": ("OctetString", "p_name"), "state": ("Integer", "p_size % 2"), "latency": ("OctetString", "concat(p_size, '.25ms')"),
        "packet_send": ("Counter64", "p_size"), "packet_recv": ("Counter64", "p_partkey % 60"), "interface": ("OctetString", "p_brand"),
    }
    rows = snmp.sdwan_health(pdus(parts(spark, sf_dir), oids.SDWAN, cells, index=INDEX))
    return rows.select("device_id", "name", "interface", "state", "latency", "packet_loss", "loss_suspect")


@query("license_info", "SELECT p_partkey // 16 AS device_id, p_type AS description, '20' || p_size AS expiry_date FROM part")
def license_info(spark, sf_dir):
    cells = {"description": ("OctetString", "p_type"), "expiry_date": ("OctetString", "concat('20', p_size)")}
    return snmp.licenses(pdus(parts(spark, sf_dir), oids.LICENSE, cells, index=INDEX)).drop("poll_ts")


@query(
    "disk_usage",
    """SELECT p_partkey // 16 AS device_id, '/m' || (p_partkey % 16 // 2) AS mount, p_partkey * 4096 AS total_bytes, least(p_size * 100, p_partkey) * 4096 AS used_bytes,
  CAST(least(p_size * 100, p_partkey) * 4096 AS DOUBLE) / (p_partkey * 4096) * 100 AS used_percent
FROM part WHERE p_partkey > 0 AND p_size % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY p_partkey // 16, p_partkey % 16 // 2 ORDER BY p_partkey) = 1""",
)
def disk_usage(spark, sf_dir):
    cells = {
        "storage_type": ("ObjectIdentifier", "concat('.1.3.6.1.2.1.25.2.1.', if(p_size % 3 = 0, '2', '4'))"), "mount": ("OctetString", "concat('/m', p_partkey % 16 div 2)"),
        "units": ("Integer", "4096"), "size": ("Integer", "p_partkey"), "used": ("Integer", "p_size * 100"),
    }
    return snmp.disk_usage(pdus(parts(spark, sf_dir), oids.STORAGE, cells, index=INDEX)).drop("poll_ts")


@query(
    "load_average",
    "SELECT c_custkey AS device_id, c_acctbal AS load1, 0.5::DOUBLE AS load5, CASE WHEN c_nationkey % 2 = 0 THEN 1.25 ELSE 0 END::DOUBLE AS load15 FROM customer",
)
def load_average(spark, sf_dir):
    rows = customers(spark, sf_dir)
    walk = None
    for i, value in ((1, "c_acctbal"), (2, "'0.50'"), (3, "if(c_nationkey % 2 = 0, '1.25', null)")):
        part = pdus(rows, {"load": oids.LOAD}, {"load": ("OctetString", value)}, index=str(i))
        walk = part if walk is None else walk.unionByName(part)
    return snmp.load_average(walk).drop("poll_ts")


@query(
    "fortinet_system",
    "SELECT c_custkey AS device_id, c_name AS hostname, 'v' || c_nationkey AS version, CAST(c_nationkey AS DOUBLE) AS cpu_usage, CASE WHEN c_nationkey % 5 = 0 THEN 0 ELSE CAST(c_nationkey AS DOUBLE) / (c_nationkey % 5) * 100 END AS disk_usage, c_nationkey % 5 AS disk_total, c_custkey AS session_count FROM customer",
)
def fortinet_system(spark, sf_dir):
    cells = {
        "hostname": ("OctetString", "c_name"), "version": ("OctetString", "concat('v', c_nationkey)"), "cpu": ("Gauge32", "c_nationkey"), "disk": ("Gauge32", "c_nationkey"),
        "disk_total": ("Gauge32", "c_nationkey % 5"), "session_count": ("Gauge32", "c_custkey"),
    }
    rows = snmp.fortinet_system(pdus(customers(spark, sf_dir), oids.FORTINET_SYSTEM, cells, index=None))
    return rows.select("device_id", "hostname", "version", "cpu_usage", "disk_usage", "disk_total", "session_count")


@query(
    "ucd_system",
    """SELECT c_custkey AS device_id, 'pfSense 2.' || c_nationkey AS version, c_custkey AS uptime, CAST(c_nationkey + 3 AS DOUBLE) / (c_nationkey + 10) * 100 AS cpu_usage,
  (c_custkey + 2000) // 1024 AS memory_total, CASE WHEN c_custkey + 2000 - 100 * c_nationkey - 900 < 0 THEN c_custkey + 2000 - 100 * c_nationkey ELSE c_custkey + 2000 - 100 * c_nationkey - 900 END::DOUBLE / (c_custkey + 2000) * 100 AS memory_usage, 5 AS session_count FROM customer""",
)
def ucd_system(spark, sf_dir):
    cells = {
        "descr": ("OctetString", "concat('pfSense 2.', c_nationkey, ' x')"), "ticks": ("TimeTicks", "c_custkey * 100 + 7"), "cpu_user": ("Integer", "c_nationkey"), "cpu_system": ("Integer", "3"),
        "cpu_idle": ("Integer", "7"), "mem_total": ("Integer", "c_custkey + 2000"), "mem_avail": ("Integer", "100 * c_nationkey"), "mem_buffer": ("Integer", "400"), "mem_cached": ("Integer", "500"), "session_count": ("Gauge32", "5"),
    }
    rows = snmp.ucd_system(pdus(customers(spark, sf_dir), oids.UCD_SYSTEM, cells, index=None), "pfsense")
    return rows.select("device_id", "version", "uptime", "cpu_usage", "memory_total", "memory_usage", "session_count")


@query(
    "fleet_system_status",
    """SELECT c_custkey AS device_id, CASE c_nationkey % 3 WHEN 0 THEN 'PAN-OS 11' WHEN 1 THEN 'ASA 9.' || c_nationkey ELSE 'plain box' END AS version, c_custkey AS uptime,
  CASE c_nationkey % 3 WHEN 1 THEN CAST(c_custkey AS DOUBLE) / (c_custkey + 1048576 * 10) * 100 END AS memory_usage FROM customer""",
)
def fleet_system_status(spark, sf_dir):
    rows = customers(spark, sf_dir)
    ticks = ("TimeTicks", "c_custkey * 100")
    palo = pdus(rows.where("c_nationkey % 3 = 0"), oids.PALO_ALTO_SYSTEM, {"ticks": ticks, "sw_version": ("OctetString", "'11'")}, index=None).withColumn("vendor", F.lit("paloalto"))
    cisco = pdus(rows.where("c_nationkey % 3 = 1"), oids.CISCO_SYSTEM, {"ticks": ticks, "descr": ("OctetString", "concat('Cisco ASA Version 9.', c_nationkey, ' ')"), "mem_used": ("Gauge32", "c_custkey"), "mem_free": ("Gauge32", "1048576 * 10")}, index=None).withColumn("vendor", F.lit("cisco_asa"))
    other = pdus(rows.where("c_nationkey % 3 = 2"), oids.GENERIC_SYSTEM, {"ticks": ticks, "descr": ("OctetString", "' plain box '")}, index=None).withColumn("vendor", F.lit("homemade"))
    return snmp.vendor_table(palo.unionByName(cisco).unionByName(other), "system_status").select("device_id", "version", "uptime", "memory_usage")


# ---------------------------------------------------------------------------------------------------------- topology

_MAC_SQL = "regexp_replace(lpad(printf('%x', p_partkey + 16777216), 12, '0'), '(..)(..)(..)(..)(..)(..)', '\\1:\\2:\\3:\\4:\\5:\\6')"
_MAC = "unhex(lpad(hex(p_partkey + 16777216), 12, '0'))"


@query(
    "arp_table",
    f"""SELECT p_partkey // 16 AS device_id, p_partkey % 16 AS if_index, {_MAC_SQL} AS mac_address, {ip_sql('p_partkey')} AS ip_address FROM part""",
)
def arp_table(spark, sf_dir):
    rows = parts(spark, sf_dir)
    old = pdus(rows.where("device_id % 2 = 0"), {"m": oids.ARP_MEDIA}, {"m": ("OctetString", _MAC)}, index=f"concat(p_partkey % 16, '.', {ip_expr('p_partkey')})", binary=("m",))
    shape = f"concat(p_partkey % 16, if(p_size % 2 = 0, '.1.4.', '.1.'), {ip_expr('p_partkey')})"
    new = pdus(rows, {"m": oids.ARP_PHYSICAL}, {"m": ("OctetString", _MAC)}, index=shape, binary=("m",))
    return topology.arp_table(old.unionByName(new)).select("device_id", "if_index", "mac_address", "ip_address")


def forwarding(spark, sf_dir):
    rows = parts(spark, sf_dir)
    octets = "concat('0.0.1.', p_partkey div 65536 % 256, '.', p_partkey div 256 % 256, '.', p_partkey % 256)"
    walk = pdus(rows, {"i": oids.BRIDGE_PORT_IF_INDEX}, {"i": ("Integer", "if(p_partkey % 16 = 5, 0, p_partkey % 16 + 100)")}, index=INDEX)
    aware = {"p": oids.QBRIDGE_FDB_PORT, "s": oids.QBRIDGE_FDB_STATUS}
    legacy = {"p": oids.BRIDGE_FDB_PORT, "s": oids.BRIDGE_FDB_STATUS}
    port, status = ("Integer", "p_partkey % 16"), ("Integer", "if(p_size % 3 = 0, null, if(p_size % 3 = 1, 3, 4))")
    walk = walk.unionByName(pdus(rows.where("device_id % 2 = 0"), aware, {"p": port, "s": status}, index=f"concat(p_size, '.', {octets})"))
    return walk.unionByName(pdus(rows, legacy, {"p": port, "s": status}, index=octets))


@query(
    "fdb_table",
    f"""SELECT p_partkey // 16 AS device_id, p_partkey % 16 + 100 AS if_index, '00:00:01' || substr({_MAC_SQL}, 9) AS mac_address, CASE WHEN p_partkey // 16 % 2 = 0 THEN p_size ELSE 0 END AS vlan_id
FROM part WHERE p_partkey % 16 NOT IN (0, 5) AND p_size % 3 <> 2""",
)
def fdb_table(spark, sf_dir):
    return topology.fdb_table(forwarding(spark, sf_dir)).select("device_id", "if_index", "mac_address", "vlan_id")


@query(
    "lldp_neighbors",
    f"""SELECT p_partkey // 16 AS device_id, p_partkey % 16 AS local_if_index, CASE WHEN p_size % 2 = 0 THEN {_MAC_SQL} ELSE p_name END AS remote_chassis_id, p_brand AS remote_port_id, p_type AS remote_sys_name,
  CASE WHEN p_size % 4 = 0 THEN 'port' || (p_partkey % 16) ELSE 'id' || (p_partkey % 16) END AS local_port_name FROM part""",
)
def lldp_neighbors(spark, sf_dir):
    rows = parts(spark, sf_dir)
    index = "concat('0.', p_partkey % 16, '.1')"
    remote = {"chassis_subtype": ("Integer", "if(p_size % 2 = 0, 4, 7)"), "port_subtype": ("Integer", "5"), "port": ("OctetString", "concat(p_brand, chr(7))"), "sys_name": ("OctetString", "p_type")}
    named = pdus(rows, oids.LLDP_REMOTE, remote, index=index)
    chassis = pdus(rows.where("p_size % 2 = 0"), oids.LLDP_REMOTE, {"chassis": ("OctetString", _MAC)}, index=index, binary=("chassis",))
    text = pdus(rows.where("p_size % 2 = 1"), oids.LLDP_REMOTE, {"chassis": ("OctetString", "p_name")}, index=index)
    local = pdus(rows, oids.LLDP_LOCAL, {"port_id": ("OctetString", "concat('id', p_partkey % 16)"), "port_desc": ("OctetString", "if(p_size % 4 = 0, concat('port', p_partkey % 16), '')")}, index=INDEX)
    walk = named.unionByName(chassis).unionByName(text).unionByName(local)
    return topology.lldp_neighbors(walk).select("device_id", "local_if_index", "remote_chassis_id", "remote_port_id", "remote_sys_name", "local_port_name")


@query(
    "cdp_neighbors",
    f"""SELECT p_partkey // 16 AS device_id, p_partkey % 16 AS local_if_index, p_name AS remote_chassis_id, p_brand AS remote_port_id, {ip_sql('p_partkey')} AS remote_mgmt_addr FROM part WHERE p_size % 3 <> 0""",
)
def cdp_neighbors(spark, sf_dir):
    rows = parts(spark, sf_dir)
    index = "concat(p_partkey % 16, '.1')"
    walk = pdus(rows, oids.CDP_CACHE, {"device": ("OctetString", "if(p_size % 3 = 0, '', p_name)"), "port": ("OctetString", "p_brand")}, index=index)
    address = pdus(rows, oids.CDP_CACHE, {"address": ("OctetString", "unhex(lpad(hex(167772160 + p_partkey), 8, '0'))")}, index=index, binary=("address",))
    return topology.cdp_neighbors(walk.unionByName(address)).select("device_id", "local_if_index", "remote_chassis_id", "remote_port_id", "remote_mgmt_addr")


# ------------------------------------------------------------------------------------------------- joins and fallbacks


@query(
    "tunnel_phase1_join",
    """WITH p1 AS (SELECT s_nationkey, arg_max(s_acctbal, s_suppkey) AS bal, arg_max(s_name, s_suppkey) AS nm FROM supplier GROUP BY 1)
SELECT c_custkey AS device_id, c_name AS tunnel_name, CASE WHEN bal > 5000 THEN 'peer ' || nm ELSE 'own' END AS remote_ip, CASE WHEN bal IS NULL THEN 'unknown' WHEN bal > 0 THEN 'up' ELSE 'unknown' END AS status
FROM customer LEFT JOIN p1 ON s_nationkey = c_nationkey""",
)
def tunnel_phase1_join(spark, sf_dir):
    phase1 = table(spark, sf_dir, "supplier").select(
        F.lit(1).alias("device_id"), F.col("s_nationkey").cast("string").alias("name"), F.col("s_suppkey").alias("line_no"),
        F.expr("if(s_acctbal > 5000, concat('peer ', s_name), '')").alias("remote_ip"), F.expr("if(s_acctbal > 0, 'up', '')").alias("status"),
        F.lit("wan").alias("interface_name"), F.lit("").alias("mode"),
    )
    phase2 = table(spark, sf_dir, "customer").select(
        F.lit(1).alias("device_id"), F.col("c_nationkey").cast("string").alias("phase1_name"), F.lit("own").alias("remote_ip"), F.col("c_name").alias("tunnel_name"), "c_custkey"
    )
    return lookups.tunnels_with_phase1(phase2, phase1).select(F.col("c_custkey").alias("device_id"), "tunnel_name", "remote_ip", "status")


@query(
    "fallback_rows",
    """SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'P' UNION ALL
SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""",
)
def fallback_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return lookups.with_fallback(orders.where("o_orderstatus = 'P'"), orders.where("o_orderstatus = 'F'"), keys=["o_custkey"]).drop("o_orderstatus")


@query(
    "secondary_supplement",
    """WITH l AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS st, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1)
SELECT c_custkey AS device_id FROM customer JOIN l ON o_custkey = c_custkey WHERE st <> 'F' AND floor(price / 100000) = 0""",
)
def secondary_supplement(spark, sf_dir):
    cycles = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("device_id"), F.col("o_orderkey").alias("cycle"), (F.col("o_orderstatus") != "F").alias("ok_arp"), F.floor(F.col("o_totalprice") / 100000).alias("rows_arp")
    )
    secondary = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("device_id"))
    return lookups.supplement(secondary, cycles, table="arp")


# ------------------------------------------------------------------------------------------------------------- traps

_TRAP_CASES = "case o_orderkey % 5 when 0 then '.1.3.6.1.4.1.12356.101.2.0.301' when 1 then '.1.3.6.1.4.1.8741.1.1.2.0.4' else '.1.3.6.1.4.1.9999.1' end"


@query(
    "trap_events",
    """WITH t AS (
  SELECT o_orderkey, o_orderkey % 5 AS c, o_custkey, '192.0.2.' || (o_custkey % 256) AS ip FROM orders)
SELECT o_orderkey AS trap_no, CASE c WHEN 0 THEN '.1.3.6.1.4.1.12356.101.2.0.301' WHEN 1 THEN '.1.3.6.1.4.1.8741.1.1.2.0.4' WHEN 2 THEN '.1.3.6.1.4.1.9999.1' ELSE '.1.3.6.1.4.1.25461.2.1.3.2.0.4' END AS trap_oid,
  CASE c WHEN 0 THEN 'VPN_TUNNEL_UP' WHEN 1 THEN 'ipsec-tunnel' WHEN 2 THEN 'GENERIC' ELSE 'threat-detected' END AS trap_type,
  CASE c WHEN 0 THEN 'info' WHEN 1 THEN 'warning' WHEN 2 THEN 'info' ELSE 'critical' END AS severity,
  CASE c WHEN 0 THEN 'VPN_TUNNEL_UP' WHEN 1 THEN 'ipsec-tunnel' WHEN 2 THEN 'GENERIC' ELSE 'threat-detected' END || '; ' || o_custkey || CASE WHEN c = 3 THEN '; hit' ELSE '' END AS message
FROM t WHERE c <> 4""",
)
def trap_events(spark, sf_dir):
    def varbind(oid: str, kind: str, value: str) -> str:
        return f"named_struct('oid', {oid}, 'type', {kind}, 'value', {value})"

    bindings = (
        f"concat(array({varbind(repr(oids.SYS_UPTIME_OID), repr('TimeTicks'), repr('5'))}, {varbind(repr('.1.2'), repr('Integer'), 'cast(o_custkey as string)')}, {varbind(repr('.1.3'), repr('Null'), repr('x'))}), "
        f"if(o_orderkey % 5 in (1, 2), array({varbind(repr(oids.SNMP_TRAP_OID), repr('ObjectIdentifier'), _TRAP_CASES)}), array()), "
        f"if(o_orderkey % 5 = 3, array({varbind(repr('.1.3.6.1.4.1.25461.2.1.3.2.0.4'), repr('OctetString'), repr('hit'))}), array()))"
    )
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("trap_no"),
        F.col("o_orderdate").cast("timestamp").alias("recv_ts"),
        F.lit("192.0.2.1").alias("src_ip"),
        F.expr("if(o_orderkey % 5 = 0, '1', '2c')").alias("version"),
        F.expr("if(o_orderkey % 5 = 0, '.1.3.6.1.4.1.12356.101.2', '')").alias("enterprise"),
        F.lit(301).alias("specific"),
        F.expr(bindings).alias("varbinds"),
    )
    return traps.classify(rows).select("trap_no", "trap_oid", "trap_type", "severity", "message")
