"""Column lists of the canonical tables, as Spark DDL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_DATAGRAMS = "recv_ts TIMESTAMP, arrival_no BIGINT, exporter STRING, payload BINARY"
RAW_LINES = "recv_ts TIMESTAMP, arrival_no BIGINT, src_ip STRING, line STRING"
RAW_PDUS = (
    "device_id BIGINT, vendor STRING, poll_ts TIMESTAMP, walk STRING, pdu_no INT, oid STRING, pdu_type STRING, "
    "value STRING, value_bytes BINARY"
)
RAW_TRAPS = (
    "recv_ts TIMESTAMP, src_ip STRING, version STRING, community STRING, enterprise STRING, specific INT, "
    "varbinds ARRAY<STRUCT<oid: STRING, type: STRING, value: STRING>>"
)
RAW_CLI = "device_id BIGINT, vendor STRING, ts TIMESTAMP, command STRING, output STRING"

_HEAD = "timestamp TIMESTAMP, device_id BIGINT, "

TABLES = {
    "flow_samples": _HEAD
    + "probe_id BIGINT, sampler_address STRING, sequence_number BIGINT, sampling_rate BIGINT, src_addr STRING, "
    "dst_addr STRING, src_port INT, dst_port INT, protocol SMALLINT, bytes BIGINT, packets BIGINT, "
    "input_if_index BIGINT, output_if_index BIGINT, tcp_flags SMALLINT, drops BIGINT, src_as BIGINT, dst_as BIGINT, "
    "as_path STRING, next_hop STRING, flow_source SMALLINT, flow_start TIMESTAMP, flow_end TIMESTAMP, "
    "firewall_event SMALLINT, flow_end_reason SMALLINT, post_nat_src_addr STRING, post_nat_dst_addr STRING, "
    "post_nat_src_port INT, post_nat_dst_port INT, icmp_type_code INT, tos SMALLINT, src_vlan INT, dst_vlan INT, "
    "app_name STRING",
    "interface_counters": _HEAD
    + "probe_id BIGINT, sampler_address STRING, if_index BIGINT, if_type BIGINT, if_speed BIGINT, "
    "if_direction BIGINT, if_status BIGINT, in_octets BIGINT, in_errors BIGINT, in_discards BIGINT, "
    "out_octets BIGINT, out_errors BIGINT, out_discards BIGINT",
    "interface_stats": _HEAD
    + "index INT, name STRING, type INT, speed BIGINT, status STRING, admin_status STRING, in_bytes BIGINT, "
    "in_packets BIGINT, in_errors BIGINT, in_discards BIGINT, out_bytes BIGINT, out_packets BIGINT, "
    "out_errors BIGINT, out_discards BIGINT, alias STRING, mtu INT, mac_address STRING, type_name STRING, "
    "high_speed BIGINT, vlan_id INT",
    "system_status": _HEAD
    + "hostname STRING, version STRING, cpu_usage DOUBLE, memory_usage DOUBLE, memory_total BIGINT, "
    "disk_usage DOUBLE, disk_total BIGINT, session_count INT, uptime BIGINT, session_rate_1 INT, "
    "session_rate_10 INT, session_rate_30 INT, session_rate_60 INT, session_count_6 INT, low_mem_usage INT, "
    "low_mem_cap INT, av_version STRING, ips_version STRING, sslvpn_users INT, sslvpn_tunnels INT, "
    "network_in_kbps DOUBLE, network_out_kbps DOUBLE, cpu_user DOUBLE, cpu_system DOUBLE, cpu_nice DOUBLE, "
    "cpu_idle DOUBLE, cpu_iowait DOUBLE, cpu_irq DOUBLE, cpu_softirq DOUBLE, memory_free BIGINT, "
    "memory_freeable BIGINT, source STRING",
    "vpn_status": _HEAD
    + "tunnel_name STRING, tunnel_type STRING, remote_ip STRING, status STRING, bytes_in BIGINT, bytes_out BIGINT, "
    "packets_in BIGINT, packets_out BIGINT, state STRING, phase1_name STRING, local_subnet STRING, "
    "remote_subnet STRING, tunnel_uptime BIGINT, interface_name STRING, mode STRING",
    "trap_events": _HEAD
    + "probe_id BIGINT, source_ip STRING, trap_oid STRING, trap_type STRING, severity STRING, message STRING",
    "ping_results": _HEAD
    + "probe_id BIGINT, target_ip STRING, success BOOLEAN, latency DOUBLE, packet_loss DOUBLE, ttl INT, "
    "error_message STRING",
    "syslog_messages": _HEAD
    + "probe_id BIGINT, hostname STRING, app_name STRING, process_id STRING, message_id STRING, "
    "structured_data STRING, message STRING, priority INT, facility INT, severity INT, source_ip STRING",
    "hardware_sensors": _HEAD + "name STRING, type STRING, value DOUBLE, status STRING, unit STRING",
    "processor_stats": _HEAD + "index INT, usage DOUBLE",
    "disk_usage": _HEAD + "mount STRING, total_bytes BIGINT, used_bytes BIGINT, used_percent DOUBLE",
    "load_average": _HEAD + "load1 DOUBLE, load5 DOUBLE, load15 DOUBLE",
    "ha_status": _HEAD
    + "system_mode STRING, group_id INT, group_name STRING, member_index INT, member_serial STRING, "
    "member_hostname STRING, cpu_usage DOUBLE, memory_usage DOUBLE, network_usage INT, session_count INT, "
    "packet_count BIGINT, byte_count BIGINT, sync_status STRING, master_serial STRING",
    "security_stats": _HEAD
    + "av_detected BIGINT, av_blocked BIGINT, av_http_detected BIGINT, av_http_blocked BIGINT, "
    "av_smtp_detected BIGINT, av_smtp_blocked BIGINT, ips_detected BIGINT, ips_blocked BIGINT, "
    "ips_critical BIGINT, ips_high BIGINT, ips_medium BIGINT, ips_low BIGINT, ips_info BIGINT, "
    "wf_http_blocked BIGINT, wf_https_blocked BIGINT, wf_url_blocked BIGINT",
    "sdwan_health": _HEAD
    + "name STRING, interface STRING, state STRING, latency DOUBLE, packet_loss DOUBLE, packet_send BIGINT, "
    "packet_recv BIGINT",
    "license_info": _HEAD + "description STRING, expiry_date STRING",
    "interface_addresses": _HEAD + "if_index INT, ip_address STRING, net_mask STRING",
    "topology_entries": _HEAD
    + "entry_type STRING, if_index INT, if_name STRING, mac_address STRING, ip_address STRING, vlan_id INT, "
    "source STRING",
    "topology_neighbors": _HEAD
    + "protocol STRING, local_if_index INT, local_port_name STRING, remote_chassis_id STRING, "
    "remote_port_id STRING, remote_port_desc STRING, remote_sys_name STRING, remote_sys_desc STRING, "
    "remote_caps STRING, remote_mgmt_addr STRING",
    "devices": "id BIGINT, name STRING, ip_address STRING, snmp_port INT, snmp_version STRING, "
    "has_community BOOLEAN, enabled BOOLEAN, vendor STRING, ssh_port INT, has_ssh_login BOOLEAN, "
    "ssh_poll_enabled BOOLEAN, ssh_poll_interval INT",
    "config_revisions": "device_id BIGINT, timestamp TIMESTAMP, checksum STRING, config_text STRING, length INT, "
    "trigger_source STRING, backup_quality STRING",
    "process_snapshots": "device_id BIGINT, timestamp TIMESTAMP, processes ARRAY<STRUCT<name: STRING, pid: INT, "
    "cpu: DOUBLE, mem: DOUBLE, command: STRING>>",
    "interface_error_snapshots": "device_id BIGINT, timestamp TIMESTAMP, interface STRING, in_errors BIGINT, "
    "in_discards BIGINT, out_errors BIGINT, out_discards BIGINT",
    "sensor_details": "device_id BIGINT, timestamp TIMESTAMP, name STRING, value DOUBLE, unit STRING, status STRING",
    "license_details": "device_id BIGINT, timestamp TIMESTAMP, description STRING, expiry_date STRING, "
    "status STRING, details STRING",
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])


def conform(rows: DataFrame, table: str) -> DataFrame:
    """Project to the canonical columns. Absent numbers and texts become 0 and '' only here; times stay null."""
    columns = []
    for field in schema(table).fields:
        value = F.col(field.name) if field.name in rows.columns else F.lit(None)
        value = value.cast(field.dataType)
        if isinstance(field.dataType, T.NumericType):
            value = F.coalesce(value, F.lit(0).cast(field.dataType))
        elif isinstance(field.dataType, T.StringType):
            value = F.coalesce(value, F.lit(""))
        columns.append(value.alias(field.name))
    return rows.select(*columns)
