"""Object identifiers by target column, and the trap table. Numbers come from the public MIBs."""

from __future__ import annotations

IF_ENTRY = ".1.3.6.1.2.1.2.2.1"
IFX_ENTRY = ".1.3.6.1.2.1.31.1.1.1"
FORTINET = ".1.3.6.1.4.1.12356.101"
PALO_ALTO = ".1.3.6.1.4.1.25461.2.1"
SONICWALL = ".1.3.6.1.4.1.8741"
CISCO = ".1.3.6.1.4.1.9.9"
UCD = ".1.3.6.1.4.1.2021"
LLDP = ".1.0.8802.1.1.2.1"

# ifTable, ifXTable and the port VLAN column.
INTERFACE = {
    "descr": f"{IF_ENTRY}.2",
    "type": f"{IF_ENTRY}.3",
    "mtu": f"{IF_ENTRY}.4",
    "speed": f"{IF_ENTRY}.5",
    "mac": f"{IF_ENTRY}.6",
    "admin": f"{IF_ENTRY}.7",
    "oper": f"{IF_ENTRY}.8",
    "in_octets": f"{IF_ENTRY}.10",
    "in_packets": f"{IF_ENTRY}.11",
    "in_discards": f"{IF_ENTRY}.13",
    "in_errors": f"{IF_ENTRY}.14",
    "out_octets": f"{IF_ENTRY}.16",
    "out_packets": f"{IF_ENTRY}.17",
    "out_discards": f"{IF_ENTRY}.19",
    "out_errors": f"{IF_ENTRY}.20",
}
INTERFACE_X = {
    "x_name": f"{IFX_ENTRY}.1",
    "hc_in": f"{IFX_ENTRY}.6",
    "hc_out": f"{IFX_ENTRY}.10",
    "high_speed": f"{IFX_ENTRY}.15",
    "alias": f"{IFX_ENTRY}.18",
    "vlan": ".1.3.6.1.2.1.17.7.1.4.5.1.1",
}
IF_TYPE_NAMES = {
    1: "other",
    6: "ethernet",
    24: "loopback",
    53: "propVirtual",
    131: "tunnel",
    135: "l2vlan",
    136: "l3ipvlan",
    150: "mplsTunnel",
    161: "lag",
    351: "vxlan",
}
ADDRESS = {"if_index": ".1.3.6.1.2.1.4.20.1.2", "net_mask": ".1.3.6.1.2.1.4.20.1.3"}

# Tunnels and sessions.
SITE_TUNNEL = {
    "phase1_name": f"{FORTINET}.12.2.2.1.2",
    "tunnel_name": f"{FORTINET}.12.2.2.1.3",
    "remote_ip": f"{FORTINET}.12.2.2.1.4",
    "src_begin": f"{FORTINET}.12.2.2.1.8",
    "src_end": f"{FORTINET}.12.2.2.1.9",
    "dst_begin": f"{FORTINET}.12.2.2.1.11",
    "dst_end": f"{FORTINET}.12.2.2.1.12",
    "bytes_in": f"{FORTINET}.12.2.2.1.18",
    "bytes_out": f"{FORTINET}.12.2.2.1.19",
    "status": f"{FORTINET}.12.2.2.1.20",
    "uptime": f"{FORTINET}.12.2.2.1.21",
}
DIALUP_TUNNEL = {
    "remote_ip": f"{FORTINET}.12.2.1.1.2",
    "uptime": f"{FORTINET}.12.2.1.1.3",
    "src_begin": f"{FORTINET}.12.2.1.1.5",
    "src_end": f"{FORTINET}.12.2.1.1.6",
    "dst_begin": f"{FORTINET}.12.2.1.1.7",
    "dst_end": f"{FORTINET}.12.2.1.1.8",
    "bytes_in": f"{FORTINET}.12.2.1.1.9",
    "bytes_out": f"{FORTINET}.12.2.1.1.10",
}
SSL_SESSION = {
    "user": f"{FORTINET}.12.2.4.1.3",
    "remote_ip": f"{FORTINET}.12.2.4.1.4",
    "bytes_in": f"{FORTINET}.12.2.4.1.7",
    "bytes_out": f"{FORTINET}.12.2.4.1.8",
}
SECURITY_ASSOCIATION = {
    "peer": f"{SONICWALL}.1.3.2.1.1.1.2",
    "src_begin": f"{SONICWALL}.1.3.2.1.1.1.3",
    "src_end": f"{SONICWALL}.1.3.2.1.1.1.4",
    "dst_begin": f"{SONICWALL}.1.3.2.1.1.1.5",
    "dst_end": f"{SONICWALL}.1.3.2.1.1.1.6",
    "encrypted": f"{SONICWALL}.1.3.2.1.1.1.9",
    "decrypted": f"{SONICWALL}.1.3.2.1.1.1.11",
    "user": f"{SONICWALL}.1.3.2.1.1.1.14",
}

# Sensors.
FORTINET_SENSOR = {"name": f"{FORTINET}.4.3.2.1.2", "value": f"{FORTINET}.4.3.2.1.3", "alarm": f"{FORTINET}.4.3.2.1.4"}
ENTITY_SENSOR = {
    "sensor_type": ".1.3.6.1.2.1.99.1.1.1.1",
    "scale": ".1.3.6.1.2.1.99.1.1.1.2",
    "precision": ".1.3.6.1.2.1.99.1.1.1.3",
    "value": ".1.3.6.1.2.1.99.1.1.1.4",
    "status": ".1.3.6.1.2.1.99.1.1.1.5",
}
SONICWALL_SENSOR = {
    "name": f"{SONICWALL}.1.3.3.3.1.1.3",
    "value": f"{SONICWALL}.1.3.3.3.1.1.4",
    "unit": f"{SONICWALL}.1.3.3.3.1.1.5",
}
LM_SENSOR = {
    "temp_name": f"{UCD}.13.16.2.1.2",
    "temp_value": f"{UCD}.13.16.2.1.3",
    "fan_name": f"{UCD}.13.16.3.1.2",
    "fan_value": f"{UCD}.13.16.3.1.3",
}
# Sensor type code -> (name pattern, class, unit).
ENTITY_SENSOR_TYPES = {
    8: ("Temperature Sensor %d", "temperature", "°C"),
    10: ("Fan %d", "fan", "RPM"),
    4: ("Voltage Sensor %d", "voltage", "V"),
    3: ("AC Voltage %d", "voltage", "V"),
    5: ("Current Sensor %d", "current", "A"),
    6: ("Power Sensor %d", "power", "W"),
}
#: Scale code 9 is "units"; each code is a factor of 1000 away from the next.
ENTITY_SCALE_UNITS = 9
ENTITY_SCALE_LAST = 13

# Processors.
HR_PROCESSOR_LOAD = ".1.3.6.1.2.1.25.3.3.1.2"
FORTINET_PROCESSOR = f"{FORTINET}.4.4.2.1.2"
CISCO_CPU_1MIN = f"{CISCO}.109.1.1.1.1.7"
CISCO_CPU_5MIN = f"{CISCO}.109.1.1.1.1.8"

# High availability.
FORTINET_HA = {"mode": f"{FORTINET}.13.1.1.0", "group_id": f"{FORTINET}.13.1.2.0", "group_name": f"{FORTINET}.13.1.7.0"}
FORTINET_HA_MEMBER = {
    "member_serial": f"{FORTINET}.13.2.1.1.2",
    "cpu_usage": f"{FORTINET}.13.2.1.1.3",
    "memory_usage": f"{FORTINET}.13.2.1.1.4",
    "network_usage": f"{FORTINET}.13.2.1.1.5",
    "session_count": f"{FORTINET}.13.2.1.1.6",
    "packet_count": f"{FORTINET}.13.2.1.1.7",
    "byte_count": f"{FORTINET}.13.2.1.1.8",
    "member_hostname": f"{FORTINET}.13.2.1.1.11",
    "sync": f"{FORTINET}.13.2.1.1.12",
    "master_serial": f"{FORTINET}.13.2.1.1.16",
}
PALO_ALTO_HA = {
    "state": f"{PALO_ALTO}.2.1.11.0",
    "peer": f"{PALO_ALTO}.2.1.12.0",
    "mode": f"{PALO_ALTO}.2.1.13.0",
    "serial": f"{PALO_ALTO}.2.1.3.0",
}
CISCO_FAILOVER = {
    "info": f"{CISCO}.147.1.2.1.1.1.2",
    "value": f"{CISCO}.147.1.2.1.1.1.3",
    "detail": f"{CISCO}.147.1.2.1.1.1.4",
}
CISCO_FAILOVER_STATES = {
    1: "other",
    2: "up",
    3: "down",
    4: "error",
    5: "overTemp",
    6: "busy",
    7: "noMedia",
    8: "backup",
    9: "active",
    10: "standby",
}

# Security counters, SD-WAN, licences, storage, load.
SECURITY = {
    "av_detected": f"{FORTINET}.8.2.1.1.1.1",
    "av_blocked": f"{FORTINET}.8.2.1.1.2.1",
    "av_http_detected": f"{FORTINET}.8.2.1.1.3.1",
    "av_http_blocked": f"{FORTINET}.8.2.1.1.4.1",
    "av_smtp_detected": f"{FORTINET}.8.2.1.1.5.1",
    "av_smtp_blocked": f"{FORTINET}.8.2.1.1.6.1",
    "ips_detected": f"{FORTINET}.9.2.1.1.1.1",
    "ips_blocked": f"{FORTINET}.9.2.1.1.2.1",
    "ips_critical": f"{FORTINET}.9.2.1.1.3.1",
    "ips_high": f"{FORTINET}.9.2.1.1.4.1",
    "ips_medium": f"{FORTINET}.9.2.1.1.5.1",
    "ips_low": f"{FORTINET}.9.2.1.1.6.1",
    "ips_info": f"{FORTINET}.9.2.1.1.7.1",
    "wf_http_blocked": f"{FORTINET}.10.1.2.1.1.1.1",
    "wf_https_blocked": f"{FORTINET}.10.1.2.1.1.2.1",
    "wf_url_blocked": f"{FORTINET}.10.1.2.1.1.3.1",
}
SDWAN = {
    "name": f"{FORTINET}.4.9.2",
    "state": f"{FORTINET}.4.9.4",
    "latency": f"{FORTINET}.4.9.5",
    "packet_send": f"{FORTINET}.4.9.7",
    "packet_recv": f"{FORTINET}.4.9.8",
    "interface": f"{FORTINET}.4.9.14",
}
LICENSE = {"description": f"{FORTINET}.4.6.3.1.1.1", "expiry_date": f"{FORTINET}.4.6.3.1.1.2"}
STORAGE = {
    "storage_type": ".1.3.6.1.2.1.25.2.3.1.2",
    "mount": ".1.3.6.1.2.1.25.2.3.1.3",
    "units": ".1.3.6.1.2.1.25.2.3.1.4",
    "size": ".1.3.6.1.2.1.25.2.3.1.5",
    "used": ".1.3.6.1.2.1.25.2.3.1.6",
}
LOAD = f"{UCD}.10.1.3"

# System scalars by vendor. Text columns are listed in SYSTEM_TEXT.
SYS_DESCR, SYS_UPTIME, SYS_NAME = ".1.3.6.1.2.1.1.1.0", ".1.3.6.1.2.1.1.3.0", ".1.3.6.1.2.1.1.5.0"
FORTINET_SYSTEM = {
    "version": f"{FORTINET}.4.1.1.0",
    "hostname": f"{FORTINET}.4.1.2.0",
    "cpu": f"{FORTINET}.4.1.3.0",
    "memory": f"{FORTINET}.4.1.4.0",
    "memory_total": f"{FORTINET}.4.1.5.0",
    "disk": f"{FORTINET}.4.1.6.0",
    "disk_total": f"{FORTINET}.4.1.7.0",
    "session_count": f"{FORTINET}.4.1.8.0",
    "low_mem_usage": f"{FORTINET}.4.1.9.0",
    "low_mem_cap": f"{FORTINET}.4.1.10.0",
    "session_rate_1": f"{FORTINET}.4.1.11.0",
    "session_rate_10": f"{FORTINET}.4.1.12.0",
    "session_rate_30": f"{FORTINET}.4.1.13.0",
    "session_rate_60": f"{FORTINET}.4.1.14.0",
    "session_count_6": f"{FORTINET}.4.1.15.0",
    "uptime": f"{FORTINET}.4.1.20.0",
    "av_version": f"{FORTINET}.4.2.1.0",
    "ips_version": f"{FORTINET}.4.2.2.0",
    "sslvpn_users": f"{FORTINET}.12.2.3.1.2.0",
    "sslvpn_tunnels": f"{FORTINET}.12.2.3.1.6.0",
}
UCD_SYSTEM = {
    "hostname": SYS_NAME,
    "descr": SYS_DESCR,
    "ticks": SYS_UPTIME,
    "cpu_user": f"{UCD}.11.9.0",
    "cpu_system": f"{UCD}.11.10.0",
    "cpu_idle": f"{UCD}.11.11.0",
    "mem_total": f"{UCD}.4.5.0",
    "mem_avail": f"{UCD}.4.6.0",
    "mem_buffer": f"{UCD}.4.14.0",
    "mem_cached": f"{UCD}.4.15.0",
    "session_count": ".1.3.6.1.4.1.12325.1.200.1.3.1.0",
}
PALO_ALTO_SYSTEM = {
    "hostname": SYS_NAME,
    "ticks": SYS_UPTIME,
    "sw_version": f"{PALO_ALTO}.2.1.1.0",
    "cpu": f"{HR_PROCESSOR_LOAD}.1",
    "session_count": f"{PALO_ALTO}.2.3.3.0",
    "av_version": f"{PALO_ALTO}.2.1.8.0",
    "ips_version": f"{PALO_ALTO}.2.1.9.0",
    "sslvpn_tunnels": f"{PALO_ALTO}.2.5.1.3.0",
}
SONICWALL_SYSTEM = {
    "hostname": SYS_NAME,
    "ticks": SYS_UPTIME,
    "firmware": f"{SONICWALL}.2.1.1.3.0",
    "session_count": f"{SONICWALL}.1.3.1.2.0",
    "cpu": f"{SONICWALL}.1.3.1.3.0",
    "memory": f"{SONICWALL}.1.3.1.4.0",
}
CISCO_SYSTEM = {
    "hostname": SYS_NAME,
    "descr": SYS_DESCR,
    "ticks": SYS_UPTIME,
    "cpu": f"{CISCO_CPU_1MIN}.1",
    "mem_used": f"{CISCO}.48.1.1.1.5.1",
    "mem_free": f"{CISCO}.48.1.1.1.6.1",
    "session_count": f"{CISCO}.147.1.2.2.2.1.5.40.6",
}
GENERIC_SYSTEM = {"hostname": SYS_NAME, "descr": SYS_DESCR, "ticks": SYS_UPTIME, "mem_kb": ".1.3.6.1.2.1.25.2.2.0"}

# Layer-2 topology.
ARP_MEDIA = ".1.3.6.1.2.1.4.22.1.2"
ARP_PHYSICAL = ".1.3.6.1.2.1.4.35.1.4"
QBRIDGE_FDB_PORT, QBRIDGE_FDB_STATUS = ".1.3.6.1.2.1.17.7.1.2.2.1.2", ".1.3.6.1.2.1.17.7.1.2.2.1.3"
BRIDGE_FDB_PORT, BRIDGE_FDB_STATUS = ".1.3.6.1.2.1.17.4.3.1.2", ".1.3.6.1.2.1.17.4.3.1.3"
BRIDGE_PORT_IF_INDEX = ".1.3.6.1.2.1.17.1.4.1.2"
LLDP_REMOTE = {
    "chassis_subtype": f"{LLDP}.4.1.1.4",
    "chassis": f"{LLDP}.4.1.1.5",
    "port_subtype": f"{LLDP}.4.1.1.6",
    "port": f"{LLDP}.4.1.1.7",
    "port_desc": f"{LLDP}.4.1.1.8",
    "sys_name": f"{LLDP}.4.1.1.9",
    "sys_desc": f"{LLDP}.4.1.1.10",
}
LLDP_LOCAL = {"port_id": f"{LLDP}.3.7.1.3", "port_desc": f"{LLDP}.3.7.1.4"}
CDP_CACHE = {
    "address": f"{CISCO}.23.1.2.1.1.4",
    "device": f"{CISCO}.23.1.2.1.1.6",
    "port": f"{CISCO}.23.1.2.1.1.7",
    "platform": f"{CISCO}.23.1.2.1.1.8",
}

# Trap OID -> (type, severity).
SNMP_TRAP_OID = ".1.3.6.1.6.3.1.1.4.1.0"
SYS_UPTIME_OID = ".1.3.6.1.2.1.1.3.0"
TRAPS = {
    f"{FORTINET}.2.0.301": ("VPN_TUNNEL_UP", "info"),
    f"{FORTINET}.2.0.302": ("VPN_TUNNEL_DOWN", "critical"),
    f"{FORTINET}.2.0.401": ("HA_SWITCH", "warning"),
    f"{FORTINET}.2.0.402": ("HA_STATE_CHANGE", "warning"),
    f"{FORTINET}.2.0.403": ("HA_HEARTBEAT_FAIL", "critical"),
    f"{FORTINET}.2.0.404": ("HA_MEMBER_DOWN", "critical"),
    f"{FORTINET}.2.0.405": ("HA_MEMBER_UP", "info"),
    f"{FORTINET}.2.0.503": ("IPS_SIGNATURE", "critical"),
    f"{FORTINET}.2.0.504": ("IPS_ANOMALY", "critical"),
    f"{FORTINET}.2.0.601": ("AV_VIRUS", "critical"),
    f"{FORTINET}.2.0.602": ("AV_OVERSIZE", "info"),
    f"{PALO_ALTO}.3.2.0.4": ("threat-detected", "critical"),
    f"{PALO_ALTO}.3.2.0.600": ("system-general", "info"),
    f"{PALO_ALTO}.3.2.0.700": ("gp-login-success", "info"),
    f"{PALO_ALTO}.3.2.0.701": ("gp-login-failed", "warning"),
    f"{PALO_ALTO}.3.2.0.702": ("gp-logout", "info"),
    f"{PALO_ALTO}.3.2.0.801": ("ha-state-change", "warning"),
    f"{PALO_ALTO}.3.2.0.803": ("ha-dataplane-down", "critical"),
    f"{PALO_ALTO}.3.2.0.826": ("ha-split-brain", "critical"),
    f"{PALO_ALTO}.3.2.0.900": ("hw-disk-error", "critical"),
    f"{PALO_ALTO}.3.2.0.913": ("hw-ps-failure", "critical"),
    f"{PALO_ALTO}.3.2.0.916": ("hw-fan-failure", "critical"),
    f"{PALO_ALTO}.3.2.0.1746": ("vpn-tunnel-up", "info"),
    f"{PALO_ALTO}.3.2.0.1747": ("vpn-tunnel-down", "critical"),
    f"{SONICWALL}.1.1.2.0.1": ("attack-detected", "critical"),
    f"{SONICWALL}.1.1.2.0.2": ("system-error", "critical"),
    f"{SONICWALL}.1.1.2.0.4": ("ipsec-tunnel", "warning"),
    f"{SONICWALL}.1.1.2.0.6": ("system-environment", "warning"),
    f"{SONICWALL}.1.1.2.0.122": ("hw-error", "critical"),
    f"{SONICWALL}.1.1.2.0.126": ("ha-state-change", "warning"),
    f"{SONICWALL}.1.1.2.0.127": ("ips-detection", "critical"),
    f"{SONICWALL}.1.1.2.0.138": ("security-services", "warning"),
    f"{SONICWALL}.1.1.2.0.140": ("vpn-event", "info"),
    f"{SONICWALL}.1.1.2.0.142": ("vpn-ike", "warning"),
    f"{SONICWALL}.1.1.2.0.143": ("vpn-ipsec", "warning"),
    f"{SONICWALL}.1.1.2.0.145": ("wan-failover", "warning"),
    f"{SONICWALL}.1.1.2.0.162": ("sslvpn-event", "info"),
}

#: Vendor profiles; an empty vendor means the first, an unknown one the last.
VENDORS = ["fortigate", "paloalto", "sonicwall", "pfsense", "opnsense", "firewalla", "cisco_asa", "generic"]
