"""Command output to rows.

``captures`` hold one command's text per row in ``output``. A text is cut into lines or blocks with array functions
inside its row, so nothing is shuffled and a long capture costs no more than its own row. Pager lines are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftnet.functions import net

PAGER = "--More--"
# Fixed patterns of the device texts.
PROCESS = r"^\s*(\S+)\s+(\d+)\s+(\S)\s+(\d+\.?\d*)\s+(\d+\.?\d*)\s+(\d+)"
ERRORS = r"errors[:\s]+(\d+).*?discards[:\s]+(\d+)"
SENSOR_NAME = r"(?i)^\s*Sensor\s+\d+:\s+(.+)$"
SENSOR_VALUE = r"(?i)^\s*Value:\s*([\d.]+)\s*(\w+)"
SENSOR_STATUS = r"(?i)^\s*Status:\s*(\w+)"
SENSOR_LINE = r"(?i)^\s*(\d+)\s+(.+?)\s+\.+\s+([\d.]+)\s*(\S+)\s*(.*)$"
LICENSE = (
    r"(?i)^(License|VM License|SSL-VPN|SSLVPN|Explicit Proxy|FortiCare|FortiGuard|Antivirus|IPS|Web Filter|"
    r"Email Filter|Application Control|Geo IP|IoT Detection|SD-WAN|Threat Feed|Virtual Domain)\s*[:.]*\s*(.+)"
)
CPU = (
    r"CPU states:\s+(\d+)%\s+user\s+(\d+)%\s+system\s+(\d+)%\s+nice\s+(\d+)%\s+idle\s+(\d+)%\s+iowait\s+(\d+)%\s+irq"
    r"\s+(\d+)%\s+softirq"
)
MEMORY = (
    r"Memory:\s+(\d+)k total,\s+(\d+)k used\s+\(([0-9.]+)%\),\s+(\d+)k free\s+\(([0-9.]+)%\),\s+(\d+)k freeable"
    r"\s+\(([0-9.]+)%\)"
)
NETWORK = r"Average network usage:\s+([\d.]+)\s+/\s+([\d.]+)\s+kbps\s+in\s+(\d+)\s+minute"
SESSIONS = r"Current sessions:\s+(\d+)"
SESSION_RATE = r"Maximal sessions:\s+(\d+)\s+sessions\s+in\s+(\d+)\s+minute"
UPTIME = r"Uptime:\s+(\d+)\s+days"
SAFE_NAME = r"^[A-Za-z0-9._-]+$"
RAIL = r"^dev\.ina2xx\.(\d+)\.(bus_voltage|current|power|label)$"
FAN = r"^dev\.emc2302\.(\d+)\.fan(\d+)\.(rpm|fault)$"
TEMPERATURE_PREFIX = "hw.temperature."
CONFIG_HEADER = "#config-version="
# The words of a process table's own header.
PROCESS_HEADERS = ["process", "CPU", "MEM", "node"]


def lines(output: Column, *, pager: bool = True) -> Column:
    """Array of lines without line ends; pager lines left out."""
    cut = F.transform(F.split(output, "\n"), lambda line: F.rtrim(line, F.lit("\r")))
    return F.filter(cut, lambda line: ~line.contains(PAGER)) if pager else cut


def fields(line: Column) -> Column:
    """Words of a line."""
    return F.filter(F.split(line, r"\s+"), lambda w: w != "")


def blocks(output: Column, header: str) -> Column:
    """Text cut before every line that matches ``header`` (a pattern that stays inside one line)."""
    return F.split(F.array_join(lines(output), "\n"), rf"\n(?={header})", -1)


def last_match(rows: Column, pattern: str, group: int) -> Column:
    """Group of the last line that matches, null if none does."""
    hit = F.try_element_at(F.filter(rows, lambda line: line.rlike(pattern)), F.lit(-1))
    return F.when(hit.isNotNull(), F.regexp_extract(hit, pattern, group))


def canonical_mac(text: Column) -> Column:
    """Colon, dash or dotted MAC in lower-case colon form, null if it is none."""
    shaped = text.rlike("^[0-9A-Fa-f]{2}((:[0-9A-Fa-f]{2}){5}|(-[0-9A-Fa-f]{2}){5})$") | text.rlike(
        r"^[0-9A-Fa-f]{4}(\.[0-9A-Fa-f]{4}){2}$"
    )
    digits = F.lower(F.regexp_replace(text, "[-:.]", ""))
    return F.when(shaped, F.regexp_replace(digits, "(..)(?=.)", "$1:"))


# ------------------------------------------------------------------------------------------------------- processes


def process_list(output: Column) -> Column:
    """Array of (name, pid, cpu, mem, command) from the lines after the summary line."""
    trimmed = F.filter(F.transform(lines(output), lambda line: F.trim(line)), lambda line: line != "")
    start = F.array_position(
        F.transform(
            trimmed, lambda line: line.contains("Run Time:") | (line.contains("U,") & line.contains("T,"))
        ),
        True,
    ).cast("int")
    after = F.when(start > 0, F.slice(trimmed, start + 1, F.size(trimmed))).otherwise(F.array().cast("array<string>"))
    rows = F.filter(
        after,
        lambda line: line.rlike(PROCESS)
        & ~line.contains("Run Time:")
        & ~F.regexp_extract(line, PROCESS, 1).isin(PROCESS_HEADERS)
        & F.regexp_extract(line, PROCESS, 2).try_cast("int").isNotNull(),
    )
    return F.transform(
        rows,
        lambda line: F.struct(
            F.regexp_extract(line, PROCESS, 1).alias("name"),
            F.regexp_extract(line, PROCESS, 2).try_cast("int").alias("pid"),
            F.regexp_extract(line, PROCESS, 4).try_cast("double").alias("cpu"),
            F.regexp_extract(line, PROCESS, 5).try_cast("double").alias("mem"),
            F.concat(
                F.regexp_extract(line, PROCESS, 1), F.lit(" ("), F.regexp_extract(line, PROCESS, 3), F.lit(")")
            ).alias("command"),
        ),
    )


def process_snapshots(captures: DataFrame) -> DataFrame:
    return captures.withColumn("processes", process_list(F.col("output"))).drop("output")


def interface_errors(captures: DataFrame) -> DataFrame:
    """One row per ``name:`` block. Only ``rx`` lines carry counters that are read; the out-counters stay 0."""
    header = r"(?i:name:)[ \t]*\S"
    rows = captures.select(
        *[c for c in captures.columns if c != "output"], F.posexplode(blocks(F.col("output"), header)).alias("block_no", "_b")
    ).where(F.col("_b").rlike("^" + header))
    received = F.filter(
        F.transform(F.split("_b", "\n"), F.lower), lambda line: line.contains("rx") & line.contains("errors")
    )

    def counter(group: int) -> Column:
        values = F.flatten(F.transform(received, lambda line: F.regexp_extract_all(line, F.lit(ERRORS), group)))
        return F.coalesce(F.try_element_at(values, F.lit(-1)).try_cast("bigint"), F.lit(0).cast("bigint"))

    return rows.select(
        *[c for c in rows.columns if c not in {"_b"}],
        F.regexp_extract("_b", r"(?i)^name:\s*(\S+)", 1).alias("interface"),
        counter(1).alias("in_errors"),
        counter(2).alias("in_discards"),
        F.lit(0).cast("bigint").alias("out_errors"),
        F.lit(0).cast("bigint").alias("out_discards"),
    )


def sensor_details(captures: DataFrame) -> DataFrame:
    """Blocks (``Sensor n:`` / ``Value:`` / ``Status:``) and one-line rows with dots. A block without a value gives no
    row, nor does one that a one-line row follows."""
    one_line = r"[ \t]*\d+[ \t]+.+?[ \t]+\.+[ \t]+[\d.]+[ \t]*\S"
    header = rf"(?:(?i:[ \t]*Sensor[ \t]+\d+:[ \t]+.)|{one_line})"
    parts = blocks(F.col("output"), header)
    rows = captures.withColumn("_parts", parts).select(
        *[c for c in captures.columns if c != "output"], "_parts", F.posexplode("_parts").alias("block_no", "_b")
    )
    body = F.split("_b", "\n")
    first = F.get(body, F.lit(0))
    is_block, is_line = first.rlike(SENSOR_NAME), first.rlike(SENSOR_LINE)
    # the line after a cut decides whether the block before it is lost
    following = F.get(F.split(F.get("_parts", F.col("block_no") + 1), "\n"), F.lit(0))
    lost = F.coalesce(following.rlike(SENSOR_LINE) & ~following.rlike(SENSOR_NAME), F.lit(False))
    has_value = F.exists(body, lambda line: line.rlike(SENSOR_VALUE))
    rows = rows.where((is_block & has_value & ~lost) | (is_line & ~is_block))

    def pick(block: Column, line_group: int) -> Column:
        return F.when(is_block, block).otherwise(F.trim(F.regexp_extract(first, SENSOR_LINE, line_group)))

    status = F.coalesce(last_match(body, SENSOR_STATUS, 1), F.lit("unknown"))
    line_status = F.trim(F.regexp_extract(first, SENSOR_LINE, 5))
    return rows.select(
        *[c for c in rows.columns if c not in {"_parts", "_b"}],
        pick(F.trim(F.regexp_extract(first, SENSOR_NAME, 1)), 2).alias("name"),
        F.coalesce(pick(last_match(body, SENSOR_VALUE, 1), 3).try_cast("double"), F.lit(0.0)).alias("value"),
        pick(last_match(body, SENSOR_VALUE, 2), 4).alias("unit"),
        F.when(is_block, status).when(line_status != "", line_status).otherwise("normal").alias("status"),
    )


def license_details(captures: DataFrame) -> DataFrame:
    rows = captures.select(
        *[c for c in captures.columns if c != "output"], F.posexplode(lines(F.col("output"))).alias("line_no", "_l")
    )
    rows = rows.withColumn("_l", F.trim("_l")).where(F.col("_l").rlike(LICENSE))
    value = F.trim(F.regexp_extract("_l", LICENSE, 2))
    lower = F.lower(value)
    status = (
        F.when(lower.isin("valid", "enabled"), "licensed")
        .when(lower.isin("expired", "disabled"), "expired")
        .when(lower.contains("none"), "no_license")
        .otherwise(value)
    )
    return rows.select(
        *[c for c in rows.columns if c != "_l"],
        F.trim(F.regexp_extract("_l", LICENSE, 1)).alias("description"),
        status.alias("status"),
        value.alias("details"),
    )


# ---------------------------------------------------------------------------------------------------- performance


def performance(captures: DataFrame) -> DataFrame:
    """Performance block to columns, absent parts as 0; memory in bytes, uptime in seconds."""
    rows = captures.withColumn("_lines", lines(F.col("output")))
    body = F.col("_lines")

    def part(pattern: str, group: int, kind: str = "bigint") -> Column:
        zero = F.lit(0.0) if kind == "double" else F.lit(0).cast("bigint")
        return F.coalesce(last_match(body, pattern, group).try_cast(kind), zero)

    cpu = ["cpu_user", "cpu_system", "cpu_nice", "cpu_idle", "cpu_iowait", "cpu_irq", "cpu_softirq"]
    return rows.select(
        *[c for c in captures.columns if c != "output"],
        *[part(CPU, i + 1, "double").alias(name) for i, name in enumerate(cpu)],
        (part(MEMORY, 1) * 1024).alias("memory_total"),
        (part(MEMORY, 2) * 1024).alias("memory_used"),
        part(MEMORY, 3, "double").alias("memory_usage"),
        (part(MEMORY, 4) * 1024).alias("memory_free"),
        (part(MEMORY, 6) * 1024).alias("memory_freeable"),
        part(NETWORK, 1, "double").alias("network_in_kbps"),
        part(NETWORK, 2, "double").alias("network_out_kbps"),
        part(SESSIONS, 1).alias("session_count"),
        part(SESSION_RATE, 2).alias("session_rate"),
        part(SESSION_RATE, 1).alias("max_sessions"),
        (part(UPTIME, 1) * 86400).alias("uptime"),
    )


def performance_processors(rows: DataFrame, *, keys: list[str]) -> DataFrame:
    """Processor rows -1 (session rate) and -2 (session maximum), only where positive."""
    pair = F.array(
        F.struct(F.lit(-1).alias("index"), F.col("session_rate").cast("double").alias("usage")),
        F.struct(F.lit(-2).alias("index"), F.col("max_sessions").cast("double").alias("usage")),
    )
    return rows.select(*keys, F.inline(pair)).where("usage > 0")


# ------------------------------------------------------------------------------------------------------------ VPN


def _edit_blocks(captures: DataFrame) -> DataFrame:
    header = r"[^\n]*(?i:edit)[ \t]+\"[^\"\n]+\""
    rows = captures.select(
        *[c for c in captures.columns if c != "output"],
        F.posexplode(blocks(F.col("output"), header)).alias("line_no", "_b"),
    )
    first = F.get(F.split("_b", "\n"), F.lit(0))
    return rows.withColumn("name", F.regexp_extract(first, r'(?i)edit\s+"([^"]+)"', 1)).where("name <> ''").withColumn(
        "_body", F.expr("slice(split(_b, '\\n'), 2, 1000000)")
    )


def _setting(name: str, value: str = r"(\S+)", group: int = 1) -> Column:
    return F.coalesce(last_match(F.col("_body"), rf"(?i)set\s+{name}\s+{value}", group), F.lit(""))


def vpn_phase1(captures: DataFrame) -> DataFrame:
    rows = _edit_blocks(captures)
    return rows.select(
        *[c for c in rows.columns if c not in {"_b", "_body"}],
        _setting("type").alias("type"),
        _setting("interface").alias("interface_name"),
        _setting("remote-gw").alias("remote_ip"),
        _setting("mode").alias("mode"),
        _setting("status").alias("status"),
    )


def vpn_phase2(captures: DataFrame) -> DataFrame:
    rows = _edit_blocks(captures)

    def subnet(name: str) -> Column:
        pair = r"(\S+)\s+(\S+)"
        return net.subnet_to_cidr(_setting(name, pair, 1), _setting(name, pair, 2))

    return rows.select(
        *[c for c in rows.columns if c not in {"_b", "_body", "name"}],
        F.col("name").alias("tunnel_name"),
        _setting("phase1name", r'"([^"]+)"').alias("phase1_name"),
        _setting("remote-gw").alias("remote_ip"),
        subnet("src-subnet").alias("local_subnet"),
        subnet("dst-subnet").alias("remote_subnet"),
    )


# -------------------------------------------------------------------------------------------------------- sensors


def sysctl_sensors(captures: DataFrame, *, keys: list[str]) -> DataFrame:
    """Temperatures, power rails that have a label, and fans numbered by (unit, channel)."""
    rows = captures.select(*keys, F.posexplode(lines(F.col("output"), pager=False)).alias("_no", "_l")).where(
        F.col("_l").contains(":")
    )
    at = F.instr("_l", ":")
    rows = rows.select(
        *keys,
        "_no",
        F.trim(F.substring("_l", F.lit(1), at - 1)).alias("_k"),
        F.trim(F.substring("_l", at + 1, F.lit(1_000_000))).alias("_v"),
    )
    key, value = F.col("_k"), F.col("_v")
    celsius = F.rtrim(value, F.lit("C")).try_cast("double")
    temperatures = rows.where(key.startswith(TEMPERATURE_PREFIX)).select(
        *keys,
        F.substring(key, len(TEMPERATURE_PREFIX) + 1, 1000).alias("name"),
        F.lit("temperature").alias("type"),
        celsius.alias("value"),
        F.lit("°C").alias("unit"),
        F.lit("normal").alias("status"),
    ).where("value is not null")

    def latest(pattern: str, group: int, name: str) -> Column:
        return F.max_by(value, F.when(F.regexp_extract(key, pattern, group) == name, F.col("_no")))

    rail_rows = rows.where(key.rlike(RAIL)).withColumn("_unit", F.regexp_extract(key, RAIL, 1).cast("bigint"))
    rails = rail_rows.groupBy(*keys, "_unit").agg(
        *[latest(RAIL, 2, n).alias(n) for n in ("label", "bus_voltage", "current", "power")]
    ).where("coalesce(label, '') <> ''")

    def rail(column: str, suffix: str, unit: str) -> Column:
        return F.struct(
            F.concat("label", F.lit(" " + suffix)).alias("name"),
            F.lit(suffix).alias("type"),
            F.col(column).try_cast("double").alias("value"),
            F.lit(unit).alias("unit"),
            F.lit("normal").alias("status"),
        )

    powered = rails.select(
        *keys, F.inline(F.array(rail("bus_voltage", "voltage", "mV"), rail("current", "current", "mA"), rail("power", "power", "mW")))
    ).where("value is not null")

    fan_rows = rows.where(key.rlike(FAN)).select(
        *keys,
        "_no",
        "_k",
        "_v",
        F.regexp_extract(key, FAN, 1).cast("bigint").alias("_unit"),
        F.regexp_extract(key, FAN, 2).cast("bigint").alias("_channel"),
    )
    fans = fan_rows.groupBy(*keys, "_unit", "_channel").agg(latest(FAN, 3, "rpm").alias("rpm"), latest(FAN, 3, "fault").alias("fault"))
    # a window over one capture's fans: a handful of rows
    numbered = fans.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_unit", "_channel")))
    speed = F.col("rpm").try_cast("double")
    readable = F.col("rpm").isNull() | speed.isNotNull() | F.col("fault").isNotNull()
    spinning = numbered.where(readable).select(
        *keys,
        F.concat(F.lit("System Fan "), F.col("_n").cast("string")).alias("name"),
        F.lit("fan").alias("type"),
        F.coalesce(speed, F.lit(0.0)).alias("value"),
        F.lit("RPM").alias("unit"),
        F.when(F.coalesce("fault", F.lit("0")) != "0", "alarm").otherwise("normal").alias("status"),
    )
    return temperatures.unionByName(powered).unionByName(spinning)


# ------------------------------------------------------------------------------------------------------- topology


def _exploded(captures: DataFrame) -> DataFrame:
    rows = captures.select(
        *[c for c in captures.columns if c != "output"],
        F.posexplode(lines(F.col("output"), pager=False)).alias("line_no", "_l"),
    )
    return rows.withColumn("_f", fields(F.col("_l")))


def _word(at: int) -> Column:
    return F.get("_f", F.lit(at))


def _unicast(rows: DataFrame, mac: Column) -> DataFrame:
    found = rows.withColumn("mac_address", canonical_mac(mac))
    return found.where(net.is_unicast_mac(F.col("mac_address")))


def arp_text(captures: DataFrame) -> DataFrame:
    """Address, age, MAC, interface."""
    rows = _exploded(captures).where((F.size("_f") >= 4) & net.canonical_ip(_word(0)).isNotNull())
    return _unicast(rows, _word(2)).select(
        *[c for c in rows.columns if c not in {"_l", "_f"}],
        _word(0).alias("ip_address"),
        "mac_address",
        _word(3).alias("interface"),
    )


def bridge_names(output: Column) -> Column:
    """Distinct safe names after ``name=`` in order."""
    named = F.filter(lines(output, pager=False), lambda line: line.contains("name="))
    names = F.transform(named, lambda line: F.regexp_extract(line, r"^.*?name=\s*(\S+)", 1))
    return F.array_distinct(F.filter(names, lambda n: n.rlike(SAFE_NAME)))


def freebsd_bridge_names(output: Column) -> Column:
    names = F.filter(F.transform(lines(output, pager=False), lambda line: F.trim(line)), lambda n: n.rlike(SAFE_NAME))
    return F.array_distinct(names)


def bridge_hosts(captures: DataFrame) -> DataFrame:
    """Learned hosts: port, device index, interface, MAC."""
    integer = r"^[+-]?[0-9]+$"
    rows = _exploded(captures).where(
        ~F.col("_l").contains("Local")
        & ~F.col("_l").contains("Static")
        & (F.size("_f") >= 4)
        & _word(0).rlike(integer)
        & _word(1).rlike(integer)
    )
    return _unicast(rows, _word(3)).select(
        *[c for c in rows.columns if c not in {"_l", "_f"}], _word(2).alias("interface"), "mac_address"
    )


def freebsd_bridge_hosts(captures: DataFrame) -> DataFrame:
    """MAC, optional VLAN word, interface; static and sticky entries skipped."""
    upper = F.upper("_l")
    rows = _exploded(captures).where((F.size("_f") >= 3) & ~upper.contains("STATIC") & ~upper.contains("STICKY"))
    interface = F.when(_word(1).startswith("Vlan"), _word(2)).otherwise(_word(1))
    return _unicast(rows, _word(0)).select(
        *[c for c in rows.columns if c not in {"_l", "_f"}], interface.alias("interface"), "mac_address"
    )


# --------------------------------------------------------------------------------------------------- configurations


def _last_index(text: Column, word: str) -> Column:
    """1-based position of the last occurrence, 0 if there is none."""
    at = F.instr(F.reverse(text), word[::-1])
    return F.when(at > 0, F.length(text) - at - len(word) + 2).otherwise(0)


def _document(text: Column, start: Column, close: str) -> tuple[Column, Column]:
    end = _last_index(text, close)
    reason = F.when(start == 0, "no config in output").when(end < start, "incomplete config")
    body = F.substring(text, start, end + len(close) - start)
    return F.when(reason.isNull(), body), reason


def xml_config(text: Column, root: str) -> tuple[Column, Column]:
    """(document, reject reason): from the XML declaration or root tag to the last closing root tag."""
    declared = F.instr(text, "<?xml")
    start = F.when(declared > 0, declared).otherwise(F.instr(text, f"<{root}>"))
    return _document(text, start, f"</{root}>")


def paloalto_config(text: Column) -> tuple[Column, Column]:
    """(document, reject reason): from the earlier of the two root forms to the last closing tag."""
    with_attributes, bare = F.instr(text, "<config "), F.instr(text, "<config>")
    start = F.when((bare > 0) & ((with_attributes == 0) | (bare < with_attributes)), bare).otherwise(with_attributes)
    return _document(text, start, "</config>")


def image_checksum(output: Column) -> Column:
    """32 hex digits after ``image:``, null if no line has them."""

    def joined(line: Column) -> Column:
        words = fields(line)
        at = F.array_position(words, "image:").cast("int")
        return F.when(at > 0, F.array_join(F.slice(words, at + 1, 16), "")).otherwise("")

    candidates = F.transform(F.split(output, "\n"), joined)
    return F.get(F.filter(candidates, lambda c: F.length(c) == 32), F.lit(0))


def from_header(text: Column) -> Column:
    """Text from its configuration header on, if something precedes it."""
    at = F.instr(text, CONFIG_HEADER)
    return F.when(at > 1, F.substring(text, at, F.length(text))).otherwise(text)
