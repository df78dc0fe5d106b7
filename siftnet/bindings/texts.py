"""Command output, validation and operational metrics on texts rendered from the tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftnet.bindings.registry import EVENTS_SQL, events, query, table
from siftnet.bindings.scalars import ip_expr, ip_sql
from siftnet.functions import text
from siftnet.operators import cli, metrics, validation
from siftnet.operators.validation import Rule, Spec


def captures(spark, sf_dir, line: str, *, head: str = "", source: str = "part", group: str = "p_partkey div 16", order: str = "p_partkey"):
    """One capture per group of rows: a head, then one rendered piece per row in order."""
    rows = table(spark, sf_dir, source).select(
        F.expr(group).alias("device_id"), F.struct(F.col(order).alias("o"), F.expr(line).alias("t")).alias("p")
    )
    texts = rows.groupBy("device_id").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    body = F.array_join(F.transform("ps", lambda p: p["t"]), "\n")
    return texts.select("device_id", F.concat(F.lit(head), body).alias("output"))


@query(
    "process_snapshots",
    """SELECT p_partkey // 16 AS device_id, replace(p_name, ' ', '_') AS name, p_partkey AS pid, p_size + 0.5::DOUBLE AS cpu, CAST(p_size AS DOUBLE) AS mem,
  replace(p_name, ' ', '_') || ' (S)' AS command FROM part WHERE p_size % 5 <> 0""",
)
def process_snapshots(spark, sf_dir):
    line = "if(p_size % 5 = 0, concat('CPU ', p_partkey, ' S 1.0 2.0 3'), concat('  ', replace(p_name, ' ', '_'), '   ', p_partkey, ' S ', p_size, '.5 ', p_size, ' 4'))"
    found = captures(spark, sf_dir, line, head="early 1 S 1.0 1.0 1\nRun Time: 3 days\n--More--\n")
    return cli.process_snapshots(found).select("device_id", F.inline("processes"))


@query(
    "interface_errors",
    """SELECT p_partkey // 16 AS device_id, p_brand AS interface, CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_partkey END AS in_errors, CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_size END AS in_discards, 0::BIGINT AS out_errors FROM part""",
)
def interface_errors(spark, sf_dir):
    line = "concat('Name: ', p_brand, ' up\\r\\n  RX errors: 9 discards: 9\\n', if(p_size % 3 = 0, '  RX errors: 0 discards: 0', concat('  Rx packets 5 errors ', p_partkey, ' and discards: ', p_size)), '\\n  TX errors: 7 discards: 7')"
    return cli.interface_errors(captures(spark, sf_dir, line, head="banner\n")).select("device_id", "interface", "in_errors", "in_discards", "out_errors")


@query(
    "sensor_details",
    """SELECT p_partkey // 16 AS device_id, CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'Row ' || p_partkey END AS name, p_size + 0.25::DOUBLE AS value, 'C' AS unit,
  CASE WHEN p_size % 2 = 0 THEN CASE WHEN p_size % 4 = 0 THEN 'ok' ELSE 'unknown' END ELSE CASE WHEN p_size % 3 = 0 THEN 'normal' ELSE 'alarm' END END AS status
FROM (SELECT *, lead(p_size) OVER (PARTITION BY p_partkey // 16 ORDER BY p_partkey) AS following FROM part)
WHERE (p_size % 2 = 0 AND p_size % 10 <> 0 AND coalesce(following % 2 = 0, true)) OR p_size % 2 = 1""",
)
def sensor_details(spark, sf_dir):
    line = (
        "if(p_size % 2 = 0, concat('Sensor ', p_partkey, ': ', p_name, if(p_size % 10 = 0, '', concat('\\n  Value: ', p_size, '.25 C')), if(p_size % 4 = 0, '\\n  Status: ok', '')), "
        "concat(' ', p_partkey, ' Row ', p_partkey, ' ..... ', p_size, '.25 C', if(p_size % 3 = 0, '', ' alarm')))"
    )
    return cli.sensor_details(captures(spark, sf_dir, line, head="Sensors\n")).select("device_id", "name", "value", "unit", "status")


@query(
    "license_details",
    """SELECT p_partkey // 16 AS device_id, 'FortiGuard' AS description, CASE p_size % 4 WHEN 0 THEN 'licensed' WHEN 1 THEN 'expired' WHEN 2 THEN 'no_license' ELSE p_name END AS status,
  CASE p_size % 4 WHEN 0 THEN 'Valid' WHEN 1 THEN 'disabled' WHEN 2 THEN 'None yet' ELSE p_name END AS details FROM part""",
)
def license_details(spark, sf_dir):
    line = "concat('  FortiGuard: ', case p_size % 4 when 0 then 'Valid' when 1 then 'disabled' when 2 then 'None yet' else p_name end, '\\nother: x')"
    return cli.license_details(captures(spark, sf_dir, line)).select("device_id", "description", "status", "details")


_PERFORMANCE = (
    "concat('CPU states: ', c_nationkey, '% user 2% system 0% nice 90% idle 1% iowait 0% irq 3% softirq\\nMemory: ', c_custkey, 'k total, 5k used (2.5%), 6k free (3.5%), 7k freeable (4.5%)\\n--More--\\n', "
    "'Average network usage: 1.5 / 2.5 kbps in 1 minute\\nCurrent sessions: ', c_custkey, '\\nMaximal sessions: ', c_nationkey, ' sessions in 1 minute\\nUptime: ', c_nationkey, ' days,  1 hours')"
)


@query(
    "performance_status",
    """SELECT c_custkey AS device_id, CAST(c_nationkey AS DOUBLE) AS cpu_user, 3.0::DOUBLE AS cpu_softirq, c_custkey * 1024 AS memory_total, 2.5::DOUBLE AS memory_usage, 7168::BIGINT AS memory_freeable,
  2.5::DOUBLE AS network_out_kbps, c_custkey AS session_count, 1::BIGINT AS session_rate, c_nationkey AS max_sessions, c_nationkey * 86400 AS uptime FROM customer""",
)
def performance_status(spark, sf_dir):
    found = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("device_id"), F.expr(_PERFORMANCE).alias("output"))
    return cli.performance(found).select(
        "device_id", "cpu_user", "cpu_softirq", "memory_total", "memory_usage", "memory_freeable", "network_out_kbps", "session_count", "session_rate", "max_sessions", "uptime"
    )


@query(
    "performance_processors",
    "SELECT c_custkey AS device_id, -1 AS index, 1.0::DOUBLE AS usage FROM customer UNION ALL SELECT c_custkey, -2, CAST(c_nationkey AS DOUBLE) FROM customer WHERE c_nationkey > 0",
)
def performance_processors(spark, sf_dir):
    found = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("device_id"), F.expr(_PERFORMANCE).alias("output"))
    return cli.performance_processors(cli.performance(found), keys=["device_id"])


@query(
    "vpn_phase1_blocks",
    f"""SELECT p_partkey // 16 AS device_id, p_name || p_partkey AS name, 'static' AS type, '"wan1"' AS interface_name, {ip_sql('p_partkey')} AS remote_ip, CASE WHEN p_size % 2 = 0 THEN 'main' ELSE '' END AS mode FROM part""",
)
def vpn_phase1_blocks(spark, sf_dir):
    line = f"concat('    edit \"', p_name, p_partkey, '\"\\n  set type dynamic\\n  set type static\\n set interface \"wan1\"\\n set remote-gw ', {ip_expr('p_partkey')}, if(p_size % 2 = 0, '\\n set mode main', ''), '\\n next')"
    return cli.vpn_phase1(captures(spark, sf_dir, line, head="config vpn ipsec phase1-interface\n")).select("device_id", "name", "type", "interface_name", "remote_ip", "mode")


@query(
    "vpn_phase2_blocks",
    f"""SELECT p_partkey // 16 AS device_id, p_name || p_partkey AS tunnel_name, p_brand AS phase1_name, {ip_sql('p_partkey // 256 * 256')} || '/24' AS local_subnet,
  CASE WHEN p_size % 3 = 0 THEN '' ELSE '10.0.0.0/8' END AS remote_subnet FROM part""",
)
def vpn_phase2_blocks(spark, sf_dir):
    line = (
        f"concat('edit \"', p_name, p_partkey, '\"\\nset phase1name \"', p_brand, '\"\\nset src-subnet ', {ip_expr('p_partkey')}, ' 255.255.255.0\\nset dst-subnet 10.9.9.9 ', "
        "if(p_size % 3 = 0, '255.0.255.0', '255.0.0.0'), '\\nnext')"
    )
    return cli.vpn_phase2(captures(spark, sf_dir, line)).select("device_id", "tunnel_name", "phase1_name", "local_subnet", "remote_subnet")


@query(
    "sysctl_sensors",
    """WITH p AS (SELECT *, p_partkey // 16 AS d, p_partkey % 16 AS i FROM part)
SELECT d AS device_id, 'CPU' || i AS name, 'temperature' AS type, p_size + 0.5::DOUBLE AS value, '°C' AS unit, 'normal' AS status FROM p WHERE i % 3 = 0
UNION ALL SELECT d, p_brand || ' voltage', 'voltage', CAST(p_size AS DOUBLE), 'mV', 'normal' FROM p WHERE i % 3 = 1 AND p_size % 2 = 0
UNION ALL SELECT d, 'System Fan ' || row_number() OVER (PARTITION BY d ORDER BY i), 'fan', CAST(p_size AS DOUBLE), 'RPM', CASE WHEN p_size % 2 = 0 THEN 'alarm' ELSE 'normal' END FROM p WHERE i % 3 = 2""",
)
def sysctl_sensors(spark, sf_dir):
    line = (
        "case p_partkey % 16 % 3 when 0 then concat('hw.temperature.CPU', p_partkey % 16, ': ', p_size, '.5C') "
        "when 1 then concat('dev.ina2xx.', p_partkey % 16, '.bus_voltage: ', p_size, if(p_size % 2 = 0, concat('\\ndev.ina2xx.', p_partkey % 16, '.label: ', p_brand), '')) "
        "else concat('dev.emc2302.', p_partkey % 16 div 8, '.fan', p_partkey % 16 % 8, '.rpm: ', p_size, '\\ndev.emc2302.', p_partkey % 16 div 8, '.fan', p_partkey % 16 % 8, '.fault: ', 1 - p_size % 2) end"
    )
    return cli.sysctl_sensors(captures(spark, sf_dir, line), keys=["device_id"])


_MAC_TEXT = "lpad(lower(hex(p_partkey + 16777216)), 12, '0')"
_COLON = f"regexp_replace({_MAC_TEXT}, '(..)(?=.)', '$1:')"
_MAC_SQL = "regexp_replace(lpad(printf('%x', p_partkey + 16777216), 12, '0'), '(..)(..)(..)(..)(..)(..)', '\\1:\\2:\\3:\\4:\\5:\\6')"


@query(
    "arp_text",
    f"SELECT p_partkey // 16 AS device_id, {ip_sql('p_partkey')} AS ip_address, {_MAC_SQL} AS mac_address, 'port' || p_size AS interface FROM part WHERE p_size % 4 <> 0",
)
def arp_text(spark, sf_dir):
    line = f"concat({ip_expr('p_partkey')}, '  12  ', if(p_size % 4 = 0, '01:00:5e:00:00:01', upper({_COLON})), ' port', p_size)"
    return cli.arp_text(captures(spark, sf_dir, line, head="Address Age Hardware Interface\n")).drop("line_no")


@query(
    "bridge_hosts",
    f"""SELECT 'linux' AS family, p_partkey // 16 AS device_id, 'lan' || p_size AS interface, {_MAC_SQL} AS mac_address FROM part WHERE p_size % 3 <> 0
UNION ALL SELECT 'freebsd', p_partkey // 16, 'igb' || p_size, {_MAC_SQL} FROM part WHERE p_size % 3 <> 0""",
)
def bridge_hosts(spark, sf_dir):
    linux = f"concat('  ', p_size, ' 7 lan', p_size, ' ', {_COLON}, ' ', if(p_size % 3 = 0, 'Local Static', 'Hash'))"
    bsd = f"concat({_COLON}, if(p_size % 2 = 0, ' Vlan1 ', ' '), 'igb', p_size, ' 1200 flags=0', if(p_size % 3 = 0, '<STATIC,STICKY>', '<>'))"
    a = cli.bridge_hosts(captures(spark, sf_dir, linux, head="show bridge\n")).select(F.lit("linux").alias("family"), "device_id", "interface", "mac_address")
    b = cli.freebsd_bridge_hosts(captures(spark, sf_dir, bsd)).select(F.lit("freebsd").alias("family"), "device_id", "interface", "mac_address")
    return a.unionByName(b)


@query(
    "bridge_names",
    """WITH n AS (SELECT p_partkey // 16 AS device_id, 'br' || (p_size % 12) AS name, min(p_partkey) AS first FROM part WHERE p_size % 5 <> 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY first) AS rn FROM n)
SELECT device_id, string_agg(name, ',' ORDER BY rn) AS linux, string_agg(name, ',' ORDER BY rn) AS freebsd FROM r GROUP BY device_id""",
)
def bridge_names(spark, sf_dir):
    name = "if(p_size % 5 = 0, 'bad;name', concat('br', p_size % 12))"
    a = captures(spark, sf_dir, f"concat('list name=', {name}, ' fdb 3')").select("device_id", F.array_join(cli.bridge_names(F.col("output")), ",").alias("linux"))
    b = captures(spark, sf_dir, f"concat(' ', {name}, ' ')").select("device_id", F.array_join(cli.freebsd_bridge_names(F.col("output")), ",").alias("freebsd"))
    return a.join(b, "device_id").where("linux <> ''")


@query(
    "config_documents",
    """SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN length(text) + 23 END AS xml_length, CASE doc_id % 4 WHEN 2 THEN 'no config in output' WHEN 3 THEN 'incomplete config' END AS xml_reason,
  CASE WHEN doc_id % 4 = 0 THEN length(text) + 27 WHEN doc_id % 4 = 1 THEN length(text) + 17 END AS paloalto_length,
  length(text) + 21 AS trimmed_length FROM documents""",
)
def config_documents(spark, sf_dir):
    opening = F.expr("case doc_id % 4 when 2 then '<nothing>' else '<opnsense>' end")
    closing = F.expr("if(doc_id % 4 = 3, '', '</opnsense>')")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("prompt # "), opening, "text", F.lit("  "), closing, F.lit(" exit")).alias("xml"),
        F.concat(F.expr("case doc_id % 4 when 0 then 'x <config version=1>' when 1 then 'y <config>' when 2 then 'z ' else '<config>' end"), "text", F.expr("if(doc_id % 4 = 3, '', '</config>')"), F.lit(" tail")).alias("pan"),
        F.concat(F.expr("if(doc_id % 2 = 0, 'FW # ', '')"), F.lit("#config-version=FGT60"), "text").alias("show"),
    )
    xml, reason = cli.xml_config(F.col("xml"), "opnsense")
    pan, _ = cli.paloalto_config(F.col("pan"))
    return rows.select(
        "doc_id", F.length(xml).alias("xml_length"), reason.alias("xml_reason"), F.length(pan).alias("paloalto_length"),
        F.length(cli.from_header(F.col("show"))).alias("trimmed_length"),
    )


@query(
    "image_checksums",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE md5(o_orderkey::VARCHAR) END AS checksum FROM orders",
)
def image_checksums(spark, sf_dir):
    pairs = "regexp_replace(md5(cast(o_orderkey as string)), '(..)', ' $1')"
    output = F.expr(f"concat('csum\\nimage: 00 11\\nis image:', if(o_orderstatus = 'P', substring({pairs}, 4), {pairs}), ' end')")
    return table(spark, sf_dir, "orders").select("o_orderkey", cli.image_checksum(output).alias("checksum"))


# -------------------------------------------------------------------------------------------------------- validation

SPEC = Spec(
    "opnsense",
    {
        "/part": {
            "size": Rule("int_range", minimum=5, maximum=40, required=True),
            "brand": Rule("enum", enum=("Brand#1", "Brand#2", "Brand#3"), required=True),
            "on": Rule("bool01"),
            "state": Rule("enable_disable"),
            "missing": Rule("enum", enum=("x",), required=True),
        },
        "/part/ip": {"local": Rule("address"), "pair": Rule("ip_mask"), "words": Rule("space_enum", enum=("red", "blue"))},
        "/tunnel": {"ike": Rule("proposal_ike"), "esp": Rule("proposal_esp")},
    },
    {"enc": ("aes256", "aes256gcm16"), "hash": ("sha256", "sha512"), "dh": ("modp2048", "ecp256"), "bare_esp": ("aes256gcm16",)},
)


@query(
    "rule_findings",
    """WITH p AS (SELECT *, '/api/part' || CASE WHEN p_partkey % 3 = 1 THEN '/ip' ELSE '' END AS path FROM part WHERE p_partkey % 3 < 2)
SELECT p_partkey AS step_no, 'size' AS field, p_size::VARCHAR AS value, 'outside range' AS reason FROM p WHERE p_partkey % 3 = 0 AND p_size NOT BETWEEN 5 AND 40
UNION ALL SELECT p_partkey, 'brand', p_brand, 'not in allowed set Brand#1|Brand#2|Brand#3' FROM p WHERE p_partkey % 3 = 0 AND p_brand NOT IN ('Brand#1', 'Brand#2', 'Brand#3')
UNION ALL SELECT p_partkey, 'state', 'on', 'must be "enable" or "disable"' FROM p WHERE p_partkey % 3 = 0 AND p_size % 2 = 0
UNION ALL SELECT p_partkey, 'missing', '', 'required field missing' FROM p WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, 'local', '%any', 'not a valid IP/CIDR/hostname (e.g. "%any" is rejected)' FROM p WHERE p_partkey % 3 = 1 AND p_size % 4 = 0
UNION ALL SELECT p_partkey, 'pair', '10.0.0.1 255.0.255.0', 'must be "<ipv4> <dotted-netmask>" (two tokens, contiguous mask)' FROM p WHERE p_partkey % 3 = 1 AND p_size % 3 = 0
UNION ALL SELECT p_partkey, 'words', 'red green', 'token green not in allowed set red|blue' FROM p WHERE p_partkey % 3 = 1 AND p_size % 5 = 0
UNION ALL SELECT p_partkey, '', '', 'body is not a JSON object' FROM part WHERE p_partkey % 3 = 2""",
)
def rule_findings(spark, sf_dir):
    body = F.expr(
        "case p_partkey % 3 when 0 then concat('{\"part\":{\"size\":', p_size, ',\"brand\":\"', p_brand, '\",\"on\":true,\"state\":\"', if(p_size % 2 = 0, 'on', 'enable'), '\"}}') "
        "when 1 then concat('{\"local\":\"', if(p_size % 4 = 0, '%any', '10.1.2.3, 10.0.0.0/8,host_a.example'), '\",\"pair\":\"10.0.0.1 ', if(p_size % 3 = 0, '255.0.255.0', '255.255.0.0'), '\",\"words\":\"', if(p_size % 5 = 0, 'red green', 'red  blue'), '\"}') "
        "else 'not json' end"
    )
    path = F.expr("concat('/api/part', if(p_partkey % 3 = 1, '/ip', ''))")
    steps = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("step_no"), path.alias("path"), body.alias("body"))
    return validation.validate(steps, SPEC).select("step_no", "field", "value", "reason")


@query(
    "cipher_proposals",
    """WITH v AS (SELECT p_partkey, (['aes256-sha256-modp2048', 'aes256gcm16-sha512-ecp256', 'des-sha256-modp2048', 'aes256-md5-modp2048', 'aes256-sha256', 'aes256gcm16', 'aes256gcm16-ecp256', 'aes256-sha256-x25519'])[p_partkey % 8 + 1] AS v, p_partkey % 8 AS c FROM part)
SELECT p_partkey, v AS proposal,
  CASE c WHEN 2 THEN 'unknown cipher des' WHEN 3 THEN 'middle term must be a bare hash, got md5' WHEN 4 THEN 'expected 3-part enc-<hash>-dh' WHEN 5 THEN 'expected 3-part enc-<hash>-dh' WHEN 6 THEN 'expected 3-part enc-<hash>-dh' WHEN 7 THEN 'unknown DH group x25519' END AS ike,
  CASE c WHEN 1 THEN 'AEAD ESP proposal is enc[-dh]' WHEN 2 THEN 'unknown cipher' WHEN 3 THEN 'unknown hash md5' WHEN 4 THEN 'bare aes256-sha256 is not a device-accepted no-PFS proposal' WHEN 7 THEN 'unknown DH group x25519' END AS esp,
  CASE c WHEN 0 THEN 'expected 2-part enc-<prf|hash>' WHEN 1 THEN 'expected 2-part enc-<prf|hash>' WHEN 2 THEN 'expected 2-part enc-<prf|hash>' WHEN 3 THEN 'expected 2-part enc-<prf|hash>' WHEN 5 THEN 'expected 2-part enc-<prf|hash>' WHEN 6 THEN 'AEAD IKE proposal needs a prf term, got ecp256' WHEN 7 THEN 'expected 2-part enc-<prf|hash>' END AS ike_two_part,
  CASE c WHEN 0 THEN 'CBC ESP proposal is enc-hash' WHEN 1 THEN 'AEAD ESP proposal is a single cipher token' WHEN 2 THEN 'unknown cipher' WHEN 3 THEN 'CBC ESP proposal is enc-hash' WHEN 6 THEN 'AEAD ESP proposal is a single cipher token' WHEN 7 THEN 'CBC ESP proposal is enc-hash' END AS esp_two_part FROM v""",
)
def cipher_proposals(spark, sf_dir):
    two = Spec("fortigate", SPEC.objects, SPEC.token_sets | {"prf": ("prfsha256",)})
    listed = "array('aes256-sha256-modp2048', 'aes256gcm16-sha512-ecp256', 'des-sha256-modp2048', 'aes256-md5-modp2048', 'aes256-sha256', 'aes256gcm16', 'aes256gcm16-ecp256', 'aes256-sha256-x25519')"
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(f"element_at({listed}, cast(p_partkey % 8 as int) + 1)").alias("proposal"))
    value = F.col("proposal")
    return rows.select(
        "p_partkey", "proposal", validation.ike_problem(SPEC, value).alias("ike"), validation.esp_problem(SPEC, value).alias("esp"),
        validation.ike_problem(two, value).alias("ike_two_part"), validation.esp_problem(two, value).alias("esp_two_part"),
    )


@query(
    "body_scalars",
    """SELECT p_partkey, p_size::VARCHAR AS whole, p_size || '.5' AS fraction, CASE WHEN p_size % 2 = 0 THEN '1' ELSE '0' END AS flag, '' AS nothing, 'true' AS text, '' AS nested FROM part""",
)
def body_scalars(spark, sf_dir):
    inner = "concat('{\"whole\":', p_size, '.0,\"fraction\":', p_size, '.5,\"flag\":', if(p_size % 2 = 0, 'true', 'false'), ',\"nothing\":null,\"text\":\"true\",\"nested\":[1]}')"
    body = F.expr(f"if(p_partkey % 2 = 0, concat('{{\"item\":', {inner}, '}}'), {inner})")
    rows = table(spark, sf_dir, "part").select("p_partkey", validation.body_fields(body).alias("f"))
    names = ["whole", "fraction", "flag", "nothing", "text", "nested"]
    return rows.select("p_partkey", *[F.coalesce(validation.scalar_text(F.try_element_at("f", F.lit(n))), F.lit("")).alias(n) for n in names])


# ----------------------------------------------------------------------------------------------------------- metrics


@query(
    "ping_summaries",
    "WITH " + EVENTS_SQL + """ SELECT device_id, us // 86400000000 AS day_no, count(*) AS sent, count(*) FILTER (event_type <> 'error') AS received, count(*) FILTER (event_type <> 'error') > 0 AS success,
  round(coalesce(avg(k) FILTER (event_type <> 'error'), 0), 9) AS latency, CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) / count(*) * 100 AS packet_loss,
  CASE WHEN count(*) FILTER (event_type <> 'error') = 0 THEN 'Request timeout' ELSE '' END AS error_message FROM e GROUP BY ALL""",
)
def ping_summaries(spark, sf_dir):
    echoes = events(spark, sf_dir).select(
        "device_id", F.expr("unix_micros(ts) div 86400000000").alias("day_no"), (F.col("event_type") != "error").alias("replied"), F.col("k").alias("latency_ms")
    )
    return metrics.ping_summary(echoes, keys=["device_id", "day_no"]).withColumn("latency", F.round("latency", 9))


@query(
    "operational_counters",
    """SELECT CASE WHEN o_orderstatus = 'P' THEN 'unknown' ELSE o_orderstatus END AS trigger, o_orderpriority AS quality, count(*) AS total FROM orders GROUP BY ALL""",
)
def operational_counters(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.expr("if(o_orderstatus = 'P', '', o_orderstatus)").alias("trigger"), F.col("o_orderpriority").alias("quality"))
    return metrics.counters(rows, labels=["trigger", "quality"])


@query(
    "poll_duration_histogram",
    "WITH " + EVENTS_SQL + """, b AS (SELECT unnest([0.01, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, 30, 1e300]::DOUBLE[]) AS bound, unnest(['0.01', '0.05', '0.1', '0.25', '0.5', '1', '2.5', '5', '10', '30', '+Inf']) AS le)
SELECT CASE WHEN event_type = 'error' THEN 'unknown' ELSE event_type END AS vendor, le, count(*) FILTER (value / 10 <= bound) AS n, count(*) AS count FROM e, b GROUP BY ALL""",
)
def poll_duration_histogram(spark, sf_dir):
    polls = events(spark, sf_dir).select(F.expr("if(event_type = 'error', '', event_type)").alias("vendor"), (F.col("value") / 10).alias("seconds"))
    return metrics.histogram(polls, labels=["vendor"]).drop("sum")


@query(
    "last_successful_poll",
    "WITH " + EVENTS_SQL + """ SELECT c_custkey AS device_id, coalesce(max(us) FILTER (event_type = 'view') // 1000000, 0) AS last_success FROM customer LEFT JOIN e ON device_id = c_custkey GROUP BY c_custkey""",
)
def last_successful_poll(spark, sf_dir):
    devices = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return metrics.last_success(events(spark, sf_dir), devices, ok=F.col("event_type") == "view")


@query(
    "operational_counter_families",
    "WITH " + EVENTS_SQL + """, f AS (
  SELECT 'poll_failures' AS family, CAST(device_id AS VARCHAR) AS subject, CASE WHEN k % 3 = 0 THEN 'unknown' ELSE 'vendor' || (k % 3) END AS kind, CASE WHEN k % 4 = 0 THEN 'timeout' ELSE 'refused' END AS reason FROM e WHERE event_type = 'error'
  UNION ALL SELECT 'limiter_drops', event_type, CASE WHEN k % 2 = 0 THEN 'source' ELSE 'total' END, 'unknown' FROM e WHERE event_type IN ('view', 'click')
  UNION ALL SELECT 'sends', CAST(l_linenumber AS VARCHAR), l_returnflag, 'ok' FROM lineitem WHERE l_linestatus = 'O'
  UNION ALL SELECT 'failed_sends', CAST(l_linenumber AS VARCHAR), l_returnflag, CASE WHEN l_linenumber = 1 THEN 'permanent' ELSE 'transient' END FROM lineitem WHERE l_linestatus = 'F')
SELECT *, count(*) AS total FROM f GROUP BY ALL""",
)
def operational_counter_families(spark, sf_dir):
    """Poll failures, limiter drops, sends and failed sends, each counted by its own labels."""
    e, lines = events(spark, sf_dir), table(spark, sf_dir, "lineitem")
    status = F.expr("if(l_linenumber = 1, 400, 503)")
    families = {
        "poll_failures": e.where("event_type = 'error'").select(
            F.col("device_id").cast("string").alias("subject"), F.expr("if(k % 3 = 0, '', concat('vendor', k % 3))").alias("kind"), F.expr("if(k % 4 = 0, 'timeout', 'refused')").alias("reason")
        ),
        "limiter_drops": e.where("event_type in ('view', 'click')").select(
            F.col("event_type").alias("subject"), F.expr("if(k % 2 = 0, 'source', 'total')").alias("kind"), F.lit(None).cast("string").alias("reason")
        ),
        "sends": lines.where("l_linestatus = 'O'").select(F.col("l_linenumber").cast("string").alias("subject"), F.col("l_returnflag").alias("kind"), F.lit("ok").alias("reason")),
        "failed_sends": lines.where("l_linestatus = 'F'").select(F.col("l_linenumber").cast("string").alias("subject"), F.col("l_returnflag").alias("kind"), text.delivery_class(status).alias("reason")),
    }
    counted = [metrics.counters(rows.withColumn("family", F.lit(name)), labels=["family", "subject", "kind", "reason"]) for name, rows in families.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2]).unionByName(counted[3])
