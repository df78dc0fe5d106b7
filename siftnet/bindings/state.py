"""Stateful operators on the event stream. Windows are hours here, because the events are minutes to hours apart."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftnet.bindings.registry import EVENTS_SQL, events, query, table
from siftnet.operators import admission, datagrams, dedup, flows, polls, segments, sequence, snapshots, throughput, triggers

HOUR_US = 3_600_000_000


def micros(name: str):
    return F.unix_micros(name)


# ---------------------------------------------------------------------------------------------------- dual export


def exported(spark, sf_dir):
    """Views and signups arrive as NetFlow, clicks as sFlow, the rest by neither."""
    family = F.when(F.col("event_type").isin("view", "signup"), "netflow").when(F.col("event_type") == "click", "sflow")
    address = F.concat(F.lit("10.0.0."), (F.col("device_id") % 256).cast("string"))
    return events(spark, sf_dir).select(
        "arrival_no",
        "ts",
        "value",
        dedup.dedup_key(F.col("device_id"), address).alias("dedup_key"),
        family.alias("_f"),
        F.coalesce(family, F.lit("other")).alias("family"),
    ).drop("_f")


_EXPORTED_SQL = (
    "WITH "
    + EVENTS_SQL
    + """, x AS (
  SELECT arrival_no, us, value,
         CASE WHEN device_id <> 0 THEN 'dev:' || device_id ELSE 'ip:10.0.0.' || (device_id % 256) END AS dedup_key,
         CASE WHEN event_type IN ('view', 'signup') THEN 'netflow' WHEN event_type = 'click' THEN 'sflow'
              ELSE 'other' END AS family
  FROM e),
marked AS (
  SELECT *, family = 'sflow' AND coalesce(us - heard < 43200000000, false) AS suppressed
  FROM (SELECT *, max(us) FILTER (family = 'netflow')
               OVER (PARTITION BY dedup_key ORDER BY arrival_no ROWS UNBOUNDED PRECEDING) AS heard FROM x)),
marked_sflow AS (
  SELECT *, family = 'netflow' AND coalesce(us - heard < 43200000000, false) AS suppressed
  FROM (SELECT *, max(us) FILTER (family = 'sflow')
               OVER (PARTITION BY dedup_key ORDER BY arrival_no ROWS UNBOUNDED PRECEDING) AS heard FROM x))
"""
)
WINDOW_SECONDS = 12 * 3600


@query("dual_export_marks", _EXPORTED_SQL + "SELECT arrival_no, dedup_key, family, suppressed FROM marked")
def dual_export_marks(spark, sf_dir):
    marked = dedup.mark_duplicates(exported(spark, sf_dir), "prefer-netflow", window_seconds=WINDOW_SECONDS)
    return marked.select("arrival_no", "dedup_key", "family", "suppressed")


@query("dual_export_prefer_sflow", _EXPORTED_SQL + "SELECT arrival_no, dedup_key, family FROM marked_sflow WHERE NOT suppressed")
def dual_export_prefer_sflow(spark, sf_dir):
    kept = dedup.deduplicate(exported(spark, sf_dir), "prefer-sflow", window_seconds=WINDOW_SECONDS)
    return kept.select("arrival_no", "dedup_key", "family")


@query(
    "dual_export_volume",
    _EXPORTED_SQL
    + """SELECT dedup_key, family, count(*) AS flow_count, CAST(sum(CAST(floor(value * 1000) AS BIGINT)) AS BIGINT) AS byte_count
FROM marked WHERE NOT suppressed GROUP BY ALL""",
)
def dual_export_volume(spark, sf_dir):
    kept = dedup.deduplicate(exported(spark, sf_dir), "prefer-netflow", window_seconds=WINDOW_SECONDS)
    return kept.groupBy("dedup_key", "family").agg(
        F.count("*").alias("flow_count"), F.sum(F.floor(F.col("value") * 1000)).cast("bigint").alias("byte_count")
    )


@query(
    "dual_export_state_changes",
    _EXPORTED_SQL
    + """SELECT arrival_no, dedup_key, family, suppressed FROM (
  SELECT *, lag(suppressed, 1, false) OVER (PARTITION BY dedup_key, family ORDER BY arrival_no) AS was FROM marked)
WHERE suppressed <> was""",
)
def dual_export_state_changes(spark, sf_dir):
    marked = dedup.mark_duplicates(exported(spark, sf_dir), "prefer-netflow", window_seconds=WINDOW_SECONDS)
    return dedup.suppression_changes(marked).select("arrival_no", "dedup_key", "family", "suppressed")


@query("dual_export_suppressed_counts", _EXPORTED_SQL + "SELECT family, count(*) AS suppressed_rows FROM marked WHERE suppressed GROUP BY ALL")
def dual_export_suppressed_counts(spark, sf_dir):
    marked = dedup.mark_duplicates(exported(spark, sf_dir), "prefer-netflow", window_seconds=WINDOW_SECONDS)
    return dedup.suppressed_counts(marked)


# ----------------------------------------------------------------------------------------------- sequence numbers


def export_headers(spark, sf_dir):
    """Headers whose sequence counts k units per datagram, loses 7 units with every error and jumps after outliers."""
    rows = events(spark, sf_dir)
    lost = F.when(F.col("event_type") == "error", 7).otherwise(0)
    jump = F.when(F.col("value") > 250, 1 << 25).otherwise(0)
    step = (F.col("k") + lost + jump).cast("bigint")
    summed = segments.finish(segments.scan(rows, ["device_id"], "arrival_no", running_sum={"_sum": step}))
    return summed.select(
        "arrival_no",
        F.col("device_id").alias("exporter"),
        F.lit(0).cast("bigint").alias("domain"),
        F.lit(5).alias("version"),
        F.pmod(F.col("_sum") - step + 4294967000, F.lit(1 << 32)).cast("bigint").alias("sequence"),
        F.col("k").alias("increment"),
        F.pmod(F.floor(F.unix_micros("ts") / 1000), F.lit(604800000)).cast("bigint").alias("uptime_ms"),
        (F.col("event_type") != "signup").alias("countable"),
    )


_SEQUENCE_SQL = (
    "WITH "
    + EVENTS_SQL
    + """, s AS (
  SELECT *, k + CASE WHEN event_type = 'error' THEN 7 ELSE 0 END + CASE WHEN value > 250 THEN 33554432 ELSE 0 END AS step
  FROM e),
h AS (
  SELECT arrival_no, device_id AS exporter, k AS increment, (us // 1000) % 604800000 AS uptime_ms,
         event_type <> 'signup' AS countable,
         (sum(step) OVER (PARTITION BY device_id ORDER BY arrival_no) - step + 4294967000) % 4294967296 AS sequence
  FROM s),
l AS (
  SELECT *, lag(sequence) OVER w AS ps, lag(increment) OVER w AS pi, lag(uptime_ms) OVER w AS pu, lag(countable) OVER w AS pc
  FROM h WINDOW w AS (PARTITION BY exporter ORDER BY arrival_no)),
d AS (SELECT *, (sequence - (ps + pi) % 4294967296 + 4294967296) % 4294967296 AS delta FROM l),
judged AS (
  SELECT arrival_no, exporter, CASE WHEN ps IS NULL OR NOT pc OR delta = 0 THEN NULL
         WHEN uptime_ms < pu OR delta >= 16777216 THEN 'seq_resync' ELSE 'seq_gap' END AS event, delta FROM d)
"""
)


@query(
    "sequence_loss_events",
    _SEQUENCE_SQL
    + """SELECT arrival_no, exporter, event, CAST(CASE WHEN event = 'seq_gap' THEN delta ELSE 0 END AS BIGINT) AS lost_units
FROM judged WHERE event IS NOT NULL""",
)
def sequence_loss_events(spark, sf_dir):
    judged = sequence.sequence_events(export_headers(spark, sf_dir))
    return judged.where("event is not null").select("arrival_no", "exporter", "event", "lost_units")


@query(
    "sequence_loss_by_exporter",
    _SEQUENCE_SQL
    + """SELECT exporter, count(*) FILTER (event = 'seq_gap') AS gaps, count(*) FILTER (event = 'seq_resync') AS resyncs,
  CAST(sum(CASE WHEN event = 'seq_gap' THEN delta ELSE 0 END) AS BIGINT) AS lost_units FROM judged GROUP BY exporter""",
)
def sequence_loss_by_exporter(spark, sf_dir):
    judged = sequence.sequence_events(export_headers(spark, sf_dir))
    return sequence.sequence_loss(judged).drop("domain", "version")


# ------------------------------------------------------------------------------------------------------ throughput

COUNTER_WRAP = 500_000_000_000


def interface_samples(spark, sf_dir, late: bool):
    """Daily polls of one counter per event type; the counter wraps. With ``late``, polls that saw an outlier carry a
    time three days back."""
    rows = events(spark, sf_dir)
    summed = segments.finish(
        segments.scan(
            rows, ["device_id", "event_type"], "arrival_no", running_sum={"_sum": F.floor(F.col("value") * 1000000000)}
        )
    )
    day = F.date_trunc("day", F.col("ts"))
    samples = summed.groupBy("device_id", "event_type", day.alias("day")).agg(
        F.max_by("_sum", "arrival_no").alias("_sum"), F.max("value").alias("_peak")
    )
    number = F.floor(F.unix_micros("day") / F.lit(24 * HOUR_US)).cast("bigint")
    shifted = F.col("day")
    if late:
        seen = samples.groupBy("device_id", "day").agg(F.max("_peak").alias("_poll_peak"))
        samples = samples.join(seen, ["device_id", "day"])
        shifted = F.when(F.col("_poll_peak") > 100, F.expr("day - interval 3 days")).otherwise(F.col("day"))
    kind = F.col("event_type")
    return samples.select(
        "device_id",
        number.alias("poll_arrival"),
        shifted.alias("poll_ts"),
        F.when(kind == "view", 1).when(kind == "click", 2).when(kind == "purchase", 3).when(kind == "signup", 4).otherwise(5).alias("if_index"),
        F.when(kind == "error", 131).otherwise(6).alias("if_type"),
        F.pmod(F.col("_sum"), F.lit(COUNTER_WRAP)).cast("bigint").alias("in_bytes"),
        F.pmod(F.col("_sum") * 3, F.lit(COUNTER_WRAP)).cast("bigint").alias("out_bytes"),
        F.when(kind == "view", 2).when(kind == "click", 4).when(kind == "signup", 5).otherwise(0).cast("bigint").alias("high_speed"),
    )


def _throughput_sql(late: bool) -> str:
    shift = "CASE WHEN poll_peak > 100 THEN day - 259200000000 ELSE day END" if late else "day"
    return f"""WITH {EVENTS_SQL}, r AS (
  SELECT *, sum(CAST(floor(value * 1000000000) AS BIGINT)) OVER (PARTITION BY device_id, event_type ORDER BY arrival_no) AS total,
         us // 86400000000 * 86400000000 AS day FROM e),
s AS (SELECT device_id, event_type, day, arg_max(total, arrival_no) AS total, max(value) AS peak FROM r GROUP BY ALL),
p AS (SELECT device_id, day, max(peak) AS poll_peak FROM s GROUP BY ALL),
polls AS (
  SELECT device_id, day // 86400000000 AS poll_arrival, day, {shift} AS poll_us,
         max({shift}) OVER (PARTITION BY device_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_us
  FROM p),
judged AS (SELECT *, prev_us IS NULL OR poll_us > prev_us AS accepted FROM polls),
i AS (
  SELECT j.device_id, j.poll_arrival, j.poll_us, j.prev_us, event_type, total % 500000000000 AS i, (total * 3) % 500000000000 AS o,
         CASE event_type WHEN 'view' THEN 2 WHEN 'click' THEN 4 WHEN 'signup' THEN 5 ELSE 0 END AS hs
  FROM s JOIN judged j ON s.device_id = j.device_id AND s.day = j.day AND j.accepted AND event_type <> 'error'),
rates AS (
  SELECT a.device_id, a.poll_arrival,
    sum(CASE WHEN a.i >= b.i AND (a.poll_us - a.prev_us) / 1e6 > 5 THEN (a.i - b.i)::DOUBLE * 8 / ((a.poll_us - a.prev_us) / 1e6) / 1000 ELSE 0 END) AS ik,
    sum(CASE WHEN a.o >= b.o AND (a.poll_us - a.prev_us) / 1e6 > 5 THEN (a.o - b.o)::DOUBLE * 8 / ((a.poll_us - a.prev_us) / 1e6) / 1000 ELSE 0 END) AS ok,
    sum(a.hs) * 1000 AS cap
  FROM i a LEFT JOIN i b ON a.device_id = b.device_id AND a.event_type = b.event_type AND b.poll_us = a.prev_us GROUP BY ALL),
own AS (
  SELECT j.*, CASE WHEN cap > 0 AND ik > cap THEN 0 ELSE coalesce(ik, 0) END AS ik,
         CASE WHEN cap > 0 AND ok > cap THEN 0 ELSE coalesce(ok, 0) END AS ok
  FROM judged j LEFT JOIN rates r ON j.device_id = r.device_id AND j.poll_arrival = r.poll_arrival)
SELECT device_id, poll_arrival, accepted,
  round(last_value(CASE WHEN accepted THEN ik END IGNORE NULLS) OVER w, 6) AS in_kbps,
  round(last_value(CASE WHEN accepted THEN ok END IGNORE NULLS) OVER w, 6) AS out_kbps
FROM own WINDOW w AS (PARTITION BY device_id ORDER BY poll_arrival ROWS UNBOUNDED PRECEDING)"""


def _throughput(spark, sf_dir, late):
    rates = throughput.device_throughput(interface_samples(spark, sf_dir, late))
    return rates.select(
        "device_id", "poll_arrival", "accepted", F.round("in_kbps", 6).alias("in_kbps"), F.round("out_kbps", 6).alias("out_kbps")
    )


@query("device_throughput", _throughput_sql(False))
def device_throughput(spark, sf_dir):
    return _throughput(spark, sf_dir, False)


@query("late_poll_guard", _throughput_sql(True))
def late_poll_guard(spark, sf_dir):
    return _throughput(spark, sf_dir, True)


_ASOF_SQL = (
    "WITH "
    + EVENTS_SQL
    + """, t AS (
  SELECT *, last_value(CASE WHEN event_type = 'view' THEN us END IGNORE NULLS) OVER w AS seen,
         last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER w AS seen_value,
         last_value(CASE WHEN event_type = 'view' THEN k END IGNORE NULLS) OVER w AS seen_k
  FROM e WINDOW w AS (PARTITION BY device_id ORDER BY arrival_no ROWS UNBOUNDED PRECEDING))
"""
)


@query(
    "fresh_throughput_lookup",
    _ASOF_SQL
    + """SELECT device_id, arrival_no, CASE WHEN us - seen <= 86400000000 THEN seen_value ELSE 0 END AS in_kbps,
  CASE WHEN us - seen <= 86400000000 THEN seen_value * 2 ELSE 0 END AS out_kbps FROM t WHERE event_type = 'purchase'""",
)
def fresh_throughput_lookup(spark, sf_dir):
    rows = events(spark, sf_dir)
    requests = rows.where("event_type = 'purchase'").select("device_id", "ts", "arrival_no")
    rates = rows.where("event_type = 'view'").select(
        "device_id", "ts", "arrival_no", F.col("value").alias("in_kbps"), (F.col("value") * 2).alias("out_kbps")
    )
    return throughput.cached_throughput(requests, rates, poll_seconds=8 * 3600).drop("ts")


@query(
    "coherent_vitals",
    _ASOF_SQL
    + """SELECT device_id, arrival_no, coalesce(us - seen <= 86400000000, false) AS from_poll,
  CASE WHEN us - seen <= 86400000000 THEN seen_value ELSE value + 1 + 2 + 0 + 0 + 0 END AS cpu_usage,
  CASE WHEN us - seen <= 86400000000 THEN seen_value / 2 ELSE value END AS memory_usage,
  CASE WHEN us - seen <= 86400000000 THEN seen_value / 4 ELSE 0 END AS disk_usage,
  CASE WHEN us - seen <= 86400000000 THEN seen_k * 1024 ELSE 0 END AS disk_total,
  CASE WHEN us - seen <= 86400000000 THEN seen_k ELSE k END AS session_count FROM t WHERE event_type = 'purchase'""",
)
def coherent_vitals(spark, sf_dir):
    rows = events(spark, sf_dir)
    head = ["device_id", "ts", "arrival_no"]
    split = rows.where("event_type = 'purchase'").select(
        *head, "value", "k", F.col("value").alias("cpu_user"), F.lit(1.0).alias("cpu_system"), F.lit(2.0).alias("cpu_nice"),
        *[F.lit(None).cast("double").alias(c) for c in ("cpu_iowait", "cpu_irq", "cpu_softirq")],
    )
    performance = split.select(
        *head,
        throughput.performance_cpu().alias("cpu_usage"),
        F.col("value").alias("memory_usage"),
        F.lit(0.0).alias("disk_usage"),
        F.lit(0).cast("bigint").alias("disk_total"),
        F.col("k").alias("session_count"),
    )
    polled = rows.where("event_type = 'view'").select(
        *head,
        F.col("value").alias("cpu_usage"),
        (F.col("value") / 2).alias("memory_usage"),
        (F.col("value") / 4).alias("disk_usage"),
        (F.col("k") * 1024).alias("disk_total"),
        F.col("k").alias("session_count"),
    )
    return throughput.coherent_vitals(performance, polled, poll_seconds=8 * 3600).drop("ts")


@query(
    "assigned_devices_only",
    "WITH " + EVENTS_SQL + """ SELECT arrival_no, device_id FROM e
WHERE device_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""",
)
def assigned_devices_only(spark, sf_dir):
    devices = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"))
    return throughput.assigned_only(events(spark, sf_dir), devices).select("arrival_no", "device_id")


# -------------------------------------------------------------------------------------------------------- triggers

_BURST_SQL = (
    "WITH RECURSIVE "
    + EVENTS_SQL
    + """, g AS (
  SELECT *, us - lag(us) OVER w AS gap FROM e WINDOW w AS (PARTITION BY device_id, event_type ORDER BY arrival_no)),
n AS (
  SELECT *, sum(CASE WHEN gap IS NULL OR gap > 21600000000 THEN 1 ELSE 0 END)
            OVER (PARTITION BY device_id, event_type ORDER BY arrival_no) AS burst FROM g),
bursts AS (
  SELECT device_id, event_type, min(arrival_no) AS first_arrival, max(arrival_no) AS last_arrival,
         count(*) AS event_count, max(us) + 21600000000 AS fire_us FROM n GROUP BY device_id, event_type, burst)
"""
)


def bursts(spark, sf_dir):
    return triggers.debounce(events(spark, sf_dir), keys=["device_id", "event_type"], gap_seconds=6 * 3600)


@query("debounced_triggers", _BURST_SQL + "SELECT * FROM bursts")
def debounced_triggers(spark, sf_dir):
    return bursts(spark, sf_dir).select(
        "device_id", "event_type", "first_arrival", "last_arrival", "event_count", micros("fire_ts").alias("fire_us")
    )


def _spaced_sql(source: str, key: str, clock: str, arrival: str, gap: int) -> str:
    """Accepted rows of a minimum-spacing rule, one recursion step per accepted row."""
    return f""", a AS (
  SELECT {key} AS key, min({arrival}) AS arrival FROM {source} GROUP BY 1
  UNION ALL
  SELECT a.key, (SELECT min(n.{arrival}) FROM {source} n WHERE n.{key} = a.key AND n.{arrival} > a.arrival
                 AND n.{clock} >= (SELECT {clock} FROM {source} c WHERE c.{key} = a.key AND c.{arrival} = a.arrival) + {gap})
  FROM a WHERE a.arrival IS NOT NULL)
"""


@query(
    "throttled_triggers",
    _BURST_SQL
    + _spaced_sql("bursts", "device_id", "fire_us", "last_arrival", 12 * HOUR_US)
    + "SELECT device_id, last_arrival, fire_us, a.arrival IS NOT NULL AS accepted FROM bursts b LEFT JOIN a ON a.key = device_id AND a.arrival = last_arrival",
)
def throttled_triggers(spark, sf_dir):
    fired = bursts(spark, sf_dir).select("device_id", "last_arrival", "fire_ts")
    marked = admission.accept_spaced(fired, keys=["device_id"], gap_seconds=12 * 3600, ts="fire_ts", arrival="last_arrival")
    return marked.select("device_id", "last_arrival", micros("fire_ts").alias("fire_us"), "accepted")


_SPACED_EVENTS_SQL = "WITH RECURSIVE " + EVENTS_SQL


@query(
    "due_polls",
    _SPACED_EVENTS_SQL
    + _spaced_sql("e", "device_id", "us", "arrival_no", 24 * HOUR_US)
    + "SELECT device_id, arrival_no FROM e JOIN a ON a.key = device_id AND a.arrival = arrival_no",
)
def due_polls(spark, sf_dir):
    marked = polls.due_polls(events(spark, sf_dir).select("device_id", "ts", "arrival_no"), interval_seconds=24 * 3600)
    return marked.where("due").select("device_id", "arrival_no")


@query(
    "minimum_request_interval",
    _SPACED_EVENTS_SQL
    + ", v AS (SELECT arrival_no, us, event_type || '/' || (device_id % 16) AS src FROM e)"
    + _spaced_sql("v", "src", "us", "arrival_no", HOUR_US)
    + "SELECT src, arrival_no, a.arrival IS NOT NULL AS accepted FROM v LEFT JOIN a ON a.key = src AND a.arrival = arrival_no",
)
def minimum_request_interval(spark, sf_dir):
    source = F.concat("event_type", F.lit("/"), (F.col("device_id") % 16).cast("string"))
    requests = events(spark, sf_dir).select("arrival_no", "ts", source.alias("src"))
    return admission.accept_spaced(requests, keys=["src"], gap_seconds=3600).select("src", "arrival_no", "accepted")


@query(
    "token_bucket_admission",
    "WITH RECURSIVE "
    + EVENTS_SQL
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY arrival_no) AS rn FROM e),
b AS (
  SELECT device_id, arrival_no, rn, us, true AS accepted, CAST(21600000000 AS BIGINT) AS tokens FROM n WHERE rn = 1
  UNION ALL
  SELECT device_id, arrival_no, rn, us, filled >= 21600000000, CASE WHEN filled >= 21600000000 THEN filled - 21600000000 ELSE filled END
  FROM (SELECT n.device_id, n.arrival_no, n.rn, n.us, least(43200000000, b.tokens + n.us - b.us) AS filled
        FROM b JOIN n ON n.device_id = b.device_id AND n.rn = b.rn + 1))
SELECT device_id, arrival_no, accepted FROM b""",
)
def token_bucket_admission(spark, sf_dir):
    rows = events(spark, sf_dir).select("device_id", "arrival_no", "ts")
    marked = admission.token_bucket(rows, keys=["device_id"], rate=1, per_seconds=6 * 3600, burst=2)
    return marked.select("device_id", "arrival_no", "accepted")


@query(
    "rate_ceiling_report",
    "WITH "
    + EVENTS_SQL
    + """, s AS (SELECT event_type AS listener, device_id, us // 1000000 AS sec, count(*) AS n FROM e GROUP BY ALL)
SELECT listener, sec AS second_no, CAST(sum(n) AS BIGINT) AS events, count(*) FILTER (n > 1) AS sources_over, sum(n) > 1 AS over_ceiling
FROM s GROUP BY ALL""",
)
def rate_ceiling_report(spark, sf_dir):
    rows = events(spark, sf_dir).withColumnRenamed("event_type", "listener")
    limits = rows.select("listener").distinct().withColumn("source_rate", F.lit(1)).withColumn("total_rate", F.lit(1))
    report = admission.rate_report(rows, listener="listener", source="device_id", limits=limits)
    return report.select("listener", F.unix_seconds("second").alias("second_no"), "events", "sources_over", "over_ceiling")


# ------------------------------------------------------------------------------------------------------- snapshots


@query(
    "latest_snapshot",
    """SELECT o_custkey, o_orderstatus, o_orderkey FROM (
  SELECT *, rank() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC) AS r FROM orders) WHERE r = 1""",
)
def latest_snapshot(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    latest = snapshots.latest_snapshot(orders, keys=["o_custkey", "o_orderstatus"], ts="o_orderdate")
    return latest.select("o_custkey", "o_orderstatus", "o_orderkey")


_CAP_SQL = """WITH t AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'arp' ELSE 'fdb' END AS entry_type FROM orders)
"""


def capped(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "F", "arp").otherwise("fdb")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", kind.alias("entry_type"))


@query(
    "topology_cap",
    _CAP_SQL
    + """SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY entry_type, o_orderkey) <= 7""",
)
def topology_cap(spark, sf_dir):
    return snapshots.cap_rows(capped(spark, sf_dir), keys=["o_custkey"], order="o_orderkey", cap=7)


@query(
    "topology_cap_report",
    _CAP_SQL
    + """SELECT o_custkey, least(count(*), 7) AS kept, least(count(*) FILTER (entry_type = 'arp'), 7) AS kept_first,
  greatest(count(*) - 7, 0) AS dropped FROM t GROUP BY ALL""",
)
def topology_cap_report(spark, sf_dir):
    return snapshots.cap_report(capped(spark, sf_dir), keys=["o_custkey"], cap=7)


# ------------------------------------------------------------------------------------------------ template lifetime


@query(
    "template_as_of",
    "WITH "
    + EVENTS_SQL
    + """, t AS (
  SELECT *, us - lag(us) OVER w > 86400000000 AS idle FROM e WINDOW w AS (PARTITION BY device_id ORDER BY arrival_no)),
s AS (
  SELECT *, last_value(CASE WHEN event_type = 'signup' THEN k WHEN idle THEN -1 END IGNORE NULLS)
            OVER (PARTITION BY device_id ORDER BY arrival_no ROWS UNBOUNDED PRECEDING) AS state FROM t)
SELECT arrival_no, device_id, CASE WHEN state >= 0 THEN state END AS template_length,
  CASE WHEN coalesce(state, -1) < 0 THEN 'data_before_template' END AS event FROM s WHERE event_type <> 'signup'""",
)
def template_as_of(spark, sf_dir):
    rows = events(spark, sf_dir).select(
        F.col("device_id").alias("exporter"), F.lit(0).alias("domain"), F.lit(256).alias("set_id"),
        (F.col("arrival_no") * datagrams.SETS_PER_DATAGRAM).alias("set_order"), F.col("ts").alias("recv_ts"), "arrival_no",
        "event_type", "k",
    )
    field = F.array(F.struct(F.lit(1).alias("ie"), F.col("k").cast("int").alias("length"), F.lit(0).alias("pen")))
    announced = rows.where("event_type = 'signup'").select(
        "exporter", "domain", F.col("set_id").alias("template_id"), "set_order", "recv_ts", field.alias("fields"),
        F.lit(False).alias("is_options"),
    )
    data = rows.where("event_type <> 'signup'").drop("event_type", "k")
    matched = datagrams.with_templates(data, announced, idle_seconds=24 * 3600)
    return matched.select(
        "arrival_no",
        F.col("exporter").alias("device_id"),
        F.get("fields", F.lit(0))["length"].cast("bigint").alias("template_length"),
        "event",
    )


@query(
    "idle_template_expiry",
    "WITH "
    + EVENTS_SQL
    + """ SELECT device_id, arrival_no FROM e
QUALIFY us - lag(us) OVER (PARTITION BY device_id ORDER BY arrival_no) > 43200000000""",
)
def idle_template_expiry(spark, sf_dir):
    touches = events(spark, sf_dir).select("device_id", "arrival_no", "ts")
    expired = datagrams.idle_expiries(touches, keys=["device_id"], order="arrival_no", ts="ts", idle_seconds=12 * 3600)
    return expired.select("device_id", "arrival_no")


@query(
    "orphaned_rate_sweep",
    """SELECT s_suppkey AS exporter, s_nationkey AS domain, s_acctbal AS rate FROM supplier
WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = s_suppkey AND c_nationkey = s_nationkey)
   OR s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey = s_suppkey)""",
)
def orphaned_rate_sweep(spark, sf_dir):
    rates = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("exporter"), F.col("s_nationkey").alias("domain"), F.col("s_acctbal").alias("rate")
    )
    live = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("exporter"), F.col("c_nationkey").alias("domain"))
    return flows.live_rates(rates, live).select("exporter", "domain", "rate")


# ------------------------------------------------------------------------------------------------------------ polls


def poll_log(spark, sf_dir):
    outcome = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "click", "skipped").when(
        F.col("event_type") == "signup", "fail").otherwise("ok")
    return events(spark, sf_dir).withColumn("outcome", outcome)


@query(
    "poll_failure_streaks",
    "WITH "
    + EVENTS_SQL
    + """, p AS (SELECT *, event_type IN ('view', 'purchase') AS ok FROM e),
i AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY device_id ORDER BY arrival_no) AS island FROM p),
n AS (SELECT *, count(*) FILTER (NOT ok) OVER (PARTITION BY device_id, island ORDER BY arrival_no) AS failures FROM i),
b AS (SELECT *, coalesce(lag(failures) OVER (PARTITION BY device_id ORDER BY arrival_no), 0) AS before FROM n)
SELECT device_id, arrival_no, failures, before >= 3 AND before % 5 <> 0 AS expected_skip FROM b""",
)
def poll_failure_streaks(spark, sf_dir):
    streaks = polls.failure_streaks(poll_log(spark, sf_dir))
    return streaks.select("device_id", "arrival_no", F.col("failures").cast("bigint").alias("failures"), "expected_skip")


@query(
    "every_fifth_poll",
    "WITH "
    + EVENTS_SQL
    + """ SELECT device_id, arrival_no, rn AS poll_no FROM (
  SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY arrival_no) - 1 AS rn FROM e) WHERE rn % 5 = 0""",
)
def every_fifth_poll(spark, sf_dir):
    return polls.every_nth_poll(events(spark, sf_dir)).select("device_id", "arrival_no", "poll_no")


@query(
    "command_results",
    "WITH "
    + EVENTS_SQL
    + """, d AS (
  SELECT arrival_no, CASE WHEN k = 0 THEN '' ELSE device_id || '-' || (k // 10) END AS command_id, event_type,
         us > us // 86400000000 * 86400000000 + 72000000000 AS expired, value, us FROM e),
f AS (
  SELECT *, CASE WHEN expired OR event_type = 'signup' OR value > 100 THEN 'failed' ELSE 'succeeded' END AS own_status,
    CASE WHEN expired THEN 'command expired before execution' WHEN event_type = 'signup' THEN 'unknown command type "signup"'
         ELSE event_type || ' done' END AS own_result FROM d WHERE command_id <> '')
SELECT command_id, arrival_no, arg_min(own_status, arrival_no) OVER w AS status, arg_min(own_result, arrival_no) OVER w AS result,
  arrival_no <> min(arrival_no) OVER w AS redelivery
FROM f WINDOW w AS (PARTITION BY command_id)""",
)
def command_results(spark, sf_dir):
    rows = events(spark, sf_dir)
    limit = F.expr("date_trunc('day', ts) + interval 20 hours")
    deliveries = rows.select(
        "arrival_no",
        "ts",
        F.when(F.col("k") == 0, "")
        .otherwise(F.concat(F.col("device_id").cast("string"), F.lit("-"), F.expr("cast(k div 10 as string)")))
        .alias("command_id"),
        F.col("event_type").alias("type"),
        limit.alias("expires_at"),
        F.when(F.col("value") > 100, "error").otherwise("ok").alias("outcome"),
        F.concat("event_type", F.lit(" done")).alias("detail"),
    )
    return polls.command_results(deliveries, known_types=["view", "click", "purchase", "error"])


@query(
    "host_key_changes",
    "WITH "
    + EVENTS_SQL
    + """, f AS (SELECT *, event_type AS fingerprint FROM e WHERE event_type <> 'error'),
l AS (SELECT *, lag(fingerprint) OVER (PARTITION BY device_id ORDER BY arrival_no) AS previous FROM f)
SELECT device_id, arrival_no, previous, fingerprint FROM l WHERE previous <> fingerprint""",
)
def host_key_changes(spark, sf_dir):
    return polls.host_key_changes(fingerprints(spark, sf_dir)).select("device_id", "arrival_no", "previous", "fingerprint")


def fingerprints(spark, sf_dir):
    text = F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type"))
    return events(spark, sf_dir).withColumn("fingerprint", text)


@query(
    "observed_host_keys",
    "WITH " + EVENTS_SQL + """ SELECT device_id, arg_max(event_type, arrival_no) AS fingerprint FROM e
WHERE event_type <> 'error' GROUP BY device_id""",
)
def observed_host_keys(spark, sf_dir):
    return polls.observed_host_keys(fingerprints(spark, sf_dir))


@query(
    "probe_readiness",
    "WITH "
    + EVENTS_SQL
    + """, l AS (
  SELECT device_id, arg_max(event_type, arrival_no) AS event_type, arg_max(us, arrival_no) AS us, arg_max(k, arrival_no) AS k
  FROM e GROUP BY device_id),
c AS (
  SELECT device_id, k >= 20 AS approved, event_type <> 'purchase' AND (SELECT max(us) FROM e) - us <= 43200000000 AS heartbeat_fresh,
         event_type <> 'click' AS listening FROM l)
SELECT device_id, heartbeat_fresh, CASE WHEN NOT approved THEN 'approved' WHEN NOT heartbeat_fresh THEN 'heartbeat'
  WHEN NOT listening THEN 'listeners' ELSE '' END AS reason, approved AND heartbeat_fresh AND listening AS ready FROM c""",
)
def probe_readiness(spark, sf_dir):
    rows = events(spark, sf_dir)
    latest = polls.latest_per_key(rows, key="device_id")
    probes = latest.select(
        "device_id",
        (F.col("k") >= 20).alias("approved"),
        F.when(F.col("event_type") != "purchase", F.col("ts")).alias("last_heartbeat"),
        F.array(F.lit("syslog"), F.lit("traps")).alias("enabled"),
        F.when(F.col("event_type") == "click", F.array(F.lit("traps")))
        .otherwise(F.array(F.lit("traps"), F.lit("syslog")))
        .alias("bound"),
    )
    newest = rows.agg(F.max("ts")).scalar()
    ready = polls.readiness(probes, now=newest, interval_seconds=F.lit(6 * 3600))
    return ready.select("device_id", "heartbeat_fresh", "reason", "ready")
