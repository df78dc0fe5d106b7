"""Syslog lines to columns, and the key=value events inside them. All Spark expressions.

``lines``: ``recv_ts``, ``arrival_no``, ``src_ip``, ``line``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftnet.operators import filters, lookups, triggers

# Largest priority, longest line, and the fields of an event.
MAX_PRIORITY = 191
MAX_LINE = 65536
EVENT_FIELDS = [
    "logid",
    "type",
    "subtype",
    "level",
    "vd",
    "user",
    "ui",
    "action",
    "cfgtid",
    "cfgpath",
    "cfgobj",
    "cfgattr",
    "devid",
    "devname",
    "msg",
]
# Fixed patterns: the accepted timestamp layouts.
ISO_LAYOUT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
PLAIN_LAYOUT = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d+)?$"
BSD_LAYOUT = r"^(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) +(\d{1,2}) (\d{2}:\d{2}:\d{2})(\.\d+)?$"
GLUED_LAYOUT = r"^<[0-9]{1,3}>[0-9]+$"


def priority(token: Column) -> Column:
    """Priority number of ``<n>...``, null if it is not 1 to 3 digits or above 191."""
    value = F.regexp_extract(token, r"^<([0-9]{1,3})>", 1).try_cast("int")
    return F.when(value <= MAX_PRIORITY, value)


def timestamp(text: Column, recv_ts: Column) -> Column:
    """Six layouts; '-', empty and unreadable text give the receive time. The layout without a year takes that of the
    receive time."""
    value = F.trim(text)
    iso = F.when(value.rlike(ISO_LAYOUT), value.try_cast("timestamp"))
    plain = F.when(value.rlike(PLAIN_LAYOUT), value.try_cast("timestamp"))
    dated = F.concat_ws(
        " ",
        F.year(recv_ts).cast("string"),
        F.regexp_extract(value, BSD_LAYOUT, 1),
        F.regexp_extract(value, BSD_LAYOUT, 2),
        F.regexp_extract(value, BSD_LAYOUT, 3),
    )
    bsd = F.when(value.rlike(BSD_LAYOUT), F.try_to_timestamp(dated, F.lit("yyyy MMM d HH:mm:ss")))
    return F.coalesce(iso, bsd, plain, recv_ts)


def id_number(text: Column) -> Column:
    """Digits of a text as a number, 0 if there are none."""
    return F.coalesce(F.regexp_replace(text, "[^0-9]", "").try_cast("bigint"), F.lit(0).cast("bigint"))


def device_hint(hostname: Column, structured: Column) -> Column:
    """Device id from the host name, else from structured data, else 0."""
    host = F.lower(F.coalesce(hostname, F.lit("")))
    parts = F.filter(F.split(host, r"[-_.]"), lambda p: F.length(p) >= 4)
    numbers = F.filter(F.transform(parts, id_number), lambda n: n > 0)
    from_host = F.when(host.startswith("fg"), F.get(numbers, F.lit(0)))
    data = F.coalesce(structured, F.lit(""))
    fields = F.from_json(F.when(data.startswith("{"), data), "MAP<STRING, MAP<STRING, STRING>>")
    named = F.map_filter(fields, lambda k, _: F.lower(k).contains("fortigate") | F.lower(k).contains("fgt"))
    ids = F.filter(F.transform(F.map_values(named), lambda m: id_number(F.try_element_at(m, F.lit("device-id")))), lambda n: n > 0)
    bracketed = id_number(F.regexp_extract(data, r"\[(\d+)\]", 1))
    return F.coalesce(from_host, F.get(ids, F.lit(0)), F.when(bracketed > 0, bracketed), F.lit(0).cast("bigint"))


def parsed(lines: DataFrame) -> DataFrame:
    """All lines with their columns and ``reject`` (why a line is no message, else null).

    Fields are separated by single spaces, priority and version too (``layout`` = ``spaced``). The common form with
    ``<n>1`` in one token is read by the standard (``layout`` = ``glued``).
    """
    tokens = F.split("line", " ", 9)
    rows = lines.withColumn("_glued", F.get(tokens, F.lit(0)).rlike(GLUED_LAYOUT))
    # after this split index 0 is the priority, 1 the timestamp, ... 6 the structured data, 7 the message
    body = F.when(F.col("_glued"), F.split("line", " ", 8)).otherwise(
        F.concat(F.slice(tokens, 1, 1), F.slice(tokens, 3, 7))
    )
    # a generator binds the words once: filters on columns made of them are not rewritten into splits of the line
    rows = rows.select("*", F.explode(F.array(body)).alias("_t"))

    def token(at: int) -> Column:
        return F.coalesce(F.get("_t", F.lit(at)), F.lit(""))

    value = priority(F.get("_t", F.lit(0)))
    few = F.size(F.split("line", " ", 3)) < F.when(F.col("_glued"), 2).otherwise(3)
    structured = F.when(token(6) == "-", "").otherwise(token(6))
    return rows.select(
        *lines.columns,
        F.when(F.col("_glued"), "glued").otherwise("spaced").alias("layout"),
        F.when(few, "too few parts").when(value.isNull(), "invalid priority").alias("reject"),
        value.alias("priority"),
        F.floor(value / 8).cast("int").alias("facility"),
        F.pmod(value, F.lit(8)).alias("severity"),
        timestamp(token(1), F.col("recv_ts")).alias("timestamp"),
        token(2).alias("hostname"),
        token(3).alias("app_name"),
        token(4).alias("process_id"),
        token(5).alias("message_id"),
        structured.alias("structured_data"),
        token(7).alias("message"),
        F.when(F.get("_t", F.lit(6)) != "-", device_hint(token(2), structured)).otherwise(0).cast("bigint").alias("device_hint"),
    )


def messages(lines: DataFrame) -> DataFrame:
    return parsed(lines).where("reject is null").drop("reject")


def rejects(lines: DataFrame) -> DataFrame:
    return parsed(lines).where("reject is not null").select(*lines.columns, "reject")


def key_values(text: Column) -> Column:
    """``key=value`` and ``key="quoted value"`` tokens as a map; keys lower-case, the last wins."""
    pattern = F.lit(r'([^\s=]+)=("([^"]*)"?|[^ \t]*)')
    keys = F.transform(F.regexp_extract_all(text, pattern, 1), F.lower)
    raw = F.regexp_extract_all(text, pattern, 2)
    values = F.transform(raw, lambda v: F.when(v.startswith('"'), F.regexp_replace(v, '^"|"$', "")).otherwise(v))
    return F.map_from_arrays(keys, values)


def events(rows: DataFrame, *, text: str = "message") -> DataFrame:
    """Rows whose text carries a non-empty ``logid``, with the event fields (absent ones empty).

    The substring test runs before the full scan of the text.
    """
    found = rows.where(F.col(text).contains("logid=")).withColumn("_kv", key_values(F.col(text)))
    fields = [F.coalesce(F.try_element_at("_kv", F.lit(name)), F.lit("")).alias(name) for name in EVENT_FIELDS]
    return found.select(*rows.columns, *fields).where("logid <> ''")


def config_change_triggers(
    lines: DataFrame, devices: DataFrame, addresses: DataFrame, *, gap_seconds: float = triggers.DEBOUNCE_SECONDS
) -> DataFrame:
    """Lines to debounced configuration-change firings: one per burst of a (device, transaction)."""
    changes = events(messages(lines)).where(filters.is_config_change(F.col("logid")))
    resolved = lookups.config_change_devices(changes.withColumnRenamed("src_ip", "source_ip"), devices, addresses)
    keyed = resolved.withColumn("trigger", triggers.trigger_key()).select("device_id", "trigger", "recv_ts", "arrival_no")
    return triggers.debounce(keyed, keys=["device_id", "trigger"], gap_seconds=gap_seconds, ts="recv_ts")
