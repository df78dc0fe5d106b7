"""SNMP trap classification.

``traps``: ``trap_no`` (unique), ``recv_ts``, ``src_ip``, ``version`` (``1`` or other), ``community``, ``enterprise``,
``specific`` and ``varbinds`` (array of oid, type, value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftnet.operators import oids

# Varbind types whose value is printed.
PRINTED_TYPES = ["OctetString", "Integer", "Counter32", "Gauge32", "Counter64", "ObjectIdentifier", "IPAddress"]


def trap_table() -> Column:
    """The fixed trap table as a map literal, OID -> (type, severity): 37 entries, so no join is needed."""
    entries = []
    for oid, (kind, severity) in oids.TRAPS.items():
        entries += [F.lit(oid), F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"))]
    return F.create_map(*entries)


def trap_oid() -> Column:
    """v1: enterprise.0.specific; later versions: the value of the trap-OID varbind, if it is an OID."""
    v1 = F.concat(F.nullif(F.col("enterprise"), F.lit("")), F.lit(".0."), F.col("specific").cast("string"))
    carrier = F.get(F.filter("varbinds", lambda v: v["oid"] == oids.SNMP_TRAP_OID), F.lit(0))
    v2 = F.when(carrier["type"] == "ObjectIdentifier", carrier["value"])
    return F.coalesce(F.when(F.col("version") == "1", v1).otherwise(v2), F.lit(""))


def varbind_text(varbind: Column) -> Column:
    printed = varbind["type"].isin(PRINTED_TYPES)
    return F.when(printed, F.coalesce(varbind["value"], F.lit(""))).otherwise("")


def trap_message(kind: Column) -> Column:
    """The type, then every non-empty varbind but the trap OID and the uptime."""
    own = F.filter("varbinds", lambda v: ~v["oid"].isin(oids.SNMP_TRAP_OID, oids.SYS_UPTIME_OID))
    texts = F.filter(F.transform(own, varbind_text), lambda t: t != "")
    return F.concat_ws("; ", F.concat(F.array(kind), texts))


def classify(traps: DataFrame) -> DataFrame:
    """``trap_events`` rows: known trap OID, else the first varbind with a known OID, else GENERIC/info if there is an
    OID at all; the rest is dropped. Traps without varbinds are dropped."""
    rows = traps.where(F.size("varbinds") > 0).withColumn("_oid", trap_oid()).withColumn("_table", trap_table())
    known = F.col("_table")[F.col("_oid")]
    first = F.get(F.filter("varbinds", lambda v: F.map_contains_key(F.col("_table"), v["oid"])), F.lit(0))["oid"]
    judged = rows.withColumn(
        "trap_oid",
        F.when(known.isNotNull(), F.col("_oid"))
        .when(first.isNotNull(), first)
        .otherwise(F.nullif(F.col("_oid"), F.lit(""))),
    ).where("trap_oid is not null")
    found = F.col("_table")[F.col("trap_oid")]
    kind = F.coalesce(found["type"], F.lit("GENERIC"))
    return judged.select(
        "trap_no",
        F.col("recv_ts").alias("timestamp"),
        F.col("src_ip").alias("source_ip"),
        "trap_oid",
        kind.alias("trap_type"),
        F.coalesce(found["severity"], F.lit("info")).alias("severity"),
        trap_message(kind).alias("message"),
    )
