"""Row filters and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftnet.functions import net

# Log ids of configuration changes, the storage type of fixed disks, record kinds by schema version.
CONFIG_CHANGE_LOGIDS = ["0100044546", "0100044547"]
FIXED_DISK_SUFFIX = ".25.2.1.4"
KIND_MIN_SCHEMA = {
    "traps": 1,
    "pings": 1,
    "syslog": 1,
    "flows": 1,
    "flow-counters": 2,
    "disk-usage": 3,
    "load-average": 3,
    "command-results": 4,
    "topology-entries": 5,
    "topology-neighbors": 5,
}


def allowed_sources(rows: DataFrame, allowlist: DataFrame | None, *, source: str = "src_ip") -> DataFrame:
    """Keep rows from listed sources. No list admits all, an empty list none; entries that are no address are void."""
    if allowlist is None:
        return rows
    return rows.join(_entries(allowlist, source), source, "left_semi")


def refused_sources(rows: DataFrame, allowlist: DataFrame | None, *, source: str = "src_ip") -> DataFrame:
    """The rows :func:`allowed_sources` drops, for counting."""
    if allowlist is None:
        return rows.limit(0)
    return rows.join(_entries(allowlist, source), source, "left_anti")


def _entries(allowlist: DataFrame, source: str) -> DataFrame:
    address = F.trim(F.col(allowlist.columns[0]))
    return allowlist.select(net.canonical_ip(address).alias(source)).where(F.col(source).isNotNull()).distinct()


def management_sources(devices: DataFrame) -> DataFrame:
    """Management addresses of the devices: the allowlist itself."""
    return devices.where(F.coalesce("ip_address", F.lit("")) != "").select("ip_address")


def community_accepted(configured: str, community: str = "community") -> Column:
    """A configured community must match; an empty one accepts every trap."""
    return F.lit(True) if configured == "" else F.coalesce(F.col(community) == configured, F.lit(False))


def has_address(src: str = "src_addr", dst: str = "dst_addr") -> Column:
    return (F.coalesce(src, F.lit("")) != "") | (F.coalesce(dst, F.lit("")) != "")


def flow_has_content(has_forward: Column, has_event: Column, src: str = "src_addr", dst: str = "dst_addr") -> Column:
    """Template-based records: forward counters, a firewall or NAT event, or an address."""
    return has_forward | has_event | has_address(src, dst)


def snmp_pollable() -> Column:
    """Enabled, with a port, and with a community where the version needs one."""
    needs_community = F.coalesce("snmp_version", F.lit("")) != "3"
    return F.col("enabled") & (~needs_community | F.col("has_community")) & (F.coalesce("snmp_port", F.lit(0)) != 0)


def ssh_pollable() -> Column:
    return F.col("enabled") & F.col("ssh_poll_enabled") & F.col("has_ssh_login")


def supported_kinds(rows: DataFrame, probes: DataFrame, *, kind: str = "kind") -> tuple[DataFrame, DataFrame]:
    """Split rows by whether their probe's negotiated schema knows the kind: (kept, discarded count by kind).

    Every row lands on one side: a probe that is not in ``probes``, or has no version there, counts as the lowest version.
    The kind table is ten fixed rows, hence the broadcast.
    """
    spark = rows.sparkSession
    minimum = F.broadcast(spark.createDataFrame(list(KIND_MIN_SCHEMA.items()), f"{kind} string, min_schema int"))
    versions = probes.groupBy("probe_id").agg(F.max("negotiated_schema").alias("negotiated_schema"))
    judged = rows.join(versions, "probe_id", "left").join(minimum, kind, "left")
    lowest = min(KIND_MIN_SCHEMA.values())
    ok = F.coalesce("negotiated_schema", F.lit(lowest)) >= F.coalesce("min_schema", F.lit(lowest))
    kept = judged.where(ok).select(*rows.columns)
    discarded = judged.where(~ok).groupBy(kind).agg(F.count("*").alias("discarded"))
    return kept, discarded


def is_config_change(logid: Column) -> Column:
    return logid.isin(CONFIG_CHANGE_LOGIDS)


def fixed_disks(storage: DataFrame) -> DataFrame:
    """Fixed disks of a storage walk, the first index of each mount.

    ``storage``: ``device_id``, ``poll_ts``, ``idx``, ``storage_type``, ``mount``, ``units``, ``size``, ``used``.
    """
    fixed = storage.where(
        F.col("storage_type").endswith(FIXED_DISK_SUFFIX)
        & (F.coalesce("mount", F.lit("")) != "")
        & ~F.col("mount").startswith("/var/unbound/")
        & (F.col("size") > 0)
        & (F.col("units") > 0)
    )
    group = ["device_id", "poll_ts", "mount"]
    first = fixed.groupBy(*group).agg(F.min_by(F.struct("idx", "units", "size", "used"), "idx").alias("_disk"))
    return first.select(*group, "_disk.*")
