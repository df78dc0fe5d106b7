"""Joins against reference data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Addresses that never identify a device.
UNUSABLE_ADDRESSES = ["", "0.0.0.0", "127.0.0.1"]


def device_addresses(devices: DataFrame, addresses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(management dimension: first listed device wins, interface dimension: last write wins)."""
    management = (
        devices.where(F.coalesce("ip_address", F.lit("")) != "")
        .groupBy(F.col("ip_address").alias("_ip"))
        .agg(F.min_by("id", "list_no").alias("_management_id"))
    )
    interface = (
        addresses.where(~F.coalesce("ip_address", F.lit("")).isin(UNUSABLE_ADDRESSES))
        .groupBy(F.col("ip_address").alias("_ip"))
        .agg(F.max_by("device_id", "write_no").alias("_interface_id"))
    )
    return management, interface


def resolve_device(
    rows: DataFrame, devices: DataFrame, addresses: DataFrame, *, ip: str = "src_ip", out: str = "device_id"
) -> DataFrame:
    """Device of an address: management address first, then interface address, else 0.

    Both dimensions are aggregated to one row per address; their size is that of the device inventory, and AQE
    broadcasts them when they turn out small, so a source with a third of all rows is not shuffled onto one task.
    """
    management, interface = device_addresses(devices, addresses)
    dimension = management.join(interface, "_ip", "full").select(
        F.col("_ip").alias(ip), F.coalesce("_management_id", "_interface_id").alias("_resolved")
    )
    joined = rows.drop(out).join(dimension, ip, "left")
    return joined.withColumn(out, F.coalesce("_resolved", F.lit(0)).cast("bigint")).drop("_resolved")


def stamp(
    rows: DataFrame, devices: DataFrame, addresses: DataFrame, *, probe_id: int, ip: str = "src_ip"
) -> DataFrame:
    """Probe id on every event, and the device id resolved from the address where it is 0."""
    resolved = resolve_device(rows.withColumnRenamed("device_id", "_given"), devices, addresses, ip=ip)
    given = F.coalesce("_given", F.lit(0))
    return resolved.withColumn("device_id", F.when(given != 0, given).otherwise(F.col("device_id"))).drop(
        "_given"
    ).withColumn("probe_id", F.lit(probe_id).cast("bigint"))


def config_change_devices(events: DataFrame, devices: DataFrame, addresses: DataFrame) -> DataFrame:
    """Config-change events with the device found strictly by packet source; events of unknown sources are dropped."""
    found = resolve_device(events.drop("device_id"), devices, addresses, ip="source_ip")
    return found.where(F.col("device_id") != 0)


def tunnels_with_phase1(phase2: DataFrame, phase1: DataFrame) -> DataFrame:
    """Phase-2 tunnels with their phase 1: the last phase-1 row of a name wins.

    ``phase1``: ``device_id``, ``name``, ``line_no``, ``remote_ip``, ``status``, ``interface_name``, ``mode``;
    ``phase2``: ``device_id``, ``phase1_name``, ``remote_ip``, ...
    """
    last = phase1.groupBy("device_id", F.col("name").alias("phase1_name")).agg(
        F.max_by(F.struct("remote_ip", "status", "interface_name", "mode"), "line_no").alias("_p1")
    )
    joined = phase2.join(last, ["device_id", "phase1_name"], "left")

    def text(name: str):
        return F.nullif(F.coalesce(F.col(f"_p1.{name}"), F.lit("")), F.lit(""))

    return joined.select(
        *[c for c in phase2.columns if c != "remote_ip"],
        F.coalesce(text("remote_ip"), F.col("remote_ip")).alias("remote_ip"),
        F.coalesce(text("status"), F.lit("unknown")).alias("status"),
        F.coalesce(text("interface_name"), F.lit("")).alias("interface_name"),
        F.coalesce(text("mode"), F.lit("")).alias("mode"),
    )


def with_fallback(preferred: DataFrame, legacy: DataFrame, *, keys: list[str]) -> DataFrame:
    """All preferred rows, and legacy rows only of keys that have no preferred row at all."""
    return preferred.unionByName(legacy.join(preferred.select(*keys).distinct(), keys, "left_anti"))


def with_preferred(rows: DataFrame, preferred: Column, *, keys: list[str]) -> DataFrame:
    """The same where both kinds come from one table: it is read once. ``preferred`` tells the kinds apart; nulls in a key are equal."""
    flagged = rows.withColumn("_preferred", F.coalesce(preferred, F.lit(False)))
    some = F.bool_or("_preferred").over(Window.partitionBy(*keys))
    return flagged.withColumn("_some", some).where("_preferred or not _some").drop("_preferred", "_some")


def supplement(secondary: DataFrame, cycles: DataFrame, *, table: str) -> DataFrame:
    """Rows of a secondary source for devices whose latest poll cycle succeeded with an empty table.

    ``cycles``: ``device_id``, ``cycle``, ``ok_<table>`` and ``rows_<table>``.
    """
    state = F.struct(F.col(f"ok_{table}").alias("ok"), F.col(f"rows_{table}").alias("n"))
    latest = cycles.groupBy("device_id").agg(F.max_by(state, "cycle").alias("_latest"))
    empty = latest.where(F.col("_latest.ok") & (F.col("_latest.n") == 0)).select("device_id")
    return secondary.join(empty, "device_id", "left_semi")

