"""Dual-export deduplication: the same traffic exported both as sFlow and as NetFlow/IPFIX."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftnet.operators import segments

# flow_source codes of flow_samples.
FLOW_SOURCE_SFLOW = 0
FLOW_SOURCE_NETFLOW_V5 = 1
FLOW_SOURCE_NETFLOW_V9 = 2
FLOW_SOURCE_IPFIX = 3

# Fixed value: how long the preferred family silences the other one.
DEDUP_WINDOW_SECONDS = 300

PREFERRED = {"prefer-netflow": "netflow", "prefer-sflow": "sflow"}


def dedup_key(device_id: Column, address: Column) -> Column:
    """``dev:<id>`` for a resolved device, else ``ip:<address>``."""
    return F.when(device_id != 0, F.concat(F.lit("dev:"), device_id.cast("string"))).otherwise(
        F.concat(F.lit("ip:"), address)
    )


def export_family(flow_source: Column) -> Column:
    return F.when(flow_source == FLOW_SOURCE_SFLOW, "sflow").otherwise("netflow")


def mark_duplicates(
    flows: DataFrame,
    policy: str,
    *,
    key: str = "dedup_key",
    family: str = "family",
    ts: str = "ts",
    arrival: str = "arrival_no",
    window_seconds: float = DEDUP_WINDOW_SECONDS,
    span: int = segments.SEGMENT_SPAN,
) -> DataFrame:
    """Add ``suppressed``: the other family was heard on this key less than the window ago.

    Any policy but ``prefer-netflow`` and ``prefer-sflow`` is off. Suppressed rows still count as heard, because the
    last-heard time comes from all rows of the preferred family.
    """
    preferred = PREFERRED.get(policy)
    if preferred is None:
        return flows.withColumn("suppressed", F.lit(False))
    heard = F.when(F.col(family) == preferred, F.unix_micros(ts))
    scanned = segments.scan(flows, [key], arrival, last={"_heard": heard}, span=span)
    age = F.unix_micros(F.col(ts)) - F.col("_heard")
    other = F.col(family).isin(*(set(PREFERRED.values()) - {preferred}))
    silent = other & F.col("_heard").isNotNull() & (age < F.lit(int(window_seconds * 1_000_000)))
    return segments.finish(scanned.withColumn("suppressed", F.coalesce(silent, F.lit(False))).drop("_heard"))


def deduplicate(flows: DataFrame, policy: str, **options) -> DataFrame:
    """The rows that survive :func:`mark_duplicates`."""
    return mark_duplicates(flows, policy, **options).where(~F.col("suppressed")).drop("suppressed")


def suppression_changes(
    marked: DataFrame,
    *,
    key: str = "dedup_key",
    family: str = "family",
    arrival: str = "arrival_no",
    span: int = segments.SEGMENT_SPAN,
) -> DataFrame:
    """One row whenever suppression of a (key, family) flips. Starting out unsuppressed is no change."""
    scanned = segments.scan(marked, [key, family], arrival, prev={"_was": F.col("suppressed")}, span=span)
    changed = F.col("suppressed") != F.coalesce(F.col("_was"), F.lit(False))
    return segments.finish(scanned.where(changed).drop("_was"))


def suppressed_counts(marked: DataFrame, *, family: str = "family") -> DataFrame:
    return marked.where("suppressed").groupBy(family).agg(F.count("*").alias("suppressed_rows"))
