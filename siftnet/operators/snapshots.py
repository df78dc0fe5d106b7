"""State snapshots: replace semantics and per-device row caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftnet.operators import segments

# Fixed value: the number of topology rows per device and snapshot that receivers accept. Nothing is capped unless a caller asks.
TOPOLOGY_ROW_CAP = 4000


def latest_snapshot(rows: DataFrame, *, keys: list[str], ts: str = "timestamp") -> DataFrame:
    """All rows of the newest snapshot of each key.

    The newest time per key is aggregated first (map-side) and joined back on (key, time). The time in the join key
    spreads a device with many snapshots over many partitions. Nulls in a key are equal to each other.
    """
    newest = rows.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.max(ts).alias("_newest"))
    same = F.col(ts) == F.col("_newest")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    return rows.join(newest, same, "left_semi")


def cap_rows(
    rows: DataFrame,
    *,
    keys: list[str],
    kind: str = "entry_type",
    first_kind: str = "arp",
    order: str = "entry_no",
    cap: int,
    span: int = segments.SEGMENT_SPAN,
) -> DataFrame:
    """Keep at most ``cap`` rows per key, rows of ``first_kind`` before the others, each in source order.

    The key's number of first rows is found on the segment summaries and comes back with the carried ranks, so rows meet
    nothing by their key alone.
    """
    is_first = F.coalesce(F.col(kind) == first_kind, F.lit(False))
    local, earlier = segments.inside(keys, order), segments.across(keys)
    before = earlier.rowsBetween(Window.unboundedPreceding, -1)
    whole = earlier.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = segments.two_level(
        rows.withColumn("_is_first", is_first),
        keys,
        order,
        local={"_first": F.sum(F.col("_is_first").cast("bigint")).over(upto), "_other": F.sum((~F.col("_is_first")).cast("bigint")).over(upto)},
        summary={"_firsts": F.count_if("_is_first"), "_others": F.count_if(~F.col("_is_first"))},
        carry=[
            {
                "_firsts_before": F.coalesce(F.sum("_firsts").over(before), F.lit(0)),
                "_others_before": F.coalesce(F.sum("_others").over(before), F.lit(0)),
                "_firsts_total": F.sum("_firsts").over(whole),
            }
        ],
        span=span,
    )
    position = F.when(F.col("_is_first"), F.col("_first") + F.col("_firsts_before")).otherwise(
        F.col("_other") + F.col("_others_before") + F.col("_firsts_total")
    )
    return ranked.where(position <= cap).select(*rows.columns)


def cap_report(
    rows: DataFrame, *, keys: list[str], kind: str = "entry_type", first_kind: str = "arp", cap: int
) -> DataFrame:
    """Kept and dropped rows per key."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col(kind) == first_kind).alias("first_n"))
    return counts.select(
        *keys,
        F.least("n", F.lit(cap)).alias("kept"),
        F.least("first_n", F.lit(cap)).alias("kept_first"),
        F.greatest(F.col("n") - cap, F.lit(0)).alias("dropped"),
    )
