"""Debounced triggers: bursts of events collapse to one firing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftnet.operators import segments

# Quiet time before a firing, and the least time between two accepted firings of a device.
DEBOUNCE_SECONDS = 60
FIRING_GAP_SECONDS = 120


def trigger_key(transaction: str = "cfgtid"):
    """The transaction id, ``_`` where it is empty."""
    return F.when(F.coalesce(F.col(transaction), F.lit("")) == "", "_").otherwise(F.col(transaction))


def debounce(
    events: DataFrame,
    *,
    keys: list[str],
    gap_seconds: float = DEBOUNCE_SECONDS,
    ts: str = "ts",
    arrival: str = "arrival_no",
    span: int = segments.SEGMENT_SPAN,
) -> DataFrame:
    """One row per burst: ``fire_ts`` (gap after the last event), event count, first and last arrival.

    A burst ends when more than ``gap_seconds`` pass without an event; events exactly the gap apart stay together, as
    ``session_window`` has it. Bursts are numbered by their first event with an ordered scan and then aggregated with
    partial aggregation, so neither a hot key nor an endless burst ends up in one task. Gaps are taken between
    neighbours by ``arrival``, also where ``ts`` goes back.
    """
    gap = F.lit(int(gap_seconds * 1_000_000))
    clock = F.unix_micros(F.col(ts))
    window = segments.inside(keys, arrival)
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.lag(clock).over(window)
    across = segments.across(keys)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    # inside a segment a burst starts after a long gap; whether the segment's first event starts one shows only in
    # the last event of the segment before
    local = {"_opens": F.when(clock - before > gap, F.col(arrival))}
    opens_first = F.col("_head_ts") - F.lag("_tail_ts").over(across) > gap
    rows = segments.two_level(
        events,
        keys,
        arrival,
        local=local,
        summary={
            "_head": F.min(arrival),
            "_head_ts": F.min_by(clock, arrival),
            "_tail_ts": F.max_by(clock, arrival),
            "_last_open": F.max("_opens"),
        },
        carry=[
            {"_head_open": F.when(F.coalesce(opens_first, F.lit(True)), F.col("_head"))},
            {"_entering": F.coalesce("_head_open", F.max(F.coalesce("_last_open", "_head_open")).over(earlier))},
        ],
        span=span,
    )
    numbered = rows.withColumn("first_arrival", F.coalesce(F.max("_opens").over(upto), F.col("_entering")))
    return (
        numbered.groupBy(*keys, "first_arrival")
        .agg(
            F.max(arrival).alias("last_arrival"),
            F.count("*").alias("event_count"),
            F.min(ts).alias("first_ts"),
            F.max(ts).alias("last_ts"),
        )
        .withColumn("fire_ts", F.timestamp_micros(F.unix_micros("last_ts") + gap))
    )
