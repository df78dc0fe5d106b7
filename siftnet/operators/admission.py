"""Admission replays: minimum spacing and token buckets.

Both rules are sequential: whether a row is accepted depends on which earlier rows were. They are evaluated exactly and
still in parallel. Each (key, segment) is turned into its *transition function* (state entering the segment -> state
leaving it), the functions are applied one after another per key on summaries only, and every segment is then replayed
with the state that really enters it. No task holds more than one segment of rows, whatever share one source has. Keys of one
segment, which most are, have nothing to carry and skip the first two steps.

Minimum spacing follows each row's next acceptable row by binary lifting: jumps over 1, 2, 4, ... acceptances, for all rows at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftnet.operators import segments

#: Origin of the internal clock; keeps ``micros * rate`` inside 64 bits.
CLOCK_ORIGIN_MICROS = 1_600_000_000_000_000

#: "Nothing accepted yet" / "bucket full": earlier than any clock value.
NEVER = -(1 << 62)


# ---------------------------------------------------------------------------------------------- minimum spacing


def spacing_transition(clock: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Last accepted time at the segment's end, by the first row accepted in it.

    Only rows that exceed every earlier one can be the first to reach a threshold. Returns ``(reach, leave)``: entering
    with last acceptance ``c``, the segment leaves with ``leave[k]`` for the first ``k`` with ``reach[k] >= c + gap``,
    and with ``c`` if there is none.
    """
    peak = np.maximum.accumulate(clock)
    record = np.r_[True, clock[1:] > peak[:-1]]
    reach = clock[record]
    following = np.searchsorted(reach, reach + gap, side="left")
    # the last acceptance of the chain that begins at each row: the chain's end stays where it is
    last = np.where(following < len(reach), np.minimum(following, len(reach) - 1), np.arange(len(reach)))
    while True:
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    leave = reach[last]
    keep = np.r_[leave[1:] != leave[:-1], True]
    return reach[keep], leave[keep]


def spaced_rows(clock: np.ndarray, gap: int, entering: int) -> np.ndarray:
    """Which rows of a segment are accepted, given the last acceptance before it."""
    n = len(clock)
    peak = np.maximum.accumulate(clock)
    first = 0 if entering == NEVER else int(np.searchsorted(peak, entering + gap, side="left"))
    # the row accepted after each row, were that one accepted; place n is the end
    jump = np.append(np.maximum(np.searchsorted(peak, clock + gap, side="left"), np.arange(1, n + 1)), n)
    accepted = np.zeros(n + 1, dtype=bool)
    accepted[first] = True
    while True:
        chain = np.flatnonzero(accepted[:n])
        ahead = jump[chain]
        if (ahead == n).all():
            return accepted[:n]
        # the rows within 2^k acceptances, and those 2^k further
        accepted[ahead] = True
        jump = jump[jump]


# ------------------------------------------------------------------------------------------------- token bucket


def bucket_transition(clock: np.ndarray, cost: int, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How a segment moves the bucket, for every state that can enter it.

    The state is the time at which the bucket would be full again; it is at most ``capacity`` after the first row.
    Returns pieces ``(upper, moving, value)`` sorted by ``upper``: a state up to ``upper`` leaves as ``state + value``
    where ``moving``, else as ``value``.
    """
    first = int(clock[0])
    low = np.array([NEVER, first], dtype=np.int64)
    high = np.array([first, first + capacity], dtype=np.int64)
    moving = np.array([False, True])
    value = np.array([NEVER, 0], dtype=np.int64)
    for now in clock.tolist():
        limit = now + capacity - cost
        # cut moving pieces where their image crosses "full again" (now) and "no token left" (limit)
        for threshold in (now, limit):
            cut = threshold - value
            split = moving & (low < cut) & (cut < high)
            if split.any():
                at = np.flatnonzero(split)
                low = np.insert(low, at + 1, cut[at])
                high = np.insert(high, at, cut[at])
                moving = np.insert(moving, at, True)
                value = np.insert(value, at, value[at])
        image = np.where(moving, high + value, value)
        full = image <= now
        admitted = ~full & (image <= limit)
        value = np.where(full, now + cost, np.where(admitted, value + cost, value))
        moving = moving & ~full
        if len(value) > 1:
            keep = np.r_[(moving[1:] != moving[:-1]) | (value[1:] != value[:-1]), True]
            low, high, moving, value = low[np.r_[True, keep[:-1]]], high[keep], moving[keep], value[keep]
    return high, moving, value


def bucket_rows(clock: np.ndarray, cost: int, capacity: int, entering: int) -> np.ndarray:
    """Which rows of a segment get a token."""
    state = entering
    admitted = np.zeros(len(clock), dtype=bool)
    for i, now in enumerate(clock.tolist()):
        after = max(state, now) + cost
        if after <= now + capacity:
            admitted[i] = True
            state = after
    return admitted


# ------------------------------------------------------------------------------------------------- shared replay


def _per_group(rows: DataFrame, group: list[str], arrival: str, schema: T.StructType, work) -> DataFrame:
    """``work(key, frame)`` for every group, its rows in arrival order.

    Partitions are sorted and streamed; only the group at the end of a batch is held until it is complete. Many small
    groups share a batch, which a grouped map would send one by one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            frame = batch if held is None else pd.concat([held, batch], ignore_index=True)
            starts = _starts(frame, group)
            held = frame.iloc[starts[-1] :]
            if len(starts) > 1:
                yield pd.concat([one(frame.iloc[i:j]) for i, j in zip(starts[:-1], starts[1:])], ignore_index=True)
        if held is not None and len(held):
            yield one(held)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        return work(tuple(frame[name].iloc[0] for name in group), frame)

    placed = rows.repartition(*group).sortWithinPartitions(*group, arrival)
    return placed.mapInPandas(run, schema)


def _starts(frame: pd.DataFrame, group: list[str]) -> list[int]:
    """Positions where a new group begins."""
    changed = np.zeros(len(frame), dtype=bool)
    changed[0] = True
    for name in group:
        values = frame[name]
        different = values.to_numpy()[1:] != values.to_numpy()[:-1]
        none = values.isna().to_numpy()
        # nulls are equal to each other, although not a number is not
        changed[1:] |= different & ~(none[1:] & none[:-1])
    return np.flatnonzero(changed).tolist()


def _replay(rows: DataFrame, keys: list[str], arrival: str, span: int, transition, apply, replay) -> DataFrame:
    """(keys, arrival) of the accepted rows. ``rows`` carries ``_clock`` (BIGINT)."""
    group = [*keys, segments.SEGMENT]
    narrow = segments.with_segment(rows, arrival, span).select(*group, arrival, "_clock")
    key_fields = [narrow.schema[k] for k in group]

    def summarise(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        parts = [np.asarray(p, dtype=np.int64).tolist() for p in transition(frame["_clock"].to_numpy())]
        return pd.DataFrame([[*key, parts]], columns=[*group, "_parts"])

    summary_type = T.StructType([*key_fields, T.StructField("_parts", T.ArrayType(T.ArrayType(T.LongType())))])
    cut = narrow.groupBy(*keys).agg(F.min(segments.SEGMENT).alias("_first"), F.max(segments.SEGMENT).alias("_last")).where("_first < _last")
    names = {k: f"_k_{k}" for k in keys}
    same = F.lit(True)
    for key, name in names.items():
        same = same & F.col(key).eqNullSafe(F.col(name))
    several = narrow.join(cut.select(*keys).withColumnsRenamed(names), same, "left_semi")
    summaries = _per_group(several, group, arrival, summary_type, summarise)

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, NEVER
        for frame in batches:
            entering = []
            for *key, parts in frame[[*keys, "_parts"]].itertuples(index=False, name=None):
                key = [None if v != v else v for v in key]
                if key != current:
                    current, state = key, NEVER
                entering.append(state)
                state = apply(state, [np.asarray(p, dtype=np.int64) for p in parts])
            yield frame[group].assign(_entering=np.asarray(entering, dtype=np.int64))

    entering_type = T.StructType([*key_fields, T.StructField("_entering", T.LongType())])
    entering = summaries.repartition(*keys).sortWithinPartitions(*group).mapInPandas(chain, entering_type)

    def accepted(_key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        keep = replay(frame["_clock"].to_numpy(), int(frame["_entering"].iloc[0]))
        return frame.loc[keep, [*keys, arrival]]

    accepted_type = T.StructType([*(rows.schema[k] for k in keys), rows.schema[arrival]])
    entered = segments.carried_in(narrow, entering, keys).withColumn("_entering", F.coalesce("_entering", F.lit(NEVER)))
    return _per_group(entered, group, arrival, accepted_type, accepted)


def accept_spaced(
    events: DataFrame,
    *,
    keys: list[str],
    gap_seconds: float,
    ts: str = "ts",
    arrival: str = "arrival_no",
    span: int = segments.SEGMENT_SPAN,
) -> DataFrame:
    """Add ``accepted``: at least ``gap_seconds`` after the last accepted row of the key. A gap <= 0 accepts all."""
    if gap_seconds <= 0:
        return events.withColumn("accepted", F.lit(True))
    gap = int(gap_seconds * 1_000_000)
    clocked = events.withColumn("_clock", F.unix_micros(F.col(ts)))

    def apply(state: int, parts: list[np.ndarray]) -> int:
        reach, leave = parts
        at = 0 if state == NEVER else int(np.searchsorted(reach, state + gap, side="left"))
        return int(leave[at]) if at < len(reach) else state

    kept = _replay(
        clocked,
        keys,
        arrival,
        span,
        lambda clock: spacing_transition(clock, gap),
        apply,
        lambda clock, entering: spaced_rows(clock, gap, entering),
    )
    return _flag(events, kept, keys, arrival)


def token_bucket(
    events: DataFrame,
    *,
    keys: list[str],
    rate: int,
    per_seconds: int = 1,
    burst: int | None = None,
    ts: str = "ts",
    arrival: str = "arrival_no",
    span: int = segments.SEGMENT_SPAN,
) -> DataFrame:
    """Add ``accepted``: a per-key bucket of ``burst`` tokens (default twice the rate), refilled at ``rate`` per
    ``per_seconds``, had a whole token left. Integer arithmetic throughout, so the replay is exact."""
    cost = per_seconds * 1_000_000
    capacity = (2 * rate if burst is None else burst) * cost
    # time never runs backwards for a bucket
    steady = segments.scan(events, keys, arrival, running_max={"_latest": F.col(ts)}, span=span)
    clocked = steady.withColumn("_clock", (F.unix_micros("_latest") - F.lit(CLOCK_ORIGIN_MICROS)) * F.lit(rate))

    def apply(state: int, parts: list[np.ndarray]) -> int:
        upper, moving, value = parts
        at = min(int(np.searchsorted(upper, state, side="left")), len(upper) - 1)
        return state + int(value[at]) if moving[at] else int(value[at])

    kept = _replay(
        clocked,
        keys,
        arrival,
        span,
        lambda clock: bucket_transition(clock, cost, capacity),
        apply,
        lambda clock, entering: bucket_rows(clock, cost, capacity, entering),
    )
    return _flag(events, kept, keys, arrival)


def _flag(events: DataFrame, kept: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    # arrival numbers are unique, so they identify a row whatever its key holds
    flagged = events.join(kept.select(arrival, F.lit(True).alias("accepted")), arrival, "left")
    return flagged.select(*events.columns, F.coalesce("accepted", F.lit(False)).alias("accepted"))


def rate_report(
    events: DataFrame,
    *,
    listener: str,
    source: str,
    limits: DataFrame,
    ts: str = "ts",
) -> DataFrame:
    """Per listener and second: events, sources over their own rate, and whether the total ceiling was passed.

    ``limits`` has one row per listener: ``source_rate`` and ``total_rate``.
    """
    second = F.date_trunc("second", F.col(ts)).alias("second")
    per_source = events.groupBy(listener, source, second).agg(F.count("*").alias("n"))
    limited = per_source.join(limits, listener)
    return (
        limited.groupBy(listener, "second")
        .agg(
            F.sum("n").alias("events"),
            F.count_if(F.col("n") > F.col("source_rate")).alias("sources_over"),
            F.max("total_rate").alias("total_rate"),
        )
        .withColumn("over_ceiling", F.col("events") > F.col("total_rate"))
    )
