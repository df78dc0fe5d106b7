"""Structured Streaming forms of the ordered operators.

Every operator here is a step over one key's rows of a micro-batch, sorted by arrival, plus a small state that is carried
to the next micro-batch. Steps are vectorised; rows of a key in one micro-batch are bounded by the trigger size of the
source. The batch forms are in :mod:`siftnet.operators`; ``tests/test_streaming.py`` checks that both agree.

Sources must deliver arrival order across micro-batches, as landed files and topics do.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siftnet.operators import admission, dedup, polls, sequence, throughput
from siftnet.sources.sinks import keyed

Step = Callable[[pd.DataFrame, tuple | None], tuple[pd.DataFrame, tuple]]


def ordered(
    stream: DataFrame, keys: list[str], step: Step, *, output: T.StructType | str, state: str, arrival: str = "arrival_no"
) -> DataFrame:
    """Run ``step(rows in arrival order, state or None) -> (output rows, new state)`` per key."""
    schema = T.StructType.fromDDL(output) if isinstance(output, str) else output
    names = [f.name for f in schema.fields]

    def run(_key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True).sort_values(arrival, ignore_index=True)
        result, after = step(rows, held.get if held.exists else None)
        held.update(after)
        yield result[names]

    return stream.groupBy(*keys).applyInPandasWithState(run, schema, state, "append", GroupStateTimeout.NoTimeout)


def _with(stream: DataFrame, *fields: T.StructField) -> T.StructType:
    return T.StructType([*stream.schema.fields, *fields])


def _micros(values: pd.Series) -> np.ndarray:
    return values.to_numpy(dtype="datetime64[us]").astype("int64")


def _carry(values: pd.Series, first) -> pd.Series:
    """Previous value of every row, the first row getting the carried one."""
    before = values.astype(object).shift(1)
    before.iloc[0] = first
    return before


# ------------------------------------------------------------------------------------------------------ flow streams


def mark_duplicates(
    flows: DataFrame, policy: str, *, key: str = "dedup_key", family: str = "family", ts: str = "ts",
    window_seconds: float = dedup.DEDUP_WINDOW_SECONDS,
) -> DataFrame:
    """Dual-export deduplication: the state is when the preferred family was last heard."""
    preferred = dedup.PREFERRED.get(policy)
    if preferred is None:
        return flows.withColumn("suppressed", F.lit(False))
    other = next(v for v in dedup.PREFERRED.values() if v != preferred)
    window = int(window_seconds * 1_000_000)

    def step(rows: pd.DataFrame, held: tuple | None):
        clock = pd.Series(_micros(rows[ts]), dtype="Int64")
        heard = clock.where(rows[family] == preferred)
        if held is not None and held[0] is not None:
            heard = pd.concat([pd.Series([held[0]], dtype="Int64"), heard], ignore_index=True).ffill().iloc[1:]
            heard = heard.reset_index(drop=True)
        else:
            heard = heard.ffill()
        silent = ((clock - heard) < window).fillna(False).astype(bool)
        rows["suppressed"] = (rows[family] == other) & silent
        last = heard.iloc[-1]
        return rows, (None if pd.isna(last) else int(last),)

    return ordered(flows, [key], step, output=_with(flows, T.StructField("suppressed", T.BooleanType())), state="heard BIGINT")


def sequence_events(headers: DataFrame, *, keys: tuple[str, ...] = ("exporter", "domain", "version")) -> DataFrame:
    """Export-sequence gaps: the state is the previous header."""

    def step(rows: pd.DataFrame, held: tuple | None):
        previous = held or (None, None, None, None)
        before = {
            name: _carry(rows[name], value)
            for name, value in zip(("sequence", "increment", "uptime_ms", "countable"), previous)
        }
        events, lost = [], []
        for i, (seq, uptime) in enumerate(zip(rows["sequence"], rows["uptime_ms"])):
            old, step_by, old_uptime, countable = (before[n].iloc[i] for n in before)
            event, delta = None, 0
            if old is not None and bool(countable):
                delta = int(seq - old - step_by) % sequence.SEQUENCE_MODULUS
                if delta:
                    restarted = not pd.isna(uptime) and not pd.isna(old_uptime) and uptime < old_uptime
                    event = "seq_resync" if restarted or delta >= sequence.RESYNC_DISTANCE else "seq_gap"
            events.append(event)
            lost.append(delta if event == "seq_gap" else 0)
        rows["event"], rows["lost_units"] = events, lost
        last = rows.iloc[-1]
        uptime = None if pd.isna(last["uptime_ms"]) else int(last["uptime_ms"])
        return rows, (int(last["sequence"]), int(last["increment"]), uptime, bool(last["countable"]))

    fields = (T.StructField("event", T.StringType()), T.StructField("lost_units", T.LongType()))
    state = "sequence BIGINT, increment BIGINT, uptime_ms BIGINT, countable BOOLEAN"
    return ordered(headers, list(keys), step, output=_with(headers, *fields), state=state)


def with_templates(timeline: DataFrame, *, idle_seconds: float = 1800) -> DataFrame:
    """Template as-of on a stream: ``timeline`` holds announcements (``fields_json`` set) and data sets (null) of
    ``exporter``, ``domain``, ``template_id``. The state is the live layout and its last use."""
    idle = int(idle_seconds * 1_000_000)

    def step(rows: pd.DataFrame, held: tuple | None):
        layout, touched = held or (None, None)
        found = []
        for fields, now in zip(rows["fields_json"], _micros(rows["recv_ts"]).tolist()):
            if fields is not None and not pd.isna(fields):
                layout = fields
            elif touched is not None and now - touched > idle:
                layout = None
            touched = now
            found.append(layout)
        rows["template_json"] = found
        return rows[rows["fields_json"].isna()], (layout, touched)

    return ordered(
        timeline,
        ["exporter", "domain", "template_id"],
        step,
        output=_with(timeline, T.StructField("template_json", T.StringType())),
        state="layout STRING, touched BIGINT",
        arrival="set_order",
    )


# ------------------------------------------------------------------------------------------------------ poll streams


def device_throughput(samples: DataFrame) -> DataFrame:
    """Device throughput per poll: the state is the last accepted poll's counters and rate."""

    def step(rows: pd.DataFrame, held: tuple | None):
        newest, counters, in_kbps, out_kbps = held or (None, "{}", 0.0, 0.0)
        earlier = json.loads(counters)
        out = []
        for (arrival, ts), poll in rows.groupby(["poll_arrival", "poll_ts"], sort=True):
            now = int(_micros(pd.Series([ts]))[0])
            accepted = newest is None or now > newest
            if accepted:
                ethernet = poll[poll["if_type"] == throughput.ETHERNET_IF_TYPE]
                seconds = (now - newest) / 1e6 if newest is not None else 0.0
                totals, current = [0.0, 0.0], {}
                for index, received, sent in zip(ethernet["if_index"], ethernet["in_bytes"], ethernet["out_bytes"]):
                    current[str(int(index))] = [int(received), int(sent)]
                    past = earlier.get(str(int(index)))
                    if past is None or seconds <= throughput.MIN_INTERVAL_SECONDS:
                        continue
                    for i, (value, old) in enumerate(zip((int(received), int(sent)), past)):
                        if value >= old:
                            totals[i] += (value - old) * 8 / seconds / 1000
                cap = float(ethernet["high_speed"].fillna(0).sum()) * 1000
                in_kbps, out_kbps = (0.0 if 0 < cap < total else total for total in totals)
                newest, earlier = now, current
            out.append((poll["device_id"].iloc[0], arrival, ts, accepted, in_kbps, out_kbps))
        names = ["device_id", "poll_arrival", "poll_ts", "accepted", "in_kbps", "out_kbps"]
        return pd.DataFrame(out, columns=names), (newest, json.dumps(earlier), float(in_kbps), float(out_kbps))

    return ordered(
        samples,
        ["device_id"],
        step,
        output="device_id BIGINT, poll_arrival BIGINT, poll_ts TIMESTAMP, accepted BOOLEAN, in_kbps DOUBLE, out_kbps DOUBLE",
        state="newest BIGINT, counters STRING, in_kbps DOUBLE, out_kbps DOUBLE",
        arrival="poll_arrival",
    )


def latest_fresh(
    timeline: DataFrame, *, keys: list[str], value: str, fresh_seconds: float, ts: str = "ts"
) -> DataFrame:
    """As-of lookup on a stream of samples (``value`` set) and requests (``value`` null): adds ``latest`` to requests."""
    fresh = int(fresh_seconds * 1_000_000)

    def step(rows: pd.DataFrame, held: tuple | None):
        newest, known = held or (None, None)
        found = []
        for now, sample in zip(_micros(rows[ts]).tolist(), rows[value]):
            if not pd.isna(sample):
                if newest is None or now > newest:
                    newest, known = now, float(sample)
                found.append(None)
            else:
                found.append(known if newest is not None and now - newest <= fresh else None)
        rows["latest"] = pd.Series(found, dtype="object")
        return rows[rows[value].isna()], (newest, known)

    fields = _with(timeline, T.StructField("latest", T.DoubleType()))
    return ordered(timeline, keys, step, output=fields, state="newest BIGINT, known DOUBLE")


def failure_streaks(log: DataFrame, *, key: str = "device_id", outcome: str = "outcome") -> DataFrame:
    """Poll failure streaks: the state is the current streak."""

    def step(rows: pd.DataFrame, held: tuple | None):
        start = held[0] if held else 0
        missed = (rows[outcome] != "ok").astype("int64")
        total = missed.cumsum() + start
        base = total.where(missed == 0).ffill().fillna(0).astype("int64")
        rows["failures"] = total - base
        before = _carry(rows["failures"], start).astype("int64")
        rows["expected_skip"] = (before >= polls.BACKOFF_FAILURES) & (before % polls.BACKOFF_EVERY != 0)
        return rows, (int(rows["failures"].iloc[-1]),)

    fields = (T.StructField("failures", T.LongType()), T.StructField("expected_skip", T.BooleanType()))
    return ordered(log, [key], step, output=_with(log, *fields), state="failures BIGINT")


def host_key_changes(keys: DataFrame, *, key: str = "device_id") -> DataFrame:
    """Changed fingerprints: the state is the last non-empty one."""

    def step(rows: pd.DataFrame, held: tuple | None):
        seen = rows[rows["fingerprint"].fillna("") != ""].copy()
        if seen.empty:
            return rows.iloc[0:0].assign(previous=None), held or (None,)
        seen["previous"] = _carry(seen["fingerprint"], held[0] if held else None)
        changed = seen[seen["previous"].notna() & (seen["previous"] != seen["fingerprint"])]
        return changed, (seen["fingerprint"].iloc[-1],)

    return ordered(keys, [key], step, output=_with(keys, T.StructField("previous", T.StringType())), state="fingerprint STRING")


def command_results(attempts: DataFrame, *, command: str = "command_id") -> DataFrame:
    """First execution of a command wins: the state is its (status, result)."""

    def step(rows: pd.DataFrame, held: tuple | None):
        first = held or (rows["status"].iloc[0], rows["result"].iloc[0])
        rows["redelivery"] = [held is not None or i > 0 for i in range(len(rows))]
        rows["status"], rows["result"] = first
        return rows, tuple(first)

    fields = _with(attempts, T.StructField("redelivery", T.BooleanType()))
    return ordered(attempts.where(F.coalesce(F.col(command), F.lit("")) != ""), [command], step, output=fields, state="status STRING, result STRING")


def newer_snapshots(rows: DataFrame, *, keys: list[str], ts: str = "timestamp") -> DataFrame:
    """Rows of snapshots not older than the newest one seen: a late snapshot never reverts a newer one."""

    def step(pdf: pd.DataFrame, held: tuple | None):
        clock = _micros(pdf[ts])
        newest = max([int(clock.max()), *([held[0]] if held else [])])
        return pdf[clock == newest] if not held or newest >= held[0] else pdf.iloc[0:0], (newest,)

    return ordered(rows, keys, step, output=rows.schema, state="newest BIGINT", arrival=ts)


# ------------------------------------------------------------------------------------------------- admission streams


def accept_spaced(events: DataFrame, *, keys: list[str], gap_seconds: float, ts: str = "ts", arrival: str = "arrival_no") -> DataFrame:
    """Minimum spacing: the state is the last accepted time."""
    gap = int(gap_seconds * 1_000_000)

    def step(rows: pd.DataFrame, held: tuple | None):
        clock = _micros(rows[ts])
        last = held[0] if held else admission.NEVER
        accepted = admission.spaced_rows(clock, gap, last)
        rows["accepted"] = accepted
        return rows, (int(clock[accepted][-1]) if accepted.any() else last,)

    return ordered(events, keys, step, output=_with(events, T.StructField("accepted", T.BooleanType())), state="last BIGINT", arrival=arrival)


def token_bucket(
    events: DataFrame, *, keys: list[str], rate: int, per_seconds: int = 1, burst: int | None = None, ts: str = "ts"
) -> DataFrame:
    """Token bucket: the state is the time at which the bucket is full again, and the newest time seen."""
    cost = per_seconds * 1_000_000
    capacity = (2 * rate if burst is None else burst) * cost

    def step(rows: pd.DataFrame, held: tuple | None):
        full_at, newest = held or (admission.NEVER, admission.NEVER)
        clock = (np.maximum.accumulate(np.maximum(_micros(rows[ts]), newest)) - admission.CLOCK_ORIGIN_MICROS) * rate
        accepted = admission.bucket_rows(clock, cost, capacity, full_at)
        for now in clock[accepted].tolist():
            full_at = max(full_at, now) + cost
        rows["accepted"] = accepted
        return rows, (int(full_at), int(clock[-1] // rate + admission.CLOCK_ORIGIN_MICROS))

    return ordered(events, keys, step, output=_with(events, T.StructField("accepted", T.BooleanType())), state="full_at BIGINT, newest BIGINT")


# ---------------------------------------------------------------------------------------------------- native streams


def debounce(events: DataFrame, *, keys: list[str], gap_seconds: float, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Debounced triggers with Spark's own session windows; a burst is emitted once the watermark has passed it."""
    session = F.session_window(F.col(ts), f"{gap_seconds} seconds")
    grouped = events.withWatermark(ts, delay).groupBy(*keys, session)
    return grouped.agg(
        F.min("arrival_no").alias("first_arrival"),
        F.max("arrival_no").alias("last_arrival"),
        F.count("*").alias("event_count"),
    ).select(*keys, "first_arrival", "last_arrival", "event_count", F.col("session_window.end").alias("fire_ts"))


def unseen_batches(batches: DataFrame, *, owner: str = "probe_id", ts: str = "recv_ts", delay: str = "10 minutes") -> DataFrame:
    """Identical replays within the watermark are dropped."""
    return keyed(batches).withWatermark(ts, delay).dropDuplicatesWithinWatermark([owner, "batch_key"])
