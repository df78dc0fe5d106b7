"""Poll bookkeeping: failure streaks, due polls, command logs, host keys and liveness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftnet.operators import segments
from siftnet.operators.admission import accept_spaced

# Fixed values of the poll rules.
BACKOFF_FAILURES = 3
BACKOFF_EVERY = 5
TOPOLOGY_EVERY = 5
DEFAULT_SSH_INTERVAL_SECONDS = 900
DEFAULT_HEARTBEAT_SECONDS = 60


def failure_streaks(
    polls: DataFrame,
    *,
    key: str = "device_id",
    arrival: str = "arrival_no",
    outcome: str = "outcome",
    span: int = segments.SEGMENT_SPAN,
) -> DataFrame:
    """Add ``failures`` (streak after this poll) and ``expected_skip`` (the rule, from the streak before it).

    Every outcome but ``ok`` lengthens the streak: a skipped poll counts as well.
    """
    ok = F.col(outcome) == "ok"
    window = segments.inside([key], arrival)
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    missed = F.sum(F.when(ok, 0).otherwise(1)).over(upto)
    earlier = segments.across([key]).rowsBetween(Window.unboundedPreceding, -1)
    # the count of misses never falls, so its value at the last success is its largest value at any success
    rows = segments.two_level(
        polls.withColumn("_ok", ok),
        [key],
        arrival,
        local={"_missed": missed},
        summary={
            "_total": F.max("_missed"),
            "_at_ok": F.max(F.when(F.col("_ok"), F.col("_missed"))),
        },
        carry=[
            {"_before": F.coalesce(F.sum("_total").over(earlier), F.lit(0))},
            {
                "_carried": F.coalesce(F.sum("_total").over(earlier), F.lit(0)),
                "_base": F.coalesce(F.max(F.col("_before") + F.col("_at_ok")).over(earlier), F.lit(0)),
            },
        ],
        span=span,
    )
    total = F.col("_missed") + F.col("_carried")
    base = F.greatest(F.max(F.when(F.col("_ok"), total)).over(upto), F.col("_base"))
    # before a success the streak stood at the misses since the success before it
    before_base = F.greatest(F.max(F.when(F.col("_ok"), total)).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.col("_base"))
    before = total - F.when(F.col("_ok"), 0).otherwise(1) - before_base
    judged = rows.withColumn("failures", total - base).withColumn(
        "expected_skip", (before >= BACKOFF_FAILURES) & (before % BACKOFF_EVERY != 0)
    )
    return segments.finish(judged.drop("_ok", "_missed", "_carried", "_base"))


def due_polls(
    sightings: DataFrame, *, key: str = "device_id", interval_seconds: float = 0, ts: str = "ts", **options
) -> DataFrame:
    """Add ``due``: first sighting, or the interval (<= 0 means 15 minutes) since the last due one has passed."""
    seconds = interval_seconds if interval_seconds > 0 else DEFAULT_SSH_INTERVAL_SECONDS
    marked = accept_spaced(sightings, keys=[key], gap_seconds=seconds, ts=ts, **options)
    return marked.withColumnRenamed("accepted", "due")


def poll_number(polls: DataFrame, *, key: str = "device_id", arrival: str = "arrival_no", **options) -> DataFrame:
    """Zero-based number of each poll of a device."""
    numbered = segments.scan(polls, [key], arrival, running_sum={"poll_no": F.lit(1)}, **options)
    return segments.finish(numbered.withColumn("poll_no", (F.col("poll_no") - 1).cast("bigint")))


def every_nth_poll(polls: DataFrame, *, n: int = TOPOLOGY_EVERY, **options) -> DataFrame:
    """The polls that also collect topology: the first and every n-th after it."""
    return poll_number(polls, **options).where(F.col("poll_no") % n == 0)


def command_results(
    deliveries: DataFrame,
    *,
    known_types: list[str],
    command: str = "command_id",
    arrival: str = "arrival_no",
    received: str = "ts",
) -> DataFrame:
    """Every delivery with the result of its command's first execution; deliveries without an id are dropped.

    ``deliveries`` has ``type``, ``expires_at``, ``outcome`` and ``detail`` of the attempt. Redeliveries repeat the
    first result, found by aggregation and an equi-join rather than by a window over the command.
    """
    valid = deliveries.where(F.coalesce(F.col(command), F.lit("")) != "")
    expired = F.col("expires_at").isNotNull() & (F.col(received) > F.col("expires_at"))
    known = F.col("type").isin(known_types)
    ok = F.col("outcome") == "ok"
    status = F.when(expired | ~known | ~ok, "failed").otherwise("succeeded")
    text = (
        F.when(expired, "command expired before execution")
        .when(~known, F.format_string('unknown command type "%s"', F.col("type")))
        .otherwise(F.col("detail"))
    )
    first = valid.groupBy(command).agg(
        F.min_by(F.struct(status.alias("status"), text.alias("result")), F.col(arrival)).alias("_first"),
        F.min(arrival).alias("_executed"),
    )
    return valid.join(first, command).select(
        command,
        arrival,
        F.col("_first.status").alias("status"),
        F.col("_first.result").alias("result"),
        (F.col(arrival) != F.col("_executed")).alias("redelivery"),
    )


def observed_host_keys(keys: DataFrame, *, key: str = "device_id", arrival: str = "arrival_no") -> DataFrame:
    """Latest non-empty fingerprint per device."""
    seen = keys.where(F.coalesce("fingerprint", F.lit("")) != "")
    return seen.groupBy(key).agg(F.max_by("fingerprint", arrival).alias("fingerprint"))


def host_key_changes(
    keys: DataFrame, *, key: str = "device_id", arrival: str = "arrival_no", span: int = segments.SEGMENT_SPAN
) -> DataFrame:
    """Rows whose fingerprint differs from the device's previous one."""
    seen = keys.where(F.coalesce("fingerprint", F.lit("")) != "")
    scanned = segments.scan(seen, [key], arrival, prev={"previous": F.col("fingerprint")}, span=span)
    return segments.finish(scanned.where(F.col("previous") != F.col("fingerprint")))


def readiness(probes: DataFrame, *, now: Column, interval_seconds: Column) -> DataFrame:
    """``ready`` and the first failing check of each probe.

    ``probes`` holds the latest row per probe: ``approved``, ``last_heartbeat``, ``enabled`` and ``bound`` (arrays of
    listener names).
    """
    seconds = F.when(interval_seconds > 0, interval_seconds).otherwise(DEFAULT_HEARTBEAT_SECONDS)
    age = F.unix_micros(now) - F.unix_micros("last_heartbeat")
    fresh = F.coalesce(age <= seconds.cast("bigint") * 2_000_000, F.lit(False))
    listening = F.forall("enabled", lambda name: F.array_contains("bound", name))
    reason = (
        F.when(~F.col("approved"), "approved").when(~fresh, "heartbeat").when(~listening, "listeners").otherwise("")
    )
    return probes.withColumn("heartbeat_fresh", fresh).withColumn("reason", reason).withColumn(
        "ready", F.col("reason") == ""
    )


def latest_per_key(rows: DataFrame, *, key: str, arrival: str = "arrival_no") -> DataFrame:
    """The newest row of each key, by partial aggregation."""
    packed = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), arrival).alias("_row"))
    return packed.select("_row.*")
