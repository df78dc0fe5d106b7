"""Device throughput from interface counters, and the values later rows borrow from the newest poll."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftnet.operators import segments

# The interface type that counts, the shortest usable interval, and the freshness factor.
ETHERNET_IF_TYPE = 6
MIN_INTERVAL_SECONDS = 5
FRESH_POLL_INTERVALS = 3


def accepted_polls(samples: DataFrame, *, span: int = segments.SEGMENT_SPAN) -> DataFrame:
    """One row per (device, poll) with ``accepted``, ``prev_poll_ts`` (newest accepted before) and ``newest_ts`` (newest
    accepted so far, this poll included).

    ``samples`` has ``device_id``, ``poll_ts``, ``poll_arrival``. A poll whose time does not exceed the newest earlier
    one of its device is ignored, so the newest accepted time is simply the largest time so far.
    """
    polls = samples.groupBy("device_id", "poll_arrival").agg(F.max("poll_ts").alias("poll_ts"))
    time = F.col("poll_ts")
    seen = segments.scan(
        polls, ["device_id"], "poll_arrival", max_before={"prev_poll_ts": time}, running_max={"newest_ts": time}, span=span
    )
    fresh = F.col("prev_poll_ts").isNull() | (F.col("poll_ts") > F.col("prev_poll_ts"))
    return segments.finish(seen.withColumn("accepted", fresh))


def device_throughput(samples: DataFrame, *, span: int = segments.SEGMENT_SPAN) -> DataFrame:
    """``in_kbps`` and ``out_kbps`` per (device, poll), every poll in its arrival order.

    ``samples``: one row per (device, poll, interface) with ``device_id``, ``poll_arrival`` (BIGINT, unique per poll),
    ``poll_ts`` (TIMESTAMP), ``if_index``, ``if_type``, ``in_bytes``, ``out_bytes``, ``high_speed`` (Mbps).

    The previous sample of an interface must come from the device's previous accepted poll, so it is found by an
    equi-join on (device, interface, that poll's time): the key is nearly unique and no device can skew it.
    An ignored poll returns the rate of the newest accepted one.
    """
    polls = accepted_polls(samples, span=span)
    ethernet = samples.where(F.col("if_type") == ETHERNET_IF_TYPE).select(
        "device_id", "poll_arrival", "if_index", "in_bytes", "out_bytes", F.coalesce("high_speed", F.lit(0)).alias("high_speed")
    )
    kept = ethernet.join(polls.where("accepted"), ["device_id", "poll_arrival"])
    earlier = kept.select(
        "device_id",
        "if_index",
        F.col("poll_ts").alias("prev_poll_ts"),
        F.col("in_bytes").alias("_in"),
        F.col("out_bytes").alias("_out"),
    )
    pairs = kept.join(earlier, ["device_id", "if_index", "prev_poll_ts"], "left")
    seconds = (F.unix_micros("poll_ts") - F.unix_micros("prev_poll_ts")) / F.lit(1e6)

    def rate(now: str, then: str) -> Column:
        usable = (F.col(now) >= F.col(then)) & (seconds > MIN_INTERVAL_SECONDS)
        return F.when(usable, (F.col(now) - F.col(then)).cast("double") * 8 / seconds / 1000).otherwise(F.lit(0.0))

    totals = pairs.groupBy("device_id", F.col("poll_ts").alias("newest_ts")).agg(
        F.sum(rate("in_bytes", "_in")).alias("_in_kbps"),
        F.sum(rate("out_bytes", "_out")).alias("_out_kbps"),
        (F.sum("high_speed").cast("double") * 1000).alias("_cap"),
    )

    def capped(total: str) -> Column:
        return F.when((F.col("_cap") > 0) & (F.col(total) > F.col("_cap")), 0.0).otherwise(F.coalesce(total, F.lit(0.0)))

    # accepted times of a device are distinct, so an ignored poll finds the newest accepted one by its time
    return polls.join(totals, ["device_id", "newest_ts"], "left").select(
        "device_id",
        "poll_arrival",
        "poll_ts",
        "accepted",
        capped("_in_kbps").alias("in_kbps"),
        capped("_out_kbps").alias("out_kbps"),
    )


def latest_fresh(
    requests: DataFrame,
    samples: DataFrame,
    *,
    keys: list[str],
    values: list[str],
    fresh_seconds: float,
    ts: str = "ts",
    arrival: str = "arrival_no",
    span: int = segments.SEGMENT_SPAN,
) -> DataFrame:
    """As-of lookup: the newest sample that arrived before each request, null once older than ``fresh_seconds``.

    Both inputs carry ``keys``, ``ts`` and a shared, unique ``arrival_no``. Samples whose time does not exceed the
    newest earlier one of the key are ignored, as a late poll must not replace a newer value. Adds ``sample_ts`` and
    the value columns as ``latest_<name>``.
    """
    # accepted samples have ever larger times, so the latest is the largest by time; of equal times the first counts
    sample = F.struct(F.col(ts).alias("sample_ts"), (-F.col(arrival)).alias("_first"), *[F.col(v) for v in values])
    facts = samples.select(*keys, ts, arrival, sample.alias("_sample"), F.lit(None).alias("_request"))
    payload = F.struct(*[F.col(c) for c in requests.columns if c not in {*keys, ts, arrival}] or [F.lit(1).alias("_one")])
    asks = requests.select(*keys, ts, arrival, F.lit(None).alias("_sample"), payload.alias("_request"))
    timeline = facts.unionByName(asks)
    looked = segments.scan(timeline, keys, arrival, running_max={"_latest": F.col("_sample")}, span=span).where(
        "_request is not null"
    )
    age = F.unix_micros(F.col(ts)) - F.unix_micros(F.col("_latest.sample_ts"))
    fresh = age <= F.lit(int(fresh_seconds * 1_000_000))
    columns = []
    for name in requests.columns:
        columns.append(F.col(name) if name in {*keys, ts, arrival} else F.col(f"_request.{name}").alias(name))
    return looked.select(
        *columns,
        F.when(fresh, F.col("_latest.sample_ts")).alias("sample_ts"),
        *[F.when(fresh, F.col(f"_latest.{v}")).alias(f"latest_{v}") for v in values],
    )


def cached_throughput(requests: DataFrame, rates: DataFrame, *, poll_seconds: float = 60, **options) -> DataFrame:
    """Latest fresh rate of the device per request, 0/0 without one."""
    found = latest_fresh(
        requests,
        rates,
        keys=["device_id"],
        values=["in_kbps", "out_kbps"],
        fresh_seconds=FRESH_POLL_INTERVALS * poll_seconds,
        **options,
    )
    return found.select(
        *requests.columns,
        F.coalesce("latest_in_kbps", F.lit(0.0)).alias("in_kbps"),
        F.coalesce("latest_out_kbps", F.lit(0.0)).alias("out_kbps"),
    )


VITALS = ["cpu_usage", "memory_usage", "disk_usage", "disk_total", "session_count"]


def performance_cpu() -> Column:
    """CPU of a performance row that has no fresh poll to borrow from."""
    parts = ["cpu_user", "cpu_system", "cpu_nice", "cpu_iowait", "cpu_irq", "cpu_softirq"]
    return sum((F.coalesce(F.col(p), F.lit(0.0)) for p in parts[1:]), F.coalesce(F.col(parts[0]), F.lit(0.0)))


def coherent_vitals(performance: DataFrame, polled: DataFrame, *, poll_seconds: float = 60, **options) -> DataFrame:
    """Performance rows take the five vitals of the latest fresh poll as a whole, or keep their own."""
    found = latest_fresh(
        performance,
        polled,
        keys=["device_id"],
        values=VITALS,
        fresh_seconds=FRESH_POLL_INTERVALS * poll_seconds,
        **options,
    )
    fresh = F.col("sample_ts").isNotNull()
    replaced = [F.when(fresh, F.col(f"latest_{v}")).otherwise(F.col(v)).alias(v) for v in VITALS]
    return found.select(*[c for c in performance.columns if c not in VITALS], *replaced, fresh.alias("from_poll"))


def assigned_only(state: DataFrame, devices: DataFrame, *, key: str = "device_id") -> DataFrame:
    """Drop derived state of devices that are no longer assigned."""
    return state.join(devices.select(F.col("id").alias(key)).distinct(), key, "left_semi")
