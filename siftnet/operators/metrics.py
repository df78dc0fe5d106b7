"""Ping summaries and operational counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper bounds of the poll-duration histogram, in seconds.
POLL_SECONDS_BUCKETS = [0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0]


def known(label: Column) -> Column:
    """A blank label reads ``unknown``."""
    return F.when(F.coalesce(label, F.lit("")) == "", "unknown").otherwise(label)


def ping_summary(echoes: DataFrame, *, keys: list[str]) -> DataFrame:
    """One result per target from single echoes (``replied``, ``latency_ms``, ``ttl``)."""
    sent, received = F.count("*"), F.count_if("replied")
    total = echoes.groupBy(*keys).agg(
        sent.alias("sent"),
        received.alias("received"),
        F.avg(F.when(F.col("replied"), F.col("latency_ms"))).alias("_latency"),
    )
    loss = (F.col("sent") - F.col("received")) / F.col("sent") * 100
    return total.select(
        *keys,
        "sent",
        "received",
        (F.col("received") > 0).alias("success"),
        F.coalesce("_latency", F.lit(0.0)).alias("latency"),
        loss.alias("packet_loss"),
        F.when(F.col("received") == 0, "Request timeout").otherwise("").alias("error_message"),
    )


def counters(events: DataFrame, *, labels: list[str]) -> DataFrame:
    """Occurrences per label combination, blanks as ``unknown``."""
    return events.groupBy(*[known(F.col(label)).alias(label) for label in labels]).agg(F.count("*").alias("total"))


def histogram(
    polls: DataFrame, *, labels: list[str], value: str = "seconds", buckets: list[float] = POLL_SECONDS_BUCKETS
) -> DataFrame:
    """Cumulative histogram rows (``le``, ``n``) with ``+Inf``, plus sum and count, in one aggregation."""
    named = [known(F.col(label)).alias(label) for label in labels]
    wide = polls.groupBy(*named).agg(
        F.array(
            *[
                F.struct(F.lit(f"{bound:g}").alias("le"), F.count_if(F.col(value) <= bound).alias("n"))
                for bound in buckets
            ],
            F.struct(F.lit("+Inf").alias("le"), F.count("*").alias("n")),
        ).alias("_buckets"),
        F.sum(value).alias("sum"),
        F.count("*").alias("count"),
    )
    return wide.select(*labels, "sum", "count", F.inline("_buckets"))


def last_success(polls: DataFrame, devices: DataFrame, *, ok: Column, ts: str = "ts") -> DataFrame:
    """Unix seconds of the last successful poll of every device, 0 if there never was one."""
    newest = polls.where(ok).groupBy("device_id").agg(F.max(ts).alias("_ts"))
    return devices.select(F.col("id").alias("device_id")).join(newest, "device_id", "left").select(
        "device_id", F.coalesce(F.unix_seconds("_ts"), F.lit(0)).alias("last_success")
    )
