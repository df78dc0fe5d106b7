"""Ordered operators on streams, run as batches with a carried state.

A micro-batch is an ordinary table, so the segmented batch operators apply to it as they are: a key that sends a third of everything is
cut into segments there, and no task ever holds a whole key. What an operator needs of the past is one row per key, the newest that
matters. Those rows are kept in a table (:func:`siftnet.sources.sinks.snapshot_writer`), go in front of the next micro-batch, and are
taken out of its result again. The step is associative: cut the stream anywhere, and the rows stay the same.

Every function here gives a ``foreachBatch`` function. ``sink(rows, batch_id)`` receives the result; a retried micro-batch finds the state that
it found the first time, so a sink that overwrites by batch id sees everything once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftnet.operators import dedup, segments, sequence, throughput
from siftnet.sources import sinks

Sink = Callable[[DataFrame, int], None]


def carried(
    path: str, *, keys: list[str], newest: str, matters: Column | None, step: Callable[[DataFrame], DataFrame], sink: Sink, buckets: int = sinks.SNAPSHOT_BUCKETS
) -> Sink:
    """Run ``step`` over each micro-batch with the held rows in front of it.

    Held is, for each of ``keys``, the row with the largest ``newest`` among those that ``matters``. Of the state only keys of the micro-batch are
    read into the step, and only buckets with newer rows are written.
    """
    remember = sinks.snapshot_writer(path, keys=keys, ts=newest, buckets=buckets)

    def run(batch: DataFrame, batch_id: int) -> None:
        held = sinks.read_snapshots(batch.sparkSession, path, batch.schema, before=batch_id).drop("_bucket")
        asked = batch.select(*[F.col(k).alias(f"_k_{k}") for k in keys]).distinct()
        same = F.lit(True)
        for key in keys:
            same = same & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
        before = held.join(asked, same, "left_semi").withColumn("_held", F.lit(True))
        result = step(before.unionByName(batch.withColumn("_held", F.lit(False))))
        sink(result.where("not _held").drop("_held"), batch_id)
        remember(batch if matters is None else batch.where(matters), batch_id)

    return run


def mark_duplicates(
    path: str, sink: Sink, policy: str, *, key: str = "dedup_key", family: str = "family", ts: str = "ts", arrival: str = "arrival_no",
    window_seconds: float = dedup.DEDUP_WINDOW_SECONDS, span: int = segments.SEGMENT_SPAN,
) -> Sink:
    """Dual-export deduplication: held is the last row of the preferred family."""
    options = {"key": key, "family": family, "ts": ts, "arrival": arrival, "window_seconds": window_seconds, "span": span}
    preferred = dedup.PREFERRED.get(policy)
    matters = F.lit(False) if preferred is None else F.col(family) == preferred
    return carried(path, keys=[key], newest=arrival, matters=matters, step=lambda rows: dedup.mark_duplicates(rows, policy, **options), sink=sink)


def suppression_changes(
    path: str, sink: Sink, *, key: str = "dedup_key", family: str = "family", arrival: str = "arrival_no", span: int = segments.SEGMENT_SPAN
) -> Sink:
    """Flips of suppression in marked flows: held is the last row of each (key, family)."""
    step = lambda rows: dedup.suppression_changes(rows, key=key, family=family, arrival=arrival, span=span)
    return carried(path, keys=[key, family], newest=arrival, matters=None, step=step, sink=sink)


def sequence_events(
    path: str, sink: Sink, *, keys: tuple[str, ...] = ("exporter", "domain", "version"), arrival: str = "arrival_no", span: int = segments.SEGMENT_SPAN
) -> Sink:
    """Export-sequence gaps: held is the last header of each stream."""
    return carried(
        path, keys=list(keys), newest=arrival, matters=None, step=lambda rows: sequence.sequence_events(rows, keys=keys, arrival=arrival, span=span), sink=sink
    )


def _looked_up(path: str, sink: Sink, is_sample: Column, ts: str, lookup: Callable[[DataFrame, DataFrame], DataFrame]) -> Sink:
    """Requests and samples in one stream of one schema: held is the newest sample of each device. Only requests come out."""

    def step(rows: DataFrame) -> DataFrame:
        return lookup(rows.where(~is_sample), rows.where(is_sample).drop("_held"))

    return carried(path, keys=["device_id"], newest=ts, matters=is_sample, step=step, sink=sink)


def cached_throughput(path: str, sink: Sink, *, is_sample: Column, ts: str = "ts", **options) -> Sink:
    """Latest fresh rate per request; ``in_kbps`` and ``out_kbps`` of a request are replaced."""

    def lookup(requests: DataFrame, rates: DataFrame) -> DataFrame:
        return throughput.cached_throughput(requests.drop("in_kbps", "out_kbps"), rates, ts=ts, **options)

    return _looked_up(path, sink, is_sample, ts, lookup)


def coherent_vitals(path: str, sink: Sink, *, is_poll: Column, ts: str = "ts", **options) -> Sink:
    """Performance rows with the vitals of the latest fresh poll, as a whole."""
    return _looked_up(path, sink, is_poll, ts, lambda performance, polled: throughput.coherent_vitals(performance, polled, ts=ts, **options))
