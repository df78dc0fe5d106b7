"""Export-sequence accounting: gaps and resynchronisations per exporter stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftnet.operators import segments

# Width of the sequence counters, and the distance from which a jump means a restart.
SEQUENCE_MODULUS = 1 << 32
RESYNC_DISTANCE = 1 << 24


def sequence_events(
    headers: DataFrame,
    *,
    keys: tuple[str, ...] = ("exporter", "domain", "version"),
    arrival: str = "arrival_no",
    span: int = segments.SEGMENT_SPAN,
) -> DataFrame:
    """Add ``event`` (null, ``seq_gap`` or ``seq_resync``) and ``lost_units`` to datagram headers.

    ``headers`` needs ``sequence``, ``increment`` (records for v5, 1 for v9, data records for IPFIX), ``uptime_ms``
    (null where the protocol has none) and ``countable``. After an uncountable datagram the next one starts afresh.
    """
    before = F.struct("sequence", "increment", "uptime_ms", "countable")
    scanned = segments.scan(headers, keys, arrival, prev={"_before": before}, span=span)
    expected = F.pmod(F.col("_before.sequence") + F.col("_before.increment"), F.lit(SEQUENCE_MODULUS))
    delta = F.pmod(F.col("sequence") - expected, F.lit(SEQUENCE_MODULUS))
    restarted = F.coalesce(F.col("uptime_ms") < F.col("_before.uptime_ms"), F.lit(False))
    event = (
        F.when(F.col("_before").isNull() | ~F.col("_before.countable") | (delta == 0), F.lit(None).cast("string"))
        .when(restarted | (delta >= RESYNC_DISTANCE), "seq_resync")
        .otherwise("seq_gap")
    )
    result = scanned.withColumn("event", event).withColumn(
        "lost_units", F.when(F.col("event") == "seq_gap", delta).otherwise(F.lit(0).cast("bigint"))
    )
    return segments.finish(result.drop("_before"))


def sequence_loss(events: DataFrame, *, keys: tuple[str, ...] = ("exporter", "domain", "version")) -> DataFrame:
    """Events and lost units per stream."""
    return events.groupBy(*keys).agg(
        F.count_if(F.col("event") == "seq_gap").alias("gaps"),
        F.count_if(F.col("event") == "seq_resync").alias("resyncs"),
        F.sum("lost_units").cast("bigint").alias("lost_units"),
    )
