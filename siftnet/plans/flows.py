"""From landed datagrams to the flow table: the end-to-end plan.

v5 and sFlow need no shuffle before deduplication. v9/IPFIX sets and records are not shuffled either while the indexes of templates and
sampling rates are small. Payloads are read once for the heads of their sets, and once or twice to be decoded; only heads, distinct template
sets, the template index and learned rates are written in between. Deduplication shuffles by device key and segment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftnet.operators import datagrams, dedup, flows, lookups, segments, sequence, sflow
from siftnet.session import checkpointed


def v5_flows(captured: DataFrame) -> DataFrame:
    return flows.v5_flows(datagrams.v5_records(datagrams.v5_headers(captured)))


def set_heads(captured: DataFrame) -> DataFrame:
    """All v9/IPFIX sets without the bodies of data sets: a few bytes a set, read several times, so written once."""
    return checkpointed(datagrams.sets(datagrams.framed(captured, bodies=False)))


def template_bodies(heads: DataFrame) -> DataFrame:
    """What exporters announce: repeats of a few template sets, each read once."""
    return checkpointed(datagrams.template_bodies(heads))


def matched_sets(captured: DataFrame, heads: DataFrame, bodies: DataFrame | None = None) -> DataFrame:
    """v9/IPFIX data sets with their template."""
    bodies = template_bodies(heads) if bodies is None else bodies
    announced = datagrams.usable_templates(datagrams.templates(heads, bodies))
    # the index is made of the digests of what is announced
    definitions = datagrams.usable_templates(bodies).select("definition", "fields", "is_options").dropDuplicates(["definition"])
    known = datagrams.template_index(announced, datagrams.data_sets(heads), definitions=definitions, kept=checkpointed)
    return datagrams.with_templates(datagrams.data_sets(datagrams.sets(datagrams.framed(captured))), index=checkpointed(known))


def decoded_template_sets(captured: DataFrame) -> DataFrame:
    """What decoding makes of each v9/IPFIX data set."""
    return datagrams.decoded_sets(matched_sets(captured, set_heads(captured)))


def template_flows(captured: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    heads = set_heads(captured)
    bodies = template_bodies(heads)
    matched = matched_sets(captured, heads, bodies)
    told = datagrams.columns_told(bodies)
    # two indexes read what records teach: a small table
    facts = checkpointed(flows.rate_facts(datagrams.records(matched.where(flows.teaches_rate(F.col("fields"), F.col("is_options"))), told=told)))
    # written, so that their size is known before the records would be shuffled to them
    of_domains, of_samplers = (checkpointed(index) for index in flows.rate_indexes(facts, heads))
    return flows.template_flows(flows.with_sampling_rate(datagrams.records(matched, told=told), overrides, indexes=(of_domains, of_samplers)))


def sflow_flows(captured: DataFrame) -> DataFrame:
    return sflow.flow_samples(sflow.samples(captured))


def flow_samples(
    netflow: DataFrame,
    sflow_datagrams: DataFrame,
    devices: DataFrame,
    addresses: DataFrame,
    *,
    probe_id: int,
    policy: str = "off",
    overrides: DataFrame | None = None,
) -> DataFrame:
    """The canonical flow table of both listeners: decoded, scaled, resolved to devices and deduplicated.

    Both captures carry arrival numbers from one sequence.
    """
    rows = (
        v5_flows(netflow)
        .unionByName(template_flows(netflow, overrides), allowMissingColumns=True)
        .unionByName(sflow_flows(sflow_datagrams), allowMissingColumns=True)
    )
    unresolved = rows.withColumn("device_id", F.lit(0).cast("bigint"))
    resolved = lookups.stamp(unresolved, devices, addresses, probe_id=probe_id, ip="sampler_address")
    keyed = resolved.withColumn("dedup_key", dedup.dedup_key(F.col("device_id"), F.col("sampler_address"))).withColumn(
        "family", dedup.export_family(F.col("flow_source"))
    )
    # flows of one datagram share its arrival number and receive time, so their order does not matter; a segment counts
    # datagrams, each with some 30 flows
    kept = dedup.deduplicate(keyed, policy, ts="recv_ts", span=segments.SEGMENT_SPAN // 32)
    return flows.flow_samples(kept)


def parse_events(captured: DataFrame) -> DataFrame:
    """Counts of everything the decoders refused, by event."""
    heads = set_heads(captured)
    framed = datagrams.framed(captured, bodies=False).drop("sets")
    decoded = datagrams.decoded_sets(matched_sets(captured, heads))
    v5 = datagrams.v5_headers(captured)
    losses = sequence.sequence_events(
        v5.where(F.length("payload") >= datagrams.V5_HEADER)
        .select(
            "arrival_no", "exporter", "domain", F.lit(5).alias("version"), "sequence", "increment", "uptime_ms",
            F.lit(True).alias("countable"),
        )
        .unionByName(datagrams.export_headers(framed, decoded))
    )
    refused = (
        datagrams.dispatch(captured).select("event")
        .unionByName(v5.select("event"))
        .unionByName(framed.select("event"))
        .unionByName(datagrams.templates(heads).select(F.col("verdict").alias("event")))
        .unionByName(decoded.select("event"))
        .unionByName(losses.select("event"))
    )
    return refused.where("event is not null").groupBy("event").agg(F.count("*").alias("total"))
