"""Landed captures as DataFrames: batch files or streams of them, always with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftnet import schemas
from siftnet.operators import cli, snmp

RAW = {
    "datagrams": schemas.RAW_DATAGRAMS,
    "lines": schemas.RAW_LINES,
    "pdus": schemas.RAW_PDUS,
    "traps": schemas.RAW_TRAPS,
    "cli": schemas.RAW_CLI,
}


def read_raw(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.schema(RAW[table]).parquet(path)


def stream_raw(spark: SparkSession, path: str, table: str, *, files_per_trigger: int = 100) -> DataFrame:
    """The same table as a stream of newly landed files, a bounded number per batch."""
    return spark.readStream.schema(RAW[table]).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def datagrams_from_kafka(spark: SparkSession, options: dict[str, str], partitions: int) -> DataFrame:
    """Datagrams from a topic of ``partitions`` partitions (value = payload, key = exporter address)."""
    return topic_records(spark.readStream.format("kafka").options(**options).load(), partitions)


def topic_records(rows: DataFrame, partitions: int) -> DataFrame:
    """Topic rows as datagrams. The topic must be keyed by exporter: all datagrams of one exporter are then in one partition, whose
    offsets are their receive order, and that is the only order that the operators use. Numbers are unique over all
    partitions; between exporters they mean nothing. A partition number outside 0..partitions-1 is an error."""
    inside = F.col("partition").between(0, partitions - 1)
    number = F.when(inside, F.col("offset") * partitions + F.col("partition"))
    return rows.select(
        F.col("timestamp").alias("recv_ts"),
        F.coalesce(number, F.raise_error(F.lit("more topic partitions than stated")).cast("bigint")).alias("arrival_no"),
        F.col("key").cast("string").alias("exporter"),
        F.col("value").alias("payload"),
    )


def split_lines(chunks: DataFrame, *, text: str = "text") -> DataFrame:
    """Received chunks to lines: split at line feeds, empty lines dropped, an unterminated tail kept whatever its length."""
    rows = chunks.select(*[c for c in chunks.columns if c != text], F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return rows.where(F.length("line") > 0)


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line").where(F.length("line") > 0)


def walk(pdus: DataFrame) -> DataFrame:
    """PDUs that carry a value."""
    return snmp.valid_pdus(pdus)


def capture_lines(captures: DataFrame) -> DataFrame:
    """(capture columns, line_no, line) without pager lines."""
    return captures.select(
        *[c for c in captures.columns if c != "output"],
        F.posexplode(cli.lines(F.col("output"))).alias("line_no", "line"),
    )


def json_records(rows: DataFrame, schema: T.StructType | str, *, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(parsed records, rejected rows): malformed items are set aside and counted, never fatal."""
    target = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    with_error = T.StructType([*target.fields, T.StructField("_corrupt", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = rows.withColumn("_r", F.from_json(payload, with_error, options))
    bad = F.col("_r").isNull() | F.col("_r._corrupt").isNotNull()
    other = [c for c in rows.columns if c != payload]
    good = parsed.where(~bad).select(*other, *[F.col(f"_r.{f.name}").alias(f.name) for f in target.fields])
    return good, parsed.where(bad).select(*rows.columns)


def envelopes(rows: DataFrame, kinds: dict[str, T.StructType | str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Mixed-kind buffer (``kind``, ``payload``) to one DataFrame per kind, plus malformed and unroutable rows."""
    parts: dict[str, DataFrame] = {}
    rejected = rows.where(~F.coalesce(F.col("kind").isin(list(kinds)), F.lit(False)))
    for kind, schema in kinds.items():
        parts[kind], bad = json_records(rows.where(F.col("kind") == kind), schema)
        rejected = rejected.unionByName(bad)
    return parts, rejected
