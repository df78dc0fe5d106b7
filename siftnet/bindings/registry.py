"""Queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores where a table is a single small file, as the test tables are; a table of many files is left as it
    is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = len(df.inputFiles())
    return df.repartition(cores) if files < cores else df


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as telemetry: device = user, arrival order = event id, times as instants."""
    rows = table(spark, sf_dir, "events")
    return rows.select(
        F.col("event_id").alias("arrival_no"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("device_id"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


#: The same view in SQL.
EVENTS_SQL = """e AS (
  SELECT event_id AS arrival_no, epoch_us(ts) AS us, user_id AS device_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events)"""
