"""Writing results: bounded chunks, replay-safe batches, snapshots that replace."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftnet.functions.text import content_key
from siftnet.operators import segments, snapshots

# Fixed value: rows of a batch unless another number is asked for.
BATCH_ROWS = 1000


def chunked(rows: DataFrame, *, keys: list[str], order: str, size: int = BATCH_ROWS, span: int = segments.SEGMENT_SPAN) -> DataFrame:
    """Add ``chunk_no``: consecutive chunks of at most ``size`` rows (one at least) per key, in order."""
    numbered = segments.scan(rows, keys, order, running_sum={"_n": F.lit(1)}, span=span)
    return segments.finish(
        numbered.withColumn("chunk_no", F.floor((F.col("_n") - 1) / F.lit(max(1, size))).cast("bigint")).drop("_n")
    )


def write_table(rows: DataFrame, path: str, *, partition_by: list[str] | None = None, rows_per_file: int = 0) -> None:
    """Append as Parquet. Chunks are data (:func:`chunked`), not files: partitions are balanced by bytes before the write, split
    where they are too large, and only a caller who names ``rows_per_file`` gets a bound on rows."""
    balanced = rows.hint("rebalance", *(partition_by or []))
    writer = balanced.write.mode("append").option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def keyed(batches: DataFrame, *, payload: str = "payload") -> DataFrame:
    return batches.withColumn("batch_key", content_key(F.col(payload)))


def unseen(batches: DataFrame, delivered: DataFrame | None = None, *, owner: str = "probe_id") -> DataFrame:
    """Batches not delivered before, identical replays dropped by (owner, content key)."""
    fresh = keyed(batches).dropDuplicates([owner, "batch_key"])
    if delivered is None:
        return fresh
    return fresh.join(delivered.select(owner, "batch_key"), [owner, "batch_key"], "left_anti")


def _read(spark: SparkSession, schema: str, base: str, pattern: str = "") -> DataFrame:
    """The table under ``base``, or those of its folders that match; empty where there is none yet."""
    try:
        return spark.read.schema(schema).option("basePath", base).parquet(base + pattern)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


#: Slots that replays are looked for in; more than a shuffle has partitions.
REPLAY_SLOTS = 1 << 16


def replay_safe_writer(
    path: str, *, owner: str = "probe_id", ts: str = "recv_ts", horizon_days: int = 7
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: appends batches, but for replays of what was delivered in the ``horizon_days`` before them.

    Two tables, both partitioned by day and batch id: ``rows`` with the batches, ``keys`` with owner and content key only. A call reads the
    keys of the days that its own rows can be replays of, however long the history is. A batch that is retried after a lost
    executor overwrites its own partitions and looks only at earlier batches, so it leaves the same rows. Identical batches of one owner
    meet in one task, which only streams through them.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        held = [c for c in batch.columns if c != ts]
        low, high = batch.agg(F.min(F.to_date(ts)), F.max(F.to_date(ts))).first()
        if low is None:
            return
        kind = batch.schema[owner].dataType.simpleString()
        schema = f"`{owner}` {kind}, batch_key string, day date, batch bigint"
        days = [str(r.d) for r in spark.sql(f"SELECT explode(sequence(date'{low}' - {horizon_days}, date'{high}')) AS d").collect()]
        known = _read(spark, schema, f"{path}/keys", "/day={" + ",".join(days) + "}").where(F.col("batch") < batch_id)
        # one shuffle of both sides: what arrived goes without its key, which is made behind the shuffle, and what is known goes
        # as a key in bytes
        slot = lambda key: F.pmod(F.xxhash64(F.col(owner), key), F.lit(REPLAY_SLOTS)).cast("int").alias("_slot")
        arrived = batch.select(slot(content_key(F.col("payload"))), F.struct(ts, *held).alias("_row"))
        theirs = known.select(slot(F.col("batch_key")), F.col(owner).alias("_owner"), F.unhex("batch_key").alias("_key"), F.col("day").alias("_day"))
        dealt = arrived.unionByName(theirs, allowMissingColumns=True).repartition("_slot")
        new = F.col("_row").isNotNull()
        groups = dealt.select(
            "_slot", "_row", "_day",
            F.when(new, F.col("_row")[owner]).otherwise(F.col("_owner")).alias("_owner"),
            F.when(new, content_key(F.col("_row.payload"))).otherwise(F.lower(F.hex("_key"))).alias("batch_key"),
        ).groupBy("_slot", "_owner", "batch_key")
        first = groups.agg(F.min("_row").alias("_row"), F.collect_set("_day").alias("_days")).where("_row is not null")
        fresh = first.select("_row.*", "batch_key", "_days").withColumn("day", F.to_date(ts))
        replayed = F.exists("_days", lambda d: d.between(F.col("day") - F.expr(f"interval {horizon_days} days"), F.col("day")))
        rows = fresh.where(~F.coalesce(replayed, F.lit(False))).drop("_days").withColumn("batch", F.lit(batch_id).cast("bigint"))

        def put(part: DataFrame, name: str) -> None:
            writer = part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("day", "batch").parquet(f"{path}/{name}")

        put(rows, "rows")
        # the keys are columns of what was just written
        written = ",".join([*days, "__HIVE_DEFAULT_PARTITION__"])
        put(_read(spark, schema, f"{path}/rows", f"/day={{{written}}}/batch={batch_id}"), "keys")

    return write


#: Buckets of keys that a snapshot table is cut into.
SNAPSHOT_BUCKETS = 64


def snapshot_writer(
    path: str, *, keys: list[str], ts: str = "timestamp", buckets: int = SNAPSHOT_BUCKETS
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: every key's rows are replaced by its newest snapshot; an older one that comes late changes nothing.

    The table is cut into buckets of keys, and each bucket has versions, one per batch that brought something newer for it. Such a batch
    writes the whole bucket anew under its own id and leaves all other buckets alone; readers take the last version of
    each (:func:`read_snapshots`). A retried batch overwrites its own versions and looks only at earlier ones.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        told = snapshots.latest_snapshot(batch, keys=keys, ts=ts).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        held = read_snapshots(spark, path, batch.schema, before=batch_id)
        newest = held.groupBy(*keys).agg(F.max(ts).alias("_held"))
        same = F.lit(True)
        for key in keys:
            same = same & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
        known = newest.withColumnsRenamed({k: f"_k_{k}" for k in keys})
        newer = told.join(known, same, "left").where(F.col("_held").isNull() | (F.col(ts) > F.col("_held"))).select(told.columns)
        # as many values as there are buckets, at most
        touched = [r._bucket for r in newer.select("_bucket").distinct().collect()]
        if not touched:
            return
        replaced = newer.select(*keys).distinct().withColumnsRenamed({k: f"_k_{k}" for k in keys})
        kept = held.where(F.col("_bucket").isin(touched)).join(replaced, same, "left_anti")
        rows = kept.unionByName(newer).withColumn("_version", F.lit(batch_id).cast("bigint"))
        writer = rows.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("_bucket", "_version").parquet(path)

    return write


def read_snapshots(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """The current rows of a snapshot table, as the batches had them, with their ``_bucket``; ``before`` a batch, if one is given."""
    names = [*schema.names, "_bucket"]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    rows = _read(spark, f"{ddl}, _bucket int, _version bigint", path)
    if before is not None:
        rows = rows.where(F.col("_version") < before)
    last = rows.groupBy("_bucket").agg(F.max("_version").alias("_version"))
    return rows.join(last, ["_bucket", "_version"], "left_semi").select(names)


def current_snapshot(history: DataFrame, *, keys: list[str], ts: str = "timestamp") -> DataFrame:
    """The table a reader of an append-only snapshot history sees: a late, older snapshot never wins."""
    return snapshots.latest_snapshot(history, keys=keys, ts=ts)
