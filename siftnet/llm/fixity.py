"""Fixity audit of archive replicas by Merkle trees.

An archive is a file of records, each at a byte offset. Its tree is built from hashes only: a leaf covers the records that begin in one
range of ``RANGE_BYTES`` bytes, in offset order; a node covers ``FAN`` neighbouring ranges of the level below; the root covers the
archive. Two replicas are compared root by root, and only below mismatching nodes are the nodes of the next level compared, down to
the ranges, whose records then tell what is corrupt, missing or extra. What is equal is read once, to hash it.

Ranges have a fixed size, so a lost or longer record changes its own range and no other as long as offsets are stored, as they
are in an archive's index. Nodes are keyed by (archive, range): a large archive is many groups, not one.

Rows and edge cases: records with a null archive or offset cannot be located and are left out; null content counts as empty; equal
rows count once; two different records of a replica at one offset are both part of the hash and are both reported; an archive that
one replica lacks is reported record by record; empty replicas are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftnet.session import checkpointed

RANGE_BYTES, FAN = 1 << 16, 16


def record_hashes(records: DataFrame) -> DataFrame:
    """(archive, offset, length, digest) of records with columns archive, offset and content."""
    content = F.coalesce(F.col("content").cast("binary"), F.lit(b""))
    located = records.where("archive IS NOT NULL AND offset IS NOT NULL")
    return located.select("archive", F.col("offset").cast("long").alias("offset"), F.octet_length(content).cast("long").alias("length"), F.sha2(content, 256).alias("digest")).distinct()


def _joined(parts: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(parts)), lambda p: F.concat_ws(":", *[p[f] for f in ("at", "length", "hash")])), "|")


def range_hashes(hashes: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(archive, node, hash) of the lowest level. A range holds at most range_bytes records of a byte or more."""
    node = F.floor(F.col("offset") / range_bytes).cast("long")
    parts = F.struct(F.col("offset").alias("at"), "length", F.col("digest").alias("hash"))
    return hashes.groupBy("archive", node.alias("node")).agg(F.sha2(_joined(parts), 256).alias("hash"))


def parents(nodes: DataFrame, fan: int = FAN) -> DataFrame:
    """The level above: the hash of at most ``fan`` children in order."""
    parts = F.struct(F.col("node").alias("at"), F.lit(0).alias("length"), "hash")
    return nodes.groupBy("archive", F.floor(F.col("node") / fan).cast("long").alias("node")).agg(F.sha2(_joined(parts), 256).alias("hash"))


def tree(hashes: DataFrame, levels: int, range_bytes: int = RANGE_BYTES, fan: int = FAN) -> list[DataFrame]:
    """Levels from the ranges up."""
    found = [checkpointed(range_hashes(hashes, range_bytes))]
    for _ in range(levels):
        found.append(checkpointed(parents(found[-1], fan)))
    return found


def _levels(*replicas: DataFrame, range_bytes: int, fan: int) -> int:
    """Levels above the ranges until node 0 covers every offset."""
    last = max([r.agg(F.max("offset")).first()[0] or 0 for r in replicas])
    levels, covered = 0, range_bytes
    while covered <= last:
        covered, levels = covered * fan, levels + 1
    return levels


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(archive, node) whose hashes differ or that only one side has."""
    left, right = a.withColumnRenamed("hash", "hash_a"), b.withColumnRenamed("hash", "hash_b")
    return left.join(right, ["archive", "node"], "full").where(~F.col("hash_a").eqNullSafe(F.col("hash_b"))).select("archive", "node")


def audit(a: DataFrame, b: DataFrame, range_bytes: int = RANGE_BYTES, fan: int = FAN) -> DataFrame:
    """Records in which replica ``b`` differs from ``a``: archive, offset, kind (corrupt, missing, extra), length and digest in each."""
    hashes = [checkpointed(record_hashes(r)) for r in (a, b)]
    levels = _levels(*hashes, range_bytes=range_bytes, fan=fan)
    left, right = (tree(h, levels, range_bytes, fan) for h in hashes)
    suspects = _differing(left[levels], right[levels])
    for level in range(levels - 1, -1, -1):
        up = suspects.select("archive", F.col("node").alias("up"))
        below = [
            side[level].withColumn("up", F.floor(F.col("node") / fan).cast("long")).join(up, ["archive", "up"], "left_semi").drop("up")
            for side in (left, right)
        ]
        suspects = checkpointed(_differing(*below))
    node = F.floor(F.col("offset") / range_bytes).cast("long")
    rows = [h.withColumn("node", node).join(suspects, ["archive", "node"], "left_semi").drop("node") for h in hashes]
    mine = rows[0].select("archive", "offset", F.col("length").alias("length_a"), F.col("digest").alias("digest_a"))
    other = rows[1].select("archive", "offset", F.col("length").alias("length_b"), F.col("digest").alias("digest_b"))
    both = mine.join(other, ["archive", "offset"], "full").where(~F.col("digest_a").eqNullSafe(F.col("digest_b")))
    kind = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra").otherwise("corrupt")
    return both.withColumn("kind", kind)
