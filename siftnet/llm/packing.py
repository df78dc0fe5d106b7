"""Conflict-constrained best-fit packing of texts into bins of a fixed number of words.

Items are packed longest first. The open bins of a shard are kept in order of their free room; from the smallest room that is large
enough, the search goes on to the next larger one until the bin is compatible: the tightest compatible bin takes the item, else a new one is
opened. A bin carries two bitmaps: the sources it holds and the duplicate clusters it holds. An item is compatible if neither its
source nor its cluster is in the bin.

Texts longer than a bin are cut into whole bins and a rest; nothing is left out or shortened. Items are dealt to shards of about
``SHARD_ITEMS`` by hash, so memory and search are bounded, and a source or cluster with a third of all items is spread evenly; the
price is one partly filled tail of bins per shard.

Rows and edge cases: texts that are null or without words are items of length 0 and still get a bin; a null source or cluster conflicts
with nothing; rows with a null doc_id are packed like others; repeated rows have equal texts, so they are of one cluster and go to
different bins.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftnet.session import checkpointed

CAPACITY, SHARD_ITEMS = 2048, 4096


def best_fit(lengths: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[int]:
    """Bin of each item, in the order given. Sources and clusters are bitmaps of their own bit, 0 for none."""
    rooms: list[tuple[int, int]] = []  # free room and bin, ascending
    held_sources: list[int] = []
    held_clusters: list[int] = []
    bins = []
    for length, source, cluster in zip(lengths, sources, clusters):
        at = bisect_left(rooms, (length, -1))
        while at < len(rooms) and (held_sources[rooms[at][1]] & source or held_clusters[rooms[at][1]] & cluster):
            at += 1
        if at < len(rooms):
            room, number = rooms.pop(at)
        else:
            room, number = capacity, len(held_sources)
            held_sources.append(0)
            held_clusters.append(0)
        held_sources[number] |= source
        held_clusters[number] |= cluster
        insort(rooms, (room - length, number))
        bins.append(number)
    return bins


def _bits(values: pd.Series, only_shared: bool) -> list[int]:
    """A bit per value, 0 for null; with ``only_shared`` none for values that occur once, as they meet no other."""
    counts = values.value_counts()
    numbers = {v: i for i, v in enumerate(counts[counts > 1].index if only_shared else counts.index)}
    return [1 << numbers[v] if v in numbers else 0 for v in values]


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("long")


def content_cluster(text: Column) -> Column:
    """Texts that are equal but for case and white space are one cluster; without words there is none."""
    plain = F.trim(F.regexp_replace(F.lower(text), "[\\x20\\x09-\\x0D]+", " "))
    return F.when(plain != "", F.xxhash64(plain))


def items_of(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, source, cluster, piece, n_words): texts as items of at most ``capacity`` words."""
    sized = docs.select("doc_id", "source", content_cluster(F.col("text")).alias("cluster"), word_count(F.col("text")).alias("total"))
    last = F.greatest(F.ceil(F.col("total") / capacity).cast("int") - 1, F.lit(0))
    pieces = sized.select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    return pieces.withColumn("n_words", F.least(F.col("total") - F.col("piece") * capacity, F.lit(capacity).cast("long"))).drop("total")


def pack(items: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(doc_id, piece, n_words, shard, bin) for items with columns doc_id, source, cluster, piece and n_words."""
    items = checkpointed(items)
    shards = max(1, -(-items.count() // shard_items))
    # repeated rows are dealt by their content too, so equal rows may share a shard; they conflict there
    shard = F.pmod(F.xxhash64("doc_id", "piece", "n_words", F.lit("shard")), F.lit(shards)).cast("int")

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_words", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        bins = best_fit(rows["n_words"].tolist(), _bits(rows["source"], False), _bits(rows["cluster"], True), capacity)
        return rows[["doc_id", "piece", "n_words", "shard"]].assign(bin=bins)

    dealt = items.withColumn("shard", shard)
    kind = dict(items.dtypes)["doc_id"]
    return dealt.groupBy("shard").applyInPandas(fill, f"doc_id {kind}, piece int, n_words long, shard int, bin long")
