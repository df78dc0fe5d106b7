"""The corpus pipeline: documents in, packed training bins out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftnet.llm import decontaminate, neardup, packing, substrings, toxicity
from siftnet.session import checkpointed


def _keeping_columns(docs: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``fn`` applied while all columns but doc_id and text have names that no operator uses; the columns of ``docs`` come back."""
    inner = {c: c if c in ("doc_id", "text") else f"_in{i}" for i, c in enumerate(docs.columns)}
    out = fn(docs.select(*[F.col(f"`{c}`").alias(inner[c]) if c != inner[c] else F.col(c) for c in docs.columns]))
    return out.select(*[F.col(inner[c]).alias(c) for c in docs.columns])


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer predicts to be toxic go. It learns from the labels that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return _keeping_columns(docs, lambda d: toxicity.toxic_passages(d, labels).where("predicted = 0"))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document with the smallest doc_id stays, and
    of rows that repeat a doc_id one. Rows without a doc_id stay."""
    dropped = neardup.near_duplicates(docs, shingle=5, percent=80).where("NOT kept").select("doc_id").distinct()
    named = docs.where("doc_id IS NOT NULL").join(dropped, "doc_id", "left_anti").dropDuplicates(["doc_id"])
    return named.select(docs.columns).unionByName(docs.where("doc_id IS NULL"))


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by a window of 50 that a smaller doc_id has are cut out; documents of which nothing is left go."""

    def cut(d: DataFrame) -> DataFrame:
        return substrings.remove_repeats(d, window=50).where("n_removed < n_words OR n_words = 0")

    left = _keeping_columns(docs, cut)
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in left.columns else left


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, whole or with up to a fifth of its words edited, go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return _keeping_columns(docs, lambda d: decontaminate.without_leaks(d, benchmark, free_end=True))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with the bin that each is packed into."""
    return packing.pack(packing.items_of(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", remove_toxic),
    ("near_dedup", remove_near_duplicates),
    ("substring_dedup", remove_repeated_passages),
    ("decontamination", remove_leaks),
    ("packing", pack),
]

#: Learned scores and hashing to shards have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each one's result written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
